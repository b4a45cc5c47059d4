import numpy as np
from pyspark.sql import functions as F

from pagemill.operators import extract, retrieval, sinks, vitals
from pagemill.sources import site_texts
from pagemill.streaming import events


def test_extraction(spark):
    html = (
        '<html lang="de"><head><title>A &amp; B &#252;</title><meta name="description" content="d"><meta property="og:Image" content="i.png">'
        '<link rel="canonical" href="/c"><link rel="alternate" hreflang="en" href="/en"><script src="a.js"></script><script async src="b.js"></script></head>'
        '<body><h1>One <b>two</b></h1><h2></h2><p>three&nbsp;four</p><script>no</script><img src="x.png" width="5"><a href="/in" rel="nofollow">In</a><a href="#f">F</a><a href="mailto:x">m</a>'
        '<script type="application/ld+json">{"@type":"Thing"}</script><script type="application/ld+json">{bad</script></body></html>'
    )
    rows = [(1, "https://x.example/", html), (2, "https://x.example/", None), (3, None, ""), (4, "https://x.example/", "<p>" + "word " * 5000)]
    got = {r.page_id: r for r in extract.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    one = got[1]
    assert (one.title, one.meta_description, one.canonical, one.lang, one.word_count) == ("A & B ü", "d", "/c", "de", 7)
    assert one.og == {"og:image": "i.png"} and [tuple(h) for h in one.headings] == [(1, "One two")] and one.images_missing_dims == 1
    assert [(x.href, x.internal, x.nofollow) for x in one.links] == [("/in", True, True)] and one.json_ld == ['{"@type":"Thing"}'] and one.render_blocking.scripts == 1
    assert got[2].title is None and got[3].word_count == 0 and got[4].word_count == 5000 and len(got[4].text_content) == 12_000


def test_sources(spark, site_table):
    xml = "<urlset><url><loc> https://x.example/a?b=1&amp;c=2 </loc></url><url><loc><![CDATA[https://x.example/d]]></loc></url></urlset>"
    files = spark.createDataFrame([("s", "f", xml), ("s", "i", "<sitemapindex><loc>https://x.example/f</loc></sitemapindex>"), ("s", "n", None)], "site_id string, file string, xml string")
    got = site_texts.sitemap_entries(files)
    assert sorted((r.kind, r.url) for r in got.collect()) == [("index", "https://x.example/f"), ("urlset", "https://x.example/a?b=1&c=2"), ("urlset", "https://x.example/d")]
    assert site_texts.first_of_each(got, 1).count() == 1
    sites = site_table([{"site_id": "s", "start_url": "https://x.example/", "robots_txt": "SITEMAP: /map.xml\nsitemap: https://x.example/map.xml"}])
    assert [r.url for r in site_texts.declared_sitemaps(sites).collect()] == ["https://x.example/map.xml"]


def test_vitals(spark):
    df = spark.createDataFrame([("s", 900.0), ("s", 700.0), ("t", None)], "site_id string, v double")
    assert [tuple(r) for r in vitals.measure(df, ["site_id"], "v", "experimental_time_to_first_byte").collect()] == [("s", "experimental_time_to_first_byte", 850.0, "needs-improvement")]
    url = spark.createDataFrame([("s", "largest_contentful_paint", 5000.0)], "site_id string, metric string, p75 double")
    origin = spark.createDataFrame([("s", "largest_contentful_paint", 1.0), ("s", "interaction_to_next_paint", 150.0)], "site_id string, metric string, p75 double")
    got = vitals.with_fallback(url, origin, ["site_id"], origin.select("site_id", "metric"))
    assert {r.metric: r.rating for r in got.collect()} == {"largest_contentful_paint": "poor", "interaction_to_next_paint": "good"}
    assert vitals.findings(got).first().note == "high"


def test_vectors(spark):
    v = retrieval.embed("images and photos of the canonical link")
    assert abs(np.linalg.norm(v) - 1) < 1e-9 and not retrieval.embed("").any() and not retrieval.embed(None).any()
    assert retrieval.embed("picture").dot(retrieval.embed("photo")) > 0.5 > retrieval.embed("picture").dot(retrieval.embed("robots"))
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(999, None), (None, data[0].tolist())], "id bigint, v array<float>")
    got = retrieval.nearest(rows, rows.where("id % 20 = 0"), "id", "v", 3).collect()
    assert len(got) == 45
    for q in range(0, 300, 20):
        scores = (data.astype(float) @ data[q].astype(float)).round(6)
        scores[q] = -99
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == np.argsort(-scores, kind="stable")[:3].tolist()
    assert retrieval.nearest(rows.where("id < 0"), rows.where("id < 0"), "id", "v", 3).count() == 0


def test_reports(spark):
    schema = "site_id string, rule_id string, category string, impact string, affected bigint"
    df = spark.createDataFrame([("s", "a<b", "c", "low", 9), ("s", "z", "c", "critical", 1)], schema)
    assert sinks.issue_markdown(df).first().body.split("\n")[2] == "| critical | z | 1 |"
    assert "<li>a&lt;b (low): 9</li>" in sinks.issue_html(df).first().body and sinks.issue_json(df).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 30 as event_id", "timestamp'2025-01-01' + make_interval(0,0,0,0,id % 30) as ts", "'k' as event_type", "1.0D as value")
    folder = str(tmp_path)
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    got = events.run_windows(spark, folder)
    assert got.exceptAll(events.windowed(spark.read.parquet(f"{folder}/events.parquet"))).count() == 0 and got.agg(F.sum("n")).first()[0] == 30


def test_watch(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert events.watch(spark, a, str(tmp_path / "b"), ["k"]) is None
    assert events.watch(spark, a, str(tmp_path / "b"), ["k"]).count() == 0
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert [tuple(r) for r in events.watch(spark, b, str(tmp_path / "b"), ["k"]).collect()] == [(2, "z")]


def test_fix_templates(spark):
    from pagemill.operators import fixes, rules

    df = fixes.templates(spark)
    assert df.count() == len(fixes.LINES) * len(fixes.FILES) and set(fixes.LINES) <= set(rules.BY_ID)
    assert fixes.patch("framework-robots-no-sitemap", "nextjs", "https://x.example").splitlines()[-1] == "+Sitemap: https://x.example/sitemap.xml"
    assert fixes.patch("schema-missing", None, "https://x.example").count('{"@context"') == 1 and fixes.patch("img-broken", "nuxt") is None


def test_link_opportunities(spark, page_table):
    text = "canonical link robots sitemap schema title "
    make = lambda n, path, body: dict(page_id=n, site_id="s", ord=n, url="https://x.example" + path, status=200, title=path, text_content=body)
    pages = page_table([make(20, "/a", text * 3), make(21, "/b", text * 4), make(22, "/c", text * 5), make(23, "/d", text * 6), make(24, "/e", "unlike words entirely")])
    edges = spark.createDataFrame([("s", "/a", "/b")], "site_id string, src string, dst string")
    clusters = spark.createDataFrame([("s", 20, 20), ("s", 22, 20)], "site_id string, page_id bigint, leader_id bigint")
    got = retrieval.link_opportunities(pages, edges, clusters).collect()
    assert [(r.url, r.note.split()[0]) for r in got] == [("/a", "/d")]


def test_crawl_state_and_hosts(spark, page_table, site_table):
    from pagemill.operators import site_rules, snapshot_diff

    rows = [
        dict(page_id=1, site_id="s", ord=2, url="https://x.example/new", requested_url="https://x.example/old", redirected_from=["https://x.example/old"], status=200, title="t" * 500),
        dict(page_id=2, site_id="s", ord=1, url="https://x.example/a/", status=404, meta_robots="none"), dict(page_id=3, site_id="s", ord=3, url="https://x.example/a", status=200), dict(page_id=4, site_id="s", url=None),
    ]
    got = {r.path: r for r in snapshot_diff.state_of(page_table(rows), "x").collect()}
    assert set(got) == {"/old", "/a"} and got["/old"].redirected_to == "/new" and len(got["/old"].title) == 200 and got["/a"].status == 404 and got["/a"].noindex_meta
    schema = "site_id string, kind string, url string, status int, final_url string, canonical string"
    variants = spark.createDataFrame([("s", "twin", "u", 200, "https://www.x.example/", None), ("s", "twin", "u", 200, "https://www.x.example/", "https://x.example/"), ("s", "http", "u", 200, "http://x.example/", None), ("s", "twin", "u", 500, "https://z.example/", None)], schema)
    sites = site_table([{"site_id": "s", "start_url": "https://x.example/", "has_sitemap": True}])
    assert sorted(r.rule_id for r in site_rules.host_findings(variants, sites).collect()) == ["indexing-host-duplicate", "indexing-http-not-redirected"]
    files = spark.createDataFrame([("s", "/map.xml", "HTTP 500"), ("s", "/ok.xml", None), ("t", "/x", "bad")], "site_id string, file string, error string")
    assert [r.url for r in site_rules.sitemap_file_findings(files, sites).collect()] == ["/map.xml"]


def test_link_opportunities_filter_before_the_best(spark, page_table):
    """Brute force over several sites, with linked pages and a cluster of more than ten copies among the nearest."""
    rng = np.random.default_rng(3)
    pool = "canonical robots sitemap schema title heading image speed anchor crawl mobile locale budget cache header".split()
    body = lambda: " ".join(rng.choice(pool, 40))
    copies = body()
    rows = []
    for n in range(100, 220):
        site = "abc"[n % 3]
        # Fourteen copies of query 120 stand on its own site, and copies of it on the others.
        text = copies if n == 120 or n % 3 != 0 and n < 150 or n in range(123, 165, 3) else body()
        rows.append(dict(page_id=n, site_id=site, ord=n, url=f"https://{site}.example/{n}", status=200, title="t", text_content=text))
    site = {r["page_id"]: r["site_id"] for r in rows}
    vector = {r["page_id"]: retrieval.embed(f"t  {r['text_content']}").astype(np.float32).astype(float) for r in rows}
    copy = {r["page_id"]: r["text_content"] == copies and r["site_id"] == "a" for r in rows}
    links = [(site[x], f"/{x}", f"/{y}") for x in vector for y in vector if x % 20 == 0 and site[x] == site[y] and x < y < x + 30]
    edges = spark.createDataFrame(links, "site_id string, src string, dst string")
    clusters = spark.createDataFrame([(site[p], p, 120) for p in vector if copy[p]], "site_id string, page_id bigint, leader_id bigint")
    want, near = set(), {}
    for x in (p for p in vector if p % 20 == 0):
        scored = sorted((-round(float(vector[x] @ vector[y]), 6), y) for y in vector if y != x and site[y] == site[x])
        near[x] = [y for s, y in scored if s <= -0.55][:2]
        free = [y for s, y in scored if s <= -0.55 and (site[x], f"/{x}", f"/{y}") not in links and not (copy[x] and copy[y])]
        want |= {(site[x], f"/{x}", f"/{y}") for y in free[:2]}
    got = retrieval.link_opportunities(page_table(rows), edges, clusters).collect()
    assert {(r.site_id, r.url, r.note.split()[0]) for r in got} == want and len([w for w in want if w[1] == "/120"]) == 2
    found = {(r.query_id, r.page_id) for r in retrieval.related_pages(page_table(rows)).collect()}
    assert found == {(x, y) for x, ys in near.items() for y in ys}
