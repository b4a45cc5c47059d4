from pagemill.functions import robots, text, urls
from pagemill.operators import content, geo, graph, rules, scoring, site_rules
from pyspark.sql import functions as F

HOME = "https://x.example/"


def found(df):
    return sorted((r["rule_id"], r["url"]) for r in df.collect())


def page(n, path="/", **k):
    base = dict(page_id=n, site_id="s", ord=n, url="https://x.example" + path, status=200, title="A title of usual length", lang="en", viewport="width=device-width", word_count=500)
    return base | k


def test_catalogue_is_complete():
    assert len(rules.CATALOG) == 69 == len(rules.BY_ID)
    assert list(rules.page_rules_ids()) == [r for r in rules.page_rules_ids() if r in rules.BY_ID]


def test_page_rules_ids_match_expressions(spark):
    assert list(rules.page_rules()) == rules.page_rules_ids()


def test_nulls_everywhere_and_repeated_rows(spark, page_table):
    blank = {"page_id": 1, "site_id": "s", "url": None}
    assert rules.page_findings(page_table([blank, blank])).count() == 0
    rows = [page(1, title=None), page(1, title=None), page(2, "/b", title="short")]
    got = [x for x in found(rules.page_findings(page_table(rows))) if x[0].startswith("meta-title")]
    assert got == [("meta-title-length", "/b"), ("meta-title-missing", "/")]
    assert rules.page_findings(page_table([])).count() == 0


def test_clashing_extra_columns_do_not_matter(spark, page_table):
    t = page_table([page(1, title="")]).withColumns({"ok": F.lit("x"), "path": F.lit("y"), "noindex": F.lit(3)})
    assert ("meta-title-missing", "/") in found(rules.page_findings(t))


def test_shared_titles(spark, page_table):
    rows = [page(1, "/1", title=" Same "), page(2, "/2", title="same"), page(2, "/2", title="same"), page(3, "/3", title="same", meta_robots="noindex"), page(4, "/4", title="")]
    assert found(rules.shared_values(page_table(rows), "title", "r")) == [("r", "/1"), ("r", "/2")]


def test_special_page_rules(spark, page_table):
    rows = [
        page(1, "/skip", headings=[(1, "a"), (3, "b")]),
        page(2, "/shell", word_count=3, html='<div id="root"></div><script src="a.js"></script>'),
        page(3, "/soft", word_count=20, title="Page not found"),
        page(4, "/links", links=[("http:/x.example/a", False, "x", False), ("/ok", True, "Here", False)]),
        page(5, "/schema", json_ld=['{"@type":"Product","name":"n"}', '{"@graph":[{"@type":"Event","name":"e"}]}', "[1", '[{"@type":"Review"}]']),
        page(6, "/a_b", og={"og:image": "/relative.png"}),
        page(7, "/two", html='<head><link rel="canonical" href="a"><link rel=canonical href="b"><meta http-equiv="refresh"></head>'),
    ]
    got = {(r.rule_id, r.url): r.note for r in rules.page_findings(page_table(rows)).collect()}
    assert ("structure-heading-skip", "/skip") in got and ("framework-js-only-content", "/shell") in got and ("indexing-soft-404", "/soft") in got
    assert got["link-malformed", "/links"] == "1 one slash" and got["link-generic-anchors", "/links"] == "1"
    assert got["schema-invalid", "/schema"].split("; ") == ["Product missing one of offers/review/aggregateRating", "Event missing startDate, location", "Review missing author, reviewRating"]
    assert got["structure-url-format", "/a_b"] == "underscore" and got["meta-og-image-url", "/a_b"] == "relative URL"
    assert got["indexing-canonical-multiple", "/two"] == "2" and ("indexing-meta-refresh", "/two") in got


def test_header_scope_is_sticky(spark):
    df = spark.createDataFrame([("noindex",), ("bingbot: noindex, nofollow",), ("bingbot: noindex, googlebot: none",), ("max-snippet: 5, noindex",), (None,)], "h string")
    assert [r[0] for r in df.select(text.header_noindex(F.col("h"))).collect()] == [True, False, True, True, False]


def test_urls(spark):
    df = spark.createDataFrame([("HTTPS://Www.X.example/A/b//?q#f",), ("https://x.example",), ("mailto:a@b",), ("",), (None,)], "u string")
    got = [tuple(r) for r in df.select(urls.page_key(F.col("u")), urls.path(F.col("u")), urls.bare_host(F.col("u"))).collect()]
    assert got == [("https://www.x.example/A/b", "/A/b", "x.example"), ("https://x.example/", "/", "x.example"), (None, None, None), (None, None, None), (None, None, None)]
    refs = ["/a", "//c.example/d", "?z=1", "#top", "../up", "./same", "next", "http://o.example/p"]
    base = F.lit("https://x.example/dir/page?x#y")
    made = [r[0] for r in spark.createDataFrame([(r,) for r in refs], "h string").select(urls.resolve(F.col("h"), base)).collect()]
    assert made == [
        "https://x.example/a", "https://c.example/d", "https://x.example/dir/page?z=1", "https://x.example/dir/page?x", "https://x.example/up",
        "https://x.example/dir/same", "https://x.example/dir/next", "http://o.example/p",
    ]


def test_robots(spark, site_table):
    txt = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: Googlebot\nAllow: /private/open\nDisallow: /private\nNoindex: /x\nDisalow: /y\nstray\n\nUser-agent: *\nContent-Signal: search=yes, ai-train=no\nDisallow:\n# end"
    sites = site_table([{"site_id": "s", "start_url": HOME, "robots_txt": txt}, {"site_id": "t", "start_url": HOME}])
    blocked = {(r.site_id, r.bot) for r in robots.root_access(sites).where("not allowed").collect()}
    assert blocked == {("s", "GPTBot"), ("s", "CCBot")}
    targets = spark.createDataFrame([("s", 1, "/private/a"), ("s", 2, "/private/open/x"), ("s", 3, "/"), ("t", 4, "/private")], "site_id string, page_id bigint, target string")
    assert [r.page_id for r in robots.blocked_paths(sites, targets).collect()] == [1]
    assert {(r.signal, r.value) for r in robots.content_signals(sites).collect()} == {("search", "yes"), ("ai-train", "no")}
    assert [r.note for r in site_rules.robots_format(sites).collect()] == ["4"]
    patterns = [("/a*b", "/axxb1", True), ("/*.pdf$", "/a.pdf", True), ("/*.pdf$", "/a.pdf?x", False), ("/x$", "/x", True), ("/x$", "/xy", False), ("/a.c", "/abc", False)]
    df = spark.createDataFrame(patterns, "p string, t string, want boolean")
    assert df.where(robots.matches(F.col("p"), F.col("t")) != F.col("want")).count() == 0


def test_cross_page_rules(spark, page_table, site_table):
    sites = site_table([{"site_id": "s", "start_url": HOME, "has_sitemap": True}])
    rows = [
        page(1, "/", hreflang=[("en", "https://x.example/"), ("fr", "https://x.example/fr"), ("en-UK", "https://x.example/uk")]),
        page(2, "/fr", hreflang=[("fr", "https://x.example/fr"), ("en", "https://x.example/")], meta_robots="noindex"),
        page(3, "/gone", status=404), page(4, "/c", canonical="/gone"), page(5, "/login", x_robots_tag="noindex"),
        page(6, "/landed", redirected_from=["https://x.example/old"]), page(7, "/uk"),
    ]
    pages = page_table(rows)
    listed = spark.createDataFrame([("s", "https://x.example/gone"), ("s", "https://x.example/old"), ("s", "/rel"), ("s", "https://o.example/"), ("s", "https://x.example/")], "site_id string, url string")
    assert found(site_rules.canonical_findings(pages, sites)) == [("indexing-canonical-mismatch", "/c"), ("indexing-canonical-target-invalid", "/c")]
    assert found(site_rules.noindex_findings(pages, sites, listed)) == [("indexing-noindex", "/fr"), ("indexing-noindex-utility", "/login")]
    notes = {(r.rule_id, r.url): r.note for r in site_rules.sitemap_findings(pages, sites, listed).collect()}
    assert notes["indexing-sitemap-hygiene", "https://x.example/gone"] == "HTTP 404" and notes["indexing-sitemap-hygiene", "https://x.example/old"] == "redirect"
    assert notes["indexing-sitemap-hygiene", "/rel"] == "not absolute" and notes["indexing-sitemap-hygiene", "https://o.example/"] == "other origin"
    assert {u for r, u in notes if r == "indexing-sitemap-gaps"} == {"/landed", "/uk"}
    lang = {r.url: r.note for r in site_rules.hreflang_findings(pages).collect()}
    assert lang == {"/": "no return link; noindex; uk"}


def test_probes(spark, site_table):
    sites = site_table([{"site_id": "s", "start_url": "https://www.x.example/"}])
    schema = "site_id string, kind string, url string, status int, redirects int, hops array<int>, final_url string, bytes bigint, content_type string, insecure boolean, probed_at timestamp"
    rows = [
        ("s", "image", "https://x.example/a.jpg", 200, 0, [], None, 150_000, "image/jpeg", True, None), ("s", "image", "https://x.example/a.jpg", 200, 0, [], None, 150_000, "image/jpeg", True, None),
        ("s", "image", "https://x.example/b.webp", 200, 0, [], None, 400_000, "image/webp", False, None), ("s", "link", "https://x.example/l", 0, 2, [301, 302], "https://x.example/m", None, None, False, None),
        ("s", "link", "https://x.example/w", 200, 1, [302], "https://x.example/login", None, None, False, None), ("s", "asset", "https://x.example/c.css", 500, 0, None, None, None, None, None, None),
    ]
    assert found(site_rules.probe_findings(spark.createDataFrame(rows, schema), sites)) == [
        ("img-legacy-format", "https://x.example/a.jpg"), ("indexing-redirect-chain", "https://x.example/l"), ("indexing-temporary-redirect", "https://x.example/l"),
        ("perf-broken-assets", "https://x.example/c.css"), ("perf-mixed-content", "https://x.example/a.jpg"),
    ]


def test_graph(spark, page_table, site_table):
    link = lambda h: (h, True, "a", False)
    rows = [page(1, "/", links=[link("/a"), link("/a"), link("/"), link("/none")]), page(2, "/a", links=[link("/b"), link("https://x.example/")]), page(3, "/b", status=500), page(4, "/lone", links=None)]
    pages, sites = page_table(rows), site_table([{"site_id": "s", "start_url": HOME}])
    assert sorted((r.src, r.dst) for r in graph.edges(pages).collect()) == [("/", "/a"), ("/a", "/"), ("/a", "/b")]
    assert [r.path for r in graph.orphans(pages, sites).collect()] == ["/lone"]
    assert [(r.src, r.status) for r in graph.broken(pages).collect()] == [("/a", 500)]
    starts = spark.createDataFrame([("s", "/")], "site_id string, node string")
    assert sorted((r.node, r.depth) for r in graph.click_depth(graph.edges(pages), starts).collect()) == [("/", 0), ("/a", 1), ("/b", 2)]
    nodes = graph.nodes(pages).selectExpr("site_id", "path as node")
    ranks = {r.node: r["rank"] for r in graph.page_rank(nodes, graph.edges(pages), 10).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["/a"] > ranks["/lone"]


def brute_leaders(n, pairs):
    near = {(min(p), max(p)) for p in pairs}
    lead = {}
    for i in range(n):
        if i in lead:
            continue
        lead[i] = i
        for j in range(i + 1, n):
            if j not in lead and (i, j) in near:
                lead[j] = i
    return lead


def test_leaders_equal_one_pass_in_order(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        n, pairs = 14, {tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)}
        v = spark.createDataFrame([("s", i) for i in range(n)], "site_id string, id int")
        p = spark.createDataFrame([("s", a, b) for a, b in pairs], "site_id string, a int, b int")
        assert {r.id: r.leader for r in content.leaders(v, p).collect()} == brute_leaders(n, pairs)


def test_duplicate_clusters(spark, page_table):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [page(1, "/1", text_content=body), page(2, "/2", text_content=body + " tail"), page(3, "/3", text_content=body), page(4, "/4", text_content="other words here"), page(5, "/5", text_content=None)]
    got = {r.page_id: r.leader_id for r in content.duplicate_clusters(page_table(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_scores_stay_in_bounds(spark):
    rows = [("s", r.id, str(i), None) for i in range(50) for r in rules.CATALOG]
    issues = scoring.issues(spark.createDataFrame(rows, "site_id string, rule_id string, url string, note string"))
    assert issues.where("rule_id = 'schema-invalid'").first().affected == 40
    ok = spark.createDataFrame([("s", 50), ("empty", 3)], "site_id string, pages bigint")
    scores = scoring.category_scores(issues, ok)
    assert scores.count() == 16 and scores.where("score < 0 or score > 100").count() == 0
    grades = {r.site_id: (r.overall, r.grade) for r in scoring.overall(scores).collect()}
    assert grades["empty"] == (100, "A") and grades["s"][1] == "F"


def test_readiness(spark, page_table, site_table):
    sites = site_table([{"site_id": "s", "start_url": HOME, "robots_txt": "User-agent: PerplexityBot\nDisallow: /", "has_llms_txt": True, "llms_txt": "# Site\n[a](/b)"}])
    pages = page_table([page(1, headings=[(2, "How does it work?"), (3, "Why us")], text_content="5 % of 20 users", meta_description="d" * 60, json_ld=['{"@type":"Organization"}'])])
    got = {r.check_id: r.status for r in geo.checks(pages, sites).collect()}
    assert got["geo-ai-search-bots"] == "fail" and got["geo-llms-txt"] == "pass" and got["geo-question-headings"] == "pass" and got["geo-entity"] == "warn"
    assert got["geo-facts"] == "pass" and got["geo-summaries"] == "pass" and "geo-content-signals" not in got
    assert geo.score(geo.checks(pages, sites)).first().score == 62
    lines = [r.line for r in geo.llms_lines(pages, sites).orderBy("ord").collect()]
    assert lines[0] == "# x.example" and lines[-1].startswith("- [A title of usual length](https://x.example/)")
