"""Registered queries keep whole pages: no cap on rows or texts of a page."""

from pagemill.plans import entry


def test_queries_keep_whole_pages(spark, page_table, tmp_path):
    html = "".join(f'<h2>h{i}</h2><img src="{i}.png"><a href="/{i}">{"x" * 150}</a>' for i in range(310))
    late = "<p>" + "word " * 50_000 + '<meta http-equiv="refresh" content="0">'
    make = lambda n, **more: dict(page_id=n, site_id="s", ord=n, url=f"https://x.example/{n}", status=200, **more)
    rows = [make(1, html=html, title="t" * 250, meta_description="d" * 350, h1s=["h" * 250]), make(2, html=late)]
    folder = str(tmp_path)
    page_table(rows).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    query = entry.queries()
    links = query["extract_links"](spark, folder).collect()
    assert len(links) == 310 and {len(r.anchor) for r in links} == {150}
    assert query["extract_headings"](spark, folder).count() == query["extract_images"](spark, folder).count() == 310
    state = {r.path: r for r in query["crawl_state"](spark, folder).collect()}["/1"]
    assert (len(state.title), len(state.description), len(state.h1)) == (250, 350, 250)
    assert [r.url for r in query["rule_indexing_meta_refresh"](spark, folder).collect()] == ["/2"]


def test_issues_count_every_affected_page(spark, page_table, tmp_path):
    rows = [dict(page_id=n, site_id="s", ord=n, url=f"https://x.example/p{n}", status=200, json_ld=['{"@type":"Review"}']) for n in range(90)]
    page_table(rows).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.rule_id: r.affected for r in entry.queries()["page_issues"](spark, str(tmp_path)).collect()}
    assert got["schema-invalid"] == 90
