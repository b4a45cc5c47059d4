"""Queries of the core and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import robots, text, urls
from pagemill.operators import content, diff_report, extract, fixes, geo, graph, retrieval, rules, scoring, sinks, site_rules, snapshot_diff, vitals
from pagemill.session import cut, tune
from pagemill.sources import site_texts
from pagemill.sources.tables import table
from pagemill.streaming import events

Query = Callable[[SparkSession, str], DataFrame]


def _on(*names: str, call: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return call(*(table(spark, folder, n) for n in names))

    return run


def _home(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    return site_files.select("site_id", urls.path(F.col("start_url")).alias("node"))


def _depths(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    return graph.click_depth(graph.edges(pages), _home(pages, site_files)).select("site_id", F.col("node").alias("path"), F.col("depth").cast("bigint").alias("depth"))


def _event_edges(ev: DataFrame) -> DataFrame:
    """Links of one graph from the events: a user to the user of the next event of that type and hour."""
    w = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    pairs = ev.select(F.lit("all").alias("site_id"), F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return pairs.where("dst is not null and src <> dst").distinct()


def _event_rank(ev: DataFrame) -> DataFrame:
    links = _event_edges(ev)
    nodes = links.select("site_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    ranked = graph.page_rank(nodes, links)
    return ranked.select(F.col("node").alias("user_id"), F.round("rank", 6).alias("page_rank"))


def _page_rank(pages: DataFrame) -> DataFrame:
    nodes = graph.nodes(pages).select("site_id", F.col("path").alias("node"))
    return graph.page_rank(nodes, graph.edges(pages)).select("site_id", F.col("node").alias("path"), F.round("rank", 6).alias("page_rank"))


def all_findings(
    pages: DataFrame, site_files: DataFrame, sitemap: DataFrame, probes: DataFrame, clusters: bool = True,
    sitemap_files: DataFrame | None = None, field: DataFrame | None = None, opportunities: bool = False,
) -> DataFrame:
    """(site_id, rule_id, url, note) of every rule that the tables can decide.

    ``sitemap_files`` (site_id, file, error) and ``field`` (site_id, metric, p75, rating) add the rules that read them;
    ``opportunities`` adds suggestions of links, whose queries are the pages with page_id divisible by 20.
    """
    cols = ["site_id", "rule_id", "url", "note"]
    parts = _findings(pages, site_files, sitemap, probes, clusters, sitemap_files, field, opportunities)
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def _findings(
    pages: DataFrame, site_files: DataFrame, sitemap: DataFrame, probes: DataFrame, clusters: bool = True,
    sitemap_files: DataFrame | None = None, field: DataFrame | None = None, opportunities: bool = False,
) -> Iterator[DataFrame]:
    """The frames of ``all_findings``, each made when it is asked for, since some run jobs for it."""
    # What takes most disk comes first.
    if opportunities:
        yield _opportunities(pages)
    if clusters:
        yield content.duplicate_findings(pages)
    yield content.content_findings(pages)
    yield rules.page_findings(pages)
    # Rules over several pages share one narrow table, written once.
    slim = cut(pages.select(*_SLIM))
    yield rules.shared_values(slim, "title", "meta-title-duplicate")
    yield rules.shared_values(slim, "meta_description", "meta-description-duplicate")
    yield site_rules.site_findings(site_files)
    yield site_rules.robots_format(site_files)
    yield site_rules.robots_blocks(site_files, slim)
    yield site_rules.probe_findings(probes, site_files)
    yield site_rules.canonical_findings(slim, site_files)
    yield site_rules.noindex_findings(slim, site_files, sitemap)
    yield site_rules.sitemap_findings(slim, site_files, sitemap)
    yield site_rules.hreflang_findings(slim)
    yield site_rules.home_schema(slim, site_files)
    yield graph.link_findings(slim, site_files)
    yield _host_rules(probes, site_files)
    if sitemap_files is not None:
        yield site_rules.sitemap_file_findings(sitemap_files, site_files)
    if field is not None:
        yield vitals.findings(field)


#: Columns that rules over several pages read; the html and the text are read where they are needed only.
_SLIM = (
    "page_id site_id ord url requested_url redirected_from status title meta_description canonical meta_robots meta_googlebot x_robots_tag h1s links hreflang json_ld word_count depth discovered_via"
).split()


def _full_audit(pages: DataFrame, site_files: DataFrame, sitemap: DataFrame, probes: DataFrame) -> DataFrame:
    return scoring.issues_of(_findings(pages, site_files, sitemap, probes), {})


def _audit(*tables: DataFrame) -> DataFrame:
    """The issues of a whole audit, written once, since scores read them more than once."""
    return cut(_full_audit(*tables))


def _scores(pages: DataFrame, site_files: DataFrame, sitemap: DataFrame, probes: DataFrame) -> DataFrame:
    return scoring.category_scores(_audit(pages, site_files, sitemap, probes), _ok_pages(pages))


def _text(pages: DataFrame, *others: DataFrame) -> DataFrame:
    found = _audit(pages, *others)
    return sinks.issue_text(found, scoring.overall(scoring.category_scores(found, _ok_pages(pages))))


def _ok_pages(pages: DataFrame) -> DataFrame:
    return pages.where("status between 200 and 299").groupBy("site_id").agg(F.count_distinct("page_id").alias("pages"))


def _cheap_issues(pages: DataFrame) -> DataFrame:
    return scoring.issues(rules.page_findings(pages), {})


def _event_vitals(ev: DataFrame) -> DataFrame:
    return vitals.measure(ev, ["event_type"], "value", "interaction_to_next_paint")


def _url_parts(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.page_key(u).alias("page_key"), urls.without_fragment(u).alias("no_fragment"), urls.is_utility(urls.path(u)).alias("utility")).distinct()


def _ease(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", text.reading_ease(F.col("text_content")).alias("ease")).distinct()


def _hash(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", text.fnv1a(F.regexp_replace("url", "[^ -~]", "")).alias("fnv")).distinct()


def _fields(field: str) -> Query:
    return _on("pages", call=lambda p: extract.extracted(p, extract.WHOLE).select("page_id", field).distinct())


def _headings(pages: DataFrame) -> DataFrame:
    return extract.extracted(pages, extract.WHOLE).select("page_id", F.posexplode("headings").alias("pos", "h")).select("page_id", "pos", "h.level", "h.text").distinct()


def _links(pages: DataFrame) -> DataFrame:
    return extract.extracted(pages, extract.WHOLE).select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "l.href", "l.internal", "l.anchor").distinct()


def _images(pages: DataFrame) -> DataFrame:
    return extract.extracted(pages, extract.WHOLE).select("page_id", F.posexplode("images").alias("pos", "i")).select("page_id", "pos", "i.src", "i.alt", "i.width", "i.height").distinct()


def _rule(rule: str) -> Query:
    return _on("pages", call=lambda p: rules.page_findings(p, [rule]))


def _top_vectors(vectors: DataFrame) -> DataFrame:
    found = retrieval.nearest(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "vec_id", (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


def _search(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """For pages whose id is divisible by 20, the four nearest documents to the title; at least 0.18."""
    corpus = retrieval.embedded(documents, "doc_id", "text")
    asked = retrieval.embedded(pages.where("page_id % 20 = 0 and title <> ''").select(F.col("page_id").alias("doc_id"), "title").distinct(), "doc_id", "title")
    return retrieval.nearest(corpus, asked, "doc_id", "vector", 4, 0.18)


def _opportunities(pages: DataFrame) -> DataFrame:
    return retrieval.link_opportunities(pages, graph.edges(pages), content.duplicate_clusters(pages))


def _host_rules(probes: DataFrame, site_files: DataFrame) -> DataFrame:
    return site_rules.host_findings(site_rules.observed_variants(probes, site_files), site_files)


#: The tables of a whole audit.
_TABLES = ("pages", "site_files", "sitemap_urls", "probes")
#: The tables of snapshots.
_HISTORY = ("site_snapshot", "page_state", "snapshot_issue")


def queries() -> dict[str, Query]:
    on = _on
    single = {f"rule_{r.replace('-', '_')}": _rule(r) for r in rules.page_rules_ids()}
    return {
        "p5_found": on("site_snapshot", "page_state", "snapshot_issue", call=snapshot_diff.snapshot_changes),
        "extract_title": _fields("title"),
        "extract_lang": _fields("lang"),
        "extract_canonical": _fields("canonical"),
        "extract_description": _fields("meta_description"),
        "extract_viewport": _fields("viewport"),
        "extract_robots": _fields("meta_robots"),
        "extract_word_count": _fields("word_count"),
        "extract_html_bytes": _fields("html_bytes"),
        "extract_headings": on("pages", call=_headings),
        "extract_links": on("pages", call=_links),
        "extract_images": on("pages", call=_images),
        "extract_assets": on("pages", call=extract.asset_refs),
        "url_parts": on("pages", call=_url_parts),
        "reading_ease": on("pages", call=_ease),
        "fnv_hash": on("pages", call=_hash),
        "page_findings": on("pages", call=rules.page_findings),
        **single,
        "rule_meta_title_duplicate": on("pages", call=lambda p: rules.shared_values(p, "title", "meta-title-duplicate")),
        "rule_meta_description_duplicate": on("pages", call=lambda p: rules.shared_values(p, "meta_description", "meta-description-duplicate")),
        "heading_steps": on("pages", call=rules.heading_steps),
        "site_findings": on("site_files", call=site_rules.site_findings),
        "rule_indexing_robots_format": on("site_files", call=site_rules.robots_format),
        "rule_robots_blocks": on("site_files", "pages", call=site_rules.robots_blocks),
        "robots_access": on("site_files", call=robots.root_access),
        "robots_signals": on("site_files", call=robots.content_signals),
        "declared_sitemaps": on("site_files", call=site_texts.declared_sitemaps),
        "crawl_frontier": on("pages", call=site_texts.crawl_frontier),
        "probe_findings": on("probes", "site_files", call=site_rules.probe_findings),
        "rule_canonical_targets": on("pages", "site_files", call=site_rules.canonical_findings),
        "rule_noindex": on("pages", "site_files", "sitemap_urls", call=site_rules.noindex_findings),
        "rule_sitemap": on("pages", "site_files", "sitemap_urls", call=site_rules.sitemap_findings),
        "rule_hreflang": on("pages", call=site_rules.hreflang_findings),
        "rule_schema_website_missing": on("pages", "site_files", call=site_rules.home_schema),
        "link_edges": on("pages", call=graph.edges),
        "link_inbound": on("pages", call=graph.inbound),
        "link_orphans": on("pages", "site_files", call=graph.orphans),
        "link_broken": on("pages", call=graph.broken),
        "link_depth": on("pages", "site_files", call=_depths),
        "link_findings": on("pages", "site_files", call=graph.link_findings),
        "page_rank_events": on("events", call=_event_rank),
        "page_rank_sites": on("pages", call=_page_rank),
        "term_counts": on("pages", call=lambda p: content.term_counts(p).select("site_id", "page_id", "term", "n")),
        "top_terms": on("pages", call=content.top_terms),
        "stuffed_terms": on("pages", call=content.stuffed_terms),
        "misaligned_titles": on("pages", call=content.misaligned),
        "duplicate_clusters": on("pages", call=content.duplicate_clusters),
        "vector_neighbours": on("embeddings", call=_top_vectors),
        "related_pages": on("pages", call=retrieval.related_pages),
        "search_documents": on("documents", "pages", call=_search),
        "geo_checks": on("pages", "site_files", call=geo.checks),
        "geo_score": on("pages", "site_files", call=lambda p, s: geo.score(geo.checks(p, s))),
        "llms_lines": on("pages", "site_files", call=geo.llms_lines),
        "page_issues": on("pages", call=_cheap_issues),
        "content_findings": on("pages", call=content.content_findings),
        "duplicate_findings": on("pages", call=content.duplicate_findings),
        "full_audit": on(*_TABLES, call=_full_audit),
        "category_scores": on(*_TABLES, call=_scores),
        "overall_score": on(*_TABLES, call=lambda *t: scoring.overall(_scores(*t))),
        "issue_priorities": on(*_TABLES, call=lambda *t: scoring.priorities(_audit(*t))),
        "report_markdown": on(*_TABLES, call=lambda *t: sinks.issue_markdown(_audit(*t))),
        "report_text": on(*_TABLES, call=_text),
        "report_html": on(*_TABLES, call=lambda *t: sinks.issue_html(_audit(*t))),
        "page_regressions": on("site_snapshot", "page_state", call=snapshot_diff.page_regressions),
        "site_regressions": on("site_snapshot", call=snapshot_diff.site_regressions),
        "issue_deltas": on("site_snapshot", "snapshot_issue", call=snapshot_diff.issue_deltas),
        "regression_gate": on("site_snapshot", "page_state", call=lambda s, p: snapshot_diff.gate(snapshot_diff.page_regressions(s, p), snapshot_diff.site_regressions(s))),
        "snapshot_fields": on(*_HISTORY, call=snapshot_diff.snapshot_fields),
        "issue_levels": on("site_snapshot", "snapshot_issue", call=diff_report.issue_levels),
        "pages_added": on("site_snapshot", "page_state", call=diff_report.pages_added),
        "category_deltas": on("site_snapshot", call=diff_report.category_deltas),
        "snapshot_summary": on(*_HISTORY, call=diff_report.summary),
        "gate_new": on(*_HISTORY, call=diff_report.fails),
        "diff_markdown": on(*_HISTORY, call=diff_report.markdown),
        "rule_link_opportunities": on("pages", call=_opportunities),
        "rule_host_variants": on("probes", "site_files", call=_host_rules),
        "crawl_state": on("pages", call=lambda p: snapshot_diff.state_of(p, "crawl", whole=True)),
        "fix_templates": lambda s, d: fixes.templates(tune(s)),
        "rule_catalog": lambda s, d: scoring.catalog(tune(s)),
        "vitals_ttfb": on("pages", call=lambda p: vitals.measure(p.select("site_id", "page_id", "response_time_ms").distinct(), ["site_id"], "response_time_ms", "experimental_time_to_first_byte")),
        "vitals_events": on("events", call=_event_vitals),
        "event_windows": lambda s, d: events.run_windows(tune(s), d),
    }


def oracle_sql() -> dict[str, str]:
    from pagemill.plans import sql

    return sql.oracle()
