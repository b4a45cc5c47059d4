"""The whole comparison of consecutive snapshots: changes of pages, site, certificates, field measures, issues and scores.

All changes are rows (snapshot_id, kind, level, path, text) of the later snapshot; gates, summaries and reports are folded
from them.  When the origin of a series changes (a preview against the live host), what depends on the host alone is left
out of the changes and listed by ``environment``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.snapshot_diff import HOST_RULES, LEVELS, _state_pairs, issue_deltas, page_regressions, series_of, site_regressions

#: Days before a certificate ends that are a warning, and that are critical; order of ratings.
TLS_WARNING, TLS_CRITICAL = 14, 3
RATINGS = {"good": 0, "needs-improvement": 1, "poor": 2}
#: Changes of the site that a change of host explains.
_HOST_KINDS = ("googlebot-blocked", "googlebot-unblocked", "ai-search-blocked", "robots-unavailable", "robots-changed", "sitemap-gone", "sitemap-shrunk")


def pairs_of(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, before_id, s, p, crossed): consecutive snapshots with their rows and whether the origin changed."""
    fields = [c for c in ("url", "origin", "taken_at", "overall", "geo_score", "category_scores", "tls", "vitals") if c in snapshots.columns]
    one = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max_by(F.struct(*fields), "loaded_at").alias("s"))
    w = Window.partitionBy("url").orderBy("place")
    rows = series_of(snapshots).join(one, "snapshot_id").select("snapshot_id", "s", "place", F.lag("s").over(w).alias("p"), F.lag("snapshot_id").over(w).alias("before_id"))
    crossed = ~F.col("s.origin").eqNullSafe(F.col("p.origin")) if "origin" in fields else F.lit(False)
    return rows.where("place > 1").select("snapshot_id", "before_id", "s", "p", crossed.alias("crossed"))


def _level(impact: Column, fresh: Column) -> Column:
    grave = F.when(impact == "critical", F.when(fresh, "critical").otherwise("warning")).when(impact == "high", "warning")
    return F.coalesce(grave, F.lit("info"))


def issue_levels(snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, rule_id, kind, impact, level): new, worsened and resolved issues; host rules are left out where the origin changed."""
    impact = issues.where("snapshot_id is not null and rule_id is not null").groupBy("snapshot_id", "rule_id").agg(F.max("impact").alias("impact"))
    pair = pairs_of(snapshots).select("snapshot_id", "before_id", "crossed")
    found = issue_deltas(snapshots, issues).join(pair, "snapshot_id").where(~(F.col("crossed") & F.col("rule_id").isin(HOST_RULES)))
    now = found.join(impact, ["snapshot_id", "rule_id"], "left").select("snapshot_id", "before_id", "rule_id", "delta", F.col("impact").alias("now"))
    was = impact.select(F.col("snapshot_id").alias("before_id"), "rule_id", F.col("impact").alias("was"))
    met = now.join(was, ["before_id", "rule_id"], "left")
    kind = F.when(F.col("delta") == "new", "new-issue").when(F.col("delta") == "worsened", "worsened-issue").otherwise("resolved")
    level = F.when(F.col("delta") == "resolved", "info").otherwise(_level(F.col("now"), F.col("delta") == "new"))
    return met.select("snapshot_id", "rule_id", kind.alias("kind"), F.when(F.col("delta") == "resolved", F.col("was")).otherwise(F.col("now")).alias("impact"), level.alias("level"))


def pages_added(snapshots: DataFrame, page_state: DataFrame) -> DataFrame:
    """(snapshot_id, path): answered pages that the snapshot before does not hold."""
    return _state_pairs(series_of(snapshots), page_state).where("a is null and b.status between 200 and 299").select("snapshot_id", "path")


def category_deltas(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, category, delta); a category that the snapshot before lacks did not change."""
    rows = pairs_of(snapshots).select("snapshot_id", F.col("p.category_scores").alias("was"), F.explode("s.category_scores").alias("category", "score"))
    return rows.select("snapshot_id", "category", (F.col("score") - F.coalesce(F.try_element_at("was", F.col("category")), F.col("score"))).alias("delta"))


def certificate_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, kind, level): tls-invalid and tls-expiring, from a column tls (trusted, days_left) if there is one."""
    pair = pairs_of(snapshots)
    if "tls" not in snapshots.columns:
        return pair.where("false").select("snapshot_id", F.lit("").alias("kind"), F.lit("").alias("level"))
    rows = pair.where("not crossed and s.tls is not null")
    broken = F.coalesce(F.col("p.tls.trusted"), F.lit(True)) & ~F.coalesce(F.col("s.tls.trusted"), F.lit(False))
    kind = F.when(broken, "tls-invalid").when(F.col("s.tls.days_left") <= TLS_WARNING, "tls-expiring")
    level = F.when(broken | (F.col("s.tls.days_left") <= TLS_CRITICAL), "critical").otherwise("warning")
    return rows.select("snapshot_id", kind.alias("kind"), level.alias("level")).where("kind is not null")


def vitals_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, kind, level, metric): measures whose rating got worse, from a column vitals (metric to p75 and rating)."""
    pair = pairs_of(snapshots)
    if "vitals" not in snapshots.columns:
        return pair.where("false").select("snapshot_id", F.lit("").alias("kind"), F.lit("").alias("level"), F.lit("").alias("metric"))
    rank = lambda c: F.coalesce(*[F.when(c == name, F.lit(n)) for name, n in RATINGS.items()])
    rows = pair.where("not crossed").select("snapshot_id", F.col("p.vitals").alias("was"), F.explode("s.vitals").alias("metric", "v"))
    rows = rows.withColumn("before", F.try_element_at("was", F.col("metric")))
    worse = rank(F.col("v.rating")) > rank(F.col("before.rating"))
    level = F.when(F.col("v.rating") == "poor", "warning").otherwise("info")
    return rows.where(worse).select("snapshot_id", F.lit("vitals-regressed").alias("kind"), level.alias("level"), "metric")


def environment(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, what): differences that a change of origin explains: hidden by header, issues of host rules."""
    pair = pairs_of(snapshots).where("crossed").select("snapshot_id")
    hidden = lambda x: F.coalesce(F.col(f"{x}.noindex_header"), F.lit(False))
    states = _state_pairs(series_of(snapshots), page_state).join(pair, "snapshot_id", "left_semi").where("a is not null")
    pages = states.where(~hidden("a") & hidden("b")).select("snapshot_id", F.col("path").alias("what"))
    rules = issue_deltas(snapshots, issues).join(pair, "snapshot_id", "left_semi").where((F.col("delta") == "new") & F.col("rule_id").isin(HOST_RULES))
    return pages.unionByName(rules.select("snapshot_id", F.col("rule_id").alias("what")))


def changes(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, kind, level, path, text): every change of a snapshot against the one before, but resolved issues."""
    crossed = pairs_of(snapshots).where("crossed").select("snapshot_id")
    none = F.lit(None).cast("string")
    pages = page_regressions(snapshots, page_state)
    # On another host a header may hide every page; only the meta tag counts there.
    by_header = _state_pairs(series_of(snapshots), page_state).join(crossed, "snapshot_id", "left_semi").where("not coalesce(b.noindex_meta, false) and not coalesce(a.noindex_meta, false)")
    headed = by_header.select("snapshot_id", "path").crossJoin(F.broadcast(snapshots.sparkSession.createDataFrame([("noindex-added",), ("noindex-removed",)], "kind string")))
    pages = pages.join(headed, ["snapshot_id", "path", "kind"], "left_anti")
    one_page = pages.where("kind <> 'titles-changed'").select("snapshot_id", "kind", "level", "path", F.concat_ws(" ", "path", "kind").alias("text"))
    titles = pages.where("kind = 'titles-changed'").groupBy("snapshot_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    titles = titles.select("snapshot_id", F.lit("titles-changed").alias("kind"), F.lit("info").alias("level"), "path", F.concat(F.col("n"), F.lit(" titles changed")).alias("text"))
    fresh = pages_added(snapshots, page_state).groupBy("snapshot_id").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    fresh = fresh.select("snapshot_id", F.lit("pages-added").alias("kind"), F.lit("info").alias("level"), "path", F.concat(F.col("n"), F.lit(" pages added")).alias("text"))
    site = site_regressions(snapshots)
    host = F.col("kind").isin(*_HOST_KINDS)
    site = site.where(~host).unionByName(site.where(host).join(crossed, "snapshot_id", "left_anti")).select("snapshot_id", "kind", "level", none.alias("path"), F.col("kind").alias("text"))
    tls = certificate_changes(snapshots).select("snapshot_id", "kind", "level", none.alias("path"), F.col("kind").alias("text"))
    field = vitals_changes(snapshots).select("snapshot_id", "kind", "level", none.alias("path"), F.concat_ws(" ", "metric", "kind").alias("text"))
    rules = issue_levels(snapshots, issues).where("kind <> 'resolved'").select("snapshot_id", "kind", "level", none.alias("path"), F.concat_ws(" ", "rule_id", "kind").alias("text"))
    out = one_page
    for part in (titles, fresh, site, tls, field, rules):
        out = out.unionByName(part)
    return out


def _rank() -> Column:
    out = F.lit(0)
    for name, value in LEVELS.items():
        out = F.when(F.col("level") == name, value).otherwise(out)
    return out


def summary(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, level, critical, warnings, overall_delta, geo_delta, crossed): a row a snapshot but the first of a series."""
    counts = changes(snapshots, page_state, issues).groupBy("snapshot_id").agg(F.max(_rank()).alias("worst"), F.count_if(F.col("level") == "critical").alias("critical"), F.count_if(F.col("level") == "warning").alias("warnings"))
    level = F.lit("none")
    for name, value in LEVELS.items():
        level = F.when(F.col("worst") == value, name).otherwise(level)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = pairs_of(snapshots).join(counts, "snapshot_id", "left")
    return rows.select(
        "snapshot_id", level.alias("level"), zero("critical"), zero("warnings"), (F.col("s.overall") - F.col("p.overall")).alias("overall_delta"), (F.col("s.geo_score") - F.col("p.geo_score")).alias("geo_delta"), "crossed"
    )


def fails(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame, gate: str = "new") -> DataFrame:
    """(snapshot_id, fails): 'critical' fails on critical changes, 'new' also on new or worsened issues above low impact, 'none' never."""
    every = pairs_of(snapshots).select("snapshot_id")
    if gate == "none":
        return every.withColumn("fails", F.lit(False))
    bad = changes(snapshots, page_state, issues).where("level = 'critical'").select("snapshot_id")
    if gate == "new":
        bad = bad.unionByName(issue_levels(snapshots, issues).where("kind <> 'resolved' and coalesce(impact, '') <> 'low'").select("snapshot_id"))
    return every.join(bad.distinct().withColumn("fails", F.lit(True)), "snapshot_id", "left").select("snapshot_id", F.coalesce("fails", F.lit(False)).alias("fails"))


def markdown(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame, most: int = 40) -> DataFrame:
    """(snapshot_id, body): a Markdown table of the gravest ``most`` changes (a top-k report), then what was resolved."""
    rank = (-_rank()).alias("r")
    found = changes(snapshots, page_state, issues).select("snapshot_id", F.struct(rank, F.coalesce("kind", F.lit("")).alias("kind"), F.regexp_replace("text", r"\|", r"\\\\|").alias("text"), "level").alias("c"))
    w = Window.partitionBy("snapshot_id").orderBy("c")
    top = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("snapshot_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    lines = F.transform("c", lambda x: F.concat(F.lit("| "), F.when(x["level"] == "critical", "**critical**").otherwise(x["level"]), F.lit(" | "), x["text"], F.lit(" |")))
    fixed = issue_levels(snapshots, issues).where("kind = 'resolved'").groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), " · ").alias("fixed"))
    head = F.array(F.lit("| | Change |"), F.lit("|---|---|"))
    rows = pairs_of(snapshots).select("snapshot_id", "s", "p").join(top, "snapshot_id", "left").join(fixed, "snapshot_id", "left")
    title = F.concat(F.lit("Score "), F.coalesce(F.col("p.overall").cast("string"), F.lit("?")), F.lit(" to "), F.coalesce(F.col("s.overall").cast("string"), F.lit("?")))
    body = F.concat_ws("\n\n", title, F.when(F.col("c").isNotNull(), F.array_join(F.concat(head, lines), "\n")), F.concat(F.lit("Fixed: "), F.col("fixed")))
    return rows.select("snapshot_id", body.alias("body"))
