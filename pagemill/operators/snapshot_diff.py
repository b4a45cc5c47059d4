"""What changed between consecutive full snapshots of one series.

Records of all snapshots are range-partitioned and sorted by (series, kind, key, place in the series).  One pass over
each sorted range then plays both pointers of a merge at once: a record is compared, column by column, with the one right
before it, and a gap in the places is a removal followed by an addition.  No snapshot is joined with another, so a record
is shuffled once, however many snapshots the series has, and a large series is split over ranges by its keys.

``keep`` stores records in that layout, a folder of sorted ranges for each snapshot, so that later runs need no history
but the last snapshot of each series: ``changes_of_kept`` merges two kept snapshots range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_FIELDS = ("status", "title", "description", "canonical", "noindex_meta", "noindex_header", "h1", "redirected_to")
ISSUE_FIELDS = ("impact", "category", "title", "paths")
#: The compared columns of both kinds, by the name they have in a record.
_COLUMNS = {
    **{f: ("bigint" if f == "status" else "boolean" if f.startswith("noindex") else "string") for f in PAGE_FIELDS},
    **{f"issue_{f}": ("array<string>" if f == "paths" else "string") for f in ISSUE_FIELDS},
}


def series_of(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, url, place, next_id): place counts from 1 in order of taken_at, ties by snapshot_id.

    Repeated rows of a snapshot count once (the last loaded holds).  A snapshot without id, url or taken_at belongs
    to no series and is left out.
    """
    one = (
        snapshots.where("snapshot_id is not null and url is not null and taken_at is not null")
        .groupBy("snapshot_id")
        .agg(F.max_by(F.struct("url", "taken_at"), F.struct("loaded_at", "taken_at", "url")).alias("s"))
        .select("snapshot_id", "s.url", "s.taken_at")
    )
    w = Window.partitionBy("url").orderBy("taken_at", "snapshot_id")
    return one.select(
        "snapshot_id", "url", F.row_number().over(w).alias("place"), F.lead("snapshot_id").over(w).alias("next_id")
    )


def _compared(df: DataFrame, fields: tuple[str, ...], prefix: str) -> Column:
    """The columns of both kinds in one struct; an empty string is null, an array is a set and null is the empty one."""
    kinds = dict(df.dtypes)
    parts = []
    for name, kind in _COLUMNS.items():
        own = name.removeprefix(prefix)
        if own not in fields or name.startswith("issue_") != (prefix == "issue_"):
            parts.append(F.lit(None).cast(kind).alias(name))
        elif kinds[own] == "string":
            parts.append(F.nullif(F.col(own), F.lit("")).alias(name))
        elif kinds[own].startswith("array"):
            parts.append(F.array_sort(F.array_distinct(F.coalesce(F.col(own), F.array().cast(kind)))).alias(name))
        else:
            parts.append(F.col(own).cast(kind).alias(name))
    return F.struct(*parts)


def keyed_records(df: DataFrame, kind: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(snapshot_id, record_kind, record_key, loaded_at, sig); rows without snapshot or key are left out."""
    loaded = F.col("loaded_at") if "loaded_at" in df.columns else F.lit(None)
    return df.where(F.col("snapshot_id").isNotNull() & F.col(key).isNotNull()).select(
        "snapshot_id",
        F.lit(kind).alias("record_kind"),
        F.col(key).alias("record_key"),
        loaded.cast("timestamp_ntz").alias("loaded_at"),
        _compared(df, fields, "issue_" if kind == "issue" else "").alias("sig"),
    )


def _differing(a: str, b: str) -> Column:
    """Names of the columns in which two records differ, null being equal to null."""
    tests = [F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), F.lit(c.removeprefix("issue_"))) for c in _COLUMNS]
    return F.array_compact(F.array(*tests))


def diff_series(series: DataFrame, records: DataFrame) -> DataFrame:
    """(snapshot_id, record_kind, record_key, change, fields) for every snapshot but the first of its series.

    ``fields`` names the columns that changed, null where a record was added or removed.

    If rows for one snapshot and key differ, the one loaded last holds (ties: the greater signature).  Records of
    snapshots that ``series`` does not name are left out.  Empty inputs give no rows.
    """
    key = ["url", "record_kind", "record_key"]
    placed = records.join(series, "snapshot_id").select(*key, "place", "next_id", "snapshot_id", "loaded_at", "sig")
    ranged = placed.repartitionByRange(*key).sortWithinPartitions(*key, "place", "loaded_at", "sig")
    by_load = Window.partitionBy(*key).orderBy("place", "loaded_at", "sig")
    held = ranged.withColumn("_after", F.lead("place").over(by_load)).where("_after is null or _after > place")
    before, after = F.lag("place").over(by_load), F.lag("sig").over(by_load)
    merged = held.select(
        *key, "snapshot_id", "place", "next_id", "sig", "_after",
        before.alias("p0"), after.alias("sig0"), F.lead("place").over(by_load).alias("p2"),
    ).withColumn("fields", F.when(F.col("p0") == F.col("place") - 1, _differing("sig0", "sig")))
    here = (
        F.when((F.col("place") > 1) & (F.col("p0").isNull() | (F.col("p0") < F.col("place") - 1)), F.lit("added"))
        .when((F.col("p0") == F.col("place") - 1) & (F.size("fields") > 0), F.lit("changed"))
    )
    gone = F.when(
        F.col("next_id").isNotNull() & (F.col("p2").isNull() | (F.col("p2") > F.col("place") + 1)), F.lit("removed")
    )
    events = F.array(
        F.struct(F.col("snapshot_id").alias("snapshot_id"), here.alias("change"), F.when(here == "changed", F.col("fields")).alias("fields")),
        F.struct(F.col("next_id").alias("snapshot_id"), gone.alias("change"), F.lit(None).cast("array<string>").alias("fields")),
    )
    return (
        merged.select("record_kind", "record_key", F.explode(events).alias("e"))
        .where("e.change is not null")
        .select("e.snapshot_id", "record_kind", "record_key", "e.change", "e.fields")
    )


def _records(page_state: DataFrame, issues: DataFrame) -> DataFrame:
    return keyed_records(page_state, "page", "path", PAGE_FIELDS).unionByName(keyed_records(issues, "issue", "rule_id", ISSUE_FIELDS))


def snapshot_changes(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, record_kind, record_key, change) of pages and issues."""
    return diff_series(series_of(snapshots), _records(page_state, issues)).drop("fields")


def snapshot_fields(snapshots: DataFrame, page_state: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, record_kind, record_key, field): a row a column that changed."""
    found = diff_series(series_of(snapshots), _records(page_state, issues)).where("change = 'changed'")
    return found.select("snapshot_id", "record_kind", "record_key", F.explode("fields").alias("field"))


def keep(page_state: DataFrame, issues: DataFrame, folder: str, ranges: int = 64) -> None:
    """Adds the records of snapshots to a folder, range-partitioned and sorted by key inside each snapshot's part.

    Of several rows for one snapshot and key the last loaded is kept.
    """
    held = _records(page_state, issues).groupBy("snapshot_id", "record_kind", "record_key").agg(F.max(F.struct("loaded_at", "sig")).alias("h")).select("snapshot_id", "record_kind", "record_key", "h.sig")
    order = ["snapshot_id", "record_kind", "record_key"]
    held.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode("append").partitionBy("snapshot_id").parquet(folder)


def changes_of_kept(spark: SparkSession, folder: str, earlier: str, later: str) -> DataFrame:
    """(record_kind, record_key, change, fields) between two snapshots that ``keep`` stored; reads these two only."""
    kept = spark.read.parquet(folder)
    key = ["record_kind", "record_key"]
    a, b = (kept.where(F.col("snapshot_id") == x).select(*key, F.col("sig").alias(n)) for x, n in ((earlier, "a"), (later, "b")))
    met = a.join(b.hint("merge"), key, "full")
    fields = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), _differing("a", "b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(fields) > 0, "changed")
    return met.select(*key, change.alias("change"), F.when(change == "changed", fields).alias("fields")).where("change is not null")


#: Rules whose result depends on the host, not the code.
HOST_RULES = (
    "indexing-noindex indexing-noindex-utility indexing-canonical-mismatch indexing-canonical-target-invalid indexing-hreflang-invalid "
    "indexing-sitemap-hygiene indexing-sitemap-gaps indexing-robots-unavailable indexing-robots-html indexing-robots-blocks-google "
    "indexing-robots-blocks-pages indexing-https-certificate indexing-soft-404-site framework-sitemap-missing framework-robots-missing "
    "framework-robots-no-sitemap perf-slow-ttfb"
).split()
LEVELS = {"info": 1, "warning": 2, "critical": 3}


def _state_pairs(series: DataFrame, page_state: DataFrame) -> DataFrame:
    """(snapshot_id, path, a, b): states of a path in a snapshot and the one before, for paths of the later one."""
    held = F.max_by(F.struct(*PAGE_FIELDS), F.struct("loaded_at", F.xxhash64(*PAGE_FIELDS)))
    state = page_state.where("snapshot_id is not null and path is not null").groupBy("snapshot_id", "path").agg(held.alias("s"))
    later = series.where("place > 1").select("snapshot_id")
    before = state.join(series.where("next_id is not null").select("snapshot_id", "next_id"), "snapshot_id").select(F.col("next_id").alias("snapshot_id"), "path", F.col("s").alias("a"))
    return state.join(later, "snapshot_id", "left_semi").withColumnRenamed("s", "b").join(before, ["snapshot_id", "path"], "left")


def page_regressions(snapshots: DataFrame, page_state: DataFrame) -> DataFrame:
    """(snapshot_id, kind, level, path): typed changes of the pages that both snapshots of a pair hold."""
    pair = _state_pairs(series_of(snapshots), page_state).where("a is not null")
    fine = lambda x: F.col(f"{x}.status").between(200, 299) & (F.coalesce(f"{x}.redirected_to", F.lit("")) == "")
    text = lambda x, f: F.coalesce(F.col(f"{x}.{f}"), F.lit(""))
    hidden = lambda x: F.coalesce(F.col(f"{x}.noindex_meta"), F.lit(False)) | F.coalesce(F.col(f"{x}.noindex_header"), F.lit(False))
    was, now = F.coalesce(fine("a"), F.lit(False)), F.coalesce(fine("b"), F.lit(False))
    error = was & (F.col("b.status") >= 400)
    moved = was & ~error & (text("b", "redirected_to") != "")
    both = was & now
    target = F.regexp_replace(F.regexp_extract(text("b", "canonical"), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    elsewhere = (text("b", "canonical") != "") & (F.when(target == "", "/").otherwise(target) != F.col("path"))
    change = lambda when, kind, level: F.when(when, F.struct(F.lit(kind).alias("kind"), level.alias("level")))
    kinds = F.array_compact(F.array(
        change(error, "page-error", F.lit("critical")),
        change(moved, "redirect-added", F.lit("warning")),
        change(both & ~hidden("a") & hidden("b"), "noindex-added", F.lit("critical")),
        change(both & hidden("a") & ~hidden("b"), "noindex-removed", F.lit("info")),
        change(both & (text("a", "canonical") != text("b", "canonical")), "canonical-changed", F.when(elsewhere, "warning").otherwise("info")),
        change(both & (text("a", "title") != text("b", "title")), "titles-changed", F.lit("info")),
        change(both & (text("a", "h1") != "") & (text("b", "h1") == ""), "h1-removed", F.lit("warning")),
        change(both & (text("a", "description") != "") & (text("b", "description") == ""), "description-removed", F.lit("warning")),
    ))
    return pair.select("snapshot_id", "path", F.explode(kinds).alias("k")).select("snapshot_id", "k.kind", "k.level", "path")


def site_regressions(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, kind, level): typed changes of robots.txt, sitemap and score against the snapshot before."""
    one = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max_by(F.struct("overall", "robots", "sitemap"), "loaded_at").alias("s"))
    series = series_of(snapshots)
    rows = series.join(one, "snapshot_id").withColumn("p", F.lag("s").over(Window.partitionBy("url").orderBy("place"))).where("place > 1")
    c = F.col
    failing = lambda x: F.coalesce((c(f"{x}.robots.status") >= 500) | (c(f"{x}.robots.status") == 429), F.lit(False))
    opened = lambda x: F.coalesce(c(f"{x}.robots.googlebot_allowed"), F.lit(True))
    blocked = lambda x: F.coalesce(c(f"{x}.robots.ai_search_blocked"), F.array().cast("array<string>"))
    newly = F.size(F.array_except(blocked("s"), blocked("p"))) > 0
    differs = F.coalesce(c("p.robots.hash"), F.lit("")) != F.coalesce(c("s.robots.hash"), F.lit(""))
    had, has = (F.coalesce(c(f"{x}.sitemap.present"), F.lit(False)) for x in "ps")
    change = lambda when, kind, level: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level")))
    gone = had & ~has
    kinds = F.array_compact(F.array(
        change(opened("p") & ~opened("s"), "googlebot-blocked", "critical"),
        change(~opened("p") & opened("s"), "googlebot-unblocked", "info"),
        change(newly, "ai-search-blocked", "warning"),
        change(~failing("p") & failing("s"), "robots-unavailable", "critical"),
        change(~(~failing("p") & failing("s")) & differs & (opened("p") == opened("s")) & ~newly, "robots-changed", "info"),
        change(gone, "sitemap-gone", "warning"),
        change(~gone & (c("p.sitemap.urls") >= 10) & (c("s.sitemap.urls") < c("p.sitemap.urls") * 0.8), "sitemap-shrunk", "warning"),
        change(c("s.overall") - c("p.overall") <= -5, "score-drop", "warning"),
    ))
    return rows.select("snapshot_id", F.explode(kinds).alias("k")).select("snapshot_id", "k.kind", "k.level")


def issue_deltas(snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    """(snapshot_id, rule_id, delta, fresh): new, worsened (with how many new paths) and resolved rules."""
    series = series_of(snapshots)
    one = issues.where("snapshot_id is not null and rule_id is not null").groupBy("snapshot_id", "rule_id").agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("paths", F.array().cast("array<string>"))))).alias("paths")
    )
    b = one.join(series.where("place > 1").select("snapshot_id"), "snapshot_id", "left_semi").withColumnRenamed("paths", "pb")
    a = one.join(series.where("next_id is not null").select("snapshot_id", "next_id"), "snapshot_id").select(F.col("next_id").alias("snapshot_id"), "rule_id", F.col("paths").alias("pa"))
    met = b.join(a, ["snapshot_id", "rule_id"], "full")
    fresh = F.size(F.array_except("pb", "pa"))
    delta = F.when(F.col("pa").isNull(), "new").when(F.col("pb").isNull(), "resolved").when(fresh > 0, "worsened")
    count = F.when(delta == "new", F.size("pb")).when(delta == "worsened", fresh).otherwise(0)
    return met.select("snapshot_id", "rule_id", delta.alias("delta"), count.alias("fresh")).where("delta is not null")


def gate(pages: DataFrame, site: DataFrame, level: str = "critical") -> DataFrame:
    """(snapshot_id, fails): whether a snapshot holds a change of at least ``level`` against the one before."""
    rank = F.lit(0)
    for name, value in LEVELS.items():
        rank = F.when(F.col("level") == name, value).otherwise(rank)
    both = pages.select("snapshot_id", "level").unionByName(site.select("snapshot_id", "level"))
    return both.groupBy("snapshot_id").agg((F.max(rank) >= LEVELS[level]).alias("fails"))


def state_of(pages: DataFrame, snapshot_id: str, whole: bool = False) -> DataFrame:
    """The page_state rows of a crawl: one a path of the requested address, of several the first in crawl order.

    Texts are cut as the audited snapshots cut them unless ``whole``.
    """
    from pagemill.functions import text, urls

    first_of = lambda c, most: (F.col(c) if isinstance(c, str) else c) if whole else F.substring(c, 1, most)
    asked = urls.path(F.coalesce("requested_url", "url"))
    moved = F.when(F.size(F.coalesce("redirected_from", F.array().cast("array<string>"))) > 0, urls.path(F.col("url")))
    rows = pages.where("url is not null").select(
        F.lit(snapshot_id).alias("snapshot_id"), "site_id", asked.alias("path"), "ord", "page_id", "status", first_of("title", 200).alias("title"),
        first_of("meta_description", 300).alias("description"), "canonical", text.meta_noindex(F.col("meta_robots"), F.lit("")).alias("noindex_meta"),
        text.header_noindex(F.col("x_robots_tag")).alias("noindex_header"), first_of(F.get("h1s", F.lit(0)), 200).alias("h1"), moved.alias("redirected_to"),
    )
    first = F.min_by(F.struct(*PAGE_FIELDS), F.struct(F.coalesce("ord", F.lit(1 << 62)), "page_id"))
    return rows.where("path is not null").groupBy("snapshot_id", "site_id", "path").agg(first.alias("s")).select("snapshot_id", "site_id", "path", "s.*")
