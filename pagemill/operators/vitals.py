"""Field measures: 75th percentiles and their ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of good and of poor, by metric.
THRESHOLDS = {
    "largest_contentful_paint": (2500.0, 4000.0), "interaction_to_next_paint": (200.0, 500.0), "cumulative_layout_shift": (0.1, 0.25),
    "first_contentful_paint": (1800.0, 3000.0), "experimental_time_to_first_byte": (800.0, 1800.0),
}
CORE = ["largest_contentful_paint", "interaction_to_next_paint", "cumulative_layout_shift"]


def rate(metric: Column, p75: Column) -> Column:
    """good, needs-improvement or poor; an unknown metric is good, a null value has no rating."""
    out = F.lit("good")
    for name, (good, poor) in THRESHOLDS.items():
        out = F.when(metric == name, F.when(p75 <= good, "good").when(p75 <= poor, "needs-improvement").otherwise("poor")).otherwise(out)
    return F.when(p75.isNotNull(), out)


def measure(values: DataFrame, keys: list[str], value: str, metric: str) -> DataFrame:
    """keys, metric, p75 and rating of a value column; groups without values are left out.

    Exact, with linear interpolation.  Values are counted in buckets of their leading bits first; only the buckets that
    hold the two places around the percentile are ranked, so no task holds the values of a whole group.
    """
    v = F.col(value).cast("double")
    rows = values.where(F.col(value).isNotNull()).select(*keys, v.alias("v"))
    # The bucket is the value at three significant digits, which keeps the order of values.
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("v"))) - 2)
    rows = rows.withColumn("bucket", F.when(F.col("v") == 0, 0.0).otherwise(F.floor(F.col("v") / step) * step))
    each = rows.groupBy(*keys, "bucket", "v").agg(F.count("*").alias("n"))
    buckets = each.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    buckets = buckets.withColumn("upto", F.sum("m").over(w)).withColumn("total", F.sum("m").over(Window.partitionBy(*keys)))
    place = (F.col("total") - 1) * 0.75
    low, high = F.floor(place), F.ceil(place)
    first = F.col("upto") - F.col("m")
    near = buckets.where((low < F.col("upto")) & (high >= first)).select(*keys, "bucket", first.alias("first"), "total")
    inside = Window.partitionBy(*keys, "bucket").orderBy("v")
    ranked = each.join(near, [*keys, "bucket"]).withColumn("end", F.col("first") + F.sum("n").over(inside)).withColumn("start", F.col("end") - F.col("n"))
    at = lambda p: F.max(F.when((F.col("start") <= p) & (p < F.col("end")), F.col("v")))
    p75 = ranked.groupBy(*keys).agg(at(low).alias("a"), at(high).alias("b"), F.max(place - low).alias("f")).withColumn("p75", F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
    return p75.select(*keys, F.lit(metric).alias("metric"), "p75", rate(F.lit(metric), F.col("p75")).alias("rating"))


def with_fallback(url_level: DataFrame, origin_level: DataFrame, keys: list[str], metrics: DataFrame) -> DataFrame:
    """The url's own p75 of each metric of ``metrics`` (keys, metric), else the origin's; null if neither has one."""
    own = url_level.select(*keys, "metric", F.col("p75").alias("own"))
    wide = origin_level.select(*keys, "metric", F.col("p75").alias("wide"))
    met = metrics.join(own, [*keys, "metric"], "left").join(wide, [*keys, "metric"], "left").withColumn("p75", F.coalesce("own", "wide"))
    return met.select(*keys, "metric", "p75", rate(F.col("metric"), F.col("p75")).alias("rating"))


def findings(vitals: DataFrame) -> DataFrame:
    """perf-core-web-vitals for sites with a core metric that is not good; the note is high if one is poor, else medium."""
    bad = vitals.where(F.col("metric").isin(CORE) & (F.col("rating") != "good"))
    worst = F.when(F.max(F.col("rating") == "poor"), "high").otherwise("medium")
    return bad.groupBy("site_id").agg(worst.alias("note")).select("site_id", F.lit("perf-core-web-vitals").alias("rule_id"), F.lit("/").alias("url"), "note")
