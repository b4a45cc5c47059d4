"""Reports: JSON lines, Markdown tables and a page of HTML from small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.scoring import IMPACT


def issue_json(issues: DataFrame) -> DataFrame:
    """(site_id, body): one JSON object an issue."""
    return issues.select("site_id", F.to_json(F.struct("rule_id", "category", "impact", "affected")).alias("body"))


def issue_markdown(issues: DataFrame, most: int = 12) -> DataFrame:
    """(site_id, body): a Markdown table of the ``most`` gravest issues of each site (a top-k report)."""
    rank = F.lit(0)
    for name, points in IMPACT.items():
        rank = F.when(F.col("impact") == name, points).otherwise(rank)
    row = F.struct((-rank).alias("r"), (-F.col("affected")).alias("n"), "rule_id", "impact", "affected")
    kept = issues.groupBy("site_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, most).alias("rows"))
    line = F.transform("rows", lambda x: F.concat(F.lit("| "), x["impact"], F.lit(" | "), x["rule_id"], F.lit(" | "), x["affected"], F.lit(" |")))
    head = F.array(F.lit("| Impact | Rule | Pages |"), F.lit("|---|---|---|"))
    return kept.select("site_id", F.array_join(F.concat(head, line), "\n").alias("body"))


def issue_text(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """(site_id, body): a plain report: the overall score of (site_id, overall, grade), then a line an issue, the gravest first."""
    rank = F.lit(0)
    for name, points in IMPACT.items():
        rank = F.when(F.col("impact") == name, points).otherwise(rank)
    rows = issues.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct((-rank).alias("r"), (-F.col("affected")).alias("n"), "rule_id", "impact", "affected"))).alias("rows"))
    line = F.transform("rows", lambda x: F.concat(F.lit("  ["), x["impact"], F.lit("] "), x["rule_id"], F.lit(": "), x["affected"]))
    head = F.concat(F.lit("Score "), F.col("overall"), F.lit(" ("), F.col("grade"), F.lit(")"))
    none = F.array().cast("array<string>")
    return scores.join(rows, "site_id", "left").select("site_id", F.array_join(F.concat(F.array(head), F.coalesce(line, none)), "\n").alias("body"))


def escaped(text):
    """&, <, > and double quotes as entities."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def issue_html(issues: DataFrame, brand: str = "Site audit") -> DataFrame:
    """(site_id, body): a self-contained HTML report, a list item an issue."""
    item = F.concat(F.lit("<li>"), escaped(F.col("rule_id")), F.lit(" ("), escaped(F.col("impact")), F.lit("): "), F.col("affected"), F.lit("</li>"))
    joined = issues.groupBy("site_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    title = escaped(F.lit(brand))
    return joined.select("site_id", F.concat(F.lit("<!doctype html><title>"), title, F.lit("</title><ul>"), F.col("items"), F.lit("</ul>")).alias("body"))


def append_snapshot(state: DataFrame, folder: str) -> None:
    """Adds states to a table partitioned by snapshot."""
    state.write.mode("append").partitionBy("snapshot_id").parquet(folder)
