"""Issues from findings, category and overall scores, priorities and grades."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.rules import catalogue
from pagemill.session import cut, release

#: Penalties, category weights, and what impact, effort and risk count for a priority.
PENALTY = {"critical": 26, "high": 15, "medium": 8, "low": 3}
CATEGORIES = {
    "metadata": 0.20, "indexing": 0.18, "structure": 0.12, "images": 0.10, "schema": 0.12, "internal-linking": 0.10, "performance": 0.13, "framework": 0.05,
}
IMPACT = {"critical": 12, "high": 7, "medium": 4, "low": 2}
EFFORT = {"low": 1.0, "medium": 0.7, "high": 0.45}
RISK = {"low": 1.0, "medium": 0.8, "high": 0.55}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D"), (50, "E")]
#: Most findings of a rule that the audited program counts as affected; queries count all.
CAPS = {
    **dict.fromkeys(
        "content-keyword-alignment content-readability content-keyword-stuffing schema-invalid indexing-redirect-chain perf-mixed-content img-broken "
        "perf-broken-assets indexing-temporary-redirect structure-url-format".split(), 40,
    ),
    **dict.fromkeys("perf-oversized-images img-legacy-format link-broken-external".split(), 60),
    "link-missing-internal-opportunities": 30,
}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in catalogue()], "rule_id string, category string, impact string, effort string, risk string, confidence int")


def _lookup(column: str, table: dict, default: object = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def issues(findings: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """(site_id, rule_id, category, impact, effort, risk, confidence, affected): a row a site and rule, capped as ``caps`` says.

    A page counts once a rule; counts are combined before the shuffle.
    """
    return _rated(_counted(findings), caps)


def issues_of(parts: Iterable[DataFrame], caps: dict[str, int] = CAPS) -> DataFrame:
    """``issues`` of all ``parts``, each counted and written, and what it took let go, before the next is made.

    One plan of all rules of an audit has more than a hundred shuffles, and a driver keeps it whole, again at every step.
    """
    kept = []
    for p in parts:
        kept.append(cut(_counted(p)))
        del p
        release(kept[0].sparkSession)
    counts = reduce(DataFrame.unionByName, kept)
    return _rated(counts.groupBy("site_id", "rule_id").agg(F.sum("n").alias("n")), caps)


def _counted(findings: DataFrame) -> DataFrame:
    return findings.groupBy("site_id", "rule_id").agg(F.count("*").alias("n"))


def _rated(counts: DataFrame, caps: dict[str, int]) -> DataFrame:
    capped = counts.withColumn("affected", F.least("n", _lookup("rule_id", caps, 1 << 40).cast("bigint"))).drop("n")
    return capped.join(F.broadcast(catalog(counts.sparkSession)), "rule_id").select("site_id", "rule_id", "category", "impact", "effort", "risk", "confidence", "affected")


def category_scores(found: DataFrame, ok_pages: DataFrame) -> DataFrame:
    """(site_id, category, score) of all categories for each site of (site_id, pages): 100 less the penalties, rounded half up."""
    spark = found.sparkSession
    names = F.broadcast(spark.createDataFrame([(c,) for c in CATEGORIES], "category string"))
    share = F.least(F.lit(1.0), F.col("affected") / F.greatest(F.lit(1), F.col("pages")))
    lost = found.join(ok_pages, "site_id").withColumn("p", _lookup("impact", PENALTY, 0) * (0.25 + 0.75 * share)).groupBy("site_id", "category").agg(F.sum("p").alias("p"))
    every = ok_pages.select("site_id").crossJoin(names).join(lost, ["site_id", "category"], "left")
    return every.select("site_id", "category", F.floor(F.greatest(F.lit(0.0), F.round(100 - F.coalesce("p", F.lit(0.0)), 9)) + 0.5).alias("score"))


def overall(scores: DataFrame) -> DataFrame:
    """(site_id, overall, grade): the weighted mean of the categories."""
    w = _lookup("category", CATEGORIES, 0.0)
    total = F.floor(F.round(F.sum(F.col("score") * w) / F.sum(w), 9) + 0.5)
    return scores.groupBy("site_id").agg(total.alias("overall")).withColumn("grade", grade(F.col("overall")))


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def priorities(found: DataFrame) -> DataFrame:
    """(site_id, rule_id, priority) from 0 to 100."""
    raw = _lookup("impact", IMPACT, 0) * _lookup("effort", EFFORT, 1.0) * _lookup("risk", RISK, 1.0) * F.col("confidence") / 100
    return found.select("site_id", "rule_id", "impact", F.floor(F.round(raw / 12 * 100, 9) + 0.5).alias("priority"))
