"""A mix of sources by target weights, in training order.

Each source's weight is a line over the training run, W(x) = share * (1 + a (2x - 1)) for x from 0 to 1; the slopes
cancel out, so the weights sum to the whole at every x, and each integrates to its share.  A document that lies at
token u of its source's stream is due where the integrated demand reaches u: the inverse of a quadratic.  Sorting by
that place interleaves the sources.  Streams are cumulated by hash buckets, so no source gathers in one task.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.token_sizes import VOCABULARY, sized
from pagemill.session import cut

#: Documents a bucket of a source holds about; a window never sees more than a bucket or one row per bucket.
BUCKET_ROWS = 50_000
#: How far a source's weight may move from its share, at the ends of the run.
DRIFT = 0.5


class Stream(NamedTuple):
    source: str
    share: float
    repeats: int
    tokens: int
    documents: int
    demand: float
    slope: float


def streams(targets: list[tuple[str, float, int]], totals: dict[str, tuple[int, int]], total_tokens: int | None = None) -> list[Stream]:
    """Demand and slope of every named source that has tokens.

    ``total_tokens`` defaults to the most that lets each of them reach its share; above that, sources whose repeats are
    used up fall short and the others keep their own demand.  Sources without tokens leave their share to the others in
    proportion.  Weights move from sources of short documents to those of long ones.
    """
    present = [(s, w, r, *totals[s]) for s, w, r in targets if w > 0 and r > 0 and totals.get(s, (0, 0))[0] > 0]
    weight = sum(p[1] for p in present)
    if not present:
        return []
    most = min(r * t * weight / w for _, w, r, t, _ in present)
    total = most if total_tokens is None else total_tokens
    lengths = {p[0]: math.log(p[3] / p[4]) for p in present}
    middle = sum(p[1] / weight * lengths[p[0]] for p in present)
    spread = max(abs(x - middle) for x in lengths.values()) or 1.0
    return [
        Stream(s, w / weight, r, t, n, min(w / weight * total, r * t), DRIFT * (lengths[s] - middle) / spread)
        for s, w, r, t, n in present
    ]


def targets_of(mix_target: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, repeats) of a table of a few fixed rows; rows with a null are left out, the first of a source holds."""
    rows = mix_target.where("source is not null and target_share is not null and max_repeats is not null").select("source", "target_share", "max_repeats")
    out: dict[str, tuple[str, float, int]] = {}
    for r in sorted(rows.distinct().collect()):
        out.setdefault(r[0], (r[0], float(r[1]), int(r[2])))
    return list(out.values())


def _lookup(name: str, values: dict, kind: str) -> Column:
    expr = F.lit(None).cast(kind)
    for source, value in values.items():
        expr = F.when(F.col("source") == source, F.lit(value).cast(kind)).otherwise(expr)
    return expr.alias(name)


def mixed(documents: DataFrame, mix_target: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, list[Stream], list]:
    """The selection (position, doc_id, source, repeat, tokens) in training order, the streams and the targets.

    position runs from 0 to 1; repeat counts from 0 and stays below max_repeats.  A document is taken if its
    stream reaches the middle of it before the demand is met.  Documents of no named source, without text or without tokens are left out.
    """
    targets = targets_of(mix_target)
    spark = documents.sparkSession
    schema = "position double, doc_id bigint, source string, repeat int, tokens bigint"
    if not targets:
        return spark.createDataFrame([], schema), [], targets
    named = documents.where(F.col("source").isin([t[0] for t in targets]))
    sizes = cut(sized(named, ["doc_id", "source"], vocabulary).where("tokens > 0"))
    # One row per named source.
    totals = {r["source"]: (r["t"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    plan = streams(targets, totals, total_tokens)
    if not plan:
        return spark.createDataFrame([], schema), plan, targets
    buckets = _lookup("buckets", {s.source: max(8, math.ceil(s.documents / BUCKET_ROWS)) for s in plan}, "int")
    hashed = sizes.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 1), buckets))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    at = hashed.join(offsets, ["source", "bucket"]).select("doc_id", "source", "tokens", (F.coalesce(inside, F.lit(0)) + F.col("offset")).alias("start"))
    whole = _lookup("whole", {s.source: s.tokens for s in plan}, "bigint")
    demand = _lookup("demand", {s.source: s.demand for s in plan}, "double")
    slope = _lookup("slope", {s.source: s.slope for s in plan}, "double")
    passes = _lookup("passes", {s.source: min(s.repeats, math.ceil(s.demand / s.tokens)) for s in plan}, "int")
    copies = (
        at.withColumn("repeat", F.explode(F.sequence(F.lit(0), passes - 1)))
        .withColumns({"whole": whole, "demand": demand, "slope": slope})
        .withColumn("u", F.col("start") + F.col("repeat") * F.col("whole"))
        .where("u + tokens / 2 <= demand")
    )
    # Half of the document, so that no source starts or ends the run by its first or last one.
    v = F.least((F.col("u") + F.col("tokens") / 2) / F.col("demand"), F.lit(1.0))
    a = F.col("slope")
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * v)
    x = F.when(F.abs(a) < 1e-9, v).otherwise((a - 1 + root) / (2 * a))
    chosen = copies.select(x.alias("position"), "doc_id", "source", "repeat", "tokens")
    return chosen.orderBy("position", "doc_id", "repeat"), plan, targets


def mix(documents: DataFrame, mix_target: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    return mixed(documents, mix_target, total_tokens, vocabulary)[0]


def shares(documents: DataFrame, mix_target: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats): one row per named source."""
    chosen, _, targets = mixed(documents, mix_target, total_tokens, vocabulary)
    got = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("repeat") + 1).alias("most_repeats"))
    named = documents.sparkSession.createDataFrame([(s, w) for s, w, _ in targets], "source string, target_share double")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    joined = F.broadcast(named).join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return joined.select(
        "source", "target_share", (F.col("tokens") / total).alias("actual_share"), "tokens",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
