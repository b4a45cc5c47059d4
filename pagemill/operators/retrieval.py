"""Hashed text vectors and nearest neighbours of a stated query set."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import cut

SIZE = 512
#: Queries sent to the executors at a time: at most 16,384 x 512 x 4 bytes, 32 MB.
BLOCK = 16_384
#: Terms that mean the same to the search, the first names the group.
SYNONYMS = [
    "image images img picture pictures photo photos graphic graphics",
    "alt alttext alternative",
    "link links url urls href hyperlink anchor",
    "title titles heading headings headline h1",
    "description descriptions desc metadescription snippet",
    "canonical canonicalize duplicate duplicates",
    "schema structured jsonld richresults richsnippet microdata",
    "sitemap sitemaps",
    "robots robotstxt noindex nofollow crawl crawler crawling index indexing indexable indexation",
    "performance perf lcp cls inp ttfb speed fast slow slowly load loads loading render rendering blocking blocks preload preloaded vitals corewebvitals",
    "metadata meta metatag metatags opengraph og twittercard",
    "fix fixes patch patches diff pullrequest pr",
]
_GROUP = {term: "=" + group.split()[0] for group in SYNONYMS for term in group.split()}
_TOKEN = re.compile(r"[a-z0-9]+")


def fnv(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def stem(word: str) -> str:
    if len(word) > 5 and word.endswith("ies"):
        return word[:-3] + "y"
    for ending in ("ing", "es", "ed", "s"):
        if len(word) > len(ending) + 2 and word.endswith(ending):
            return word[: -len(ending)]
    return word


@lru_cache(maxsize=200_000)
def _place(feature: str) -> tuple[int, float]:
    """Bucket and signed weight of a feature."""
    weight = 1.6 if feature[0] == "=" else 0.4 if feature[0] == "~" else 1.0
    return fnv(feature) % SIZE, weight if fnv("sign:" + feature) & 1 else -weight


@lru_cache(maxsize=200_000)
def _features(word: str) -> tuple[str, ...]:
    root = stem(word)
    group = _GROUP.get(word) or _GROUP.get(root)
    padded = f"#{word}#"
    grams = [f"~{padded[i : i + 3]}" for i in range(len(padded) - 2)] if len(word) > 4 else []
    return (word, *([root] if root != word else []), *([group] if group else []), *grams)


def embed(text: str | None) -> np.ndarray:
    """A unit vector of SIZE numbers; zeros for a text without words."""
    counts: dict[str, int] = {}
    for word in _TOKEN.findall((text or "").lower()):
        for f in _features(word):
            counts[f] = counts.get(f, 0) + 1
    v = np.zeros(SIZE)
    for f, n in counts.items():
        bucket, weight = _place(f)
        v[bucket] += weight * (1 + math.log(n))
    length = float(np.sqrt((v * v).sum()))
    return v / length if length else v


def embedded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vector) of the texts; rows without a key are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.concatenate([embed(t) for t in b.column(1).to_pylist()]).astype(np.float32) if b.num_rows else np.zeros(0, np.float32)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SIZE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[key, "vector"])

    kind = dict(df.dtypes)[key]
    return df.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, vector array<float>")


def _blocks(queries: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """The queries in ranges of their keys, written once; each holds at most BLOCK rows, which is checked."""
    parts = max(1, -(-queries.count() // (BLOCK // 2)))
    placed = cut(queries.repartitionByRange(parts, *keys).withColumn("_block", F.spark_partition_id()))
    for row in placed.groupBy("_block").agg(F.count("*").alias("n")).orderBy("_block").collect():
        own = placed.where(F.col("_block") == row["_block"]).drop("_block")
        if row["n"] <= BLOCK:
            yield own
        else:
            for at in range(0, row["n"], BLOCK):
                yield own.orderBy(*keys).offset(at).limit(BLOCK)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float = -2.0) -> DataFrame:
    """(query_id, key, score, rank): the k rows of the largest dot product for each query, itself left out.

    Queries go out in blocks of at most BLOCK, which bounds what a task holds; every row is met, so recall is 1.  Ties go to the
    lower key.  Null vectors are left out.
    """
    spark = rows.sparkSession
    wanted = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    # Vectors may come from Python; they are made once, not for each block.
    source = cut(rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<float>").alias(vector)))
    kind = dict(rows.dtypes)[key]
    schema = f"query_id {kind}, {key} {kind}, score double"
    found = spark.createDataFrame([], schema)
    for asked in _blocks(wanted, key):
        block = asked.toArrow()
        ids = block.column(0).to_numpy()
        matrix = np.array(block.column(1).to_pylist(), np.float32)
        sent = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy(zero_copy_only=False)
                mine = np.array(b.column(1).to_pylist(), np.float32)
                for start in range(0, len(ids), 512):
                    part, names = matrix[start : start + 512], ids[start : start + 512]
                    scores = (part.astype(np.float64) @ mine.T.astype(np.float64)).round(6)
                    scores[(names[:, None] == own[None, :]) | (scores < least)] = -9
                    # A stable sort over rows in order of key gives ties to the lower key.
                    order = np.argsort(own, kind="stable")
                    best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                    q, r = np.repeat(np.arange(len(names)), best.shape[1]), best.ravel()
                    keep = scores[q, r] > -9
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[q[keep]]), pa.array(own[r[keep]]), pa.array(scores[q, r][keep])], names=["query_id", key, "score"]
                    )

        found = found.unionByName(source.mapInArrow(run, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _words() -> Column:
    texts = F.transform(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")), lambda h: h["text"])
    return F.concat_ws(" ", "title", F.array_join(texts, " "), "text_content")


def _similar(rows: DataFrame, linked: DataFrame, k: int, least: float) -> DataFrame:
    """(site_id, query_id, page_id, score, rank): the k most similar pages of the own site for queries with page_id divisible by 20.

    ``rows`` are (site_id, page_id, node, leader_id, words), ``linked`` (site_id, query_id, nodes).  A page of the query's
    node, of one of its linked nodes or of its leader is left out before the k are taken; a null leader is no cluster.
    Queries go out in blocks, in order of site, and a block embeds the pages of its sites only.
    """
    spark = rows.sparkSession
    rows = cut(rows)
    asked = rows.where("page_id % 20 = 0").join(linked.withColumnRenamed("query_id", "page_id"), ["site_id", "page_id"], "left")
    schema = "site_id string, query_id bigint, page_id bigint, score double"
    found = spark.createDataFrame([], schema)
    for part in _blocks(asked, "site_id", "page_id"):
        block = part.select("site_id", "page_id", "node", "leader_id", "words", "nodes").toArrow()
        site, words = np.array(block.column("site_id").to_pylist(), object), block.column("words").to_pylist()
        ids, nodes, leads = (np.array([-1 if v is None else v for v in block.column(c).to_pylist()], np.int64) for c in ("page_id", "node", "leader_id"))
        alone = np.array([v is None for v in block.column("leader_id").to_pylist()])
        seen = [np.array(v or [], np.int64) for v in block.column("nodes").to_pylist()]
        of_site = {s: np.flatnonzero(site == s) for s in set(site)}
        sent = spark.sparkContext.broadcast((of_site, ids, nodes, leads, alone, seen, words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            of_site, ids, nodes, leads, alone, seen, words = sent.value
            vectors: dict[str, np.ndarray] = {}
            for b in batches:
                sites = np.array(b.column("site_id").to_pylist(), object)
                for s in of_site.keys() & set(sites):
                    here = np.flatnonzero(sites == s)
                    own = b.column("page_id").to_numpy(zero_copy_only=False)[here]
                    here = here[np.argsort(own, kind="stable")]
                    some = b.take(pa.array(here))
                    own, node = some.column("page_id").to_numpy(zero_copy_only=False), some.column("node").to_numpy(zero_copy_only=False)
                    lead = np.array([-1 if v is None else v for v in some.column("leader_id").to_pylist()], np.int64)
                    free = np.array([v is None for v in some.column("leader_id").to_pylist()])
                    mine = np.array([embed(t) for t in some.column("words").to_pylist()], np.float32).astype(np.float64)
                    by_node = np.argsort(node, kind="stable")
                    if s not in vectors:
                        vectors[s] = np.array([embed(words[i]) for i in of_site[s]], np.float32)
                    for start in range(0, len(of_site[s]), 512):
                        part = of_site[s][start : start + 512]
                        scores = (vectors[s][start : start + 512].astype(np.float64) @ mine.T).round(6)
                        same = (leads[part][:, None] == lead[None, :]) & ~alone[part][:, None] & ~free[None, :]
                        scores[(nodes[part][:, None] == node[None, :]) | (ids[part][:, None] == own[None, :]) | same | (scores < least)] = -9
                        to = np.concatenate([seen[i] for i in part])
                        who = np.repeat(np.arange(len(part)), [len(seen[i]) for i in part])
                        low, high = (np.searchsorted(node[by_node], to, side) for side in ("left", "right"))
                        many = high - low
                        places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                        scores[np.repeat(who, many), by_node[places]] = -9
                        # A stable sort over rows in order of page_id gives ties to the lower one.
                        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                        q, r = np.repeat(np.arange(len(part)), best.shape[1]), best.ravel()
                        keep = scores[q, r] > -9
                        q, r = q[keep], r[keep]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([s] * len(q), pa.string()), pa.array(ids[part[q]]), pa.array(own[r]), pa.array(scores[q, r])], names=["site_id", "query_id", "page_id", "score"]
                        )

        found = found.unionByName(rows.mapInArrow(run, schema))
    w = Window.partitionBy("site_id", "query_id").orderBy(F.desc("score"), "page_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _rows(pages: DataFrame) -> DataFrame:
    """(site_id, page_id, path, words): the answered pages, once each."""
    from pagemill.functions import urls

    ok = pages.where("status between 200 and 299 and site_id is not null and page_id is not null").dropDuplicates(["site_id", "page_id"])
    return ok.select("site_id", "page_id", F.coalesce(urls.path(F.col("url")), F.col("url")).alias("path"), _words().alias("words"))


def related_pages(pages: DataFrame, k: int = 2, least: float = 0.55) -> DataFrame:
    """(query_id, page_id, score, rank): for pages whose page_id is divisible by 20, the most similar other pages of their site."""
    rows = _rows(pages).select("site_id", "page_id", F.col("page_id").alias("node"), F.lit(None).cast("bigint").alias("leader_id"), "words")
    none = rows.sparkSession.createDataFrame([], "site_id string, query_id bigint, nodes array<bigint>")
    return _similar(rows, none, k, least).drop("site_id")


def link_opportunities(pages: DataFrame, edges: DataFrame, clusters: DataFrame, k: int = 2, most: int = 30) -> DataFrame:
    """(site_id, rule_id, url, note): similar pages of a site that a queried page does not link to yet.

    Queries are the pages whose page_id is divisible by 20, against all pages of their site.  Pairs that are linked, or in
    one cluster of near-duplicates, are left out before the best ``k`` are taken; at most ``most`` a site are reported (a
    top-k report).
    """
    placed = _rows(pages).where("path is not null")
    # A path is known by its lowest page_id.
    node = cut(placed.groupBy("site_id", "path").agg(F.min("page_id").alias("node")))
    place = placed.select("site_id", "page_id", "path")
    to = edges.join(node.select("site_id", F.col("path").alias("dst"), "node"), ["site_id", "dst"])
    asked = place.where("page_id % 20 = 0").select("site_id", F.col("page_id").alias("query_id"), F.col("path").alias("src"))
    linked = asked.join(to, ["site_id", "src"]).groupBy("site_id", "query_id").agg(F.collect_list("node").alias("nodes"))
    leader = clusters.select("site_id", "page_id", "leader_id")
    rows = placed.join(node, ["site_id", "path"]).join(leader, ["site_id", "page_id"], "left").select("site_id", "page_id", "node", "leader_id", "words")
    best = _similar(rows, linked, k, least=0.55)
    a, b = (place.select("site_id", F.col("page_id").alias(c), F.col("path").alias(p)) for c, p in (("query_id", "pa"), ("page_id", "pb")))
    top = Window.partitionBy("site_id").orderBy(F.desc("score"), "query_id", "page_id")
    # The best of each salt first, so that no site is ranked in one task.
    salted = Window.partitionBy("site_id", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy(F.desc("score"), "query_id", "page_id")
    best = best.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= most)
    kept = best.withColumn("n", F.row_number().over(top)).where(F.col("n") <= most).join(a, ["site_id", "query_id"]).join(b, ["site_id", "page_id"])
    return kept.select("site_id", F.lit("link-missing-internal-opportunities").alias("rule_id"), F.col("pa").alias("url"), F.concat(F.col("pb"), F.lit(" "), F.round("score", 2)).alias("note"))
