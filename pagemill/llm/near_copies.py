"""Pages whose main bodies are nearly the same, without comparing all pairs.

A page is the set of its five-word runs.  Its fingerprint is cut into segments by content: a run belongs to the segment
of its least four-word stretch (least by hash), so neighbouring runs share a segment and a page of n runs has about 2n/3.
The popcounts of the segments are a sparse vector; the Manhattan distance of two vectors never exceeds the symmetric
difference of the sets, as every run lies in one segment.  The range join over that grid:

1. Exact copies collapse into classes by a 128-bit signature; only class representatives go on.
2. The pages of each segment are counted (combined before the shuffle).  What lies in a segment of one class alone is
   distance to every other page.
3. A cell of the grid is (segment, size step).  A page enters the cells of its rarest segments, as many as must hold
   more popcount than the largest allowed distance leaves out: if two pages share none of these, the popcounts they can
   have in common are too few.  Sizes are steps of the ratio of the threshold, so the larger of two partners lies in the
   same or the next step.
4. Inside a cell a pair lives on only if the Manhattan distance of the popcounts, summed up to SUMS coordinates, is
   within the bound; this is tested in the join itself.  What is left is tested on the whole vectors.
5. Pairs are verified exactly on the runs.

No step drops a pair that meets the threshold, and nothing but the result is quadratic in a group of copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.main_content import labelled
from pagemill.session import cut, shuffled

RUN = 5
#: Words of the stretch that names a run's segment.
STRETCH = 4
#: Coordinates that the popcounts are summed up to for the test inside a cell.
SUMS = 16
#: Classes of copies up to this size show all pairs; of larger ones each member is paired with the lowest page_id.
EXPANDED = 64
#: So many page_ids (24 bytes each) of copies are broadcast at most; beyond that the join shuffles.
BROADCAST_COPIES = 200_000
_WORDS = re.compile(r"[^\W_]+")
_word_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    if len(_word_hashes) > 300_000:
        _word_hashes.clear()
    value = _word_hashes[word] = xxhash.xxh3_64_intdigest(word)
    return value


def _mixed(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``size`` words."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ ids[k : len(ids) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def fingerprint(words: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all runs of consecutive words, and the segments they lie in with their popcounts.

    Nothing if there are fewer words than a run has.
    """
    if len(words) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    get = _word_hashes.get
    ids = np.array([get(w) or _hash(w) for w in words], np.uint64)
    runs, first = np.unique(_mixed(ids, run).view(np.int64), return_index=True)
    size = min(STRETCH, run)
    stretches = np.lib.stride_tricks.sliding_window_view(_mixed(ids, size), run - size + 1)
    segments, counts = np.unique(stretches[first].min(axis=1).view(np.int64), return_counts=True)
    return runs, segments, counts.astype(np.int32)


def run_hashes(words: list[str], run: int = RUN) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of consecutive words; none if there are fewer words."""
    return fingerprint(words, run)[0]


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, kind)))


def page_sets(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, signature, runs, segments, counts) of every page whose main body has a run of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, signs, prints = [], [], []
            page_ids = b.column("page_id").to_pylist()
            for pid, (page, main) in zip(page_ids, labelled(b.column("html").to_pylist())):
                words: list[str] = []
                for block, y in zip(page, main):
                    if y and block.no >= 0:
                        words += _WORDS.findall(block.text.casefold())
                found = fingerprint(words, run)
                if len(found[0]):
                    ids.append(pid)
                    signs.append(xxhash.xxh3_128_digest(found[0].tobytes()))
                    prints.append(found)
            lists = [_lists([f[k] for f in prints], kind) for k, kind in enumerate((np.int64, np.int64, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(signs, pa.binary()), *lists], names=["page_id", "signature", "runs", "segments", "counts"])

    source = pages.where("page_id is not null and html is not null").select("page_id", "html")
    return source.mapInArrow(work, "page_id bigint, signature binary, runs array<bigint>, segments array<bigint>, counts array<int>")


def _manhattan(a: str, b: str) -> Column:
    total = F.lit(0)
    for word in range(SUMS // 8):
        for k in range(8):
            x, y = (F.shiftrightunsigned(F.col(f"{side}.sum{word}"), 8 * k).bitwiseAND(F.lit(255)) for side in (a, b))
            total = total + F.abs(x - y)
    return total


def classes(sets: DataFrame) -> DataFrame:
    """(page_id, row, n, rep, rep_row): every page once, with the lowest page_id of its class of equal sets."""
    page = sets.groupBy("page_id").agg(F.max(F.struct("signature", "row", "n")).alias("m")).select("page_id", "m.*")
    first = page.groupBy("signature").agg(F.min(F.struct("page_id", "row")).alias("r"))
    rep = first.select("signature", F.col("r.page_id").alias("rep"), F.col("r.row").alias("rep_row"))
    return page.join(rep, "signature").drop("signature")


def representatives(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(page_id, n, runs, segments, counts) of the class representatives.

    The rows to leave out are broadcast only if they were counted to be at most BROADCAST_COPIES.
    """
    held = members.where("page_id = rep").select(F.col("rep_row").alias("row"))
    others = cut(sets.select("row").join(held, "row", "left_anti"))
    small = others.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    return sets.drop("signature").join(F.broadcast(others) if small else others, "row", "left_anti").drop("row")


def vectors(reps: DataFrame) -> DataFrame:
    """(page_id, n, vector): per page the popcounts of the segments it shares with others, the rarest segment first.

    ``vector`` is an array of (pages, segment, count); pages without a shared segment are left out.
    """
    cells = reps.select("page_id", "n", F.explode(F.arrays_zip("segments", "counts")).alias("c")).select("page_id", "n", F.col("c.segments").alias("segment"), F.col("c.counts").cast("smallint").alias("count"))
    rarity = cells.groupBy("segment").agg(F.count("*").alias("pages")).where("pages > 1").select("segment", F.least("pages", F.lit(32767)).cast("smallint").alias("pages"))
    return cells.join(shuffled(rarity), "segment").groupBy("page_id", "n").agg(F.array_sort(F.collect_list(F.struct("pages", "segment", "count"))).alias("vector"))


def posts(vector: DataFrame, percent: int) -> DataFrame:
    """(page_id, size, sum0.., cells, above): where each page enters the grid, and what its bound is tested on.

    ``cells`` are hashes of (segment, size step), ``above`` those of the next step.  ``size`` holds the number of runs in
    its upper half and in its lower half what is alone, the popcount outside shared segments; ``sum0..`` hold the popcounts inside summed up to SUMS coordinates by
    the segments' leading bits, eight to a bigint; a sum above 255 is stored as 255, which can only lower a distance.
    Pages that share too little with all others are left out.
    """
    shift, words = 64 - (SUMS - 1).bit_length(), SUMS // 8

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            bounds = lists.offsets.to_numpy()
            flat = lists.values
            segment, count = flat.field("segment").to_numpy(), flat.field("count").to_numpy().astype(np.int64)
            n = b.column("n").to_numpy().astype(np.int64)
            rows, alone, sums, cells, above = [], [], [], [], []
            for i in range(b.num_rows):
                own = slice(bounds[i], bounds[i + 1])
                left = np.cumsum(count[own][::-1])[::-1]
                # Partners share at least this much; the cells to enter leave less than that of popcount out.
                wanted = -(-n[i] * percent // 100)
                enter = int((left >= wanted).sum())
                if enter:
                    rows.append(i)
                    alone.append(n[i] - left[0])
                    places = (segment[own].view(np.uint64) >> np.uint64(shift)).astype(np.int64)
                    sums.append(np.minimum(np.bincount(places, weights=count[own], minlength=SUMS), 255).astype(np.uint8))
                    step = int(np.log(n[i]) / np.log(100 / percent) + 1e-9)
                    for k, out in enumerate((cells, above)):
                        out.append(segment[own][:enter] ^ np.int64((step + k) * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF))
            packed = np.array(sums, np.uint8).reshape(-1, SUMS).view(np.int64).reshape(-1, words)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("page_id"), pa.array((n[rows] << 32) + np.array(alone, np.int64)), *(pa.array(packed[:, k]) for k in range(words)), _lists(cells, np.int64), _lists(above, np.int64)],
                names=["page_id", "size", *(f"sum{k}" for k in range(words)), "cells", "above"],
            )

    coordinates = ", ".join(f"sum{k} bigint" for k in range(words))
    return vector.mapInArrow(work, f"page_id bigint, size bigint, {coordinates}, cells array<bigint>, above array<bigint>")


def candidates(entered: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``posts`` that meet in a cell of the grid within the Manhattan bound; a has the smaller set."""
    kept = ["page_id", "size", *(f"sum{k}" for k in range(SUMS // 8))]
    left = entered.select(*kept, F.explode(F.concat("cells", "above")).alias("cell"))
    right = entered.select(*kept, F.explode("cells").alias("cell"))
    n = lambda x: F.shiftright(F.col(f"{x}.size"), 32)
    alone = lambda x: F.col(f"{x}.size").bitwiseAND(F.lit((1 << 32) - 1))
    # |A^B| <= (1-t)/(1+t) (|A|+|B|), and what only one page has is in it whole.
    most = (n("l") + n("r")) * (100 - percent)
    least = (alone("l") + alone("r") + _manhattan("l", "r")) * (100 + percent)
    ordered = (n("l") < n("r")) | ((n("l") == n("r")) & (F.col("l.page_id") < F.col("r.page_id")))
    met = left.alias("l").join(shuffled(right).alias("r"), (F.col("l.cell") == F.col("r.cell")) & ordered & (least <= most))
    return met.select(F.col("l.page_id").alias("a"), F.col("r.page_id").alias("b")).distinct()


def similar_classes(reps: DataFrame, entered: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of representatives whose sets share at least ``percent`` of their union; a has the smaller set."""
    pairs = candidates(entered, percent)
    one, two = (reps.select(F.col("page_id").alias(x), F.col("n").alias(f"n{x}"), F.col("runs").alias(f"r{x}")) for x in "ab")
    common = F.size(F.array_intersect("ra", "rb"))
    return pairs.join(shuffled(one), "a").join(shuffled(two), "b").where(common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def near_copies(pages: DataFrame, percent: int = 60, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """Membership (page_id, rep) of the classes of equal bodies, and the similar pairs (a, b) of representatives.

    Pages without a run of ``run`` words in the main body, null page_ids and null html take no part; repeated rows of
    a page_id count once if their html is the same.  An empty table gives two empty tables.
    """
    sets = cut(page_sets(pages, run).withColumns({"row": F.monotonically_increasing_id(), "n": F.size("runs")}))
    members = cut(classes(sets))
    reps = representatives(sets, members)
    return members, similar_classes(reps, cut(posts(vectors(reps), percent)), percent)


def near_pairs(pages: DataFrame, percent: int = 60, run: int = RUN) -> DataFrame:
    """(page_id_a, page_id_b), a < b: the pairs of pages, copies expanded up to EXPANDED members of a class."""
    members, pairs = near_copies(pages, percent, run)
    pairs = cut(pairs)
    several = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1")
    shown = members.join(several, "rep", "left").select(
        "rep", "page_id", F.coalesce("size", F.lit(1)).alias("size"), (F.coalesce("size", F.lit(1)) <= EXPANDED).alias("whole")
    )
    group = shown.where("size > 1")
    within = (
        group.where("whole or page_id = rep").select("rep", F.col("page_id").alias("p"))
        .join(group.select("rep", F.col("page_id").alias("q")), "rep").where("p < q").select("p", "q")
    )
    ends = shown.where("whole or page_id = rep").select("rep", "page_id")
    across = (
        pairs.join(ends.select(F.col("rep").alias("a"), F.col("page_id").alias("p")), "a")
        .join(ends.select(F.col("rep").alias("b"), F.col("page_id").alias("q")), "b")
        .select("p", "q")
    )
    low, high = F.least("p", "q").alias("page_id_a"), F.greatest("p", "q").alias("page_id_b")
    return within.unionByName(across).select(low, high)


def near_groups(pages: DataFrame, percent: int = 60, run: int = RUN) -> DataFrame:
    """(page_id, class_id, links): one row per page; links counts the other classes similar to its own."""
    members, pairs = near_copies(pages, percent, run)
    both = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return (
        members.select("page_id", F.col("rep").alias("class_id"))
        .join(both, "class_id", "left")
        .select("page_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    )


def near_links(pages: DataFrame, percent: int = 60, run: int = RUN) -> DataFrame:
    """(class_id_a, class_id_b), a < b: the similar pairs of classes of equal bodies; with near_groups whole at any class size."""
    pairs = near_copies(pages, percent, run)[1]
    return pairs.select(F.least("a", "b").alias("class_id_a"), F.greatest("a", "b").alias("class_id_b"))
