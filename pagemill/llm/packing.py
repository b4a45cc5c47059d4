"""Filling fixed-capacity containers with whole documents.

Documents of one size are interchangeable, so the packing is decided on the histogram of sizes, which has at most
capacity rows however many documents there are.  Martello-Toth dominance fixes sets of sizes that no other choice can
beat, many at a time; what is left is packed best-fit, container by container pattern, the fullest that the remaining
sizes allow.  Documents then find their container by their rank among those of their size, which is counted
distributed, split by partition, so that no size gathers in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.token_sizes import VOCABULARY, sized
from pagemill.session import cut


class Pattern(NamedTuple):
    """A filling by sizes and counts, and how many containers have it."""

    sizes: dict[int, int]
    times: int


class _Sizes:
    """A multiset of sizes: counts, the distinct sizes in order, and a table of the counts by size."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {s: n for s, n in histogram.items() if n > 0}
        self.order = sorted(self.count)
        self.table = np.zeros(self.order[-1] + 2 if self.order else 1, np.int64)
        for s, n in self.count.items():
            self.table[s] = n

    def take(self, size: int, n: int) -> None:
        left = self.count[size] - n
        self.table[size] = left
        if left:
            self.count[size] = left
        else:
            del self.count[size]
            del self.order[bisect_left(self.order, size)]

    def give(self, size: int, n: int) -> None:
        if size not in self.count:
            insort(self.order, size)
        self.count[size] = self.count.get(size, 0) + n
        self.table[size] = self.count[size]

    def at_most(self, bound: int) -> int | None:
        i = bisect_right(self.order, bound)
        return self.order[i - 1] if i else None


def _fit(sizes: _Sizes, large: int, room: int) -> int | None:
    """The largest size that fits into ``room`` beside one item of size ``large``."""
    other = sizes.at_most(room)
    if other == large and sizes.count[large] < 2:
        i = bisect_left(sizes.order, large)
        other = sizes.order[i - 1] if i else None
    return other


def _smallest(sizes: _Sizes, large: int, n: int) -> list[int]:
    """The n smallest items beside one item of size ``large``."""
    out: list[int] = []
    for s in sizes.order:
        out += [s] * min(n - len(out), sizes.count[s] - (s == large))
        if len(out) == n:
            break
    return out


def _pair(sizes: _Sizes, room: int) -> tuple[int, int]:
    """Two items of the largest sum that fits into ``room``, the larger first; (0, 0) if no two fit."""
    order = np.flatnonzero(sizes.table[: max(0, room) + 1])
    # Beside each item the largest that fits and is not larger; an item that stands once needs a smaller one.
    at = np.searchsorted(order, np.minimum(order, room - order), "right") - 1
    at -= (at >= 0) & (order[at] == order) & (sizes.table[order] < 2)
    sums = np.where(at >= 0, order + order[at], 0)
    if not len(sums) or sums.max() == 0:
        return 0, 0
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return int(order[best]), int(order[at[best]])


def _best_pair(sizes: _Sizes, large: int, room: int) -> int:
    """The largest sum of two items that fit into ``room`` beside one of size ``large``; 0 if none do."""
    sizes.table[large] -= 1
    found = sum(_pair(sizes, room))
    sizes.table[large] += 1
    return found


def reduce_dominated(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Fixes fillings that dominate all others of their largest item, largest first, and takes them out.

    An item alone dominates if nothing fits beside it.  The largest item that fits beside it dominates if it fills the
    container, or no two others fit, or no two that fit fill more and no three fit.
    """
    fixed: list[Pattern] = []
    for large in reversed(list(sizes.order)):
        while large in sizes.count:
            room = capacity - large
            other = _fit(sizes, large, room)
            if other is None:
                n = sizes.count[large]
                sizes.take(large, n)
                fixed.append(Pattern({large: 1}, n))
                break
            dominates = other == room
            if not dominates:
                three = _smallest(sizes, large, 3)
                dominates = len(three) < 2 or three[0] + three[1] > room
                if not dominates and (len(three) < 3 or sum(three) > room):
                    dominates = _best_pair(sizes, large, room) <= other
            if not dominates:
                break
            if other == large:
                n = sizes.count[large] // 2
                sizes.take(large, 2 * n)
                fixed.append(Pattern({large: 2}, n))
            else:
                n = min(sizes.count[large], sizes.count[other])
                sizes.take(large, n)
                sizes.take(other, n)
                fixed.append(Pattern({large: 1, other: 1}, n))
    return fixed


def _exactly(sizes: _Sizes, order: np.ndarray, goal: int) -> dict[int, int] | None:
    """One, two or three items whose sum is ``goal``, the largest first; None if there are none."""
    table = sizes.table

    def has(*items: int) -> bool:
        return all(table[s] >= items.count(s) for s in items)

    if goal < len(table) and table[goal]:
        return {goal: 1}
    rest = goal - order
    fits = (rest > 0) & (rest <= order) & (table[np.clip(rest, 0, len(table) - 1)] > 0)
    for i in np.flatnonzero(fits)[::-1]:
        a, b = int(order[i]), int(rest[i])
        if has(a, b):
            return {a: 1, b: 1} if a != b else {a: 2}
    for a in order[::-1]:
        a = int(a)
        if 3 * a < goal:
            break
        second = order[: np.searchsorted(order, min(a, goal - a - 1), "right")]
        third = goal - a - second
        fits = (third > 0) & (third <= second)
        fits[fits] = table[third[fits]] > 0
        for i in np.flatnonzero(fits)[::-1]:
            items = (a, int(second[i]), int(third[i]))
            if has(*items):
                return {s: items.count(s) for s in items}
    return None


def _fullest(sizes: _Sizes, room: int) -> dict[int, int]:
    """Items whose sum is the largest that fits into ``room``.

    No sum exceeds the largest multiple of the sizes' common divisor.  Up to three items that reach it are looked for
    in the table of sizes; else all sums are built, bit k of a set being the sum k, until it is reached.
    """
    order = np.flatnonzero(sizes.table[: room + 1])
    if not len(order):
        return {}
    least = _smallest(sizes, 0, 3)
    if len(least) < 3 or sum(least) > room:
        # No three fit: one or two do best.
        one, pair = int(order[-1]), _pair(sizes, room)
        return {one: 1} if one >= sum(pair) else {pair[0]: 1, pair[1]: 1} if pair[0] != pair[1] else {pair[0]: 2}
    goal = room - room % int(np.gcd.reduce(order))
    few = _exactly(sizes, order, goal)
    if few is not None:
        return few
    reach, mask = [1], (1 << (goal + 1)) - 1
    used: list[int] = []
    for s in order.tolist():
        bits, left, step = reach[-1], min(sizes.count[s], room // s), 1
        while left > 0:
            n = min(step, left)
            bits |= (bits << (s * n)) & mask
            left, step = left - n, step * 2
        reach.append(bits)
        used.append(s)
        if bits >> goal & 1:
            break
    goal = reach[-1].bit_length() - 1
    out: dict[int, int] = {}
    for i in range(len(used) - 1, -1, -1):
        s = used[i]
        for n in range(min(sizes.count[s], goal // s), 0, -1):
            if reach[i] >> (goal - s * n) & 1:
                out[s] = n
                goal -= s * n
                break
        if goal == 0:
            break
    return out


def best_fit(sizes: _Sizes, capacity: int) -> list[Pattern]:
    """Packs what is left: the largest item with the fullest filling beside it, as often as the sizes last."""
    out: list[Pattern] = []
    while sizes.order:
        large = sizes.order[-1]
        sizes.take(large, 1)
        filling = _fullest(sizes, capacity - large)
        sizes.give(large, 1)
        filling[large] = filling.get(large, 0) + 1
        times = min(sizes.count[s] // n for s, n in filling.items())
        for s, n in filling.items():
            sizes.take(s, n * times)
        out.append(Pattern(filling, times))
    return out


def pack(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Fillings for all items; sizes must be from 1 to ``capacity``."""
    sizes = _Sizes(histogram)
    return reduce_dominated(sizes, capacity) + best_fit(sizes, capacity)


def _slots(plans: dict[int, list[Pattern]]) -> np.ndarray:
    """(spec, size, first rank, first container, items per container) in order."""
    rows = []
    for spec, patterns in plans.items():
        used: dict[int, int] = {}
        base = 0
        for filling, times in patterns:
            for s, n in filling.items():
                rows.append((spec, s, used.get(s, 0), base, n))
                used[s] = used.get(s, 0) + n * times
            base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def specs_of(container_spec: DataFrame) -> list[tuple[int, str, int]]:
    """(number, name, capacity) of a table of a few fixed rows; rows without name or a positive capacity are left out."""
    rows = container_spec.where("spec_name is not null and capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct()
    return [(i, r[0], int(r[1])) for i, r in enumerate(sorted(rows.collect()))]


def _items(documents: DataFrame, specs: list[tuple[int, str, int]], vocabulary: str) -> DataFrame:
    """(doc_id, tokens, pid, spec, capacity, size): what each document leaves to pack for each spec."""
    sizes = cut(sized(documents, ["doc_id"], vocabulary).withColumn("pid", F.spark_partition_id()))
    each = F.array(*[F.struct(F.lit(i).alias("spec"), F.lit(c).cast("bigint").alias("capacity")) for i, _, c in specs])
    rest = F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens"))
    return sizes.select("doc_id", "tokens", "pid", F.explode(each).alias("e")).select("doc_id", "tokens", "pid", "e.*").withColumn("size", rest)


def packed(documents: DataFrame, container_spec: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_name, container_id, doc_id, piece, start_token, n_tokens).

    A document above the capacity is split into full pieces, each its own container, and a rest that is packed like a
    document.  Documents without tokens go into containers of their own kind ('empty').  Null texts are left out; doc_id
    must be unique.  Container ids are unique inside a spec.
    """
    schema = "spec_name string, container_id string, doc_id bigint, piece int, start_token bigint, n_tokens bigint"
    specs = specs_of(container_spec)
    if not specs:
        return documents.sparkSession.createDataFrame([], schema)
    items = _items(documents, specs, vocabulary)
    counts = cut(items.where("size > 0").groupBy("spec", "size", "pid").agg(F.count("*").alias("n")))
    # At most the sum of the capacities many rows.
    histogram = counts.groupBy("spec", "size").agg(F.sum("n").alias("n")).collect()
    plans = {i: pack({r["size"]: r["n"] for r in histogram if r["spec"] == i}, c) for i, _, c in specs}
    slots = _slots(plans)
    before = F.sum("n").over(Window.partitionBy("spec", "size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("spec", "size", "pid", F.coalesce(before, F.lit(0)).alias("offset"))
    key = ["spec", "size", "pid"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")) - 1 + F.col("offset")
    ranked = items.where("size > 0").join(offsets, key).select("spec", "size", "doc_id", "tokens", "capacity", place.alias("rank"))
    width = int(slots[:, 1].max()) + 1 if len(slots) else 1
    group = slots[:, 0] * width + slots[:, 1]

    def place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, first = np.unique(group, return_index=True)
        last = np.append(first[1:], len(group))
        for b in batches:
            spec, size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("spec", "size", "rank"))
            own = spec * width + size
            found = np.empty(len(own), np.int64)
            for k in np.unique(own):
                i = np.searchsorted(heads, k)
                rows = own == k
                found[rows] = first[i] + np.searchsorted(slots[first[i] : last[i], 2], rank[rows], "right") - 1
            container = slots[found, 3] + (rank - slots[found, 2]) // slots[found, 4]
            kept = [b.column(c) for c in ("spec", "size", "doc_id", "tokens", "capacity")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(container, pa.int64())], names=["spec", "size", "doc_id", "tokens", "capacity", "container"])

    placed = ranked.mapInArrow(place_all, "spec int, size bigint, doc_id bigint, tokens bigint, capacity bigint, container bigint")
    names = F.element_at(F.array(*[F.lit(n) for _, n, _ in specs]), F.col("spec") + 1).alias("spec_name")
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    rest = placed.select(
        names, F.concat(F.lit("b"), F.col("container")).alias("container_id"), "doc_id",
        F.when(F.col("tokens") > F.col("capacity"), whole).otherwise(0).cast("int").alias("piece"),
        (F.col("tokens") - F.col("size")).alias("start_token"), F.col("size").alias("n_tokens"),
    )
    full = (
        items.where("tokens > capacity")
        .select(names, "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
        .select(
            "spec_name", F.concat_ws(".", F.concat(F.lit("d"), F.col("doc_id")), F.col("piece")).alias("container_id"), "doc_id",
            F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"),
        )
    )
    empty = items.where("tokens = 0").select(names, F.lit("empty").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"))
    return rest.unionByName(full).unionByName(empty)


def filling(documents: DataFrame, container_spec: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(spec_name, capacity, containers, least, tokens): containers used, and the least that the tokens could need."""
    used = packed(documents, container_spec, vocabulary).where("n_tokens > 0")
    spec = container_spec.where("spec_name is not null and capacity_tokens > 0").select("spec_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    by_container = used.groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    return (
        by_container.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
        .join(F.broadcast(spec), "spec_name")
        .select("spec_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens")
    )
