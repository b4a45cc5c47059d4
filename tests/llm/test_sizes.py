"""Token sizes, packing and mixing."""

import random

import pytest

from pagemill.llm import mixing, packing, token_sizes


def least_containers(sizes, capacity):
    """The optimum of a small instance by exhaustive search."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(order):
            best = len(bins)
            return
        tried = set()
        for k, room in enumerate(bins):
            if room >= order[i] and room not in tried:
                tried.add(room)
                bins[k] -= order[i]
                place(i + 1, bins)
                bins[k] += order[i]
        bins.append(capacity - order[i])
        place(i + 1, bins)
        bins.pop()

    order = sorted(sizes, reverse=True)
    place(0, [])
    return best


def unpack(patterns):
    return sorted(s for sizes, times in patterns for s, n in sizes.items() for _ in range(n * times))


@pytest.mark.parametrize("seed", range(25))
def test_packing_holds_every_item_and_is_near_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 11))]
    histogram = {s: sizes.count(s) for s in sizes}
    got = packing.pack(histogram, capacity)
    assert unpack(got) == sorted(sizes) and all(sum(s * n for s, n in p.sizes.items()) <= capacity for p in got)
    assert sum(p.times for p in got) <= least_containers(sizes, capacity) + 1


@pytest.mark.parametrize("seed", range(25))
def test_reduction_loses_no_container(seed):
    rng = random.Random(100 + seed)
    sizes = [rng.randint(4, 20) for _ in range(9)]
    left = packing._Sizes({s: sizes.count(s) for s in sizes})
    fixed = packing.reduce_dominated(left, 20)
    rest = [s for s, n in left.count.items() for _ in range(n)]
    assert sum(p.times for p in fixed) + least_containers(rest, 20) == least_containers(sizes, 20)


def test_packing_of_billions_is_decided_on_the_histogram():
    got = packing.pack({60: 10**9, 40: 10**9, 33: 3 * 10**9 + 1}, 100)
    assert sum(p.times for p in got) == 2 * 10**9 + 1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


SPEC = "spec_name string, capacity_tokens int"


def test_packed_documents(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(1, 40), "a") for i in range(200)] + [(1000, "word " * 333, "a"), (1001, "", "a"), (1002, None, "a"), (1003, "word " * 128, "a")]
    df = documents(spark, rows).coalesce(3).withColumnsRenamed({"source": "size"})
    got = packing.packed(df, spark.createDataFrame([("s", 64), ("s", 64), ("t", 1000), (None, 5), ("zero", 0)], SPEC)).collect()
    assert {r.spec_name for r in got} == {"s", "t"} and len({(r.spec_name, r.doc_id, r.piece) for r in got}) == len(got)
    for spec, capacity in (("s", 64), ("t", 1000)):
        own = [r for r in got if r.spec_name == spec]
        filled = {}
        for r in own:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
        assert max(filled.values()) <= capacity
        for i, text, _ in rows:
            if text is not None:
                n = token_sizes.count_tokens(text)
                pieces = sorted((r.start_token, r.n_tokens) for r in own if r.doc_id == i)
                assert sum(x for _, x in pieces) == n and (len(pieces) == 1 or n > capacity)
                assert all(a + x == b for (a, x), (b, _) in zip(pieces, pieces[1:]))
    total = packing.filling(df, spark.createDataFrame([("s", 64)], SPEC)).first()
    assert total.containers <= total.least + 2
    assert packing.packed(df.where("doc_id < 0"), spark.createDataFrame([("s", 64)], SPEC)).count() == 0
    assert packing.packed(df, spark.createDataFrame([], SPEC)).count() == 0


def test_long_texts_count_like_whole_ones(monkeypatch):
    text = "Die Lampen halten, it's 42 lamps!\n\n" * 300 + "x" * 500
    whole = token_sizes.count_tokens(text)
    monkeypatch.setattr(token_sizes, "STRETCH", 100)
    assert token_sizes.count_tokens(text) == whole


def test_mix(spark):
    rows = [(i, "word " * 20, "big") for i in range(300)] + [(1000 + i, "word " * 10, "small") for i in range(20)] + [(5000, None, "big"), (5001, "word", None), (5002, "word " * 9, "unnamed")]
    target = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2), ("big", None, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(documents(spark, rows), target).collect()
    assert {r.source for r in got} == {"big", "small"} and max(r.repeat for r in got) == 3
    assert len({(r.doc_id, r.repeat) for r in got}) == len(got)
    tokens = {s: sum(r.tokens for r in got if r.source == s) for s in ("big", "small")}
    assert abs(tokens["big"] / sum(tokens.values()) - 2 / 3) < 0.02
    positions = [r.position for r in got]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    early = [r for r in got if r.position < 0.5]
    # Short documents come rather early, long ones rather late, as the schedule says.
    assert sum(r.tokens for r in early if r.source == "small") > 0.55 * tokens["small"]
    share = {r.source: r for r in mixing.shares(documents(spark, rows), target).collect()}
    assert share["none"].tokens == 0 and share["small"].most_repeats == 4
    capped = mixing.streams([("a", 0.5, 1), ("b", 0.5, 1)], {"a": (100, 10), "b": (1000, 10)}, 1000)
    assert [s.demand for s in capped] == [100, 500]
    assert mixing.mix(documents(spark, []), target).count() == 0


def test_schedule_sums_to_one():
    plan = mixing.streams([("a", 0.2, 3), ("b", 0.5, 3), ("c", 0.3, 3)], {"a": (100, 50), "b": (9000, 10), "c": (500, 20)})
    for x in (0, 0.3, 1):
        assert abs(sum(s.share * (1 + s.slope * (2 * x - 1)) for s in plan) - 1) < 1e-9
    assert all(abs(s.slope) <= mixing.DRIFT + 1e-9 for s in plan)


def test_packing_at_a_long_context_capacity():
    """All sizes up to 32,768, which took longer than anyone waits when every sum was built for each filling."""
    import time

    from pagemill.llm.packing import pack

    histogram = {s: 1 + s * 7919 % 50 for s in range(1, 32_769)}
    began = time.time()
    patterns = pack(histogram, 32_768)
    assert time.time() - began < 60
    placed: dict[int, int] = {}
    for filling, times in patterns:
        assert sum(s * n for s, n in filling.items()) <= 32_768
        for s, n in filling.items():
            placed[s] = placed.get(s, 0) + n * times
    assert placed == histogram
    least = -(-sum(s * n for s, n in histogram.items()) // 32_768)
    assert sum(p.times for p in patterns) <= 1.005 * least
