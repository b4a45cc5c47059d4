from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagemill.operators import snapshot_diff as D

SNAP = "snapshot_id string, url string, taken_at timestamp, loaded_at timestamp"
STATE = "snapshot_id string, path string, status int, title string, description string, canonical string, noindex_meta boolean, noindex_header boolean, h1 string, redirected_to string, loaded_at timestamp"
ISSUE = "snapshot_id string, rule_id string, impact string, category string, title string, paths array<string>"


def day(n):
    return datetime(2025, 1, 1 + n)


def run(spark, snaps, states, issues=()):
    s = spark.createDataFrame([(i, u, t and day(t), day(0)) for i, u, t in snaps], SNAP)
    p = spark.createDataFrame([(i, k, st_, t, None, None, None, None, None, None, day(n)) for i, k, st_, t, n in states], STATE)
    q = spark.createDataFrame([(i, r, "low", "c", "t", paths) for i, r, paths in issues], ISSUE)
    return sorted(tuple(r) for r in D.snapshot_changes(s, p, q).collect())


def test_typed_changes_gaps_and_order(spark):
    snaps = [("b", "u", 2), ("a", "u", 1), ("c", "u", 3), ("x", "v", 1), ("n", None, 1), ("m", "u", None)]
    states = [("a", "/1", 200, "t", 1), ("c", "/1", 200, "t", 1), ("a", "/2", 200, "t", 1), ("b", "/2", 404, "t", 1), ("c", "/2", 404, "t", 1), ("x", "/9", 200, "t", 1), ("zz", "/0", 200, "t", 1)]
    assert run(spark, snaps, states) == [("b", "page", "/1", "removed"), ("b", "page", "/2", "changed"), ("c", "page", "/1", "added")]


def test_last_load_holds_and_null_equals_empty(spark):
    snaps = [("a", "u", 1), ("b", "u", 2), ("b", "u", 2)]
    states = [("a", "/1", 200, None, 1), ("b", "/1", 500, "x", 1), ("b", "/1", 200, "", 2), ("b", "/1", 200, "", 2), ("b", None, 1, "", 1)]
    assert run(spark, snaps, states) == []


def test_issues_compare_paths_as_sets(spark):
    snaps = [("a", "u", 1), ("b", "u", 2), ("c", "u", 3)]
    issues = [("a", "r", ["/2", "/1", "/1"]), ("b", "r", ["/1", "/2"]), ("b", "r", ["/1", "/2"]), ("a", "s", None), ("b", "s", [])]
    assert run(spark, snaps, [], issues) == [("c", "issue", "r", "removed"), ("c", "issue", "s", "removed")]


def test_empty_tables(spark):
    assert run(spark, [], []) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 5), st.sampled_from("abc"), st.integers(0, 2)), max_size=15))
def test_equals_pairwise_comparison(spark, rows):
    snaps = [(f"s{i}", "u", i) for i in range(1, 6)]
    held = {}
    for i, k, v in rows:
        held[i, k] = v
    got = run(spark, snaps, [(f"s{i}", k, v, None, 1) for (i, k), v in held.items()])
    want = []
    for i in range(2, 6):
        for k in "abc":
            a, b = held.get((i - 1, k)), held.get((i, k))
            if a != b:
                want.append((f"s{i}", "page", k, "added" if a is None else "removed" if b is None else "changed"))
    assert got == sorted(want)


def test_regressions(spark):
    s = spark.createDataFrame([("a", "u", day(1), day(0)), ("b", "u", day(2), day(0))], SNAP)
    p = spark.createDataFrame(
        [
            ("a", "/e", 200, "t", None, None, False, False, "h", None, day(1)), ("b", "/e", 404, "t", None, None, False, False, "h", None, day(1)),
            ("a", "/n", 200, "t", "d", None, False, False, "h", None, day(1)), ("b", "/n", 200, "t", None, "/x", True, False, None, None, day(1)),
            ("b", "/new", 200, "t", None, None, False, False, "h", None, day(1)),
        ],
        STATE,
    )
    got = {(r.kind, r.level, r.path) for r in D.page_regressions(s, p).collect()}
    assert got == {
        ("page-error", "critical", "/e"), ("noindex-added", "critical", "/n"), ("canonical-changed", "warning", "/n"), ("h1-removed", "warning", "/n"), ("description-removed", "warning", "/n"),
    }
