"""The whole comparison of snapshots on a small history with a change of host, certificates and field measures."""

from datetime import datetime

from pagemill.operators import diff_report as R
from pagemill.operators import snapshot_diff as D

SNAP = (
    "snapshot_id string, url string, origin string, taken_at timestamp, loaded_at timestamp, overall int, geo_score int, category_scores map<string,int>, "
    "robots struct<status:int,hash:string,googlebot_allowed:boolean,ai_search_blocked:array<string>>, sitemap struct<present:boolean,urls:int>, "
    "tls struct<trusted:boolean,days_left:int>, vitals map<string,struct<p75:double,rating:string>>"
)
STATE = "snapshot_id string, path string, status int, title string, description string, canonical string, noindex_meta boolean, noindex_header boolean, h1 string, redirected_to string, loaded_at timestamp"
ISSUE = "snapshot_id string, rule_id string, impact string, category string, title string, paths array<string>"


def day(n):
    return datetime(2025, 1, 1 + n)


def history(spark):
    robots = [(200, "h", True, []), (200, "h", True, []), (200, "x", False, [])]
    tls, field = [(True, 90), (False, 2), (True, 3)], [{"lcp": (2000.0, "good")}, {"lcp": (4500.0, "poor")}, {"lcp": (2000.0, "good")}]
    snaps = [(s, "u", o, day(i), day(i), v, g, {"a": v}, robots[i], (True, 20), tls[i], field[i]) for i, (s, o, v, g) in enumerate([("s1", "https://a", 90, 50), ("s2", "https://a", 80, 60), ("s3", "https://b", 80, None)])]
    page = lambda s, p, status=200, hidden=False: (s, p, status, "t", "d", None, False, hidden, "h", None, day(0))
    states = [page("s1", "/"), page("s1", "/x"), page("s2", "/"), page("s2", "/x", 500), page("s2", "/new"), page("s3", "/", hidden=True), page("s3", "/new")]
    issues = [
        ("s1", "r1", "high", "c", "t", ["/"]), ("s2", "r1", "high", "c", "t", ["/", "/x"]), ("s2", "r2", "critical", "c", "t", ["/"]), ("s3", "r1", "high", "c", "t", ["/"]),
        ("s3", "indexing-noindex", "critical", "c", "t", ["/"]),
    ]
    return spark.createDataFrame(snaps, SNAP), spark.createDataFrame(states, STATE), spark.createDataFrame(issues, ISSUE)


def test_changes_levels_and_gates(spark):
    s, p, i = history(spark)
    got = {(r.snapshot_id, r.kind, r.level) for r in R.changes(s, p, i).collect()}
    assert got == {
        ("s2", "page-error", "critical"), ("s2", "pages-added", "info"), ("s2", "score-drop", "warning"), ("s2", "tls-invalid", "critical"), ("s2", "vitals-regressed", "warning"),
        ("s2", "worsened-issue", "warning"), ("s2", "new-issue", "critical"),
    }
    assert {tuple(r) for r in R.environment(s, p, i).collect()} == {("s3", "/"), ("s3", "indexing-noindex")}
    rows = {r.snapshot_id: r for r in R.summary(s, p, i).collect()}
    assert (rows["s2"].level, rows["s2"].critical, rows["s2"].overall_delta, rows["s2"].geo_delta) == ("critical", 3, -10, 10)
    assert (rows["s3"].level, rows["s3"].crossed, rows["s3"].geo_delta) == ("none", True, None)
    for gate, want in (("new", {("s2", True), ("s3", False)}), ("critical", {("s2", True), ("s3", False)}), ("none", {("s2", False), ("s3", False)})):
        assert {tuple(r) for r in R.fails(s, p, i, gate).collect()} == want
    body = {r.snapshot_id: r.body for r in R.markdown(s, p, i).collect()}
    assert body["s2"].startswith("Score 90 to 80\n\n| | Change |") and "**critical** | /x page-error" in body["s2"] and body["s3"].endswith("Fixed: r2")


def test_kept_snapshots(spark, tmp_path):
    s, p, i = history(spark)
    D.keep(p, i, str(tmp_path / "kept"), ranges=2)
    got = {(r.record_kind, r.record_key, r.change, tuple(r.fields or ())) for r in D.changes_of_kept(spark, str(tmp_path / "kept"), "s1", "s2").collect()}
    assert got == {("page", "/x", "changed", ("status",)), ("page", "/new", "added", ()), ("issue", "r1", "changed", ("paths",)), ("issue", "r2", "added", ())}
    whole = {(r.record_kind, r.record_key, r.change) for r in D.snapshot_changes(s, p, i).where("snapshot_id = 's2'").collect()}
    assert whole == {g[:3] for g in got}
