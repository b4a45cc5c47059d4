"""The whole audit is planned rule by rule: no one plan reads the tables for all of its rules."""

import time

from pagemill.operators import scoring
from pagemill.plans import entry
from pagemill.session import cut


def test_full_audit_joins_no_plans_of_its_parts(spark):
    found = entry.queries()["full_audit"](spark, "/root/testdata/sf0.001")
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_counted_as_their_union(spark):
    rows = [("s", "img-broken"), ("s", "img-broken"), ("t", "img-broken"), ("s", "schema-missing")]
    parts = [spark.createDataFrame(some, "site_id string, rule_id string") for some in (rows[:1], rows[1:3], rows[3:])]
    whole = scoring.issues(spark.createDataFrame(rows, "site_id string, rule_id string"))
    assert sorted(scoring.issues_of(parts).collect()) == sorted(whole.collect()) and whole.count() == 3


def test_a_cut_leaves_no_shuffle_files(spark):
    blocks = lambda: {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = blocks()
    kept = cut(spark.range(1000).groupBy("id").count())
    end = time.time() + 10
    while blocks() - before and time.time() < end:
        time.sleep(0.1)
    assert not blocks() - before and kept.count() == 1000
