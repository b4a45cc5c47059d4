import pytest
from pyspark.sql import functions as F

from pagemill.operators import rules, scoring


def test_user_rules_join_the_pass_and_the_scores(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    mine = rules.Rule("mine-no-images", "images", "high", "low", "low", 90)
    rules.register(mine, lambda: (F.col("ok") & F.col("images").isNull(), F.lit("none")))
    try:
        found = rules.page_findings(pages, ["mine-no-images", "meta-title-missing"])
        assert {r.rule_id for r in found.select("rule_id").distinct().collect()} <= {"mine-no-images", "meta-title-missing"}
        rows = spark.createDataFrame([("s", "mine-no-images")], "site_id string, rule_id string")
        assert scoring.issues(rows).first().impact == "high"
        with pytest.raises(ValueError):
            rules.register(rules.Rule("img-broken", "images", "high", "low", "low", 90), lambda: (F.lit(True), F.lit("")))
    finally:
        rules.unregister("mine-no-images")
    assert "mine-no-images" not in {r.id for r in rules.catalogue()}
