"""Joins of exploded rows and long arrays, whose size the planner underestimates, are never broadcast."""

import re

from pagemill.operators import content


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def stored(spark, page_table, folder):
    rows = [dict(page_id=n, site_id="s", ord=n, url=f"https://x.example/p{n}", status=200, title="t", h1s=["h"], word_count=300, text_content=f"some words of page {n}") for n in range(4)]
    page_table(rows).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return spark.read.parquet(f"{folder}/pages.parquet")


def test_terms_are_not_broadcast(spark, page_table, tmp_path):
    assert not re.search(r"BroadcastHashJoin \[site_id#\d+, term#", plan(content.top_terms(stored(spark, page_table, tmp_path))))


def test_titles_and_stems_are_not_broadcast(spark, page_table, tmp_path):
    pages = stored(spark, page_table, tmp_path)
    ranked = spark.range(4).selectExpr("cast(id as string) as site_id", "id as page_id", "'words' as term", "1 as rank", "1L as n", "1 as total")
    assert not re.search(r"BroadcastHashJoin \[site_id#\d+, page_id#", plan(content.misaligned(pages, ranked)))


def test_runs_are_not_broadcast(spark):
    sets = spark.range(4).selectExpr("'s' as site_id", "id", "array(1L, 2L, 3L, id + 9) as runs")
    found = content.similar_pairs(sets, 40)
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted((r.a, r.b) for r in found.collect()) == [(a, b) for a in range(4) for b in range(a + 1, 4)]
