"""Loops that must run to their end, on chains longer than any fixed number of rounds."""

from pagemill.operators import content, graph


def test_leaders_of_a_long_chain(spark):
    length = 106
    ids = spark.createDataFrame([("s", i) for i in range(length)], "site_id string, id bigint")
    pairs = spark.createDataFrame([("s", i, i + 1) for i in range(length - 1)], "site_id string, a bigint, b bigint")
    got = {r.id: r.leader for r in content.leaders(ids, pairs.coalesce(1)).collect()}
    # One pass in order: every second id leads and takes the next.
    assert got == {i: i - i % 2 for i in range(length)}


def test_click_depth_of_a_long_chain(spark):
    length = 55
    links = spark.createDataFrame([("s", f"/{i}", f"/{i + 1}") for i in range(length)] + [("s", "/9", "/2")], "site_id string, src string, dst string").coalesce(1)
    got = graph.click_depth(links, spark.createDataFrame([("s", "/0")], "site_id string, node string")).collect()
    assert {r.node: r.depth for r in got} == {f"/{i}": i for i in range(length + 1)}
