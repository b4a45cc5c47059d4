"""The internal link graph of each site: edges, click depth, orphans, broken links and rank.

Loops run over DataFrames; every few steps the state is written to the shared checkpoint folder, so plans stay short
and a lost executor costs at most those steps.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.session import cut

EVERY = 5


def nodes(pages: DataFrame) -> DataFrame:
    """(site_id, path, status, depth, page_id): a page per path, of several the last in crawl order."""
    rows = pages.where("url is not null").select("site_id", F.coalesce(urls.path(F.col("url")), F.col("url")).alias("path"), "ord", "page_id", "status", "depth")
    last = F.max_by(F.struct("page_id", "status", "depth"), F.struct(F.coalesce("ord", F.lit(-1)), "page_id"))
    return rows.groupBy("site_id", "path").agg(last.alias("n")).select("site_id", "path", "n.*")


def edges(pages: DataFrame) -> DataFrame:
    """(site_id, src, dst): distinct internal links between crawled paths, without self links; nofollow links count."""
    link = pages.where("url is not null").select("site_id", F.coalesce(urls.path(F.col("url")), F.col("url")).alias("src"), "url", F.explode("links").alias("l")).where("l.internal and l.href is not null")
    to = link.select("site_id", "src", urls.resolve(F.col("l.href"), F.col("url")).alias("to"))
    to = to.select("site_id", "src", urls.path(F.col("to")).alias("dst")).where("dst is not null and dst <> src").distinct()
    return to.join(nodes(pages).select("site_id", F.col("path").alias("dst")), ["site_id", "dst"], "left_semi").select("site_id", "src", "dst")


def inbound(pages: DataFrame) -> DataFrame:
    """(site_id, path, inbound): how many other pages link to each."""
    counts = edges(pages).groupBy("site_id", F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    return nodes(pages).join(counts, ["site_id", "path"], "left").select("site_id", "path", F.coalesce("n", F.lit(0)).alias("inbound"))


def orphans(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """(site_id, path): pages that no other links to, but the start page."""
    start = site_files.select("site_id", urls.path(F.col("start_url")).alias("path"))
    linked = edges(pages).select("site_id", F.col("dst").alias("path"))
    return nodes(pages).select("site_id", "path").join(linked, ["site_id", "path"], "left_anti").join(start, ["site_id", "path"], "left_anti")


def broken(pages: DataFrame) -> DataFrame:
    """(site_id, src, dst, status): links to pages that answer with an error."""
    bad = nodes(pages).where("status >= 400").select("site_id", F.col("path").alias("dst"), "status")
    return edges(pages).join(bad, ["site_id", "dst"]).select("site_id", "src", "dst", "status")


def click_depth(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(site_id, node, depth) of all nodes that ``starts`` (site_id, node) reach over (site_id, src, dst)."""
    found = cut(starts.distinct().withColumn("depth", F.lit(0)))
    ahead = found
    for depth in count(1):
        step = ahead.withColumnRenamed("node", "src").join(links, ["site_id", "src"]).select("site_id", F.col("dst").alias("node")).distinct()
        ahead = cut(step.join(found.select("site_id", "node"), ["site_id", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if ahead.isEmpty():
            break
        found = cut(found.unionByName(ahead)) if depth % EVERY == 0 else found.unionByName(ahead)
    return found


def page_rank(vertices: DataFrame, links: DataFrame, rounds: int = 40, damping: float = 0.85) -> DataFrame:
    """(site_id, node, rank) after a fixed number of rounds from a uniform start, each site summing to 1.

    What nodes without links hold is spread evenly over their site.
    """
    degree = links.groupBy("site_id", "src").agg(F.count("*").alias("out"))
    weighted = cut(links.join(degree, ["site_id", "src"]).select("site_id", "src", "dst", (1 / F.col("out")).alias("w")))
    size = vertices.groupBy("site_id").agg(F.count("*").alias("n"))
    base = cut(vertices.join(size, "site_id"))
    rank = base.select("site_id", "node", (1 / F.col("n")).alias("rank"))
    for k in range(1, rounds + 1):
        given = weighted.join(rank.withColumnRenamed("node", "src"), ["site_id", "src"]).groupBy("site_id", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        # A site holds 1 in all; what its links do not pass on is what nodes without links hold.
        passed = given.groupBy("site_id").agg(F.sum("got").alias("passed"))
        share = damping * (F.coalesce("got", F.lit(0.0)) + (1 - F.coalesce("passed", F.lit(0.0))) / F.col("n"))
        rank = base.join(given, ["site_id", "node"], "left").join(passed, "site_id", "left").select("site_id", "node", ((1 - damping) / F.col("n") + share).alias("rank"))
        if k % EVERY == 0 or k == rounds:
            rank = cut(rank)
    return rank


def link_findings(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """link-orphan-pages (unless the page asks not to be indexed) and link-broken-internal."""
    from pagemill.operators.rules import flagged

    hidden = flagged(pages).where("meta_noindex").select("site_id", "path")
    lone = orphans(pages, site_files).join(hidden, ["site_id", "path"], "left_anti")
    first = lone.select("site_id", F.lit("link-orphan-pages").alias("rule_id"), F.col("path").alias("url"), F.lit(None).cast("string").alias("note"))
    second = broken(pages).select("site_id", F.lit("link-broken-internal").alias("rule_id"), F.col("src").alias("url"), F.concat(F.col("dst"), F.lit(" "), F.col("status")).alias("note"))
    return first.unionByName(second)
