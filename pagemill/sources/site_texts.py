"""Sitemaps, robots.txt and snapshots as sources: texts become tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import robots, urls

_XML = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
#: Fixed value: extensions of addresses that hold no page.
ASSETS = r"(?i)\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|txt|pdf|zip|gz|mp4|webm|mp3|woff2?|ttf|eot|map)(\?|#|$)"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(site_id, file, kind, ord, url) of (site_id, file, xml): index or urlset by the root tag, entities decoded."""
    loc = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    url = F.col("u")
    for entity, char in _XML:
        url = F.replace(url, F.lit(entity), F.lit(char))
    kind = F.when(F.col("xml").rlike("(?i)<sitemapindex"), "index").otherwise("urlset")
    return files.select("site_id", "file", kind.alias("kind"), F.posexplode(loc).alias("ord", "u")).select("site_id", "file", "kind", F.col("ord").cast("bigint").alias("ord"), url.alias("url"))


def first_of_each(entries: DataFrame, most: int = 5000) -> DataFrame:
    """Entries of urlsets in order, a URL once, at most ``most`` a site (a feature of the sitemap walk)."""
    one = entries.where("kind = 'urlset'").groupBy("site_id", "url").agg(F.min(F.struct("file", "ord")).alias("o"))
    w = Window.partitionBy("site_id").orderBy("o", "url")
    return one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("site_id", (F.col("n") - 1).cast("bigint").alias("ord"), "url")


def declared_sitemaps(site_files: DataFrame) -> DataFrame:
    """(site_id, url): absolute addresses of the Sitemap lines of robots.txt, each once."""
    rows = robots.lines(site_files).where("name = 'sitemap' and value <> ''").join(site_files.select("site_id", "start_url"), "site_id")
    return rows.select("site_id", urls.resolve(F.col("value"), F.col("start_url")).alias("url")).where("url is not null").distinct()


def crawl_frontier(pages: DataFrame) -> DataFrame:
    """(site_id, url): same-site links to pages that were not crawled, fragments cut, assets left out."""
    links = pages.select("site_id", "url", F.explode("links").alias("l")).where("l.href is not null and l.href not like '#%'")
    target = urls.without_fragment(urls.resolve(F.col("l.href"), F.col("url")))
    to = links.select("site_id", target.alias("to"), "url")
    to = to.where(urls.same_site(F.col("to"), F.col("url")) & ~F.col("to").rlike(ASSETS))
    keyed = to.select("site_id", urls.page_key(F.col("to")).alias("url")).where("url is not null").distinct()
    return keyed.join(pages.select("site_id", urls.page_key(F.col("url")).alias("url")), ["site_id", "url"], "left_anti")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot documents (JSON lines); documents without url, pages or version are left out."""
    schema = (
        "v int, url string, origin string, takenAt timestamp, pagesCrawled int, overall int, geoScore int, categoryScores map<string,int>, "
        "pages map<string,struct<status:int,title:string,description:string,canonical:string,noindexMeta:boolean,noindexHeader:boolean,h1:string,redirectedTo:string>>, "
        "issues array<struct<ruleId:string,impact:string,category:string,title:string,paths:array<string>>>"
    )
    return spark.read.schema(schema).json(path).where("v is not null and url is not null and pages is not null")
