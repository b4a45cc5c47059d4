import pytest
from pyspark.sql import SparkSession

from pagemill.session import tune


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


PAGE = (
    "page_id bigint, site_id string, ord bigint, url string, requested_url string, redirected_from array<string>, status int, html string, title string, "
    "meta_description string, canonical string, lang string, meta_robots string, meta_googlebot string, x_robots_tag string, viewport string, twitter_card string, "
    "h1s array<string>, headings array<struct<level:int,text:string>>, images array<struct<src:string,alt:string,width:int,height:int,loading:string>>, "
    "links array<struct<href:string,internal:boolean,anchor:string,nofollow:boolean>>, json_ld array<string>, hreflang array<struct<lang:string,href:string>>, "
    "og map<string,string>, text_content string, word_count int, html_bytes bigint, response_time_ms bigint, render_ms bigint, "
    "render_blocking struct<scripts:int,stylesheets:int>, images_missing_dims int, depth int, discovered_via string, fetched_at timestamp, loaded_at timestamp"
)
SITE = (
    "site_id string, start_url string, framework string, robots_txt string, robots_status int, robots_is_html boolean, has_robots boolean, robots_declares_sitemap boolean, "
    "has_sitemap boolean, sitemap_truncated boolean, not_found_status int, not_found_probe string, not_found_landed_on string, has_llms_txt boolean, llms_txt string, "
    "crawl_complete boolean, tls struct<host:string,valid_to:timestamp,days_left:int,issuer:string,trusted:boolean,error:string>"
)


def make(spark, schema, rows):
    """A table from dicts; what a row leaves out is null."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@pytest.fixture(scope="session")
def page_table(spark):
    return lambda rows: make(spark, PAGE, rows)


@pytest.fixture(scope="session")
def site_table(spark):
    return lambda rows: make(spark, SITE, rows)
