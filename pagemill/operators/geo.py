"""Readiness for answer engines: twelve checks a site, their score, and an llms.txt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import robots, urls
from pagemill.operators.rules import flagged

#: Types that describe content, and words that open a question.
ANSWER_TYPES = "FAQPage QAPage HowTo Article BlogPosting NewsArticle TechArticle Product Recipe".split()
QUESTION = r"(?i)\?\s*\z|^(how|what|why|when|where|which|who|can|does|is|are|should|do)(?![A-Za-z0-9_])"
FACT = r"(?i)(?<![A-Za-z0-9_])\d+(?:[.,]\d+)?\s?(%|percent|x(?![A-Za-z0-9_])|ms(?![A-Za-z0-9_])|kb(?![A-Za-z0-9_])|€|\$|users|customers)"
#: Weights of scored checks; all others count once.
WEIGHTS = {"geo-ai-search-bots": 3, "geo-server-rendered": 2}
INFORMATIONAL = ("geo-ai-training-bots", "geo-content-signals")


def _json() -> Column:
    return F.array_join(F.coalesce("json_ld", F.array().cast("array<string>")), "\n")


def _typed(names: list[str]) -> Column:
    return _json().rlike(r'"@type"\s*:\s*(\[[^\]]*)?"(' + "|".join(names) + ')"')


def _status(passed: Column, warned: Column | None = None, otherwise: str = "warn") -> Column:
    out = F.when(passed, "pass")
    return (out if warned is None else out.when(warned, "warn")).otherwise(otherwise)


def checks(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """(site_id, check_id, status): pass, warn or fail; geo-content-signals only where a site declares some.

    Pages count if they answer 2xx and may be indexed; repeated rows of a page count once.
    """
    keep = flagged(pages).where("ok and not noindex")
    html = F.coalesce("html", F.lit(""))
    heads = F.filter(F.coalesce("headings", F.array().cast("array<struct<level:int,text:string>>")), lambda h: h["level"].between(2, 3) & h["text"].rlike(QUESTION))
    page = keep.select(
        "site_id", "page_id",
        ((F.coalesce("word_count", F.lit(0)) < 80) & (F.col("html_bytes") > 15_000)).alias("shell"),
        _typed(ANSWER_TYPES).alias("answers"), _typed(["Organization", "Person"]).alias("entity"), _json().contains('"sameAs"').alias("same_as"),
        (_json().contains('"author"') | html.rlike("(?i)<meta[^>]+name=[\"']author[\"']|rel=[\"']author[\"']")).alias("author"),
        (_json().rlike('"date(Modified|Published)"') | html.rlike("(?i)article:(modified|published)_time|<time[^>]+datetime=")).alias("dated"),
        F.size(heads).alias("questions"),
        (F.regexp_count(F.coalesce("text_content", F.lit("")), F.lit(FACT)) >= 2).alias("facts"),
        (F.length(F.trim(F.coalesce("meta_description", F.lit("")))) >= 50).alias("described"),
    ).dropDuplicates(["site_id", "page_id"])
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    site = page.groupBy("site_id").agg(
        F.count("*").alias("n"), *[count(c) for c in ("shell", "answers", "entity", "same_as", "author", "dated", "facts", "described")], F.sum("questions").alias("questions")
    )
    access = robots.root_access(site_files).groupBy("site_id").agg(
        F.count_if(~F.col("allowed") & (F.col("purpose") != "training")).alias("search"), F.count_if(~F.col("allowed") & (F.col("purpose") == "training")).alias("training")
    )
    signals = robots.content_signals(site_files).groupBy("site_id").agg(F.count("*").alias("signals"))
    text = F.coalesce("llms_txt", F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    formed = F.coalesce(F.get(lines, F.lit(0)).rlike(r"^#\s+\S"), F.lit(False)) & text.rlike(r"\[[^\]]+\]\([^)\s]+\)")
    files = site_files.select("site_id", (F.coalesce("has_llms_txt", F.lit(False)) & formed).alias("llms"))
    zero = ["n", "shell", "answers", "entity", "same_as", "author", "dated", "facts", "described", "questions", "search", "training", "signals"]
    all_ = files.join(access, "site_id", "left").join(signals, "site_id", "left").join(site, "site_id", "left").fillna(0, zero)
    c = F.col
    table = {
        "geo-ai-search-bots": _status(c("search") == 0, None, "fail"),
        "geo-ai-training-bots": _status(c("training") == 0),
        "geo-content-signals": F.when(c("signals") > 0, "pass"),
        "geo-llms-txt": _status(c("llms")),
        "geo-server-rendered": F.when(c("shell") == 0, "pass").when(c("shell") >= F.ceil(c("n") / 2), "fail").otherwise("warn"),
        "geo-answer-schema": _status(c("answers") > 0),
        "geo-entity": _status((c("entity") > 0) & (c("same_as") > 0), c("entity") > 0, "fail"),
        "geo-authorship": _status(c("author") > 0),
        "geo-freshness": _status(c("dated") > 0),
        "geo-question-headings": _status(c("questions") >= 2),
        "geo-facts": _status(c("facts") > 0),
        "geo-summaries": _status((c("described") == c("n")) & (c("n") > 0), c("described") > 0, "fail"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check_id"), v.alias("status")) for k, v in table.items()])
    return all_.select("site_id", F.explode(rows).alias("r")).select("site_id", "r.check_id", "r.status").where("status is not null")


def score(checked: DataFrame) -> DataFrame:
    """(site_id, score): pass 1, warn a half, fail 0, weighted, in percent rounded half up; informational checks are left out."""
    w = F.lit(1)
    for name, weight in WEIGHTS.items():
        w = F.when(F.col("check_id") == name, weight).otherwise(w)
    v = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    return checked.where(~F.col("check_id").isin(*INFORMATIONAL)).groupBy("site_id").agg(F.floor(F.sum(w * v) / F.sum(w) * 100 + 0.5).alias("score"))


def llms_lines(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """(site_id, ord, line): the lines of an llms.txt, a link a page that may be indexed, under the site's name.

    The name is og:site_name of the start page, else the last part that most titles share, else the host.  Lines stay
    rows: a sink joins them per site.
    """
    rows = flagged(pages).where("ok and not meta_noindex").select("site_id", "page_id", "ord", "url", "path", "title", "meta_description", "og").dropDuplicates(["site_id", "page_id"])
    last = F.element_at(F.split("title", r"\s+[|–—·-]\s+"), -1)
    suffix = rows.where(F.size(F.split("title", r"\s+[|–—·-]\s+")) > 1).groupBy("site_id", last.alias("s")).agg(F.count("*").alias("n"), F.min("ord").alias("o")).where("n > 1")
    common = suffix.groupBy("site_id").agg(F.max_by("s", F.struct("n", -F.col("o"))).alias("suffix"))
    home = rows.join(site_files.select("site_id", urls.path(F.col("start_url")).alias("start")), "site_id").where("path = start")
    named = home.groupBy("site_id").agg(F.min(F.try_element_at("og", F.lit("og:site_name"))).alias("og_name"), F.min("meta_description").alias("about"))
    site = site_files.select("site_id", urls.bare_host(F.col("start_url")).alias("host")).join(common, "site_id", "left").join(named, "site_id", "left")
    site = site.withColumn("name", F.coalesce("og_name", "suffix", "host"))
    top = site.select("site_id", F.lit(-2).cast("bigint").alias("ord"), F.concat(F.lit("# "), F.col("name")).alias("line"))
    about = site.where("about <> ''").select("site_id", F.lit(-1).cast("bigint").alias("ord"), F.concat(F.lit("> "), F.col("about")).alias("line"))
    own = Window.partitionBy("site_id", "url").orderBy("ord", "page_id")
    page = rows.withColumn("rn", F.row_number().over(own)).where("rn = 1").join(site.select("site_id", "name"), "site_id")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("path"))
    parts = F.split(title, r"\s+[|–—·-]\s+")
    short = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == F.col("name")), F.regexp_replace(title, r"\s+[|–—·-]\s+[^|–—·-]*$", "")).otherwise(title)
    links = page.select("site_id", "ord", F.concat(F.lit("- ["), short, F.lit("]("), F.col("url"), F.lit(")"), F.when(F.col("meta_description") != "", F.concat(F.lit(": "), F.col("meta_description"))).otherwise("")).alias("line"))
    return top.unionByName(about).unionByName(links)
