"""robots.txt as tables: directives, the groups that govern a crawler, and who may fetch what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Crawlers with owner and purpose; a fallback crawler's groups hold where none names the crawler.
BOTS = [
    ("Googlebot", "Google Search", "search", None),
    ("Bingbot", "Microsoft", "both", None),
    ("OAI-SearchBot", "OpenAI", "search", None),
    ("ChatGPT-User", "OpenAI", "search", None),
    ("GPTBot", "OpenAI", "training", None),
    ("Claude-SearchBot", "Anthropic", "search", None),
    ("Claude-User", "Anthropic", "search", None),
    ("ClaudeBot", "Anthropic", "training", None),
    ("PerplexityBot", "Perplexity", "search", None),
    ("Perplexity-User", "Perplexity", "search", None),
    ("Google-Extended", "Google", "both", None),
    ("Applebot", "Apple", "search", "Googlebot"),
    ("Applebot-Extended", "Apple", "training", None),
    ("meta-webindexer", "Meta", "search", None),
    ("meta-externalagent", "Meta", "training", None),
    ("Amzn-SearchBot", "Amazon", "search", None),
    ("Amazonbot", "Amazon", "training", None),
    ("MistralAI-Index", "Mistral", "search", None),
    ("MistralAI-Training", "Mistral", "training", None),
    ("DuckAssistBot", "DuckDuckGo", "search", None),
    ("CCBot", "Common Crawl", "training", None),
]
#: Directives that are known besides user-agent.
KNOWN = "user-agent allow disallow sitemap crawl-delay host clean-param request-rate visit-time".split()


def bots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOTS, "bot string, owner string, purpose string, fallback string")


def lines(site_files: DataFrame) -> DataFrame:
    """(site_id, line, text, name, value): lines of robots.txt that say something, numbered from 1; name is null without a colon."""
    rows = site_files.where("robots_txt is not null").select("site_id", F.posexplode(F.split("robots_txt", "\r?\n")).alias("pos", "raw"))
    text = F.trim(F.regexp_replace("raw", "#.*$", ""))
    colon = F.instr(F.col("text"), ":")
    return (
        rows.select("site_id", (F.col("pos") + 1).alias("line"), text.alias("text"))
        .where("text <> ''")
        .withColumn("name", F.when(colon > 1, F.lower(F.trim(F.expr("substring(text, 1, instr(text, ':') - 1)")))))
        .withColumn("value", F.when(colon > 0, F.trim(F.expr("substring(text, instr(text, ':') + 1)"))))
    )


def groups(site_files: DataFrame) -> DataFrame:
    """(site_id, grp, name, value): directives with their group; a group begins where user-agent follows another directive."""
    named = lines(site_files).where(F.col("name").rlike("^[a-z-]+$"))
    w = Window.partitionBy("site_id").orderBy("line")
    agent = F.col("name") == "user-agent"
    begins = (agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))).cast("int")
    return named.withColumn("grp", F.sum(begins).over(w)).where("grp > 0").select("site_id", "grp", "name", "value")


def governing(site_files: DataFrame) -> DataFrame:
    """(site_id, bot, purpose, grp): the groups that hold for each crawler; those that name it, else its fallback, else '*'."""
    agents = groups(site_files).where("name = 'user-agent'").select("site_id", "grp", F.lower("value").alias("agent")).distinct()
    star = F.col("agent") == "*"
    names = lambda who: ~star & F.contains(F.lower(who), F.col("agent"))
    rank = F.when(names(F.col("bot")), 1).when(names(F.col("fallback")), 2).when(star, 3)
    met = agents.crossJoin(F.broadcast(bots(site_files.sparkSession))).withColumn("rank", rank).where("rank is not null")
    best = F.min("rank").over(Window.partitionBy("site_id", "bot"))
    return met.withColumn("best", best).where("rank = best").select("site_id", "bot", "purpose", "grp").distinct()


def matches(pattern: Column, path: Column) -> Column:
    """RFC 9309: prefixes, '*' for any run, '$' at the end anchors."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    wild = F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"), F.when(anchored, F.lit(r"\z")).otherwise(F.lit("")))
    return F.when(~F.contains(body, F.lit("*")), F.when(anchored, path == body).otherwise(F.startswith(path, body))).otherwise(F.rlike(path, wild))


def _rules(site_files: DataFrame) -> DataFrame:
    found = groups(site_files).where("name in ('allow', 'disallow') and value <> ''")
    return found.select("site_id", "grp", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))


def root_access(site_files: DataFrame) -> DataFrame:
    """(site_id, bot, purpose, allowed): whether each crawler may fetch the root; without a matching rule it may."""
    spark = site_files.sparkSession
    hits = governing(site_files).join(_rules(site_files).where(matches(F.col("pattern"), F.lit("/"))), ["site_id", "grp"])
    verdict = hits.groupBy("site_id", "bot").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    every = site_files.select("site_id").distinct().crossJoin(F.broadcast(bots(spark).select("bot", "purpose")))
    return every.join(verdict, ["site_id", "bot"], "left").select("site_id", "bot", "purpose", F.coalesce("allow", F.lit(True)).alias("allowed"))


def blocked_paths(site_files: DataFrame, pages: DataFrame, bot: str = "Googlebot") -> DataFrame:
    """(site_id, page_id): pages (site_id, page_id, target) whose path and query ``bot`` may not fetch."""
    own = governing(site_files).where(F.col("bot") == bot).join(_rules(site_files), ["site_id", "grp"]).select("site_id", "allow", "pattern")
    hits = pages.join(own, "site_id").where(matches(F.col("pattern"), F.col("target")))
    verdict = hits.groupBy("site_id", "page_id").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    return verdict.where("not allow").select("site_id", "page_id")


def content_signals(site_files: DataFrame) -> DataFrame:
    """(site_id, signal, value): 'k=yes' and 'k=no' of content-signal lines in '*' groups, the last holds."""
    rows = groups(site_files)
    star = rows.where("name = 'user-agent' and value = '*'").select("site_id", "grp").distinct()
    w = Window.partitionBy("site_id", "signal").orderBy(F.desc("grp"), F.desc("pos"))
    pairs = rows.where("name = 'content-signal'").join(star, ["site_id", "grp"]).select("site_id", "grp", F.posexplode(F.split("value", ",")).alias("pos", "pair"))
    form = r"(?i)^([a-z-]+)\s*=\s*(yes|no)$"
    kept = pairs.withColumn("pair", F.trim("pair")).where(F.col("pair").rlike(form))
    found = kept.select("site_id", "grp", "pos", F.lower(F.regexp_extract("pair", form, 1)).alias("signal"), F.lower(F.regexp_extract("pair", form, 2)).alias("value"))
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("site_id", "signal", "value")
