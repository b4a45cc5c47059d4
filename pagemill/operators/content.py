"""What pages are about: term weights, stuffing, alignment of titles, and near-duplicate clusters per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.operators.rules import flagged
from pagemill.session import cut, release, shuffled

SHINGLE = 8
#: Similarity of a cluster's members to its leader, in percent.
CLUSTER = 72


def readable(pages: DataFrame) -> DataFrame:
    """Indexable pages with words, one row a page: what content measures are taken over."""
    rows = flagged(pages).where("ok and not meta_noindex and word_count > 0")
    return rows.select("site_id", "page_id", "ord", "path", "title", "h1s", "text_content", "word_count").dropDuplicates(["site_id", "page_id"])


def term_counts(pages: DataFrame) -> DataFrame:
    """(site_id, page_id, term, n, first, total): counts of terms, the place each first stands, and all terms of the page."""
    rows = readable(pages).select("site_id", "page_id", text.tokens(F.col("text_content")).alias("t"))
    flat = rows.select("site_id", "page_id", F.size("t").alias("total"), F.posexplode("t").alias("pos", "term"))
    return flat.groupBy("site_id", "page_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.first("total").alias("total"))


def term_weights(pages: DataFrame) -> DataFrame:
    """(site_id, page_id, term, n, first, weight): tf-idf with idf = ln((N+1)/(df+1))+1 over the pages of the site.

    Document frequencies are combined before the shuffle, so a term of every page costs no more than another.
    """
    counts = term_counts(pages)
    df = counts.groupBy("site_id", "term").agg(F.count("*").alias("df"))
    size = readable(pages).groupBy("site_id").agg(F.count("*").alias("pages"))
    idf = df.join(size, "site_id").select("site_id", "term", (F.log((F.col("pages") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return counts.join(shuffled(idf), ["site_id", "term"]).select("site_id", "page_id", "term", "n", "first", "total", (F.col("n") / F.col("total") * F.col("idf")).alias("weight"))


def _ranked(pages: DataFrame) -> DataFrame:
    """Terms in order of weight; equal weights, to nine digits, in order of their first place."""
    w = Window.partitionBy("site_id", "page_id").orderBy(F.desc(F.round("weight", 9)), "first")
    return term_weights(pages).withColumn("rank", F.row_number().over(w))


def top_terms(pages: DataFrame, most: int = 8) -> DataFrame:
    """(site_id, page_id, rank, term, weight): the heaviest terms, weights rounded half up to three digits."""
    return _ranked(pages).where(F.col("rank") <= most).select("site_id", "page_id", "rank", "term", (F.floor(F.round(F.col("weight") * 1000, 6) + 0.5) / 1000).alias("weight"))


def stuffed_terms(pages: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(site_id, page_id, term, percent): up to 5 terms of six or more uses and over 6 % of a page of 300 words or more."""
    long = readable(pages).where("word_count >= 300").select("site_id", "page_id", "word_count")
    share = F.col("n") / F.greatest("total", "word_count")
    dense = (_ranked(pages) if ranked is None else ranked).join(long, ["site_id", "page_id"]).where((F.col("n") >= 6) & (share > 0.06))
    w = Window.partitionBy("site_id", "page_id").orderBy("rank")
    kept = dense.withColumn("k", F.row_number().over(w)).where("k <= 5")
    return kept.select("site_id", "page_id", "term", (F.floor(share * 1000 + 0.5) / 10).alias("percent"))


def _stem(term: Column) -> Column:
    return F.regexp_replace(term, "(ing|ed|es|s)$", "")


def misaligned(pages: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """(site_id, page_id, topic): pages of 200 words or more whose title and h1s share no stem with their five heaviest terms."""
    heavy = (_ranked(pages) if ranked is None else ranked).where("rank <= 5").groupBy("site_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    heavy = heavy.where("size(t) >= 3").select("site_id", "page_id", F.col("t.term").alias("terms"))
    shown = F.concat_ws(" ", "title", F.array_join("h1s", " "))
    stems = F.transform(F.filter(F.split(F.regexp_replace(F.lower(shown), "[^a-z0-9]", " "), " +"), lambda w: w != ""), _stem)
    rows = readable(pages).where("word_count >= 200").select("site_id", "page_id", stems.alias("stems"))
    met = rows.join(shuffled(heavy), ["site_id", "page_id"]).where(~F.arrays_overlap(F.transform("terms", _stem), "stems"))
    return met.select("site_id", "page_id", F.array_join(F.slice("terms", 1, 3), ", ").alias("topic"))


def content_findings(pages: DataFrame) -> DataFrame:
    """content-keyword-stuffing and content-keyword-alignment."""
    path = readable(pages).select("site_id", "page_id", "path")
    # Both read heavy or frequent terms only; texts are split once.
    ranked = cut(_ranked(pages).where("rank <= 5 or n >= 6"))
    stuffed = stuffed_terms(pages, ranked).groupBy("site_id", "page_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ", ").alias("note"))
    one = stuffed.join(path, ["site_id", "page_id"]).select("site_id", F.lit("content-keyword-stuffing").alias("rule_id"), F.col("path").alias("url"), "note")
    two = misaligned(pages, ranked).join(path, ["site_id", "page_id"]).select("site_id", F.lit("content-keyword-alignment").alias("rule_id"), F.col("path").alias("url"), F.col("topic").alias("note"))
    return one.unionByName(two)


def shingles(body: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of all runs of ``size`` words; shorter texts give one run of all words, empty ones none."""
    ws = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    # The words are bound to a lambda's variable, else every run would split the text anew.
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))
    found = F.get(F.transform(F.array(ws), lambda w: F.when(F.size(w) > 0, F.array_distinct(runs(w)))), F.lit(0))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def similar_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(site_id, a, b) with a < b of (site_id, id, runs) whose sets share ``percent`` of their union.

    Two such sets must meet in one of the rarest runs of each, in one fixed order; only runs that several sets hold are
    posted, and pairs are verified on the shared runs.  Equal sets must have been collapsed before.
    """
    flat = sets.select("site_id", "id", F.explode("runs").alias("run"))
    counts = flat.groupBy("site_id", "run").agg(F.count("*").alias("df")).where("df > 1")
    own = flat.join(shuffled(counts), ["site_id", "run"]).groupBy("site_id", "id").agg(F.array_sort(F.collect_list(F.struct("df", "run"))).alias("s"))
    shared = cut(own.join(shuffled(sets.select("site_id", "id", F.size("runs").alias("n"))), ["site_id", "id"]).select("site_id", "id", "n", F.col("s.run").alias("shared")))
    wanted = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100.0)).cast("int") + 1 - (F.col("n") - F.size("shared"))
    posts = shared.withColumn("take", F.least(wanted, F.size("shared"))).where("take > 0").select("site_id", "id", "n", F.explode(F.slice("shared", 1, F.col("take"))).alias("run"))
    near = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    same = (F.col("x.site_id") == F.col("y.site_id")) & (F.col("x.run") == F.col("y.run")) & (F.col("x.id") < F.col("y.id"))
    pairs = posts.alias("x").join(shuffled(posts).alias("y"), same & near).select(F.col("x.site_id").alias("site_id"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    one = shared.select("site_id", F.col("id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = shared.select("site_id", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    kept = pairs.join(shuffled(one), ["site_id", "a"]).join(shuffled(two), ["site_id", "b"]).where(common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    return kept.select("site_id", "a", "b")


def leaders(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(site_id, id, leader): greedy clusters in order of id; an id that no earlier leader is similar to leads.

    Rounds settle every id whose earlier neighbours are settled, as many at a time as there are, instead of one pass
    in order; the result is the same.  Every round settles at least the first undecided id, so the rounds end; a chain
    of ids takes as many rounds as it is long.
    """
    links = cut(pairs.select("site_id", F.col("a").alias("before"), F.col("b").alias("id")))
    # Only ids with a neighbour are in question; one without an earlier neighbour leads.
    first = links.select("site_id", F.col("before").alias("id")).distinct().join(links.select("site_id", "id").distinct(), ["site_id", "id"], "left_anti")
    waiting = links.select("site_id", "id").distinct().withColumn("leader", F.lit(None).cast(dict(links.dtypes)["id"]))
    state = cut(first.withColumn("leader", F.col("id")).unionByName(waiting))
    while not state.where("leader is null").isEmpty():
        before = state.select("site_id", F.col("id").alias("before"), F.col("leader").alias("lead"))
        seen = links.join(before, ["site_id", "before"]).groupBy("site_id", "id").agg(
            F.min(F.when(F.col("lead") == F.col("before"), F.col("before"))).alias("head"), F.min(F.when(F.col("lead").isNull(), F.col("before"))).alias("wait")
        )
        # Claimed by its first leader once no earlier neighbour is undecided before it; leads once none is left at all.
        claimed = F.col("head").isNotNull() & (F.col("wait").isNull() | (F.col("wait") > F.col("head")))
        alone = F.col("head").isNull() & F.col("wait").isNull()
        now = F.coalesce(F.col("leader"), F.when(claimed, F.col("head")).when(alone, F.col("id")))
        state = cut(state.join(seen, ["site_id", "id"], "left").select("site_id", "id", now.alias("leader")))
    rest = vertices.select("site_id", "id").join(state, ["site_id", "id"], "left_anti").withColumn("leader", F.col("id"))
    return rest.unionByName(state)


def duplicate_clusters(pages: DataFrame, percent: int = CLUSTER) -> DataFrame:
    """(site_id, page_id, leader_id): every page with shingles and the page that leads its cluster, in crawl order.

    Pages of equal sets act as their first one.  Pages without text have no row.
    """
    order = F.struct(F.coalesce("ord", F.lit(1 << 62)).alias("ord"), "page_id")
    rows = readable(pages).select("site_id", "page_id", order.alias("o"), F.sort_array(shingles(F.col("text_content"))).alias("runs")).where("size(runs) > 0")
    rows = cut(rows.withColumn("sig", F.xxhash64("runs", F.size("runs"))))
    first = cut(rows.groupBy("site_id", "sig").agg(F.min("o").alias("id"), F.min_by("runs", "o").alias("runs")))
    # From here on only first pages need their runs; those of all pages are let go.
    rows = cut(rows.drop("runs"))
    release(pages.sparkSession)
    reps = first.select("site_id", "id", "runs")
    led = leaders(reps, similar_pairs(reps, percent))
    lead = led.select("site_id", "id", F.col("leader.page_id").alias("leader_id"))
    return rows.join(first.select("site_id", "sig", "id"), ["site_id", "sig"]).join(lead, ["site_id", "id"]).select("site_id", "page_id", "leader_id")


def duplicate_findings(pages: DataFrame) -> DataFrame:
    """indexing-duplicate-content: members of clusters of several pages; the note is the leading page."""
    led = cut(duplicate_clusters(pages))
    several = led.groupBy("site_id", "leader_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    path = readable(pages).select("site_id", "page_id", F.col("path").alias("url"))
    met = led.join(several, ["site_id", "leader_id"], "left_semi").join(path, ["site_id", "page_id"])
    return met.select("site_id", F.lit("indexing-duplicate-content").alias("rule_id"), "url", F.col("leader_id").cast("string").alias("note"))
