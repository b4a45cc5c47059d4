"""Rules that look at the files of a site, at measured resources, or from one page to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import robots, urls
from pagemill.operators.rules import flagged

#: ISO 639-1 languages and ISO 3166-1 regions.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
REGIONS = (
    "ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bl bm bn bo bq br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg eh er es et fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mf mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug um us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()


def _finding(rule: str, url: Column, note: Column | None = None) -> list[Column]:
    return [F.col("site_id"), F.lit(rule).alias("rule_id"), url.alias("url"), (F.lit(None) if note is None else note).cast("string").alias("note")]


def site_findings(site_files: DataFrame) -> DataFrame:
    """Rules on a site's own files; one row per site and rule at most."""
    c = F.col
    falsy = lambda name: ~F.coalesce(c(name), F.lit(False))
    truthy = lambda name: F.coalesce(c(name), F.lit(False))
    status = F.coalesce("robots_status", F.lit(0))
    days = c("tls.days_left")
    untrusted = ~F.coalesce(c("tls.trusted"), F.lit(True))
    broken_tls = c("tls.error").isNotNull() | untrusted | (days <= 14)
    severe = F.when(untrusted | c("tls.error").isNotNull() | (days < 0), "critical").otherwise("high")
    tests = {
        "framework-sitemap-missing": (falsy("has_sitemap"), None),
        "framework-robots-missing": (falsy("has_robots"), None),
        "framework-robots-no-sitemap": (truthy("has_sitemap") & truthy("has_robots") & falsy("robots_declares_sitemap"), None),
        "indexing-robots-unavailable": ((status >= 500) | (status == 429), status),
        "indexing-robots-html": (truthy("robots_is_html"), None),
        "indexing-soft-404-site": (c("not_found_status").between(200, 299), c("not_found_status")),
        "indexing-https-certificate": (c("tls").isNotNull() & broken_tls, severe),
    }
    fired = [
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), (F.lit(None) if note is None else note).cast("string").alias("note")))
        for rule, (when, note) in tests.items()
    ]
    return site_files.select("site_id", F.col("start_url").alias("url"), F.explode(F.array_compact(F.array(*fired))).alias("f")).select(
        "site_id", "f.rule_id", "url", "f.note"
    )


def robots_format(site_files: DataFrame) -> DataFrame:
    """Sites whose robots.txt has lines that crawlers cannot read; the note counts them."""
    bad = robots.lines(site_files).where(F.col("name").isNull() | (F.col("name") == "") | ~F.col("name").isin(robots.KNOWN))
    return bad.groupBy("site_id").agg(F.count("*").alias("n")).select(*_finding("indexing-robots-format", F.lit("/robots.txt"), F.col("n")))


def robots_blocks(site_files: DataFrame, pages: DataFrame) -> DataFrame:
    """Sites whose root Googlebot may not fetch, and elsewhere the ok, indexable pages that it may not."""
    root = robots.root_access(site_files).where("bot = 'Googlebot'")
    closed = root.where("not allowed").select(*_finding("indexing-robots-blocks-google", F.lit("/robots.txt")))
    query = F.regexp_extract("url", r"(\?[^#]*)", 1)
    rows = flagged(pages).where("ok and not noindex").select("site_id", "page_id", "path", F.concat(urls.raw_path(F.col("url")), query).alias("target")).distinct()
    opened = rows.join(root.where("allowed").select("site_id"), "site_id", "left_semi")
    hit = rows.join(robots.blocked_paths(site_files, opened), ["site_id", "page_id"], "left_semi")
    return closed.unionByName(hit.select(*_finding("indexing-robots-blocks-pages", F.col("path"))))


def probe_findings(probes: DataFrame, site_files: DataFrame) -> DataFrame:
    """Rules on measured images, links and assets; a probe of one URL and kind counts once, the latest.

    Status 0 is unknown and never broken.
    """
    newest = F.max_by(F.struct("status", "redirects", "hops", "final_url", "bytes", "content_type", "insecure"), F.struct("probed_at", "status", "final_url"))
    one = probes.where("url is not null").groupBy("site_id", "kind", "url").agg(newest.alias("p")).select("site_id", "kind", "url", "p.*")
    rows = one.join(site_files.select("site_id", urls.bare_host(F.col("start_url")).alias("home")), "site_id", "left")
    c = F.col
    image, link, asset = (c("kind") == k for k in ("image", "link", "asset"))
    measured = image & c("status").between(200, 299) & (c("bytes") > 0)
    kind = F.coalesce("content_type", F.lit(""))
    legacy = measured & kind.rlike("jpe?g|png") & (c("bytes") > 100_000)
    cap = F.when(kind.rlike("webp|avif"), 500_000).otherwise(300_000)
    kb = F.floor(c("bytes") / 1024 + 0.5)
    detour = F.exists(F.coalesce("hops", F.array().cast("array<int>")), lambda h: h.isin(302, 307))
    own = (urls.bare_host(c("url")) == c("home")) & urls.host(c("final_url")).isNotNull() & ~urls.is_utility(urls.path(c("final_url")))
    tests = {
        "img-legacy-format": (legacy, kb),
        "perf-oversized-images": (measured & ~legacy & (c("bytes") > cap), kb),
        "link-broken-external": (link & c("status").isin(404, 410, 500), c("status")),
        "indexing-redirect-chain": (link & (c("redirects") >= 2), c("redirects")),
        "perf-mixed-content": (image & c("insecure"), None),
        "img-broken": (image & (c("status") >= 400), c("status")),
        "perf-broken-assets": (asset & (c("status") >= 400), c("status")),
        "indexing-temporary-redirect": (link & detour & own, None),
    }
    fired = [
        F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), (F.lit(None) if note is None else note).cast("string").alias("note")))
        for rule, (when, note) in tests.items()
    ]
    return rows.select("site_id", "url", F.explode(F.array_compact(F.array(*fired))).alias("f")).select("site_id", "f.rule_id", "url", "f.note")


def _narrow(pages: DataFrame) -> DataFrame:
    """What look-ups between pages read, one row per page."""
    return (
        flagged(pages)
        .select(
            "site_id", "page_id", "ord", "url", "path", "status", "ok", "meta_noindex", "noindex", "canonical", "discovered_via",
            urls.page_key(F.col("url")).alias("key"), "redirected_from",
        )
        .dropDuplicates(["site_id", "page_id"])
    )


def lookup(pages: DataFrame) -> DataFrame:
    """(site_id, key, t_url, t_status, t_noindex, t_canonical, via_redirect): by page key the page itself, else one that a redirect led to.

    Of several the lowest ord holds.
    """
    rows = _narrow(pages)
    target = F.struct(F.col("url").alias("t_url"), F.col("status").alias("t_status"), F.col("noindex").alias("t_noindex"), F.col("canonical").alias("t_canonical"), F.col("path").alias("t_path"))
    direct = rows.select("site_id", "key", "ord", "page_id", F.lit(False).alias("via_redirect"), target.alias("t"))
    hops = rows.select("site_id", F.explode("redirected_from").alias("from"), "ord", "page_id", target.alias("t"))
    moved = hops.select("site_id", urls.page_key(F.col("from")).alias("key"), "ord", "page_id", F.lit(True).alias("via_redirect"), "t")
    both = direct.unionByName(moved).where("key is not null")
    best = F.min_by(F.struct("via_redirect", "t"), F.struct("via_redirect", F.coalesce("ord", F.lit(1 << 62)), "page_id"))
    return both.groupBy("site_id", "key").agg(best.alias("b")).select("site_id", "key", "b.via_redirect", "b.t.*")


def canonical_findings(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """indexing-canonical-mismatch and indexing-canonical-target-invalid."""
    rows = _narrow(pages).where("ok and canonical <> ''").withColumn("to", urls.resolve(F.col("canonical"), F.col("url")))
    home = site_files.select("site_id", urls.origin(F.col("start_url")).alias("home"))
    other = rows.join(home, "site_id").where((urls.origin(F.col("to")) == F.col("home")) & (urls.path(F.col("to")) != F.col("path")))
    mismatch = other.select(*_finding("indexing-canonical-mismatch", F.col("path"), urls.path(F.col("to"))))
    away = rows.select("site_id", "path", "key", urls.page_key(F.col("to")).alias("to_key")).where("to_key <> key")
    met = away.join(lookup(pages).withColumnRenamed("key", "to_key"), ["site_id", "to_key"])
    why = F.when(F.col("t_status") >= 400, F.concat(F.lit("HTTP "), F.col("t_status"))).when(F.col("via_redirect"), "redirect").when(F.col("t_noindex"), "noindex")
    bad = met.withColumn("why", why).where("why is not null").select(*_finding("indexing-canonical-target-invalid", F.col("path"), F.col("why")))
    return mismatch.unionByName(bad)


def noindex_findings(pages: DataFrame, site_files: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """indexing-noindex and, for utility pages that no sitemap lists, indexing-noindex-utility."""
    listed = sitemap_urls.select("site_id", urls.host_path(F.col("url")).alias("hp")).where("hp is not null").distinct().withColumn("listed", F.lit(True))
    home = site_files.select("site_id", urls.path(F.col("start_url")).alias("start"))
    rows = _narrow(pages).where("ok and noindex").withColumn("hp", urls.host_path(F.col("url")))
    met = rows.join(listed, ["site_id", "hp"], "left").join(home, "site_id", "left")
    in_sitemap = F.coalesce(F.col("listed"), F.lit(False)) | (F.coalesce("discovered_via", F.lit("")) == "sitemap")
    deliberate = ~in_sitemap & ~F.coalesce(F.col("path") == F.col("start"), F.lit(False)) & urls.is_utility(F.col("path"))
    rule = F.when(deliberate, "indexing-noindex-utility").otherwise("indexing-noindex")
    note = F.concat_ws(" + ", F.when(F.col("meta_noindex"), "meta"), F.when(in_sitemap, "sitemap"), F.when(F.col("path") == F.col("start"), "start page"))
    return met.select("site_id", rule.alias("rule_id"), F.col("path").alias("url"), note.alias("note"))


def _canonical_key(page_url: Column, canonical: Column) -> Column:
    return urls.page_key(urls.resolve(F.nullif(canonical, F.lit("")), page_url))


def sitemap_findings(pages: DataFrame, site_files: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """indexing-sitemap-hygiene for entries and indexing-sitemap-gaps for pages."""
    home = site_files.select("site_id", urls.origin(F.col("start_url")).alias("home"), F.coalesce("sitemap_truncated", F.lit(False)).alias("cut"))
    entries = sitemap_urls.where("url is not null").select("site_id", "url").distinct().join(home, "site_id").withColumn("key", urls.page_key(F.col("url")))
    met = entries.join(lookup(pages), ["site_id", "key"], "left")
    canonical = _canonical_key(F.col("t_url"), F.col("t_canonical"))
    why = (
        F.when(F.col("key").isNull(), "not absolute")
        .when(urls.origin(F.col("url")) != F.col("home"), "other origin")
        .when(F.col("t_status") >= 400, F.concat(F.lit("HTTP "), F.col("t_status")))
        .when(F.col("via_redirect"), "redirect")
        .when(F.col("t_noindex"), "noindex")
        .when(canonical != urls.page_key(F.col("t_url")), "canonical elsewhere")
    )
    hygiene = met.withColumn("why", why).where("why is not null").select(*_finding("indexing-sitemap-hygiene", F.col("url"), F.col("why")))
    with_list = entries.where("not cut").select("site_id").distinct()
    elsewhere = F.coalesce(_canonical_key(F.col("url"), F.col("canonical")) != F.col("key"), F.lit(False))
    indexable = _narrow(pages).where("ok and not noindex").where(~elsewhere & (F.coalesce("discovered_via", F.lit("")) != "sitemap") & F.col("key").isNotNull())
    gaps = indexable.join(with_list, "site_id", "left_semi").join(entries.select("site_id", "key").where("key is not null"), ["site_id", "key"], "left_anti")
    return hygiene.unionByName(gaps.select(*_finding("indexing-sitemap-gaps", F.col("path"))))


def language_problem(code: Column) -> Column:
    """Why an hreflang code is invalid, or null."""
    v = F.lower(F.trim(code))
    form = r"^([a-z]{2,3})(?:-([a-z]{4}))?(?:-([a-z0-9]{2,3}))?$"
    lang, region = F.regexp_extract(v, form, 1), F.regexp_extract(v, form, 3)
    return (
        F.when(v == "x-default", None)
        .when(v.contains("_"), "underscore")
        .when(~v.rlike(form), "not a code")
        .when(~lang.isin(LANGUAGES) & lang.isin(REGIONS) & (region == ""), "country")
        .when(~lang.isin(LANGUAGES), "unknown language")
        .when(region == "", None)
        .when(region == "uk", "uk")
        .when(region.rlike("^[0-9]+$"), "numeric region")
        .when(~region.isin(REGIONS), "unknown region")
    )


def hreflang_findings(pages: DataFrame) -> DataFrame:
    """indexing-hreflang-invalid; the note lists the kinds of faults in order."""
    rows = flagged(pages).where("ok and size(hreflang) > 0").select("site_id", "page_id", "url", "path", "hreflang", "noindex").dropDuplicates(["site_id", "page_id"])
    entry = rows.select("site_id", "page_id", "url", "path", F.explode("hreflang").alias("h")).select(
        "site_id", "page_id", "path", F.trim("h.lang").alias("lang"), F.trim("h.href").alias("href"), urls.page_key(F.col("url")).alias("own"), urls.resolve(F.col("h.href"), F.col("url")).alias("abs")
    ).withColumn("key", urls.page_key(F.col("abs")))
    who = ["site_id", "page_id", "path"]
    code = entry.withColumn("why", language_problem(F.col("lang"))).where("why is not null").select(*who, "why")
    relative = entry.where(~F.col("href").rlike("(?i)^https?://")).select(*who, F.lit("relative URL").alias("why"))
    selfless = entry.groupBy(*who).agg(F.max(F.coalesce(F.col("key") == F.col("own"), F.lit(False))).alias("has")).where("not has").select(*who, F.lit("no self").alias("why"))
    several = entry.groupBy(*who, F.lower("lang").alias("l")).agg(F.count_distinct(F.coalesce("key", "href")).alias("n")).where("n > 1").select(*who, F.lit("several URLs").alias("why"))
    target = entry.where("key <> own").join(lookup(pages), ["site_id", "key"])
    back = entry.select("site_id", F.col("own").alias("key"), F.col("key").alias("own")).distinct().withColumn("returns", F.lit(True))
    reciprocal = target.join(back, ["site_id", "key", "own"], "left")
    fault = (
        F.when(F.col("t_status") >= 400, F.concat(F.lit("HTTP "), F.col("t_status"))).when(F.col("via_redirect"), "redirect")
        .when(F.col("t_noindex"), "noindex").when(F.col("returns").isNull(), "no return link")
    )
    bad = reciprocal.withColumn("why", fault).where("why is not null").select(*who, "why")
    faults = code.unionByName(relative).unionByName(selfless).unionByName(several).unionByName(bad)
    return faults.groupBy(*who).agg(F.array_sort(F.collect_set("why")).alias("w")).select(*_finding("indexing-hreflang-invalid", F.col("path"), F.array_join("w", "; ")))


def observed_variants(probes: DataFrame, site_files: DataFrame) -> DataFrame:
    """(site_id, kind, url, status, final_url, canonical): requests to a site's own host under plain http or its www twin.

    Of several probes of a url the latest holds.  kind is 'http' for plain requests, else 'twin'.
    """
    last = F.max_by(F.struct("status", "final_url"), F.struct("probed_at", "status", "final_url"))
    one = probes.where("kind = 'link' and url is not null").groupBy("site_id", "url").agg(last.alias("p")).select("site_id", "url", "p.*")
    met = one.join(site_files.select("site_id", "start_url"), "site_id").where(urls.bare_host(F.col("url")) == urls.bare_host(F.col("start_url")))
    kind = F.when(urls.scheme(F.col("url")) == "http", "http").when(urls.host(F.col("url")) != urls.host(F.col("start_url")), "twin")
    return met.select("site_id", kind.alias("kind"), "url", "status", "final_url", F.lit(None).cast("string").alias("canonical")).where("kind is not null")


def host_findings(variants: DataFrame, site_files: DataFrame) -> DataFrame:
    """indexing-host-duplicate and indexing-http-not-redirected from (site_id, kind, url, status, final_url, canonical)."""
    met = variants.join(site_files.select("site_id", "start_url"), "site_id").where("status between 200 and 299")
    other = (urls.host(F.col("final_url")) != urls.host(F.col("start_url"))) & ~F.coalesce(urls.host(F.col("canonical")) == urls.host(F.col("start_url")), F.lit(False))
    twin = met.where(F.col("kind") != "http").where(other).select(*_finding("indexing-host-duplicate", F.col("final_url")))
    plain = met.where((F.col("kind") == "http") & (urls.scheme(F.col("final_url")) == "http")).select(*_finding("indexing-http-not-redirected", F.col("final_url")))
    return twin.unionByName(plain)


def sitemap_file_findings(sitemap_files: DataFrame, site_files: DataFrame) -> DataFrame:
    """indexing-sitemap-format from (site_id, file, error), for sites that have or declare a sitemap."""
    bad = sitemap_files.where("error is not null")
    sites = site_files.where("coalesce(has_sitemap, false) or coalesce(robots_declares_sitemap, false)").select("site_id")
    return bad.join(sites, "site_id", "left_semi").select(*_finding("indexing-sitemap-format", F.col("file"), F.col("error")))


def home_schema(pages: DataFrame, site_files: DataFrame) -> DataFrame:
    """schema-website-missing: start pages whose JSON-LD names neither Organization nor WebSite."""
    rows = flagged(pages).where("ok").select("site_id", "page_id", "path", "json_ld").dropDuplicates(["site_id", "page_id"])
    home = rows.join(site_files.select("site_id", urls.path(F.col("start_url")).alias("start")), "site_id").where("path = start")
    named = F.exists(F.coalesce("json_ld", F.array().cast("array<string>")), lambda j: j.rlike(r'"@type"\s*:\s*(\[[^\]]*)?"(Organization|WebSite)"'))
    return home.where(~named).select(*_finding("schema-website-missing", F.col("path")))
