"""The audit's rules: one catalogue, and one pass over the pages for every rule that needs a single page.

Findings are long: (site_id, rule_id, url, note, ord).  Page rules are array elements of one projection, so a scan
serves all of them and Catalyst prunes what a chosen subset does not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text, urls


class Rule(NamedTuple):
    id: str
    category: str
    impact: str
    effort: str
    risk: str
    confidence: int


def _rules(category: str, table: str) -> list[Rule]:
    return [Rule(i, category, a, e, r, int(c)) for i, a, e, r, c in (line.split() for line in table.strip().splitlines())]


#: Rule ids with impact, effort, risk and confidence, by category.
CATALOG = [
    *_rules("metadata", """
meta-title-missing high low low 100
meta-title-duplicate medium low low 100
meta-title-length low low low 90
meta-description-missing medium low low 100
meta-description-duplicate low low low 100
meta-og-image-missing low low low 95
meta-og-image-url low low low 95
content-keyword-alignment low medium low 55"""),
    *_rules("indexing", """
indexing-noindex critical low medium 100
indexing-noindex-utility low low low 60
indexing-robots-unavailable critical medium low 95
indexing-robots-blocks-google critical low medium 95
indexing-robots-blocks-pages high low medium 85
indexing-robots-html medium low low 90
indexing-robots-format medium low low 90
indexing-broken-page high medium low 100
indexing-soft-404-site high medium low 90
indexing-soft-404 medium medium low 70
indexing-canonical-missing medium low low 95
indexing-canonical-mismatch high low medium 80
indexing-canonical-target-invalid high low low 90
indexing-canonical-multiple high low low 95
indexing-meta-refresh medium low low 95
indexing-hreflang-invalid high medium low 85
indexing-duplicate-content high medium medium 80
indexing-redirect-chain low low low 90
indexing-temporary-redirect low low low 85
indexing-html-lang-missing low low low 100
indexing-sitemap-hygiene medium low low 90
indexing-sitemap-gaps low low low 80
indexing-sitemap-format high low low 90
indexing-https-certificate high low low 95
indexing-host-duplicate high low medium 90
indexing-http-not-redirected high low medium 90"""),
    *_rules("structure", """
structure-h1-missing medium low low 100
structure-h1-multiple low low low 100
structure-heading-skip low low low 85
structure-thin-content medium high low 80
structure-url-format low medium medium 85
content-readability low medium low 55
content-keyword-stuffing medium medium low 70"""),
    *_rules("images", """
img-alt-missing medium low low 100
img-dimensions-missing medium low low 90
img-lazy-missing low low low 70
img-legacy-format medium medium low 90
img-broken high low low 95"""),
    *_rules("schema", """
schema-missing medium medium low 90
schema-invalid medium low low 90
schema-website-missing low low low 85"""),
    *_rules("internal-linking", """
link-orphan-pages high medium low 90
link-deep-pages medium medium low 80
link-broken-internal medium low low 100
link-broken-external medium low low 95
link-malformed medium low low 90
link-generic-anchors low low low 85
link-missing-internal-opportunities medium low low 75"""),
    *_rules("performance", """
perf-core-web-vitals medium high low 95
perf-slow-ttfb medium medium low 85
perf-render-blocking medium medium medium 75
perf-oversized-images medium low low 85
perf-heavy-html low medium low 80
perf-mixed-content high low medium 95
perf-broken-assets high low low 90
perf-viewport-missing high low low 100
perf-viewport-no-width medium low low 95"""),
    *_rules("framework", """
framework-sitemap-missing medium low low 95
framework-robots-missing low low low 95
framework-robots-no-sitemap low low low 90
framework-js-only-content high high medium 75"""),
]
BY_ID = {r.id: r for r in CATALOG}

#: Anchors that say nothing about their target.
GENERIC_ANCHORS = ["click here", "here", "read more", "learn more", "this", "link", "more"]
#: Titles and headings of error pages.
SOFT_404 = (
    r"(?i)(^|[\s|:–-])404([\s|:–-]|\z)|(?<![A-Za-z0-9_])page (?:was )?not found(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?:could not|can['’]?t|cannot) be found(?![A-Za-z0-9_])"
    r"|^\s*not found\s*\z|page introuvable|page non trouv[ée]e|seite nicht gefunden|p[áa]gina no encontrada|pagina non trovata|pagina niet gevonden"
)
#: Malformed links, the first that matches names the fault.
MALFORMED = [
    (r"(?i)^https?:/(?!/)", "one slash"),
    (r"(?i)^https?//", "missing colon"),
    (r"(?i)^(?:htp|htps|htt|hhtp|htttp|htttps|ttp|ttps):", "misspelt scheme"),
    (r"\\", "backslash"),
    (r"^\S*\s+\S", "space inside"),
]
#: Properties that search engines require, by type; a list needs one of its members.
SCHEMA_REQUIRED: dict[str, list] = {
    "Product": ["name", ["offers", "review", "aggregateRating"]],
    "BreadcrumbList": ["itemListElement"],
    "Event": ["name", "startDate", "location"],
    "LocalBusiness": ["name", "address"],
    "Recipe": ["name", "image"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
    "JobPosting": ["title", "datePosted", "description", "hiringOrganization"],
    "Review": ["author", "reviewRating"],
}
_SHELL = r"(?is)<(div|main)\b[^>]*\bid\s*=\s*[\"'](root|app|__next|__nuxt|svelte)[\"'][^>]*>\s*</\1>|<app-root\b[^>]*>\s*</app-root>"


def flagged(pages: DataFrame) -> DataFrame:
    """Pages with the populations rules draw from: ok, errored, meta_noindex, noindex, path."""
    status = F.coalesce("status", F.lit(0))
    meta = text.meta_noindex(F.col("meta_robots"), F.col("meta_googlebot"))
    return pages.withColumns(
        {
            "ok": (status >= 200) & (status < 300),
            "errored": status >= 400,
            "meta_noindex": meta,
            "noindex": meta | text.header_noindex(F.col("x_robots_tag")),
            "path": F.coalesce(urls.path(F.col("url")), F.col("url")),
        }
    )


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _n(c: Column) -> Column:
    return c.cast("string")


def _head() -> Column:
    at = F.regexp_instr(F.col("html"), F.lit("(?i)</head>"))
    return F.when(at > 1, F.substring(F.col("html"), F.lit(1), at - 1)).otherwise(F.col("html"))


def _og_problem() -> Column:
    v = F.trim(F.try_element_at("og", F.lit("og:image")))
    local = r"(?i)^(localhost|127\.\d+\.\d+\.\d+|0\.0\.0\.0|\[::1\])$"
    bare = lambda u: F.regexp_replace(urls.host(u), r":\d+$", "")
    return (
        F.when(v.isNull() | v.startswith("//"), None)
        .when(~v.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), F.lit("relative URL"))
        .when(~v.rlike(r"(?i)^https?:"), F.concat(F.lower(F.substring_index(v, ":", 1)), F.lit(" URL")))
        .when(urls.host(v).isNull() | (urls.host(v) == ""), F.lit("malformed URL"))
        .when(bare(v).rlike(local) & ~F.coalesce(bare(F.col("url")).rlike(local), F.lit(False)), F.lit("points at localhost"))
    )


def _malformed(href: Column) -> Column:
    h = F.trim(href)
    fault = F.lit(None).cast("string")
    for pattern, name in reversed(MALFORMED):
        fault = F.when(h.rlike(pattern), F.lit(name)).otherwise(fault)
    return F.when((h != "") & ~h.rlike("(?i)^(mailto|tel|javascript|data|sms):") & ~h.startswith("#"), fault)


def _schema_nodes() -> Column:
    """JSON-LD nodes, the members of a top-level array or of @graph one by one, as JSON strings."""
    blocks = F.coalesce(F.col("json_ld"), F.array().cast("array<string>"))
    members = lambda b: F.coalesce(
        F.from_json(F.get_json_object(b, "$.@graph"), "array<string>"), F.when(F.ltrim(b).startswith("["), F.from_json(b, "array<string>")), F.array(b)
    )
    return F.flatten(F.transform(blocks, members))


def _missing(node: Column) -> Column:
    """What a node lacks, 'Type missing a, b' per type; types given as an array count too."""
    kind = F.get_json_object(node, "$.@type")
    faults = []
    for name, required in SCHEMA_REQUIRED.items():
        absent = lambda p: F.coalesce(F.get_json_object(node, f"$.{p}"), F.lit("")) == ""
        lacks = []
        for need in required:
            if isinstance(need, list):
                gone = absent(need[0])
                for p in need[1:]:
                    gone = gone & absent(p)
                lacks.append(F.when(gone, F.lit("one of " + "/".join(need))))
            else:
                lacks.append(F.when(absent(need), F.lit(need)))
        missing = F.array_compact(F.array(*lacks))
        typed = (kind == name) | kind.contains(f'"{name}"')
        faults.append(F.when(typed & (F.size(missing) > 0), F.concat(F.lit(f"{name} missing "), F.array_join(missing, ", "))))
    return F.array_compact(F.array(*faults))


def page_rules() -> dict[str, tuple[Column, Column]]:
    """Predicate and note of every rule that one page decides."""
    c = F.col
    indexable = c("ok") & ~c("meta_noindex")
    title = F.trim(F.coalesce("title", F.lit("")))
    empty = lambda name, kind: F.coalesce(c(name), F.array().cast(kind))
    images = empty("images", "array<struct<src:string,alt:string,width:int,height:int,loading:string>>")
    links = empty("links", "array<struct<href:string,internal:boolean,anchor:string,nofollow:boolean>>")
    headings = empty("headings", "array<struct<level:int,text:string>>")
    levels = F.transform(headings, lambda h: h["level"])
    steps = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: b > a + 1)
    h1s = empty("h1s", "array<string>")
    lazy = F.size(F.filter(images, lambda i: F.lower(i["loading"]) == "lazy"))
    bare = F.size(F.filter(images, lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) == ""))
    generic = F.size(F.filter(links, lambda x: x["internal"] & F.lower(F.trim(x["anchor"])).isin(GENERIC_ANCHORS)))
    blocking = F.coalesce(c("render_blocking.scripts"), F.lit(0)) + F.coalesce(c("render_blocking.stylesheets"), F.lit(0))
    faults = F.array_compact(F.transform(links, lambda x: _malformed(x["href"])))
    words = F.coalesce("word_count", F.lit(0))
    schema = F.flatten(F.transform(_schema_nodes(), _missing))
    ease = text.reading_ease(c("text_content"))
    og_problem = _og_problem()
    canonicals = F.regexp_count(_head(), F.lit(r"(?i)<link\b[^>]*\brel=[\"']?canonical\b[^>]*>"))
    soft = F.coalesce(c("title"), F.lit("")).rlike(SOFT_404) | F.coalesce(F.get(h1s, F.lit(0)), F.lit("")).rlike(SOFT_404)
    # A null would hide that a page has no canonical at all.
    elsewhere = F.coalesce(urls.page_key(urls.resolve(F.nullif(c("canonical"), F.lit("")), c("url"))) != urls.page_key(c("url")), F.lit(False))
    params = F.when(c("url").contains("?"), F.size(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda x: x != ""))).otherwise(0)
    shape = F.array_compact(
        F.array(
            F.when(urls.path(c("url")).contains("_"), F.lit("underscore")),
            F.when(params > 2, F.concat(_n(params), F.lit(" parameters"))),
            F.when(F.length("url") > 200, F.lit("long")),
        )
    )
    none = F.lit(None).cast("string")
    return {
        "meta-title-missing": (indexable & (title == ""), none),
        "meta-title-length": (indexable & (title != "") & ((F.length(title) < 15) | (F.length(title) > 65)), _n(F.length("title"))),
        "meta-description-missing": (indexable & _blank("meta_description"), none),
        "meta-og-image-missing": (c("ok") & (F.coalesce(F.try_element_at("og", F.lit("og:image")), F.lit("")) == ""), none),
        "meta-og-image-url": (c("ok") & (F.coalesce(F.try_element_at("og", F.lit("og:image")), F.lit("")) != "") & og_problem.isNotNull(), og_problem),
        "indexing-canonical-missing": (indexable & (F.coalesce("canonical", F.lit("")) == ""), none),
        "indexing-html-lang-missing": (c("ok") & (F.coalesce("lang", F.lit("")) == ""), none),
        "indexing-broken-page": (c("errored"), _n(c("status"))),
        "indexing-soft-404": (c("ok") & (words < 250) & soft, none),
        "indexing-canonical-multiple": (c("ok") & (canonicals > 1), _n(canonicals)),
        "indexing-meta-refresh": (c("ok") & _head().rlike(r"(?i)<meta\b[^>]*http-equiv=[\"']?refresh[\"']?[^>]*>"), none),
        "structure-h1-missing": (indexable & (F.size(h1s) == 0), none),
        "structure-h1-multiple": (indexable & (F.size(h1s) > 1), _n(F.size(h1s))),
        "structure-heading-skip": (indexable & F.exists(steps, lambda s: F.coalesce(s, F.lit(False))), none),
        "structure-thin-content": (indexable & (words < 120), _n(words)),
        "structure-url-format": (c("ok") & ~c("noindex") & ~elsewhere & (F.size(shape) > 0), F.array_join(shape, "; ")),
        "content-readability": (indexable & (words >= 200) & (ease < 20), _n(ease)),
        "img-alt-missing": (c("ok") & (bare > 0), _n(bare)),
        "img-dimensions-missing": (c("ok") & (F.coalesce("images_missing_dims", F.lit(0)) > 0), _n(c("images_missing_dims"))),
        "img-lazy-missing": (c("ok") & (F.size(images) >= 5) & (lazy / F.size(images) < 0.3), _n(F.size(images) - lazy)),
        "schema-missing": (indexable & (F.size(empty("json_ld", "array<string>")) == 0), none),
        "schema-invalid": (indexable & (F.size(schema) > 0), F.array_join(F.slice(schema, 1, 3), "; ")),
        "link-deep-pages": (F.coalesce("depth", F.lit(0)) >= 4, _n(c("depth"))),
        "link-generic-anchors": (c("ok") & (generic > 0), _n(generic)),
        "link-malformed": (c("ok") & (F.size(faults) > 0), F.concat(_n(F.size(faults)), F.lit(" "), F.get(faults, F.lit(0)))),
        "perf-slow-ttfb": (c("ok") & (c("response_time_ms") > 800), _n(c("response_time_ms"))),
        "perf-render-blocking": (c("ok") & (blocking >= 3), _n(blocking)),
        "perf-heavy-html": (c("ok") & (c("html_bytes") > 250_000), _n(c("html_bytes"))),
        "perf-viewport-missing": (c("ok") & (F.coalesce("viewport", F.lit("")) == ""), none),
        "perf-viewport-no-width": (c("ok") & (F.coalesce("viewport", F.lit("")) != "") & ~F.lower("viewport").rlike(r"width\s*="), none),
        "framework-js-only-content": (
            indexable & (words < 50) & F.coalesce(c("html").rlike(r"(?is)<script\b[^>]*\bsrc\s*=") & c("html").rlike(_SHELL), F.lit(False)), none,
        ),
    }


#: Rules that users add: id, its row of the catalogue, and what makes its test and note from the columns of ``flagged``.
_ADDED: dict[str, tuple[Rule, Callable[[], tuple[Column, Column]]]] = {}


def register(rule: Rule, test: Callable[[], tuple[Column, Column]]) -> None:
    """Adds a page rule: ``test`` gives when it fires and its note.  An id of the catalogue cannot be taken."""
    if rule.id in BY_ID:
        raise ValueError(f"{rule.id} is a rule already")
    _ADDED[rule.id] = (rule, test)


def unregister(rule_id: str) -> None:
    _ADDED.pop(rule_id, None)


def catalogue() -> list[Rule]:
    """All rules, those that users added last."""
    return [*CATALOG, *(rule for rule, _ in _ADDED.values())]


FINDING = "site_id string, rule_id string, url string, note string, ord bigint"


def page_findings(pages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(site_id, rule_id, url, note, ord) of the page rules; url is the page's path.

    Rows that repeat a page count once.  Null statuses are neither ok nor errors.
    """
    tests = page_rules() | {rule: make() for rule, (_, make) in _ADDED.items()}
    chosen = {rule: test for rule, test in tests.items() if only is None or rule in only}
    fired = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), note.alias("note"))) for rule, (when, note) in chosen.items()]
    rows = flagged(pages)
    if len(chosen) == 1:
        # A plain filter reaches the scan, an array element doesn't.
        rows = rows.where(next(iter(chosen.values()))[0])
    return (
        rows
        .select("site_id", "page_id", F.col("path").alias("url"), "ord", F.explode(F.array_compact(F.array(*fired))).alias("f"))
        .select("site_id", "page_id", "f.rule_id", "url", "f.note", "ord")
        .distinct()
        .drop("page_id")
    )


def shared_values(pages: DataFrame, column: str, rule: str) -> DataFrame:
    """Findings for indexable pages of a site that share a trimmed, lower-case value.

    Values are counted before they meet the pages again, so a value that a third of the pages has stays cheap.
    """
    rows = (
        flagged(pages)
        .where("ok and not meta_noindex")
        .select("site_id", "page_id", "ord", F.col("path").alias("url"), F.col(column).alias("note"), F.lower(F.trim(column)).alias("key"))
        .where("key <> ''")
        .distinct()
    )
    shared = rows.groupBy("site_id", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, ["site_id", "key"], "left_semi").select("site_id", F.lit(rule).alias("rule_id"), "url", "note", "ord")


def heading_steps(pages: DataFrame) -> DataFrame:
    """(page_id, pos, level, before): headings with the level before, as rows."""
    rows = pages.select("page_id", F.posexplode("headings").alias("pos", "h")).select("page_id", "pos", F.col("h.level").alias("level")).distinct()
    w = Window.partitionBy("page_id").orderBy("pos")
    return rows.select("page_id", "pos", "level", F.lag("level").over(w).alias("before"))


def page_rules_ids() -> list[str]:
    """Ids of the rules that one page decides, without building expressions."""
    return [
        "meta-title-missing", "meta-title-length", "meta-description-missing", "meta-og-image-missing", "meta-og-image-url", "indexing-canonical-missing",
        "indexing-html-lang-missing", "indexing-broken-page", "indexing-soft-404", "indexing-canonical-multiple", "indexing-meta-refresh", "structure-h1-missing",
        "structure-h1-multiple", "structure-heading-skip", "structure-thin-content", "structure-url-format", "content-readability", "img-alt-missing",
        "img-dimensions-missing", "img-lazy-missing", "schema-missing", "schema-invalid", "link-deep-pages", "link-generic-anchors", "link-malformed",
        "perf-slow-ttfb", "perf-render-blocking", "perf-heavy-html", "perf-viewport-missing", "perf-viewport-no-width", "framework-js-only-content",
    ]
