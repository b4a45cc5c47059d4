"""Fields of a page from its HTML, by pattern and without a DOM; every expression stays in the JVM.

Null html gives nulls and empty arrays.  Attribute values must be quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls

#: The caps of the audited crawler on what is kept of a page; queries keep all (WHOLE).
CAPS = {"html": 60_000, "text": 12_000, "headings": 60, "images": 120, "links": 300, "anchor": 120, "body_bytes": 512 * 1024}
WHOLE: dict[str, int] = {}
#: Entities in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]
_SPACE = r"[\s\p{Z}\x{FEFF}]+"


def decode(text: Column) -> Column:
    """Common entities, then numeric ones; a code point that does not exist is dropped."""
    out = text
    for entity, char in ENTITIES:
        out = F.regexp_replace(out, "(?i)" + entity, char.replace("$", r"\$"))
    parts = F.regexp_extract_all(out, F.lit(r"(?is)(&#x[0-9a-f]{1,6};|&#[0-9]{1,7};|[^&]+|&)"), F.lit(1))

    def one(p: Column) -> Column:
        hexed, dec = p.rlike(r"(?i)^&#x[0-9a-f]{1,6};$"), p.rlike(r"^&#[0-9]{1,7};$")
        point = F.when(hexed, F.conv(F.regexp_extract(p, "(?i)^&#x([0-9a-f]+);$", 1), 16, 10).cast("bigint")).when(dec, F.regexp_extract(p, "^&#([0-9]+);$", 1).cast("bigint"))
        valid = point.between(1, 1114111) & ~point.between(55296, 57343)
        over = point - 65536
        pair = F.concat(F.hex(F.shiftright(over, 10) + 55296), F.hex(over.bitwiseAND(F.lit(1023).cast("bigint")) + 56320))
        wide = F.decode(F.unhex(F.when(point < 65536, F.lpad(F.hex(point), 4, "0")).otherwise(pair)), "UTF-16BE")
        return F.when(~hexed & ~dec, p).when(valid, wide).otherwise("")

    numeric = F.array_join(F.transform(parts, one), "")
    return F.trim(F.when(F.contains(out, F.lit("&#")), numeric).otherwise(out))


def plain(markup: Column) -> Column:
    """Text without tags, white space collapsed, entities decoded."""
    return decode(F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), _SPACE, " ")))


def attr(tag: Column, name: str) -> Column:
    """A quoted attribute, decoded; null if the tag has none."""
    found = F.regexp_extract(tag, rf"(?is){name}\s*=\s*(\"([^\"]*)\"|'([^']*)')", 1)
    return F.when(found != "", decode(F.substring(found, F.lit(2), F.length(found) - 2)))


def tags(html: Column, pattern: str) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(0))


def head(html: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1), F.lit("")), html)


def visible(html: Column) -> Column:
    """Text of the body, or of the whole page where none is closed, without scripts, styles, noscript and templates."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), html)
    return plain(F.regexp_replace(body, r"(?is)<(script|style|noscript|template)\b.*?</\1>", " "))


def meta(metas: Column, name: str) -> Column:
    """Content of the first meta tag of that name or property."""
    own = F.filter(metas, lambda t: (F.lower(attr(t, "name")) == name) | (F.lower(attr(t, "property")) == name))
    return attr(F.get(own, F.lit(0)), "content")


def title(html: Column) -> Column:
    return F.when(html.rlike(r"(?is)<title[^>]*>.*?</title>"), plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def canonical(html: Column) -> Column:
    return attr(F.get(tags(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*>"), F.lit(0)), "href")


def headings(html: Column) -> Column:
    found = tags(html, r"(?is)<h([1-6])\b[^>]*>.*?</h\1>")
    rows = F.transform(found, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), plain(h).alias("text")))
    return F.filter(rows, lambda h: h["text"] != "")


def images(html: Column) -> Column:
    found = F.filter(tags(html, r"(?is)<img\b[^>]*>"), lambda t: attr(t, r"\bsrc").isNotNull())
    number = lambda t, name: F.when(attr(t, name).rlike("^[0-9]+$"), attr(t, name).cast("int"))
    return F.transform(
        found,
        lambda t: F.struct(
            attr(t, r"\bsrc").alias("src"), attr(t, r"\balt").alias("alt"), number(t, r"\bwidth").alias("width"), number(t, r"\bheight").alias("height"), attr(t, r"\bloading").alias("loading")
        ),
    )


def links(html: Column, base: Column, anchor: int | None = None) -> Column:
    """Links but fragments, mail, telephone and script ones; internal if root-relative or of the page's origin."""
    found = tags(html, r"(?is)<a\b[^>]*>.*?</a>")
    opening = lambda a: F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0)
    rows = F.transform(
        found,
        lambda a: F.struct(
            attr(opening(a), r"\bhref").alias("href"), plain(a).alias("anchor"), F.coalesce(F.lower(attr(opening(a), r"\brel")), F.lit("")).contains("nofollow").alias("nofollow")
        ),
    )
    kept = F.filter(rows, lambda x: (x["href"] != "") & ~x["href"].rlike("(?i)^(#|mailto:|tel:|javascript:)"))
    own = lambda x: x["href"].startswith("/") | F.coalesce(F.startswith(x["href"], urls.origin(base)), F.lit(False))
    return F.transform(kept, lambda x: F.struct(x["href"].alias("href"), own(x).alias("internal"), _first(x["anchor"], anchor).alias("anchor"), x["nofollow"].alias("nofollow")))


def json_ld(html: Column) -> Column:
    """JSON-LD blocks that parse, as written."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, lambda j: F.trim(j)), lambda j: F.try_parse_json(j).isNotNull())


def _first(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def extracted(pages: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """page_id and every field that html and url give; pages need page_id, url and html.  What ``caps`` does not name is kept whole."""
    some = lambda items, name: F.slice(items, 1, caps[name]) if name in caps else items
    html = F.col("html")
    metas = tags(html, r"(?is)<meta\b[^>]*>")
    head_metas = tags(head(html), r"(?is)<meta\b[^>]*>")
    og = F.filter(head_metas, lambda t: F.coalesce(F.lower(attr(t, r"\bproperty")).startswith("og:"), F.lit(False)) & (F.coalesce(attr(t, r"\bcontent"), F.lit("")) != ""))
    alternates = F.filter(tags(head(html), r"(?is)<link\b[^>]*\brel\s*=\s*[\"']alternate[\"'][^>]*>"), lambda t: attr(t, "hreflang").isNotNull() & attr(t, r"\bhref").isNotNull())
    seen = visible(html)
    scripts = F.filter(tags(head(html), r"(?is)<script\b[^>]*>"), lambda t: t.rlike(r"(?i)\bsrc\s*=") & ~t.rlike(r"(?i)\b(async|defer)\b|type\s*=\s*[\"']module"))
    sheets = F.filter(tags(head(html), r"(?is)<link\b[^>]*\brel\s*=\s*[\"']stylesheet[\"'][^>]*>"), lambda t: ~t.rlike(r"(?i)media\s*=\s*[\"']print"))
    found = headings(html)
    pics = images(html)
    return pages.select(
        "page_id", title(html).alias("title"), meta(metas, "description").alias("meta_description"), canonical(html).alias("canonical"),
        attr(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), r"\blang").alias("lang"), F.lower(meta(metas, "robots")).alias("meta_robots"),
        F.lower(meta(metas, "googlebot")).alias("meta_googlebot"), meta(metas, "viewport").alias("viewport"), meta(metas, "twitter:card").alias("twitter_card"),
        F.transform(F.filter(found, lambda h: h["level"] == 1), lambda h: h["text"]).alias("h1s"), some(found, "headings").alias("headings"),
        some(pics, "images").alias("images"), F.size(F.filter(pics, lambda i: i["width"].isNull() | i["height"].isNull())).alias("images_missing_dims"),
        some(links(html, F.col("url"), caps.get("anchor")), "links").alias("links"), json_ld(html).alias("json_ld"),
        F.transform(alternates, lambda t: F.struct(attr(t, "hreflang").alias("lang"), attr(t, r"\bhref").alias("href"))).alias("hreflang"),
        F.map_from_entries(F.transform(og, lambda t: F.struct(F.lower(attr(t, r"\bproperty")), attr(t, r"\bcontent")))).alias("og"),
        _first(seen, caps.get("text")).alias("text_content"), F.size(F.filter(F.split(seen, _SPACE), lambda w: w != "")).alias("word_count"),
        F.octet_length("html").cast("bigint").alias("html_bytes"), F.struct(F.size(scripts).alias("scripts"), F.size(sheets).alias("stylesheets")).alias("render_blocking"),
    )


def asset_refs(pages: DataFrame) -> DataFrame:
    """(page_id, url): stylesheets and scripts a page asks for, resolved."""
    html = F.col("html")
    sheets = F.transform(tags(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']stylesheet[\"'][^>]*>"), lambda t: attr(t, r"\bhref"))
    scripts = F.transform(tags(html, r"(?is)<script\b[^>]*>"), lambda t: attr(t, r"\bsrc"))
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(F.array_distinct(F.array_compact(F.concat(sheets, scripts)))).alias("ref"))
    return rows.select("page_id", urls.resolve(F.col("ref"), F.col("base")).alias("url")).distinct()
