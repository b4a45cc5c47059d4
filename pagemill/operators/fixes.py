"""Patch texts for rules that a template can mend, by framework.

A patch is made against the text of the file it changes: lines go behind the opening tag they belong in, attributes into
it.  A file that is missing is created.  Where the text holds no place for the change there is no patch.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where each framework keeps its parts.
FILES = {
    "nextjs": {"layout": "app/layout.tsx", "robots": "public/robots.txt", "sitemap": "public/sitemap.xml", "page": "app/page.tsx"},
    "nuxt": {"layout": "app.vue", "robots": "public/robots.txt", "sitemap": "public/sitemap.xml", "page": "pages/index.vue"},
    "astro": {"layout": "src/layouts/Layout.astro", "robots": "public/robots.txt", "sitemap": "public/sitemap.xml", "page": "src/pages/index.astro"},
    "sveltekit": {"layout": "src/app.html", "robots": "static/robots.txt", "sitemap": "static/sitemap.xml", "page": "src/routes/+page.svelte"},
    "wordpress": {"layout": "header.php", "robots": "robots.txt", "sitemap": "sitemap.xml", "page": "index.php"},
    "static": {"layout": "index.html", "robots": "robots.txt", "sitemap": "sitemap.xml", "page": "index.html"},
}
#: Rule, part it mends and the lines that mend it; {origin} is the site's.
LINES = {
    "framework-robots-missing": ("robots", ["User-agent: *", "Allow: /", "Sitemap: {origin}/sitemap.xml"]),
    "framework-robots-no-sitemap": ("robots", ["Sitemap: {origin}/sitemap.xml"]),
    "framework-sitemap-missing": (
        "sitemap",
        ['<?xml version="1.0" encoding="UTF-8"?>', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "  <url><loc>{origin}/</loc></url>", "</urlset>"],
    ),
    "perf-viewport-missing": ("layout", ['<meta name="viewport" content="width=device-width, initial-scale=1">']),
    "indexing-html-lang-missing": ("layout", ['<html lang="en">']),
    "indexing-canonical-missing": ("layout", ['<link rel="canonical" href="{origin}/">']),
    "schema-missing": ("layout", ['<script type="application/ld+json">{{"@context":"https://schema.org","@type":"WebPage","url":"{origin}/"}}</script>']),
    "schema-website-missing": ("page", ['<script type="application/ld+json">{{"@context":"https://schema.org","@type":"WebSite","url":"{origin}/"}}</script>']),
    "meta-og-image-missing": ("layout", ['<meta property="og:image" content="{origin}/og.png">']),
    "meta-og-image-url": ("layout", ['<meta property="og:image" content="{origin}/og.png">']),
}


#: The tag behind which a part's lines go.
_HEAD = re.compile(r"<(?:head|Head|svelte:head)\b[^>]*>[ \t]*\n?")
_HTML = re.compile(r"<html\b(?![^>]*\blang\s*=)")


def changed(rule: str, text: str | None, origin: str = "https://example.com") -> str | None:
    """The text of a file with the rule mended; None where it has no place for it or needs no change."""
    if rule not in LINES:
        return None
    part, lines = LINES[rule]
    added = [line.format(origin=origin) for line in lines]
    if rule == "indexing-html-lang-missing":
        found = _HTML.search(text or "")
        return text[: found.end()] + ' lang="en"' + text[found.end() :] if found else None
    if part in ("robots", "sitemap"):
        if not text:
            return "\n".join(added) + "\n"
        missing = [line for line in added if line not in text.splitlines()]
        return text.rstrip("\n") + "\n" + "\n".join(missing) + "\n" if missing and part == "robots" else None
    found = _HEAD.search(text or "")
    if not found or any(line in text for line in added):
        return None
    indent = re.match(r"[ \t]*", text[found.end() :])[0] or "  "
    return text[: found.end()] + ("" if found[0].endswith("\n") else "\n") + "".join(f"{indent}{line}\n" for line in added) + text[found.end() :]


def patch(rule: str, framework: str | None, origin: str = "https://example.com", text: str | None = None) -> str | None:
    """A unified diff that mends the rule in ``text``, by default a minimal file of the framework; None where none can."""
    if rule not in LINES:
        return None
    name = FILES.get(framework or "static", FILES["static"])[LINES[rule][0]]
    if text is None:
        text = SKELETON if LINES[rule][0] in ("layout", "page") else ROBOTS if rule == "framework-robots-no-sitemap" else None
    new = changed(rule, text, origin)
    if new is None:
        return None
    before, after = (text or "").splitlines(keepends=True), new.splitlines(keepends=True)
    return "".join(difflib.unified_diff(before, after, f"a/{name}" if text else "/dev/null", f"b/{name}"))


#: What a part looks like where its text is not given.
SKELETON = "<!doctype html>\n<html>\n<head>\n  <meta charset=\"utf-8\">\n</head>\n<body>\n</body>\n</html>\n"
ROBOTS = "User-agent: *\nAllow: /\n"


def templates(spark: SparkSession) -> DataFrame:
    """(rule_id, framework, file, patch): every rule with a template and every framework, against minimal files."""
    rows = [(r, f, FILES[f][LINES[r][0]], patch(r, f)) for r in LINES for f in FILES]
    return spark.createDataFrame(rows, "rule_id string, framework string, file string, patch string")


def patched(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(site_id, rule_id, file, patch) for findings (site_id, rule_id) and source files (site_id, framework, origin, file, text).

    Rules without a template, and files without a place for the change, give no row; a missing robots or sitemap file is
    a row of ``files`` with null text.
    """
    @F.pandas_udf("string")
    def part(rule: pd.Series, framework: pd.Series, file: pd.Series, text: pd.Series, origin: pd.Series) -> pd.Series:
        return pd.Series([_patch_of(*row) for row in zip(rule, framework, file, text, origin)], dtype=object)

    met = findings.where(F.col("rule_id").isin(*LINES)).select("site_id", "rule_id").distinct().join(files, "site_id")
    made = met.select("site_id", "rule_id", "file", part("rule_id", "framework", "file", "text", "origin").alias("patch"))
    return made.where("patch is not null")


def _patch_of(rule: str, framework: str | None, file: str, text: str | None, origin: str | None) -> str | None:
    wanted = FILES.get(framework or "static", FILES["static"])[LINES[rule][0]]
    if file != wanted or (text is None and LINES[rule][0] in ("layout", "page")):
        return None
    return patch(rule, framework, origin or "https://example.com", text)
