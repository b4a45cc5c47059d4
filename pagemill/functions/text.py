"""Text measures and robots directives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a page's topic.
STOPWORDS = (
    "a an the and or but if then else for to of in on at by with without from as is are was were be been being this that these those it its it's "
    "you your yours we our us they them their he she his her i me my mine do does did done have has had having will would can could should may "
    "might must not no yes so than too very just also more most some any all each every other into out up down over under again once here there "
    "when where why how what which who whom whose about above below between through during before after get got make made use used using new one "
    "two three per via etc into onto off out"
).split()
_SPACE = r"[\s\p{Z}\x{FEFF}\x85]+"


def words(text: Column) -> Column:
    """Stretches between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case terms of 3 to 24 letters and digits that are no stop words and no numbers."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]", " ")
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOPWORDS)])
    return F.filter(
        F.split(plain, " +"), lambda w: F.length(w).between(3, 24) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")
    )


def syllables(word: Column) -> Column:
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.regexp_count(F.regexp_replace(letters, r"e$", ""), F.lit("[aeiouy]+"))
    return F.when(F.length(letters) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), groups))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease, rounded half up; 100 below 20 words."""
    ws = words(text)
    n = F.size(ws)
    stops = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[.!?]+"))
    sentences = F.greatest(F.lit(1), stops, F.floor(n / 25 + 0.5))
    spoken = F.aggregate(ws, F.lit(0), lambda a, w: a + syllables(w))
    ease = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (spoken / n)
    return F.when(n < 20, F.lit(100).cast("bigint")).otherwise(F.floor(F.round(ease, 9) + 0.5))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters, as bigint."""
    return F.aggregate(
        F.split(text, ""), F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint"))
    )


_NOINDEX = r"(?<![A-Za-z0-9_])(noindex|none)(?![A-Za-z0-9_])"


def meta_noindex(robots: Column, googlebot: Column) -> Column:
    found = [F.coalesce(F.lower(c).rlike(_NOINDEX), F.lit(False)) for c in (robots, googlebot)]
    return found[0] | found[1]


def header_directives(header: Column, agent: str = "googlebot") -> Column:
    """The directives of an X-Robots-Tag value that apply to ``agent``; a crawler's scope holds for what follows it."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), ","), lambda p: F.trim(p)), lambda p: p != "")
    scoped = lambda p: p.rlike(r"^[a-z0-9_-]+\s*:") & ~p.rlike(r"^(max-snippet|max-image-preview|max-video-preview|unavailable_after)\s*:")
    named = lambda p: F.trim(F.regexp_extract(p, r"^([a-z0-9_-]+)\s*:", 1))
    rest = lambda p: F.trim(F.regexp_replace(p, r"^[a-z0-9_-]+\s*:", ""))
    start = F.struct(F.lit("").alias("scope"), F.array().cast("array<string>").alias("out"))

    def fold(acc: Column, p: Column) -> Column:
        scope = F.when(scoped(p), named(p)).otherwise(acc["scope"])
        token = F.when(scoped(p), rest(p)).otherwise(p)
        keep = (token != "") & ((scope == "") | (scope == agent))
        return F.struct(scope.alias("scope"), F.when(keep, F.array_append(acc["out"], token)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, fold)["out"]


def header_noindex(header: Column) -> Column:
    return F.arrays_overlap(header_directives(header), F.array(F.lit("noindex"), F.lit("none")))
