"""Duplicates hidden by formatting: progressive partition refinement.

Round 1 splits all rows by invariants that no reformatting can change and that need no parsing: the numbers of letters
and digits of description and title and their letter histograms.  Only rows in classes with several members go on.
Round 2 splits those classes by the costly key: the description's words in order and the title's parts, each a list of
words, in sorted order.  Both rounds find their classes by a partial aggregate, so a class that holds a third of all
rows is combined before the shuffle; its rows are then met by an equi-join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The separators between the parts of a title.
SEPARATORS = r"[|–—\-·»/]|::"
_SPACE = r"[\s\p{Z}\x85]"
_NOT_WORD = r"[^\p{L}\p{N}]+"


def _folded(text: Column, between: str) -> Column:
    """Words with ``between`` between them, case ignored, also where upper case has more letters (ß and SS).

    The words are cut out between the two case changes: next to each other the optimizer would drop the first.
    """
    return F.lower(F.regexp_replace(F.upper(text), _NOT_WORD, between))


def words_in_order(text: Column) -> Column:
    """The words of a text joined by single spaces; '' if it has none."""
    return F.trim(_folded(text, " "))


def title_parts(title: Column) -> Column:
    """Sorted list of the title's parts, each as its words in order; parts without words are left out."""
    parts = F.split(title, rf"(?<={_SPACE})(?:{SEPARATORS})(?={_SPACE})")
    return F.array_sort(F.filter(F.transform(parts, words_in_order), lambda p: p != ""))


def _squeezed(text: Column) -> Column:
    return _folded(text, "")


def _histogram(text: Column) -> Column:
    """A text's letters in sorted order say how often each occurs."""
    return F.array_join(F.array_sort(F.split(text, "")), "")


def invariants(title: Column, description: Column) -> Column:
    """One 64-bit value of the cheap invariants: stripped lengths and letter histograms."""
    t, d = _squeezed(title), _squeezed(description)
    return F.xxhash64(F.length(t), F.length(d), _histogram(t), _histogram(d))


def _several(classes: DataFrame, key: str) -> DataFrame:
    """Keys with several different page_ids, and the lowest of them."""
    return (
        classes.groupBy(key)
        .agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"))
        .where("lo < hi")
        .select(key, F.col("lo").alias("first_page_id"))
    )


def refine(pages: DataFrame) -> DataFrame:
    """(key, page_id) of the rows that survive round 1; null page_ids and texts without a word are left out."""
    holds_word = F.col("title").rlike(r"[\p{L}\p{N}]") & F.col("meta_description").rlike(r"[\p{L}\p{N}]")
    rows = pages.select("page_id", "title", "meta_description").where(F.col("page_id").isNotNull() & holds_word)
    rows = rows.withColumn("cheap", invariants(F.col("title"), F.col("meta_description")))
    alive = _several(rows.select("page_id", "cheap"), "cheap").select("cheap")
    survivors = rows.join(alive, "cheap", "left_semi")
    costly = F.sha2(
        F.concat_ws("\n", words_in_order(F.col("meta_description")), F.array_join(title_parts(F.col("title")), "\n")), 256
    )
    return survivors.select(costly.alias("key"), "page_id")


def format_copies(pages: DataFrame) -> DataFrame:
    """(first_page_id, page_id): each page of a group of copies but its lowest page_id.

    Rows that repeat a page_id count once.  An empty table gives no rows; extra columns are ignored.
    """
    keyed = refine(pages)
    return keyed.join(_several(keyed, "key"), "key").where("page_id > first_page_id").select("first_page_id", "page_id").distinct()


def collapsed(pages: DataFrame) -> DataFrame:
    """(first_page_id, copies): one record per group of copies and the number of page_ids that carried it."""
    return (
        format_copies(pages)
        .groupBy("first_page_id")
        .agg((F.count("page_id") + 1).alias("copies"))
    )
