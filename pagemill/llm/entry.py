"""Queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import tune
from pagemill.sources.tables import table


def _p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.format_copies import format_copies

    return format_copies(table(tune(spark), folder, "pages"))


def _p1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.format_copies import collapsed

    return collapsed(table(tune(spark), folder, "pages"))


def _p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.residue import residue_found

    return residue_found(table(tune(spark), folder, "pages"))


def _p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.lookalike import lookalike_found

    return lookalike_found(table(tune(spark), folder, "pages"))


def _p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.main_content import main_found

    return main_found(table(tune(spark), folder, "pages"))


def _p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.near_copies import near_pairs

    return near_pairs(table(tune(spark), folder, "pages"))


def _p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.near_copies import near_groups

    return near_groups(table(tune(spark), folder, "pages"))


def _p6_links(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.near_copies import near_links

    return near_links(table(tune(spark), folder, "pages"))


def _p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.packing import packed

    tune(spark)
    return packed(table(spark, folder, "documents"), table(spark, folder, "container_spec"))


def _p7_filling(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.packing import filling

    tune(spark)
    return filling(table(spark, folder, "documents"), table(spark, folder, "container_spec"))


def _p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.mixing import mix

    tune(spark)
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def _p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.mixing import shares

    tune(spark)
    return shares(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def _p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.personal import personal_found

    return personal_found(table(tune(spark), folder, "documents"))


def _p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    from pagemill.llm.personal import redacted

    return redacted(table(tune(spark), folder, "documents"))


def queries() -> dict:
    return {
        "p1_found": _p1_found,
        "p1_collapsed": _p1_collapsed,
        "p2_found": _p2_found,
        "p3_found": _p3_found,
        "p4_found": _p4_found,
        "p6_found": _p6_found,
        "p6_groups": _p6_groups,
        "p6_links": _p6_links,
        "p7_packed": _p7_packed,
        "p7_filling": _p7_filling,
        "p8_mixed": _p8_mixed,
        "p8_shares": _p8_shares,
        "p9_found": _p9_found,
        "p9_redacted": _p9_redacted,
    }


def oracle_sql() -> dict[str, str]:
    from pagemill.llm import sql

    return dict(sql.ORACLE)
