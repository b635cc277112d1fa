"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest

    return digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents"), narrow=True)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest

    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import labelled_pages, url_verdicts

    pages = table(spark, sf_dir, "pages")
    found = url_verdicts(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from .oracles import mix_sql, quality_sql, urls_sql

    return {"op4_mix": mix_sql(), "op9_quality": quality_sql(), "op10_urls": urls_sql()}
