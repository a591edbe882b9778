"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidra.llm import balltree, decontam, html_tree, lm, negatives, ogg, packing, pii, quality, shared, simhash, substring, tokenfile, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.stored(_table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), shared.tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.new_folder(spark, "tokens")
    tokenfile.write_token_files(_table(spark, sf_dir, "documents"), folder, shared.tokenizer_path())
    return tokenfile.read_token_files(spark, folder)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(_table(spark, sf_dir, "embeddings"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_html": op1_html,
        "op2_simhash": op2_simhash,
        "op3_pii": op3_pii,
        "op4_lm": op4_lm,
        "op5_media": op5_media,
        "op6_packing": op6_packing,
        "op7_toxicity": op7_toxicity,
        "op8_tokenfile": op8_tokenfile,
        "op9_substring": op9_substring,
        "op10_decontam": op10_decontam,
        "op11_negatives": op11_negatives,
        "op12_quality": op12_quality,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_lm": lm.REPORT_SQL,
        "op9_substring": substring.REPORT_SQL,
        "op10_decontam": decontam.REPORT_SQL,
        "op11_negatives": negatives.REPORT_SQL,
        "op13_centroids": balltree.REPORT_SQL,
    }
