"""The queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hardneg, html_text, langid, licences, line_dedup, neighbours, omh, phrases, pieces, shards, simhash, toxicity
from .common import read


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    return got.select("doc_id", "n_tokens", F.xxhash64("tokens").alias("token_hash"), "lossless")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.of_embeddings(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_licence_scan": op4_licence_scan,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_training_order": op9_training_order,
    "op10_toxicity": op10_toxicity,
    "op11_simhash_near_dedup": op11_simhash_near_dedup,
    "op12_phrase_mining": op12_phrase_mining,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op12_phrase_mining": phrases.ORACLE, "op13_hard_negatives": hardneg.ORACLE}
