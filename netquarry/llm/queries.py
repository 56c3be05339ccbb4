"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm import (
    chunk_codec,
    langid,
    line_dedup,
    merkle_manifest,
    nn_descent,
    oracles,
    packing,
    phrase_mining,
    projection_search,
    repetition,
    secret_ledger,
    simhash_gray,
    token_orc,
    toxicity,
)
from netquarry.llm.staging import documents
from netquarry.session import utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(utc(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_chunk_codec")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.round_trip(documents(spark, sf_dir))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels)


@query("op3_langid")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


@query("op4_line_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.occurrences(documents(spark, sf_dir)).drop("row_key")


@query("op5_repetition", oracles.REPETITION)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


@query("op6_nn_descent", oracles.VECTORS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op7_token_orc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.store_and_read(documents(spark, sf_dir))


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op9_secret_ledger", oracles.SECRETS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secrets(documents(spark, sf_dir))


@query("op10_simhash_gray")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(documents(spark, sf_dir))


@query("op11_projection_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_search.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_merkle_manifest", oracles.MANIFEST)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(documents(spark, sf_dir))


@query("op13_phrase_mining", oracles.PHRASES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(documents(spark, sf_dir))
