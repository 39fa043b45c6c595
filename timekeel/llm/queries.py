"""The registered queries: each applies one operator to its whole table.

Those without SQL rest on fitted models, tokenizers, random draws, spans by position or
searches that SQL cannot express or run on whole tables. `tests/llm` holds each against
brute force, an exact round trip or held-out rows instead.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import collocations, conversations, language, near_duplicates, neighbours, oracles, packing, pii, positive_unlabelled, quality, secret_scan, shards, transducer, wavelet
from .common import documents, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LEVEL_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query
def op2_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(documents(spark, sf_dir), LEVEL_BPE)


@query
def op3_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


@query
def op4_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir))


@query
def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


@query
def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)


@query
def op7_lookahead_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(documents(spark, sf_dir), WORD_BPE)


@query
def op8_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(documents(spark, sf_dir))


@query
def op9_contextual_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


@query
def op10_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_BPE)


@query
def op11_lr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(ship(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLES["op11_lr_repair"] = oracles.CONVERSATIONS


@query
def op12_toivonen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


ORACLES["op12_toivonen"] = oracles.COLLOCATIONS


@query
def op13_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive_unlabelled.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
