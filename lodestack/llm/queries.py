"""Registered queries of this subpackage and the SQL that expresses them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import oracles
from lodestack.llm.bpe import encode_documents
from lodestack.llm.dualtree import exact_top_k
from lodestack.llm.exact import exact_duplicates
from lodestack.llm.langid import identify
from lodestack.llm.lines import dedupe_lines
from lodestack.llm.manifest import audit
from lodestack.llm.minhash import near_duplicates
from lodestack.llm.mixing import plan_mix
from lodestack.llm.negatives import hard_negatives
from lodestack.llm.permutation import approximate_top_k
from lodestack.llm.quality import classify
from lodestack.llm.sharding import shard_documents
from lodestack.llm.substrings import remove_repeats
from lodestack.llm.tables import Scratch, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), shards=24)


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op4")).drop("spans")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_lines(docs, Scratch(spark, "op8")).select("row.doc_id", "n_lines", "n_removed", "kept_sha256")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"), Scratch(spark, "op10"), weights=(3, 1, 2), share=1.5, most=2.0).drop("copies")



def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label, Scratch(spark, "op12"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op13")).drop("place")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_quality, op3_sharding, op4_suffix_arrays, op5_byte_bpe, op6_dual_tree, op7_permutation_index, op8_lines, op9_language, op10_mixing, op11_manifest, op12_hard_negatives, op13_exact)}
ORACLES = {
    "op1_minhash": oracles.MINHASH,
    "op4_suffix_arrays": oracles.SUBSTRINGS,
    "op6_dual_tree": oracles.DUAL_TREE,
    "op8_lines": oracles.LINES,
    "op10_mixing": oracles.MIXING,
    "op11_manifest": oracles.MANIFEST,
    "op12_hard_negatives": oracles.NEGATIVES,
    "op13_exact": oracles.EXACT,
}
