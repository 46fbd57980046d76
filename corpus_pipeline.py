"""From raw documents to token ids, stage by stage; each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.bpe import encode_documents
from lodestack.llm.lines import dedupe_lines
from lodestack.llm.minhash import near_duplicates
from lodestack.llm.mixing import mix_documents
from lodestack.llm.quality import fit, score
from lodestack.llm.tables import Scratch, fresh_name, give_back_memory, table

RANKS = "byte_bpe_50k.tiktoken"
#: The least score that passes.
ACCEPTED = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier accepts, in the columns given.

    Rows are judged one by one by their text alone: rows that repeat an id or a text stay or go alike, a null or empty text has
    the score of a text without pieces, a null id is no obstacle. An empty table stays empty. Columns may have any names.
    """
    give_back_memory(spark)
    vectors, network = fit(docs, table(spark, sf_dir, "labels"))
    name = fresh_name("score", docs.columns)
    return score(docs, vectors, network, docs.columns, name=name).where(F.col(name) >= ACCEPTED).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches; documents of which no line is left go.

    `n_chars`, if there is such a column, follows the new text. A null text stays null, and a text that had no words before
    stays as it was. Rows equal in id and text both keep their lines. A null id comes first. An empty table stays empty.
    """
    give_back_memory(spark)
    rebuilt = dedupe_lines(docs, Scratch(spark, "lines")).where("kept_text is null or n_removed = 0 or trim(kept_text) <> ''")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return rebuilt.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, a null id last; of equal ids any one.

    Rows are told apart by a number of their own, so a repeated id decides nothing: each of its texts stays or goes with its own
    group. Null, empty and blank texts match nothing and stay. An empty table stays empty.
    """
    give_back_memory(spark)
    scratch = Scratch(spark, "near")
    row = fresh_name("row", docs.columns)
    held = scratch.put(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(held, scratch, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    least = F.struct(F.isnull("doc_id").alias("none"), "doc_id", row)
    known = groups.join(held.select(row, "doc_id"), row)
    first = known.groupBy("component_id").agg(F.min(least).alias("m")).select("component_id", F.col(f"m.{row}").alias("first"))
    gone = scratch.put(known.join(first, "component_id").where(F.col(row) != F.col("first")).select(row))
    # Here and not in the next stage, which runs no Python.
    give_back_memory(spark)
    return held.join(gone, row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not, once or twice.

    A null source is a source of its own, a null text has size 0 and is not taken beyond whole rounds of its source. Rows that repeat an
    id are drawn alike. An empty table stays empty. Only built-in functions run.
    """
    return mix_documents(docs, Scratch(spark, "mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per document copy; a null text counts as empty, and every row gives a row."""
    give_back_memory(spark)
    return encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]

#: Classifier, sketches and tokenizers are beyond SQL; tests compare each stage with plain Python on its own input, the
#: classifier by its own scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
