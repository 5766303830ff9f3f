"""A training corpus from raw documents: grade, deduplicate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of `docs`, whatever their names. Every stage takes an empty table
(and returns one), null and repeated ids, null, empty and very long texts, and nulls in any other column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadglass.llm.common import cut, keep_rows, row_keyed
from roadglass.llm.exact_dedup import exact_dedup
from roadglass.llm.mixing import mix
from roadglass.llm.pieces import encode_pieces
from roadglass.llm.quality_model import keep_good
from roadglass.llm.registry import PIECE_MODEL, TARGETS
from roadglass.llm.simhash import simhash_components


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels table, does not reject.

    Null and empty texts have no features and are judged by the model's intercept; equal texts are judged alike, repeated
    rows each. Without labels, or with one grade only, all stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest doc_id (null the smallest), of rows that repeat it one of them."""
    rows, key = row_keyed(docs)
    paired = rows.withColumn("_pair", F.struct(F.col("doc_id").alias("id"), F.col(key).alias("key")))
    kept = exact_dedup(paired, id_col="_pair").filter("kept").select(F.col("_pair.key").alias(key))
    return keep_rows(rows, kept, key).drop(key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row: that with the smallest doc_id, a null only if all are null."""
    rows, key = row_keyed(docs)
    paired = rows.withColumn("_pair", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key")))
    linked = simhash_components(paired, id_col="_pair")
    kept = linked.filter(F.col("_pair.key") == F.col("component_id.key")).select(F.col("_pair.key").alias(key))
    return keep_rows(rows, kept, key).drop(key)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small languages more often, so that the expected token totals have the
    stated shares.

    Null languages are not learnt from, but such rows take part by their words. If no language of the table has a target
    every row is taken once; a language without a target is too, and a warning names targets without documents. Null and
    empty texts have no tokens and no words that tell a language; repeated rows are taken equally often."""
    return mix(docs, domain_col="lang", targets=TARGETS, min_rate=1.0)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, with the round trip through decoding checked. Null and empty texts have no ids;
    repeated rows and null ids are rows like any other."""
    return encode_pieces(docs, PIECE_MODEL)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_languages),
    ("SentencePiece encoding and decoding", tokenise),
]

#: Trained models, SimHash and tokenising are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
