"""The stages of the pipeline, in order. Each takes (spark, docs, sf_dir) and works on all that the one before kept.

All but the last return the columns of documents. Rows without doc_id and columns beyond the usual ones go
through; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import minhash, mixing, packing, suffix, toxicity

#: Bytes of a string that is taken for a repeated passage: 50 words of three letters and the spaces between them.
PASSAGE = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as toxic go; the model is learned from the labelled ones among docs."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike to 80 % the one with the smallest doc_id stays; of rows that repeat, one."""
    kept = minhash.near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    known = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id is null"))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes that start at two or more places go from all of them; n_chars follows the text."""
    out = suffix.without_repeats(docs, length=PASSAGE)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stands as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated-strings", drop_repeated_strings),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
