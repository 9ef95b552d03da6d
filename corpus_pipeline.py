"""The corpus pipeline: stages that filter and clean documents, then pack them.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame with the columns of ``docs``, the last one the packed pieces.  Stages
that drop rows give each row a key of its own, so rows without a doc_id and rows
that share one are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridloom.llm import decontaminate, minhash, packing, quality, suffix
from gridloom.llm.common import Scratch, table


def keyed(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key in a column of a new name: doc_id, if it is an integer that each row has for itself.

    Otherwise a number, with the rows written, so that it is the same whenever it is read.
    """
    key = "row_key"
    while key in docs.columns:
        key += "_"
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        shared = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("doc_id is null or rows > 1")
        if shared.isEmpty():
            return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return Scratch(spark, "keyed").keep(docs.withColumn(key, F.monotonically_increasing_id())), key


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their key for a doc_id."""
    return rows.drop("doc_id").withColumnRenamed(key, "doc_id")


def without(rows: DataFrame, key: str, judged: DataFrame) -> DataFrame:
    """``rows`` but for those whose key is the doc_id of a row in ``judged``."""
    return rows.join(judged.select(F.col("doc_id").alias(key)), key, "left_anti").drop(key)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; it trusts the documents with good labels."""
    rows, key = keyed(spark, docs)
    trusted = rows.join(quality.trusted_ids(table(spark, sf_dir, "labels")), "doc_id", "left_semi").select(F.col(key).alias("doc_id"))
    judged = quality.classify(by_key(rows, key), trusted)
    return without(rows, key, judged.filter(~F.col("keep"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: one with the smallest doc_id, without any only if none has one."""
    rows, key = keyed(spark, docs)
    groups = minhash.near_duplicates(by_key(rows, key)).select(F.col("doc_id").alias(key), F.col("component_id").alias("component"))
    ids = rows.select(key, F.col("doc_id").cast("long").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(key).alias("key")))
    kept = groups.join(ids, key).groupBy("component").agg(first.alias("first")).select(F.col("first.key").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the text; a document of which nothing is left goes.

    Bytes of a character that a cut splits go too; ``n_chars`` is counted anew where the text changed.
    """
    rest = [c for c in docs.columns if c != "text"]
    held = docs.select("doc_id", "text", F.struct(F.col("text").isNull().alias("was_null"), F.struct(*rest).alias("rest")).alias("held"))
    cleaned = suffix.dedup_substrings(held, carry="held").filter("n_removed = 0 or n_removed < n_bytes")
    columns = {c: F.col("held.rest")[c] for c in rest} | {"text": F.when(~F.col("held.was_null"), F.col("kept"))}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return cleaned.select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, key = keyed(spark, docs)
    judged = decontaminate.decontaminate(by_key(rows, key), table(spark, sf_dir, "benchmark"))
    return without(rows, key, judged.filter("contaminated")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences: place, length and checksum of each."""
    return packing.digests(packing.pack(docs, with_ids=False))


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_filter),
    ("best_fit_packing", packed),
]

#: Several stages are iterative or keep statistics that SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
