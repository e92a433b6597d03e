"""The corpus pipeline: documents in, packed training sequences out.

Each stage calls one operator of ``cleanlake.llm``, works on all rows its predecessor kept, and is
written as Parquet in the shared folder before the next one reads it. All but the last return the
columns of documents; the last returns one row per piece of a sequence.

Every row is judged by its own text, whether its id is null, repeated or neither: stages that drop
rows do so by id and hash of the text. An empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm import decontamination, jaccard_join, language, line_dedup, packing
from cleanlake.llm.shared import BLANK_CHARS, fresh_folder, small_batches, table, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in one of the learned languages.

    Rejected are texts that are null or without letters, in which no language can be told. Learned
    from the labelled documents of two folds.
    """
    small_batches(spark)
    model = language.learn(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    judged = language.identify(docs, model)
    return judged.where(F.col("lang_pred") != language.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in at least ten documents, and documents of which no line is left."""
    small_batches(spark)
    out = line_dedup.dedup_lines(docs, min_docs=10)
    out = out.where((F.col("n_dropped") == 0) | (F.trim("text", F.lit(BLANK_CHARS)) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*docs.columns)


def _by_row(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with (id, hash of the text); nulls are equal."""
    rows = rows.toDF("_id", "_code")
    same = docs["doc_id"].eqNullSafe(rows["_id"]) & (F.xxhash64(docs["text"]) == rows["_code"])
    return docs.join(rows, same, how).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the smallest id, null ids last."""
    small_batches(spark)
    rows = written(jaccard_join.row_groups(docs.select("doc_id", "text")), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "code"))
    kept = rows.where("comp is not null").groupBy("comp").agg(first.alias("kept"), F.count("*").alias("all"))
    kept = written(kept.where(F.col("all") > 1).select("comp", "kept"), "kept")
    other = ~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("code") == F.col("kept.code")))
    copies = written(rows.join(kept, "comp").where(other).select("doc_id", "code").distinct(), "copies")
    left = _by_row(docs, copies, "left_anti")
    # Rows that agree in id and text are told apart by nothing: one of them stays.
    again = rows.groupBy("doc_id", "code").agg(F.count("*").alias("all"), F.max("comp").alias("comp"))
    again = again.where("all > 1 and (comp is not null or doc_id is not null)").select("doc_id", "code")
    again = written(again, "repeated-rows")
    if again.isEmpty():
        return left
    once = _by_row(left, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _by_row(left, again, "left_anti").unionByName(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, whole or edited."""
    small_batches(spark)
    found = decontamination.row_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = written(found.select("doc_id", "code").distinct(), "leaks")
    return _by_row(docs, found, "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 1,024 tokens."""
    small_batches(spark)
    return packing.pack(
        docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    )


STAGES = [
    ("language", languages),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("packing", sequences),
]

#: Languages, groups and alignments are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
