"""From raw documents to training shards, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import decontaminate, language_id, mixing, near_dup, sharding
from tessaline.llm.common import settle, shared_dir, small, table, with_row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in none of the learned languages; learns from the stage's own labelled input.

    Every row is judged by its text alone, so null and repeated ids, equal rows and columns besides
    those of ``documents`` make no difference. Texts that are null or have no letter go. Without labels, or without rows, nothing stays.
    """
    training = docs.filter("lang is not null").select("doc_id", "lang", "text")
    judged = language_id.identify_languages(docs.select(*COLUMNS), training)
    return judged.filter("accepted").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies, that with the smallest id; null ids come last.

    Rows are told apart by a key of their own: of equal rows one stays, rows without an id are compared like all
    others, and of different texts under one id each has its own verdict. Null and empty texts are nothing's copies and stay.
    """
    keyed = with_row_key(docs, COLUMNS)
    gone = settle(near_dup.near_duplicates(keyed, id_col="row", percent=80, width=5).filter("not kept").select("row"), "pipeline-copies")
    return keyed.join(small(gone), "row", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows that hold a passage of the benchmark. Each goes or stays by its own text, whatever its id. Null and empty texts stay."""
    keyed = with_row_key(docs, COLUMNS)
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="row")
    gone = settle(leaks.select("row").distinct(), "pipeline-leaks")
    return keyed.join(small(gone), "row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each row as often as the mix does: not at all, once, or in up to three copies.

    Every row is drawn for itself, so null and repeated ids lose none. Null and empty texts have no word to take and go.
    """
    labels = mixing.label_weight(table(spark, sf_dir, "labels"))
    keyed = with_row_key(docs, COLUMNS)
    taken = mixing.mix_sources(keyed, labels, carry=("row",)).filter("taken > 0")
    copies = taken.select("row", (F.col("taken") / F.col("size")).cast("int").alias("copies"))
    return keyed.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, shard, slot. Repeated and null ids are placed row by row; no rows give none."""
    return sharding.shard_documents(docs, shards=40)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mix", mix),
    ("shards", shard),
]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/tessaline/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
