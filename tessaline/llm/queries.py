"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import (
    alignment,
    audio_prints,
    decontaminate,
    fill_middle,
    language_id,
    licenses,
    mixing,
    near_dup,
    oracle,
    quality,
    sharding,
    simhash,
    token_counts,
    url_filters,
)
from tessaline.llm.common import settle, table

#: The rules of op7 as (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id")) == 2, F.lit(False))
    training = docs.filter(~held_out & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    judged = language_id.identify_languages(docs.select("doc_id", held_out.alias("held_out"), "text"), training)
    return judged.drop("text")


def op5_audio_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is played as a melody. Of each whose id is divisible by 50 a late and noisy excerpt is the query, sought among all melodies.

    One row per vector; matches are those of its excerpt, so a query's own class is among them, three integers late.
    """
    vectors = table(spark, sf_dir, "embeddings")
    whole = audio_prints.fingerprints(vectors, "vec_id", "embedding", rate=4000, decode=audio_prints.melody)
    asked = F.col("vec_id") % 50 == 0
    parts = audio_prints.fingerprints(vectors.filter(asked), "vec_id", "embedding", rate=4000, decode=audio_prints.excerpt)
    # an excerpt has the number -1 - vec_id
    parts = parts.withColumn("vec_id", -1 - F.col("vec_id"))
    aligned = settle(audio_prints.align(whole.unionByName(parts), "vec_id", F.col("vec_id") < 0), "audio-aligned")
    found = aligned.filter("vec_id < 0").select((-1 - F.col("vec_id")).alias("vec_id"), F.filter("matches", lambda m: m["class_id"] >= 0).alias("found")).dropDuplicates(["vec_id"])
    every = aligned.filter("vec_id >= 0 or vec_id is null").select("vec_id", F.when(F.col("class_id") < 0, -1 - F.col("class_id")).otherwise(F.col("class_id")).alias("class_id"), "matches")
    joined = every.join(found, "vec_id", "left").withColumn("matches", F.coalesce("found", "matches"))
    return joined.select("vec_id", "class_id", F.coalesce(asked, F.lit(False)).alias("is_query"), F.size("matches").alias("n_matches"), "matches")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_counts.read_piece_model(public_tokenizers.path("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", n_bytes.alias("n_bytes"), "text")
    return token_counts.count_tokens(docs, pieces).withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.label_weight(table(spark, sf_dir, "labels"))
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter("quality is not null and toxic is not null")
    ratings = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    rated = quality.rate_quality(table(spark, sf_dir, "documents"), ratings)
    return rated.select(
        "doc_id", "expected_grade", F.element_at("tails", 1).alias("p_from_1"), F.element_at("tails", 2).alias("p_from_2"), "grade", "kept"
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return alignment.align_tokens(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_decontamination": op2_decontamination,
    "op3_near_dup": op3_near_dup,
    "op4_language_id": op4_language_id,
    "op5_audio_prints": op5_audio_prints,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_token_counts": op8_token_counts,
    "op9_source_mix": op9_source_mix,
    "op10_quality": op10_quality,
    "op11_simhash": op11_simhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE: dict[str, str] = {
    "op1_license_scan": oracle.license_sql(),
    "op7_url_filter": oracle.url_sql(URL_RULES),
    "op9_source_mix": oracle.mix_sql(),
    "op12_fill_in_middle": oracle.middle_sql(),
}
