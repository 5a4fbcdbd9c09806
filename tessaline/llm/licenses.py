"""License scans: exact phrases, and an exact set-similarity join against license templates.

DataFrame operations only. Templates are a table. A text block is a window of consecutive words, twice as long as the
template it is held against, so the template lies within one window wherever it stands, and what one template finds
doesn't hang on the others. A block meets a template if it holds at least ``threshold`` of the template's distinct words.

Words are ordered by how many documents hold them, counted over the whole corpus, rarest
first. A block that meets a template must hold one of its first m - need + 1 words (prefix
filter), enough template words at all (length filter), and enough of them from the first common
word on (positional filter). The templates' first words make an index, word -> templates, that documents' words are joined
with; only documents found by it are held against those templates: a block's words are a subset of its document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.common import Scratch, ascii_lower, small, with_row_key

#: Phrases and the label each one gives.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices by which licenses are granted, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STEP = 64, 32  # at least: for a template of over STEP words its own length and twice that


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def needed(template_words: int, threshold: float) -> int:
    """Smallest number of common words that makes up ``threshold`` of a template."""
    return next(k for k in range(template_words + 1) if k >= threshold * template_words - 1e-9)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    at = lambda i: F.forall(
        F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda k: F.get(words, i + k) == F.get(strings(parts), k)
    )
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<int>"))


def as_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``label, text`` of a list; the plan holds it as one string, however long the list is."""
    lines = [f"{label}\t{' '.join(text.split())}" for label, text in templates]
    parts = F.split("line", "\t")
    rows = spark.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("line")).filter("line <> ''")
    return rows.select(parts[0].alias("label"), parts[1].alias("text"))


def numbered(templates: DataFrame) -> DataFrame:
    """``template, label, words, number`` of templates: distinct words, and how many words the text has. Equal templates are one."""
    words = words_of(F.col("text"))
    key = F.xxhash64("label", "text", F.length("text"))
    return templates.select("label", "text").distinct().select(key.alias("template"), "label", F.array_distinct(words).alias("words"), F.size(words).alias("number"))


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, str]] | DataFrame | None = None,
    threshold: float = 0.8,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    n_base counts all places of the phrases, first_word and last_word are the smallest and
    largest start (null without one). labels adds those of templates found in a block. score is
    1 where a phrase stands, else the largest containment found at or over the
    threshold, else 0. blocks lists (block, label, containment) of all matches; block k begins at word k times the template's step. Null and empty texts have no
    word. Rows are judged one by one, so repeated and null ids stay apart. No rows give none. Other columns are not read.

    templates: (label, text), a list or a DataFrame with these columns. They may be whole license texts, hundreds of them, and none is fine; with under
    8 distinct words common words alone would meet one, which raises ValueError. A block's length and step are the template's own.

    The texts are read three times: for words of templates, for the documents these point at, and for the phrases.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    if not isinstance(templates, DataFrame):
        templates = as_table(spark, templates)
    scratch = Scratch(spark, "licenses")
    listed = scratch.settle(numbered(templates), "templates")
    if not listed.filter(F.size("words") < 8).isEmpty():
        raise ValueError("templates must have 8 distinct words at least")
    keyed = with_row_key(docs, [id_col, text_col], id_col).select("row", F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))

    # words of templates in documents, and how many documents hold each
    vocabulary = scratch.settle(listed.select(F.explode("words").alias("w")).distinct(), "vocabulary")
    held = keyed.select("row", F.explode(F.array_distinct("words")).alias("w")).join(small(vocabulary), "w")
    held = scratch.settle(held, "held")
    counts = held.groupBy("w").agg(F.count("*").alias("n"))
    ordered = listed.select("template", "label", "number", F.explode("words").alias("w")).join(counts, "w", "left")
    ordered = ordered.groupBy("template", "label", "number").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))).alias("x"))
    size = F.size("words")
    step = F.greatest(F.lit(STEP), F.col("number"))
    ready = (
        ordered.withColumn("words", F.transform("x", lambda x: x["w"]))
        .withColumn("need", F.ceil(threshold * size - F.lit(1e-9)).cast("int"))
        .select("template", "label", "words", "need", F.slice("words", F.lit(1), size - F.col("need") + 1).alias("prefix"), step.alias("step"), F.greatest(F.lit(BLOCK), 2 * step).alias("length"))
    )
    ready = scratch.settle(ready, "ready")
    index = scratch.settle(ready.select("template", F.explode("prefix").alias("w")), "index")
    candidates = held.join(small(index), "w").select("row", "template").distinct()
    pointed = scratch.settle(candidates.groupBy("row").agg(F.collect_set("template").alias("templates")), "candidates")

    texts = keyed.select("row", "words").join(small(pointed.select("row")), "row", "left_semi").join(pointed, "row")
    pairs = texts.select("row", "words", F.explode("templates").alias("template")).join(ready.withColumnRenamed("words", "own"), "template")
    pairs = pairs.filter(F.size(F.array_intersect("own", "words")) >= F.col("need"))
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - F.col("length")) / F.col("step")), F.lit(0)).cast("int")),
        lambda i: F.struct(i.alias("block"), F.array_intersect("own", F.slice(F.col("words"), i * F.col("step") + 1, F.col("length"))).alias("common")),
    )

    def met(window: Column) -> Column:
        common = window["common"]
        # the place of the first common word must leave enough words from there on
        late = F.size("own") - F.array_position("own", F.element_at(common, 1)) + 1
        return (F.size(common) >= F.col("need")) & F.arrays_overlap("prefix", common) & (late >= F.col("need"))

    found = F.transform(
        F.filter(windows, met), lambda w: F.struct(w["block"].alias("block"), F.col("label").alias("label"), (F.size(w["common"]) / F.size("own").cast("double")).alias("containment"))
    )
    blocks = pairs.select("row", F.explode(found).alias("block")).groupBy("row").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    blocks = scratch.settle(blocks, "blocks")
    scratch.keep(blocks)

    none = F.array().cast("array<int>")
    places = [
        F.when(F.forall(F.array(*[F.lit(w) for w in sorted(set(p.split()))]), lambda w: F.array_contains("words", w)), phrase_starts(F.col("words"), p)).otherwise(none)
        for p in phrases
    ]
    base = keyed.select("row", "id", F.size("words").cast("long").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)])
    starts = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))]) if phrases else none
    own = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())]).cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    listed_blocks = F.coalesce("blocks", F.array().cast("array<struct<block:int,label:string,containment:double>>"))
    return base.join(blocks, "row", "left").withColumn("blocks", listed_blocks).select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        F.when(F.size(starts) > 0, 1.0)
        .otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
        .alias("score"),
        "blocks",
    )
