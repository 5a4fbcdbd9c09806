"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Each source gets a target number of words. Complete epochs come first: every document
is taken floor(target / source size) times. The rest of the target is drawn without
replacement: a document's key is an exponential variate divided by its quality weight, and
documents are taken in the order of their keys until the rest is used up.

No source is sorted as a whole. Keys are dealt into bins of equal probability; sums of bins
tell for every source in which bin its budget ends, and only that bin is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for a null text."""
    parts = F.size(F.split(text, SPACES)) - F.when(text.rlike(r"\A[\x20\x09-\x0D]"), 1).otherwise(0) - F.when(
        text.rlike(r"[\x20\x09-\x0D]\z"), 1
    ).otherwise(0)
    return F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(parts).cast("long")


def label_weight(labels: DataFrame) -> DataFrame:
    """Quality weight per document of a label table: 2 if good, 1/2 if not. One row per id."""
    return (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.when(F.max("quality") >= 1, 2.0).otherwise(0.5).alias("weight"))
    )


def uniform(id_: Column, size: Column, seed: int) -> Column:
    """Number in (0, 1) from the MD5 digest of seed, id and size; the same in every run and engine.

    The size is in it so that rows without an id, or with one that repeats, don't all get the same key.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), size.cast("string"))
    digits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, cap: float, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sizes(source, source_size)`` -> the same with ``target``.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes.
    A target stops at ``cap`` times its source; what it leaves is shared by weight among
    the others until none is above. That fixed point is found at once: with sources in the order
    of cap per weight, those before the first that the common level doesn't fill are capped.
    One row per source is all that is ordered here.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    )
    filled = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = W.orderBy(F.col("most") / F.col("w"), "place")
    before, all_ = by_level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    levels = filled.withColumn("turn", F.row_number().over(by_level)).withColumn(
        "level",
        (F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    ).withColumn("free", F.col("level") * F.col("w") < F.col("most"))
    return levels.withColumn("common", F.min_by("level", F.when(F.col("free"), F.col("turn"))).over(all_)).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("common") * F.col("w"), F.col("most")), F.col("most")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    cap: int = 3,
    seed: int = 9,
    bins: int = 4096,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken``, and the ``carry`` columns as they are.

    size: words of the whole text (null: 0). taken: words the mix takes, whole copies only, so at
    most ``cap`` times the size. quality: ``doc_id, weight`` with positive weights, one row per id;
    documents without one weigh 1. The document at which a budget ends is taken if that
    brings the source nearer to its target. Ties of keys go by id, then size, then the carried columns; rows that
    agree in all of these are interchangeable, and any one of them is taken. Empty texts take nothing; an empty table gives
    an empty result. Null sources are a source of their own. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    carried = [f"carry_{i}" for i in range(len(carry))]
    if quality is not None:
        narrow = narrow.join(quality.select(F.col("doc_id").alias("id"), "weight"), "id", "left")
    else:
        narrow = narrow.withColumn("weight", F.lit(1.0))
    u = uniform(F.col("id"), F.col("size"), seed)
    weight = F.coalesce("weight", F.lit(1.0))
    keyed = narrow.select(
        "id",
        "source",
        "size",
        (-F.log(u) / weight).alias("key"),
        # equal keys stay in one bin, and bins follow the order of the keys
        F.least(F.floor((1 - F.exp(F.log(u) / weight)) * bins), F.lit(bins - 1)).cast("int").alias("bin"),
        *carried,
    )
    rows = settle(keyed, "mix-rows")
    sums = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    total = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = (
        source_targets(total, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    upto = W.partitionBy("t.source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = (
        sums.alias("s")
        .join(targets.alias("t"), same)
        .withColumn("upto", F.sum("words").over(upto))
        .groupBy("t.source")
        .agg(
            F.min(F.when(F.col("upto") > F.col("budget"), F.col("bin"))).alias("last_bin"),
            F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("words_before"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.first("epochs").alias("epochs"),
            F.first("budget").alias("budget"),
        )
        .withColumn("last_bin", F.coalesce("last_bin", F.lit(bins)))
        .withColumn("words_before", F.coalesce("words_before", F.lit(0)))
    )
    per_source = settle(ends, "mix-sources")
    # one row per source: sent to all tasks only if there are few sources
    few = per_source.limit(100_001).count() <= 100_000
    side = F.broadcast(per_source) if few else per_source
    joined = rows.alias("s").join(side.alias("t"), same).drop(F.col("t.source"))
    inside = F.col("bin") == F.col("last_bin")
    order = W.partitionBy("source").orderBy("key", "id", "size", *carried).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = joined.filter(inside).withColumn("reach", F.col("words_before") + F.sum("size").over(order))
    nearer = F.col("reach") - F.col("budget") <= F.col("budget") - (F.col("reach") - F.col("size"))
    extra = F.when((F.col("reach") <= F.col("budget")) | nearer, 1).otherwise(0)
    others = joined.filter(~inside).withColumn("extra", F.when(F.col("bin") < F.col("last_bin"), 1).otherwise(0))
    return (
        last.withColumn("extra", extra)
        .drop("reach")
        .unionByName(others)
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            (F.least(F.col("epochs") + F.col("extra"), F.lit(cap)) * F.col("size")).cast("long").alias("taken"),
            *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
        )
    )
