"""Minimax contiguous partition of atomic groups into shards. DataFrame operations only.

Rows with equal text form a group, and a group is never split. Groups are ordered by
the MD5 digest of their text, so the order depends on the texts alone. The smallest shard
capacity for which a greedy pass over the ordered sizes needs no more than the wanted
shards is found by binary search; cuts then keep that capacity and lie as near to equal
shares as it allows, so that no shard stays empty when one group alone sets the capacity.

What the driver holds is bounded at every input size: sums of the groups that share the
first ``atom_digits`` hex digits of the digest (4 digits: 65,536 sums). These runs are the
atoms of the search. On small inputs nearly every atom is one group; on large ones an
atom is about 1/65,536 of all bytes, so the capacity found exceeds the one over single
groups by less than one atom.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.llm.common import settle


def greedy_ends(prefix: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of greedily filled shards over running sums, at most ``shards`` of them."""
    ends, at = [], 0
    while at < len(prefix) - 1 and len(ends) < shards:
        at = bisect_right(prefix, prefix[at] + capacity) - 1
        ends.append(at)
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity at which ``shards`` greedy shards hold all."""
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    low = max(max(sizes, default=0), -(-prefix[-1] // shards))
    high = low + max(sizes, default=0)
    while low < high:
        mid = (low + high) // 2
        ends = greedy_ends(prefix, mid, shards)
        if not ends or ends[-1] == len(sizes):
            high = mid
        else:
            low = mid + 1
    return low


def choose_cuts(sizes: list[int], shards: int) -> list[int]:
    """Index at which each of the shards 1, 2, ... begins; no shard exceeds the smallest capacity.

    Sizes are positive. Within what the capacity leaves open, a shard ends where it
    comes nearest to an equal share of all that is left.
    """
    capacity, n, prefix = smallest_capacity(sizes, shards), len(sizes), [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    earliest = [n]  # [k]: the first index from which k shards can hold the rest
    for _ in range(shards - 1):
        earliest.append(bisect_left(prefix, prefix[earliest[-1]] - capacity))
    cuts, at = [], 0
    for left in range(shards - 1, 0, -1):
        aim = prefix[at] + (prefix[n] - prefix[at]) / (left + 1)
        end = bisect_left(prefix, aim)
        if end > at and (end > n or aim - prefix[end - 1] <= prefix[end] - aim):
            end -= 1
        last = bisect_right(prefix, prefix[at] + capacity) - 1
        at = min(max(end, earliest[left], at), last)
        cuts.append(at)
    return cuts


def shard_documents(
    docs: DataFrame,
    shards: int = 40,
    text_col: str = "text",
    id_col: str = "doc_id",
    overhead: int = 16,
    atom_digits: int = 4,
    rows_per_chunk: int = 100_000,
) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, shard, slot``.

    size: UTF-8 bytes of the text plus ``overhead``; a null text counts as no bytes, has
    CRC 0 and is a group of its own, apart from the empty text. slot: numbers 0, 1, ... without gaps
    within each shard. Repeated rows and ids are numbered each for itself. An empty table
    gives an empty result; shards may stay empty if there are fewer groups than shards.
    Only ``id_col`` and ``text_col`` are read, so other columns cannot clash.

    Texts are read once, into a narrow table in the shared folder. A group may hold any
    share of all rows: sums are pre-aggregated on the map side, and slots are numbered in
    chunks of a shard dealt by id and digest, then moved by the counts of the chunks before.
    """
    text = F.col(text_col)
    rows = settle(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
            F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("crc"),
            F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("null")).alias("digest"),
        ),
        "shard-rows",
    )
    atom = F.substring("digest", 1, atom_digits)
    sums = sorted(
        (r["atom"], r["bytes"], r["n"])
        for r in rows.groupBy(atom.alias("atom")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    )
    cuts = choose_cuts([b for _, b, _ in sums], shards)
    begins = [sums[c][0] if c < len(sums) else "~" for c in cuts]
    shard = sum((F.when(F.col("digest") >= b, 1).otherwise(0) for b in begins), F.lit(0))
    edges = [0, *cuts, len(sums)]
    most = max((sum(n for _, _, n in sums[a:b]) for a, b in zip(edges, edges[1:], strict=False)), default=0)
    chunks = max(8, -(-most // rows_per_chunk))
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("id", "digest"), F.lit(chunks)).cast("int")
    )
    before = (
        dealt.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .withColumn(
            "before",
            F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("n")
    )
    order = W.partitionBy("shard", "chunk").orderBy("digest", F.col("id").asc_nulls_last())
    return (
        dealt.withColumn("within", F.row_number().over(order) - 1)
        .join(before, ["shard", "chunk"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            "shard",
            (F.col("before") + F.col("within")).cast("long").alias("slot"),
        )
    )
