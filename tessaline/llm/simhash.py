"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its word shingles, repeats
included. Two fingerprints that differ in three bits or fewer are linked.

The bits are cut into two segments of 32, so that of two linked fingerprints one segment differs in one bit or none. Each
segment is indexed under its 32 variants with one bit deleted: such a pair has a variant in common. Fingerprints that
share a variant meet in a bin, and equality joins find them. Equal fingerprints are one node, so copies never meet.

Only components are wanted, so a bin isn't compared pair by pair. All its members are compared with its smallest one, the
leader; after that most bins lie in one component and are done. In the others, members of different components are
compared if the bin has ``pairs_up_to`` members at most. The members of larger bins go by another exact way: all variants of the
whole fingerprint with three bits deleted. Linked fingerprints have one of these in common, and eight
fingerprints at most share one, so the work is in proportion to the members however they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import Scratch, fitted, join_by_key
from tessaline.llm.components import connected_components

BITS, SEGMENT, SEED = 64, 32, 42
DISTANCE = 3  # fixed value: two segments hold three differing bits with one at most in either


def fingerprint(text: str | None, width: int = 3, at_once: int = 1 << 16) -> int:
    """Fingerprint of a whole text; zero without a word."""
    # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space only
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    number, ones = len(words) - k + 1, np.zeros(BITS, np.int64)
    for at in range(0, number, at_once):
        upto = min(at + at_once, number)
        cuts = zip(begins[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in cuts], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > number).tobytes(), "big")


def variants(print_: Column) -> Column:
    """Keys of the 64 signatures of a fingerprint: the deleted bit's number, then the segment that holds it with that bit zero."""
    segment = lambda i: F.shiftrightunsigned(print_, SEGMENT) if i >= SEGMENT else print_
    rest = lambda i: F.lit((1 << SEGMENT) - 1 - (1 << i % SEGMENT))
    return F.array(*[F.lit(i << SEGMENT) + segment(i).bitwiseAND(rest(i)) for i in range(BITS)])


def three_deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under all its variants with three bits deleted: ``gone`` tells which, ``rest`` is what is left."""
    masks = np.array([~sum(1 << b for b in bits) & ((1 << BITS) - 1) for bits in combinations(range(BITS), DISTANCE)], np.uint64)
    for b in batches:
        for f in b.column(0).to_numpy().view(np.uint64):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(masks), dtype=np.int32)), pa.array((masks & f).view(np.int64)), pa.array(np.full(len(masks), f).view(np.int64))],
                names=["gone", "rest", "node"],
            )


def crowded_bins(nodes: DataFrame) -> DataFrame:
    """``key, node, lead, members``: distinct fingerprints under each variant that several have, with the smallest of them.

    Both sides are joined by a shuffle: Spark takes the size of ``nodes`` for the size of its 64 variants each, and would broadcast millions of bins.
    """
    signed = nodes.select("node", F.explode(variants(F.col("node"))).alias("key"))
    bins = signed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("members")).filter("members > 1")
    return signed.hint("merge").join(bins.hint("merge"), "key")


def paired_members(few: DataFrame) -> DataFrame:
    """``few(key, node, root)`` -> ``a, ra, b, rb``: members of different components that share a variant. Settled rows repeat keys and take little room as Parquet, so they aren't broadcast either."""
    x, y = few.select("key", F.col("node").alias("a"), F.col("root").alias("ra")), few.select("key", F.col("node").alias("b"), F.col("root").alias("rb"))
    return x.hint("merge").join(y.hint("merge"), "key").filter("a < b and ra <> rb")


def near_prints(nodes: DataFrame, scratch: Scratch, pairs_up_to: int = 256) -> DataFrame:
    """``nodes(node)``, distinct fingerprints as settled rows -> ``node, root`` for those that are linked with another one."""
    settle = scratch.settle
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE
    shared = settle(crowded_bins(nodes), "bins")
    led = shared.filter((F.col("node") != F.col("lead")) & near("node", "lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    links = settle(led.distinct(), "links")
    roots = settle(connected_components(links, settle=settle), "roots")
    # two members are compared by now; of more, those outside the leader's component are not yet among each other
    placed = shared.filter("members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    open_ = settle(placed.join(split, "key").select("key", "node", "root", "members"), "open")
    if open_.isEmpty():
        return roots
    few = open_.filter(F.col("members") <= pairs_up_to)
    paired = paired_members(few).filter(near("a", "b")).select("a", "b")
    crowded = settle(open_.filter(F.col("members") > pairs_up_to).select("node").distinct(), "crowded")
    # all fingerprints under one of these variants are linked with each other, eight at most
    alike = crowded.repartition(max(8, -(-crowded.count() // 100))).mapInArrow(three_deleted, "gone int, rest long, node long")
    alike = alike.groupBy("gone", "rest").agg(F.collect_list("node").alias("nodes")).filter(F.size("nodes") > 1)
    alike = alike.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b")
    more = settle(paired.unionByName(alike).distinct(), "links")
    return settle(connected_components(links.unionByName(more), settle=settle), "roots")


def simhash_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, pairs_up_to: int = 256) -> DataFrame:
    """One row per document: ``id_col, fingerprint, component_id, kept``.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are ``width`` words with one space between, each as
    often as it stands there; with fewer words the whole sequence is the one shingle. A fingerprint bit is 1 if it is set in over half of the
    XXH64 hashes. fingerprint: 16 lower-case hex digits. component_id: smallest id reachable over links of three differing bits or
    fewer. kept: id = component_id. Null, empty and blank texts have the fingerprint zero and are linked by it like any other. Rows of
    equal ids are linked as their texts are. A row without id links others as well; its component_id is the smallest id there is, null if none,
    and it is kept only in that case. An empty table gives an empty result. Other columns are not read.

    Most of the work is done when this is called. Texts are read once; then only fingerprints are shuffled.
    """
    id_type = dict(docs.dtypes)[id_col]
    scratch = Scratch(docs.sparkSession, "simhash")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(prints.view(np.int64))], names=["id", "node"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, f"id {id_type}, node long")
    rows = scratch.settle(rows, "rows")
    nodes = scratch.settle(fitted(rows.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n")), rows.count()), "nodes")
    rooted = nodes.join(near_prints(nodes.select("node"), scratch, pairs_up_to), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = scratch.settle(rooted, "rooted")
    groups = scratch.settle(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "groups")
    judged = scratch.settle(join_by_key(rooted, groups, "root").select("node", "n", "component_id"), "judged")
    scratch.keep(rows, judged)
    return join_by_key(rows, judged, "node").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )
