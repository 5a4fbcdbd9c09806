"""SimHash against brute force, with its exact way for crowded bins, and odd input."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessaline.llm import simhash
from tessaline.llm.common import Scratch


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """prints: {node: value} -> {node: smallest node linked}."""
    nodes = sorted(prints)
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_fingerprint(prose):
    for text in (None, "", " \n\t", "One", "one two", "one  two\nTHREE", "Été à ÇA là", prose(3), prose(500), "same same same same same"):
        assert simhash.fingerprint(text) == plain_print(text) == simhash.fingerprint(text, at_once=7)


def test_variants_find_all_within_three_bits(spark):
    """Every two fingerprints of a distance of up to three share a variant, wherever the bits lie."""
    rng = random.Random(1)
    rows, wanted = [], []
    for k in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), k % 4):
            b ^= 1 << bit
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    shared = df.filter(F.arrays_overlap(simhash.variants(F.col("a")), simhash.variants(F.col("b"))))
    assert shared.count() == 300 and df.filter(F.size(simhash.variants(F.col("a"))) == 64).count() == 300
    far = df.select("a", F.col("a").bitwiseXOR(F.lit((1 << 40) + (1 << 41) + 3)).alias("b"))
    assert far.filter(F.arrays_overlap(simhash.variants(F.col("a")), simhash.variants(F.col("b")))).isEmpty()


@pytest.mark.parametrize("pairs_up_to", [0, 3, 256])
def test_components_equal_brute_force(spark, pairs_up_to):
    """Clouds of fingerprints around centres and chains, crowded in one bin: by pairs and by variants with three bits deleted."""
    rng = random.Random(4)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        # differences in the upper half only: all of a cloud share the lower segment's bins
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(32, 64), rng.randint(0, 6))) for _ in range(40)}
        link = centre ^ 0xFFFF
        for _ in range(6):
            link ^= sum(1 << b for b in rng.sample(range(64), 3))
            prints.add(link)
    prints |= {0, (1 << 64) - 1, 7, 1 << 63}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in prints}
    nodes = spark.createDataFrame([(n,) for n in signed], "node long").repartition(3)
    got = {r["node"]: r["root"] for r in simhash.near_prints(nodes, Scratch(spark, "test"), pairs_up_to).collect()}
    want = components(signed)
    assert {n: got.get(n, n) for n in want} == want and len(set(want.values())) > 4


def test_documents(spark, prose, rng):
    base = prose(200)
    words = base.split()
    near = [" ".join(words[:i] + [prose(1)] + words[i + 1 :]) for i in rng.sample(range(200), 25)]
    texts = [base, base.upper().replace("\n", " "), *near, *[prose(120) for _ in range(10)], None, "", " \n ", "a b", "A  b", "a"]
    rows = [(100 - i, t, "x", "y", 5) for i, t in enumerate(texts)] + [(100, base, "x", "y", 5), (None, base, "x", "y", 5), (None, "only one without id", "x", "y", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, fingerprint string, n int").repartition(5)
    got = simhash.simhash_duplicates(df).collect()
    assert len(got) == len(rows) and all(r["fingerprint"] == format(plain_print(t), "016x") for r, t in ((r, t) for r in got for i, t, *_ in rows if i == r["doc_id"] and i is not None))
    prints = {i: plain_print(t) for i, t, *_ in rows if i is not None}
    want = components(prints)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert {i: r["component_id"] for i, r in by.items()} == want and all(r["kept"] == (r["component_id"] == i) for i, r in by.items())
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {want[100 - texts.index(None)]}
    lost = sorted(((r["component_id"], r["kept"]) for r in got if r["doc_id"] is None), key=str)
    assert lost == sorted([(want[100], False), (None, True)], key=str)
    assert simhash.simhash_duplicates(df.limit(0)).collect() == []


def test_a_hot_group_of_equal_texts(spark):
    """A third of all rows is one text: its component comes by the broadcast of hot keys, all others by the join."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text for a third of all rows").otherwise(F.concat(F.lit("own words of "), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha1(F.col("id").cast("string")))).alias("text"))
    got = simhash.simhash_duplicates(rows)
    assert got.filter("component_id = 0").count() == 1000 and got.filter("kept").count() == got.select("component_id").distinct().count() >= 1990


def test_exploded_variants_are_not_broadcast(spark, tmp_path):
    """A few megabytes of fingerprints have 64 variants each, whose bins don't fit the driver."""
    spark.createDataFrame([(i * 7,) for i in range(1000)], "node long").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    few = nodes.select((F.col("node") % 3).alias("key"), "node", F.col("node").alias("root"))
    for df in (simhash.crowded_bins(nodes), simhash.paired_members(few)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
