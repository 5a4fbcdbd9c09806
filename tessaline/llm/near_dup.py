"""Near-duplicate detection by HyperMinHash sketches.

A document's set holds the 64-bit hashes of its distinct shingles. A sketch has 192 buckets, each
with a 16-bit register: the number of leading zeros of the smallest hash in the bucket and
the 10 bits after the first one. Sets of 1,024 shingles and more are dealt over the
buckets; smaller ones would leave many empty, so there every bucket sees the whole set under a hash of its own.
Sizes from which a partner may lie on the other side get both sketches.

Some registers make a band, 6 at a similarity of 0.85 and 5 at 0.8; documents that agree in one of the 32 or 38 bands meet
in a bin. At the least similarity that links, the chance to meet in no bin is 3e-7. Within a bin, documents are compared with one of them, the leader; where some
end up in another component, a few of these lead in their turn. So a large group of copies
costs comparisons in proportion to its size. What is then still outside its leader's component is mostly unlike all
others of the bin, as texts that share one passage. For these an exact way remains, a prefix filter: with frequent
shingles last, two sets can only be similar enough if they share one of their first shingles, 15 or 20 % of each set. No bin is capped.

A comparison estimates the similarity from the registers, less what chance collisions add. Pairs
over six standard errors below the threshold end there; the others are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.llm.common import Scratch, fitted, join_by_key, small
from tessaline.llm.components import connected_components

BUCKETS = 192
MISS = 3e-7  # fixed value: the most that the chance to meet in no bin may be
MANTISSA = 10
EMPTY = 0xFFFF
DEALT_FROM = 1024
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(3))
FLIP = _rng.integers(0, 1 << 63, (BUCKETS, 1), dtype=np.uint64)
ODD = _rng.integers(0, 1 << 63, (BUCKETS, 1), dtype=np.uint64) * U(2) + U(1)
BAND_ODD = _rng.integers(0, 1 << 63, 6, dtype=np.uint64) * U(2) + U(1)


def miss(threshold: float, band: int) -> float:
    """Chance that documents of a similarity of ``threshold`` agree in no band of ``band`` registers."""
    return (1 - threshold**band) ** (BUCKETS // band)


def band_of(threshold: float) -> int:
    """Registers of a band: as many as keep the chance of a miss within ``MISS``, 6 at most."""
    return max(k for k in range(1, len(BAND_ODD) + 1) if k == 1 or miss(threshold, k) <= MISS)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class WordHashes(dict):
    """Hash of each word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Hashes of the distinct shingles of texts. Keeps word hashes, about ``keep`` of them."""

    def __init__(self, width: int, keep: int = 100_000):
        self.width, self.keep, self.known = width, keep, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower changes A-Z only, bytes.split cuts at ASCII white space only
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.keep:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n, k = len(h), min(self.width, len(h))
        s = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            s = s * U(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
        return np.unique(scramble(s))


def registers(least: np.ndarray) -> np.ndarray:
    """16-bit registers of smallest hashes: leading zeros, then the bits after the first one."""
    part, exponent = np.frexp(np.maximum(least, U(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    bits = np.minimum(((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | bits).astype(np.uint16)


def sketch_whole(s: np.ndarray) -> np.ndarray:
    return registers(((s[None, :] ^ FLIP) * ODD).min(1))


def sketch_dealt(s: np.ndarray) -> np.ndarray:
    bucket = (((s >> U(32)) * U(BUCKETS)) >> U(32)).astype(np.int64)
    value = scramble(s ^ U(0x5851F42D4C957F2D))
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, bucket, value)
    out = registers(least)
    out[np.bincount(bucket, minlength=BUCKETS) == 0] = EMPTY
    return out


def sketches(s: np.ndarray, threshold: float) -> tuple[bytes | None, bytes | None]:
    """Sketches of a set: under hashes of each bucket's own, and dealt over the buckets."""
    n = len(s)
    whole = sketch_whole(s).tobytes() if 0 < n < DEALT_FROM / threshold + 1 else None
    return whole, sketch_dealt(s).tobytes() if n > DEALT_FROM * threshold - 1 else None


def _chance() -> float:
    """Probability that registers of two different smallest hashes agree, for buckets alike in size."""
    zeros = np.arange(40)[:, None]
    low = 2.0**-zeros * (1 + np.arange(1 << MANTISSA)[None, :] / (1 << MANTISSA)) / 2
    high = low + 2.0**-zeros / (1 << (MANTISSA + 1))
    p = np.exp(-64 * low) - np.exp(-64 * high)
    return float((p * p).sum())


CHANCE = _chance()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of rows of registers."""
    used = (a != EMPTY) | (b != EMPTY)
    agree = ((a == b) & used).sum(1)
    share = agree / np.maximum(used.sum(1), 1)
    return (share - CHANCE) / (1 - CHANCE)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    percent: int = 85,
    width: int = 5,
    turns: int = 3,
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    Documents are linked if 100 * shared shingles >= ``percent`` * all shingles of both (``percent`` >= 80).
    Words are runs without ASCII white space, A-Z lower-cased; with fewer than ``width`` words the whole sequence is the one
    shingle. component_id is the smallest id reachable over links, kept is id = component_id.
    Null and empty texts have an empty set, n_shingles 0 and no link. Rows with equal ids and texts are one document
    twice and both keep their mark; a row without an id is linked with nothing, has no component_id and is kept.
    An empty table gives an empty result. Other columns are not read.

    Documents with equal sets are one node, so exact copies are never paired. Shuffled are
    ids and band hashes; texts only to fetch the sets of documents that share a bin.
    """
    threshold = percent / 100
    band = band_of(threshold)
    n_bands = BUCKETS // band
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            n, node, whole, dealt = [], [], [], []
            for text in b.column("text"):
                s = shingle(text.as_py())
                n.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                w, d = sketches(s, threshold)
                whole.append(w)
                dealt.append(d)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(whole, pa.binary()), pa.array(dealt, pa.binary())],
                names=["id", "n", "node", "whole", "dealt"],
            )

    scratch = Scratch(docs.sparkSession, "near-dup")
    settle = scratch.settle
    signed = settle(rows.mapInArrow(digest, f"id {id_type}, n long, node long, whole binary, dealt binary"), "signed")
    linked = signed.filter("node is not null and id is not null")
    nodes = linked.groupBy("node").agg(F.min(F.struct("id", "n", "whole", "dealt")).alias("x"))
    nodes = nodes.select("node", F.col("x.id").alias("rep"), "x.n", "x.whole", "x.dealt")
    number = signed.count()
    nodes = settle(fitted(nodes, number, 5_000), "nodes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n = b.column("node").to_numpy(), b.column("n").to_numpy()
            for family, name in enumerate(("whole", "dealt")):
                has = np.flatnonzero(b.column(name).is_valid().to_numpy(zero_copy_only=False))
                if not len(has):
                    continue
                raw = b"".join(b.column(name).take(pa.array(has)).to_pylist())
                r = np.frombuffer(raw, np.uint16).reshape(len(has), BUCKETS)[:, : n_bands * band].reshape(len(has), n_bands, band)
                key = scramble(((r.astype(np.uint64) + U(1)) * BAND_ODD[:band]).sum(2) + (np.arange(n_bands, dtype=np.uint64) * U(2) + U(family)) * U(0x9E3779B97F4A7C15))
                use = (r != EMPTY).any(2)
                at, _ = np.nonzero(use)
                yield pa.RecordBatch.from_arrays(
                    [_signed(key[use]), pa.array(node[has][at]), pa.array(n[has][at])], names=["key", "node", "n"]
                )

    banded = nodes.select("node", "n", "whole", "dealt").mapInArrow(bands, "key long, node long, n long")
    banded = settle(banded, "bands")
    members = banded.count()
    bins = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("members")).filter("members > 1")
    shared = banded.join(bins, "key").select("key", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), "members")
    shared = settle(fitted(shared, members), "bins")
    met = shared.count()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            keep, sets = [], []
            for i, (text, node) in enumerate(zip(b.column("text"), b.column("node").to_pylist(), strict=True)):
                s = shingle(text.as_py())
                if len(s) and xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == node:
                    keep.append(i)
                    sets.append(s.view(np.int64))
                if len(keep) >= 500 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).take(pa.array(keep, pa.int64())) for c in ("node", "n", "whole", "dealt")] + [pa.array(sets, pa.list_(pa.int64()))],
                        names=["node", "n", "whole", "dealt", "shingles"],
                    )
                    keep, sets = [], []

    in_bins = settle(fitted(shared.select("node").distinct(), met), "in-bins")
    wanted = nodes.join(small(in_bins), "node", "left_semi")
    texts = rows.filter("text is not null").join(wanted, rows["id"] == wanted["rep"]).select("text", "node", "n", "whole", "dealt")
    sets = settle(fitted(texts, number, 5_000).mapInArrow(shingles, "node long, n long, whole binary, dealt binary, shingles array<long>"), "sets")
    least = threshold - 6 * (threshold * (1 - threshold) / BUCKETS) ** 0.5

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = np.full(b.num_rows, -1.0)
            for x, y in (("wa", "wb"), ("da", "db")):
                has = np.flatnonzero(
                    b.column(x).is_valid().to_numpy(zero_copy_only=False) & b.column(y).is_valid().to_numpy(zero_copy_only=False)
                )
                if len(has):
                    at = pa.array(has)
                    r = [np.frombuffer(b"".join(b.column(c).take(at).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (x, y)]
                    best[has] = np.maximum(best[has], estimate(*r))
            at = pa.array(np.flatnonzero(best >= least))
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at)], names=["a", "b"])

    def likely_pairs(pairs: DataFrame, most: int) -> DataFrame:
        """Those of ``pairs(a, b)``, at most about ``most``, that the sketches don't rule out."""
        of = lambda s: sets.select(F.col("node").alias(s), F.col("whole").alias(f"w{s}"), F.col("dealt").alias(f"d{s}"))
        pairs = settle(fitted(pairs, most), "pairs")
        close = small(pairs).join(of("a"), "a").join(of("b"), "b").select("a", "b", "wa", "da", "wb", "db")
        return fitted(close, pairs.count(), 10_000).mapInArrow(likely, "a long, b long")

    def links(pairs: DataFrame, most: int) -> DataFrame:
        """Those of ``pairs(a, b)``, at most about ``most``, that the full sets confirm."""
        passed = settle(fitted(pairs, most), "passed")
        full = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("shingles").alias(f"s{s}"))
        both = small(passed).join(full("a"), "a").join(full("b").join(small(passed, "b"), "b", "left_semi"), "b")
        return (
            fitted(both, passed.count(), 2_000)
            .withColumn("common", F.size(F.array_intersect("sa", "sb")))
            .filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)
            .select("a", "b")
        )

    def pairs_of(df: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
        alike = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
        return df.filter((F.col(x) != F.col(y)) & alike).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    roots = settle(connected_components(links(likely_pairs(pairs_of(shared, "lead", "lead_n", "node", "n"), met), met), settle=settle), "roots")

    def open_bins(members: DataFrame, roots: DataFrame, had: DataFrame | None) -> DataFrame:
        """Those of ``members`` whose bin holds documents outside the leader's component which had no turn yet."""
        placed = members.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("had", F.lit(False))
        if had is not None:
            placed = placed.drop("had").join(small(had), ["key", "node"], "left").withColumn("had", F.coalesce("had", F.lit(False)))
        split = placed.groupBy("key").agg(
            F.max(F.when(F.col("node") == F.col("lead"), F.col("root"))).alias("lead_root"),
            F.min(F.when(~F.col("had"), F.col("root"))).alias("low"),
            F.max(F.when(~F.col("had"), F.col("root"))).alias("high"),
        )
        split = split.filter("low <> lead_root or high <> lead_root").select("key", "lead_root")
        return settle(placed.join(small(settle(fitted(split, met), "split")), "key").withColumn("outside", (F.col("root") != F.col("lead_root")) & ~F.col("had")).drop("lead_root", "had"), "open")

    def merged(roots: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
        """Components after the confirmed ones of ``pairs``, at most about ``most``, are added."""
        known = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return settle(connected_components(known.unionByName(links(pairs, most)), settle=settle), "roots")

    open_ = open_bins(shared.filter("members > 2").drop("lead_n", "members"), roots, None)
    scratch.keep(signed, sets, roots, open_)
    if not open_.isEmpty():
        # the same hash orders all bins, so that bins of one group choose the same documents and pairs repeat
        turn = W.partitionBy("key").orderBy(F.xxhash64("node"))
        most = open_.count()
        x = open_.filter("outside").withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= turns)
        x = settle(fitted(x, most), "turn")
        chosen = x.select("key", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"))
        y = open_.filter("node <> lead").select("key", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"))
        roots = merged(roots, likely_pairs(pairs_of(small(chosen).join(y, "key").filter("rx <> ry"), "x", "nx", "y", "ny"), turns * most), turns * most)
        open_ = open_bins(open_.drop("root", "outside"), roots, x.select("key", "node", F.lit(True).alias("had")))
    if not open_.isEmpty():
        left = settle(fitted(open_.groupBy("node", "n", "root").agg(F.max("outside").alias("outside")), open_.count()), "left")
        texts = sets.select("node", "n", "shingles").join(small(left.select("node", "root", "outside")), "node")
        # frequent shingles as a sample of fixed size shows them; any order gives right results, so sampling it loses nothing
        some = F.broadcast(left.select("node").orderBy(F.xxhash64("node", F.lit(1))).limit(2000))
        often = sets.select("node", "shingles").join(some, "node").select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
        rank = np.array([r["s"] for r in often.orderBy(F.desc("c"), "s").limit(100_000).collect()], np.int64)[::-1]
        sent = docs.sparkSession.sparkContext.broadcast((np.sort(rank), np.argsort(rank)))

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, places = sent.value
            for b in batches:
                rows, tokens, places_ = [], [], []
                for i, s in enumerate(b.column("shingles")):
                    s = s.values.to_numpy()
                    order = np.full(len(s), -1)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        order = np.where(common[at] == s, places[at], -1)
                    length = len(s) - -(-percent * len(s) // 100) + 1
                    tokens.append(s[np.lexsort((s, order))[:length]])
                    rows.append(np.full(len(tokens[-1]), i))
                    places_.append(np.arange(len(tokens[-1])))
                at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                token = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
                place = pa.array(np.concatenate(places_) if places_ else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([token, place] + [b.column(c).take(at) for c in ("node", "n", "root", "outside")], names=["token", "place", "node", "n", "root", "outside"])

        kept = settle(texts.mapInArrow(prefixes, "token long, place long, node long, n long, root long, outside boolean"), "prefixes")
        # what passes is so close that an estimate would rule out few: it goes to the full sets at once.
        # before the first common shingle nothing is shared, so what follows must be enough (positional filter)
        enough = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
        x = kept.filter("outside").select("token", F.col("place").alias("px"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"))
        y = kept.select("token", F.col("place").alias("py"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"), F.col("outside").alias("oy"))
        found = fitted(x.join(y, "token").filter("rx <> ry and (x < y or not oy)").filter(enough), kept.count())
        roots = merged(roots, pairs_of(found, "x", "nx", "y", "ny"), kept.count())
    scratch.keep(signed, roots)
    # one row per document set, then per component: rows get their component by the set, so that no component's rows meet in one task
    counted = settle(fitted(linked.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n")), number), "counted")
    rooted = settle(counted.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    groups = settle(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "groups")
    judged = settle(join_by_key(rooted, groups, "root").select("node", "n", "component_id"), "judged")
    scratch.keep(signed, judged)
    alone = signed.filter("node is null or id is null").select("id", "n", F.col("id").alias("component_id"))
    return (
        join_by_key(linked.select("id", "n", "node"), judged, "node")
        .select("id", "n", "component_id")
        .unionByName(alone)
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
        )
    )
