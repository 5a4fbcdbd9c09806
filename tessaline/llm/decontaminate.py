"""Benchmark decontamination: an exact count of shared words, then their order.

A document leaks an item if a stretch of about the item's length holds most of the item's words in their order
(longest common subsequence), or fewer of them but also the item's answer. A stretch that does so has at least
``likely`` of the item's words, so of any R of them all but those that may be missing. For each item the rarest words for which
this rules out most are counted in blocks of all texts; what reaches the count goes to the subsequence check, at every
stretch. The count is a bound, not a guess: it rejects no leak.

A randomised SVD of TF-IDF passages gives every term a short latent vector; each leak is reported with the cosine of
its stretch and the item. The cosine decides nothing.

Vocabulary, document frequencies and the SVD come from all passages of all documents, together with all items. Texts are
cut into words once and written as chunks of numbers, each with its own list of words; the first pass of the fit writes
them as places in the vocabulary, which is all that its second pass and the search read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessaline.llm.common import Scratch, fitted

BLOCK = 8  # words that are counted at once
EDGES = ".,;:!?\"'()[]{}|#*&%$"  # fixed values: what most often stands around a word
SPAN = 32  # words of a passage
COMMON = 1000  # a term stands in more than one of so many documents, and in more than two
STORED = {"compression": "zstd"}  # Snappy keeps whole pages outside the heap, and a page holds all of a task's long values
CHUNK = 64  # the cosine of longer items is that of their nearest part of this many words


def normal(token: str) -> str:
    """Lower case, letters and digits only."""
    token = token.lower()
    if token.isalnum():
        return token
    inner = token.strip(EDGES)
    return inner if inner.isalnum() else "".join(c for c in inner if c.isalnum())


def words_of(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


def answer_of(text: str) -> list[str]:
    """The last sentence's words, of an item that names no answer."""
    parts = [w for w in map(words_of, text.replace("?", ".").replace("!", ".").split(".")) if w]
    return parts[-1] if len(parts) > 1 else []


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the places of ``a`` as bits of one integer."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def listed(x: pa.Array) -> pa.ListArray:
    """A single list that holds all of ``x``."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def normal_all(tokens: pa.Array) -> pa.Array:
    """``normal`` of each token, none of which holds a line's end."""
    plain, words = pc.string_is_ascii(tokens), pc.ascii_lower(tokens)
    odd = pc.and_(plain, pc.invert(pc.ascii_is_alnum(words)))
    words = pc.replace_with_mask(words, odd, pc.replace_substring_regex(words.filter(odd), "[^0-9a-z]+", ""))
    other = tokens.filter(pc.invert(plain))
    if len(other):
        lower = pc.binary_join(listed(other), "\n")[0].as_py().lower().split("\n")
        made = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in lower]
        words = pc.replace_with_mask(words, pc.invert(plain), pa.array(made, words.type))
    return words


def number_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, as ``words_of`` gives them: how many, their places in the list of distinct words, and that list."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words = normal_all(coded.dictionary).dictionary_encode()
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    number = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
    flat = number[words.indices.to_numpy()][coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    kept = flat >= 0
    return np.bincount(owner[kept], minlength=len(texts)), flat[kept], words.dictionary.filter(pa.array(real))


def packed(numbers: np.ndarray, below: int) -> bytes:
    return numbers.astype(np.uint16 if below <= 1 << 16 else np.uint32).tobytes()


def unpacked(numbers: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` numbers of ``packed``."""
    held = numbers.as_buffer()
    return np.frombuffer(held, f"u{held.size // n}")


@dataclass
class Index:
    """Latent vectors of terms (one more, of zeros, for words outside) and the items' own."""

    vocabulary: pa.Array
    vectors: np.ndarray
    item_ids: list
    items: list[list[int]]
    answers: list[list[int]]
    chunk_of: list[int]
    idf: np.ndarray
    item_vectors: np.ndarray


def _step(passages: list[np.ndarray], idf: np.ndarray, basis: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(A' A basis, (A basis)' (A basis)) for the TF-IDF rows A of passages, each of unit length."""
    passages = [p for p in passages if len(p)]
    if not passages:
        return np.zeros_like(basis), np.zeros((basis.shape[1],) * 2)
    row = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    term = np.concatenate(passages)
    cell, count = np.unique(row.astype(np.int64) * len(idf) + term, return_counts=True)
    row, term = cell // len(idf), cell % len(idf)
    value = count * idf[term]
    value /= np.sqrt(np.bincount(row, value * value, len(passages)))[row]
    value = value.astype(basis.dtype)
    y = np.zeros((len(passages), basis.shape[1]), basis.dtype)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    y[row[starts]] = np.add.reduceat(value[:, None] * basis[term], starts)
    order = np.argsort(term, kind="stable")
    heads = np.flatnonzero(np.r_[True, term[order][1:] != term[order][:-1]])
    z = np.zeros_like(basis)
    z[term[order][heads]] = np.add.reduceat(value[order, None] * y[row[order]], heads)
    y = y.astype(np.float64)
    z *= basis.dtype.type(weight)
    return z, weight * (y.T @ y)


def orthonormal(z: np.ndarray) -> np.ndarray:
    """``z`` with orthonormal columns that span the same space, in place; found from its Gram matrix, twice for accuracy."""
    for _ in range(2):
        gram = sum(p.T.astype(np.float64) @ p for p in np.array_split(z, len(z) // 10_000 + 1))
        values, axes = np.linalg.eigh(gram)
        turn = (axes / np.sqrt(np.maximum(values, 1e-9 * max(float(values[-1]), 1e-30)))).astype(z.dtype)
        for k in range(0, len(z), 10_000):
            z[k : k + 10_000] = z[k : k + 10_000] @ turn
    return z


def by_term(places: np.ndarray, terms: int) -> np.ndarray:
    """Order of ``places`` below ``terms``, equal ones as they stand."""
    return np.argsort(places.astype(np.uint16) if terms <= 1 << 16 else places, kind="stable")


def encode(docs: DataFrame, text_col: str, id_col: str, at_once: int = 5 << 18) -> DataFrame:
    """All words of every text as numbers: a row for about ``at_once`` bytes of whole texts.

    ids, sizes: of the documents that have words, and how many. places: into ``words``, the row's distinct words; found: in how
    many of its documents each stands. Sizes and places are ``packed``.
    """
    kind = dict(docs.dtypes)[id_col]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col)
            piece = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // at_once
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), b.num_rows]
            for low, high in itertools.pairwise(cuts):
                sizes, flat, words = number_words(texts.slice(low, high - low))
                if not len(flat):
                    continue
                at = np.flatnonzero(sizes)
                sizes = sizes[at]
                order = by_term(flat, len(words))
                term, owner = flat[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
                first = np.r_[True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])]
                found = np.bincount(term[first], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        listed(b.column(id_col).slice(low, high - low).take(pa.array(at))),
                        pa.array([sizes.astype(np.uint32).tobytes()]),
                        pa.array([packed(flat, len(words))]),
                        listed(words.cast(pa.string())),
                        listed(pa.array(found, pa.int32())),
                        pa.array([int((-(-sizes // SPAN)).sum())], pa.int64()),
                    ],
                    names=["ids", "sizes", "places", "words", "found", "passages"],
                )

    return docs.select(id_col, text_col).mapInArrow(places, f"ids array<{kind}>, sizes binary, places binary, words array<string>, found array<int>, passages long")


def sums_of_rows(rows: np.ndarray, picked: np.ndarray, width: int, at_once: int = 4096) -> np.ndarray:
    """Sum of each ``width`` successive ones of ``rows[picked]``, and a last row of zeros."""
    n = len(picked) // width
    out, ones = np.empty((n + 1, rows.shape[1]), rows.dtype), np.ones((1, width), rows.dtype)
    out[n] = 0
    held, step = np.empty((at_once, rows.shape[1]), rows.dtype), at_once // width
    for a in range(0, n, step):
        some = picked[a * width : min(a + step, n) * width]
        np.take(rows, some, 0, out=held[: len(some)], mode="clip")
        np.matmul(ones, held[: len(some)].reshape(-1, width, rows.shape[1]), out=out[a : min(a + step, n), None])
    return out


def sums_of_runs(rows: np.ndarray, picked: np.ndarray, sizes: np.ndarray, width: int = 8) -> np.ndarray:
    """Sum of each run of ``rows[picked]``. sizes: of the runs, none of them empty. The last of ``rows`` holds zeros."""
    groups = -(-sizes // width)
    first = np.cumsum(groups) - groups
    slots = np.full(int(groups.sum()) * width, len(rows) - 1, np.int32)
    slots[np.arange(len(picked)) + np.repeat(first * width - (np.cumsum(sizes) - sizes), sizes)] = picked
    some = sums_of_rows(rows, slots, width)
    several = groups > 1
    out = some[first]
    if several.any():
        out[several] = sums_of_runs(some, np.flatnonzero(np.repeat(several, groups)), groups[several], width)
    return out


def project(places: np.ndarray, sizes: np.ndarray, terms: np.ndarray, idf: np.ndarray, basis: np.ndarray, z: np.ndarray, gram: np.ndarray) -> None:
    """Adds to ``z`` and ``gram`` what ``_step`` gives for all passages of documents.

    sizes: their words; places: of these in ``terms``, which holds no place of the vocabulary twice; words outside have the one after the last.
    """
    inside = np.flatnonzero((terms < len(idf)) & (np.bincount(places, minlength=len(terms)) > 0))
    if not len(inside):
        return
    own, none = terms[inside], len(inside)
    number = np.full(len(terms), none, np.uint16 if none < 1 << 16 else np.int32)
    number[inside] = np.arange(none)
    weight = idf[own].astype(np.float32)
    scaled = np.zeros((none + 1, basis.shape[1]), np.float32)  # the last one, of zeros, fills short passages up
    np.multiply(basis[own], weight[:, None], out=scaled[:-1])
    parts = -(-sizes.astype(np.int64) // SPAN)
    n = int(parts.sum())
    moved = (np.cumsum(parts) - parts) * SPAN - (np.cumsum(sizes, dtype=np.int64) - sizes)
    filled = np.full(n * SPAN, none, number.dtype)
    filled[np.arange(len(places)) + np.repeat(moved, sizes)] = number[places]
    y = sums_of_rows(scaled, filled, SPAN)
    # a passage's cells: its distinct words
    row = np.sort(filled.reshape(n, SPAN), 1)
    new = np.ones(row.shape, bool)
    np.not_equal(row[:, 1:], row[:, :-1], out=new[:, 1:])
    cells = np.flatnonzero(new)
    times = np.diff(np.r_[cells, row.size])
    square = np.add.reduceat((times * np.r_[weight, 0.0][row.ravel()[cells]]) ** 2, np.searchsorted(cells, np.arange(n) * SPAN))
    scale = np.where(square > 0, 1 / np.sqrt(np.maximum(square, 1e-30)), 0.0).astype(np.float32)[:, None]
    y[:-1] *= scale
    wide = y.astype(np.float64)
    gram += wide.T @ wide
    y[:-1] *= scale
    held = np.bincount(filled, minlength=none + 1)[:none]
    by = by_term(filled, none + 1)[: held.sum()] // SPAN
    total = sums_of_runs(y, by, held)
    total *= weight[:, None]
    z[own] += total


def fit_index(docs: DataFrame, items: list[tuple[object, str, str | None]], text_col: str, id_col: str, rank: int, power: int = 2, block: int = 1024) -> tuple[DataFrame, Index]:
    """The documents (ids, sizes, terms: vocabulary places of all their words) and the index, fitted on all passages of all of them and all items.

    The vocabulary holds the words of items and answers, and those that stand in more than two and more than a thousandth of all
    documents, so its size is bounded by the number of different words of a thousand mean documents. Each of ``power`` passes
    over all documents multiplies by A'A, for the TF-IDF rows A of passages. Tasks' sums
    are added by blocks of ``block`` terms; the driver gets one row of each. The first pass also writes the words as vocabulary places.
    """
    spark, total = docs.sparkSession, docs.count()
    scratch = Scratch(spark, "leak-fit")
    encoded = scratch.settle(encode(docs, text_col, id_col), "places", **STORED)
    own = [words_of(text) for _, text, _ in items]
    asked = [words_of(a) if a else answer_of(t) for _, t, a in items]
    listed = sorted({w for ws in [*own, *asked] for w in ws})
    found = encoded.select(F.explode(F.arrays_zip("words", "found")).alias("x")).groupBy(F.col("x.words").alias("w")).agg(F.sum("x.found").alias("n"))
    named = F.broadcast(spark.createDataFrame(pa.table({"w": pa.array(listed, pa.string()), "own": pa.array([True] * len(listed))})))
    common = found.join(named, "w", "left").filter((F.col("own") | ((F.col("n") > 2) & (F.col("n") * COMMON > total)))).select("w", "n").toArrow().to_pydict()
    df = dict.fromkeys(listed, 0) | dict(zip(common["w"], common["n"], strict=True))
    vocabulary = {w: i for i, w in enumerate(sorted(df))}
    words = pa.array(list(vocabulary), pa.string())
    idf = np.log((1 + total) / (1 + np.array([df[w] for w in vocabulary]))) + 0.1
    item_terms = [[vocabulary[w] for w in ws] for ws in own]
    width = min(rank + 8, len(vocabulary))
    basis = np.random.Generator(np.random.PCG64(2)).standard_normal((len(vocabulary), width), np.float32)
    weight = max(1, encoded.agg(F.sum("passages")).first()[0] or 0) / max(1, len(items))
    ids = encoded.schema["ids"].dataType
    source, chunks = fitted(encoded.select("ids", "sizes", "places", "words"), total, 10_000), None
    for turn in range(power):
        sent = spark.sparkContext.broadcast((words, idf, basis))

        def part(batches: Iterator[pa.RecordBatch], sent=sent, kind=to_arrow_type(ids), coded=turn > 0) -> Iterator[pa.RecordBatch]:
            words, idf, basis = sent.value
            z, gram = np.zeros_like(basis), np.zeros((basis.shape[1],) * 2)
            every = np.arange(len(words) + 1)
            names = ["k", "sums", "ids", "sizes", "terms"][: 2 if coded else 5]

            def row(k: int | None, sums: np.ndarray | None, *chunk: pa.Array) -> pa.RecordBatch:
                sums = None if sums is None else sums.tobytes()
                return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([sums], pa.binary()), *(chunk or [pa.nulls(1, t) for t in (kind, pa.binary(), pa.binary())])][: len(names)], names=names)

            for b, i in ((b, i) for b in batches for i in range(b.num_rows)):
                sizes = np.frombuffer(b.column("sizes")[i].as_buffer(), np.uint32)
                if coded:
                    terms = unpacked(b.column("terms")[i], int(sizes.sum()))
                else:
                    place = pc.fill_null(pc.index_in(b.column("words")[i].values, value_set=words), len(words)).to_numpy()
                    terms = place[unpacked(b.column("places")[i], int(sizes.sum()))]
                    yield row(None, None, b.column("ids").slice(i, 1), b.column("sizes").slice(i, 1), pa.array([packed(terms, len(every))]))
                project(terms, sizes, every, idf, basis, z, gram)
            for k in range(0, len(z), block):
                yield row(k, z[k : k + block])
            yield row(-1, gram)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for k, sums in zip(b.column("k").to_pylist(), b.column("sums"), strict=True):
                    more = np.frombuffer(sums.as_buffer(), np.float64 if k < 0 else np.float32)
                    out[k] = out[k] + more if k in out else more.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["k", "sums"])

        z, gram = _step([np.array(t, np.int64) for t in item_terms], idf, basis, weight)
        if turn:
            made = chunks.select("sizes", "terms").mapInArrow(part, "k long, sums binary")
        else:
            made = scratch.settle(source.mapInArrow(part, f"k long, sums binary, ids {ids.simpleString()}, sizes binary, terms binary"), "terms", **STORED)
            numbered, chunks = made, fitted(made.filter("k is null").select("ids", "sizes", "terms"), total, 10_000)
        sums = scratch.settle(made.filter("k is not null").select("k", "sums").repartition("k").mapInArrow(added, "k long, sums binary"), "sums", **STORED)
        for r in sums.toLocalIterator():
            if r["k"] < 0:
                gram += np.frombuffer(r["sums"]).reshape(gram.shape)
            else:
                z[r["k"] : r["k"] + block] += np.frombuffer(r["sums"]).reshape(-1, width).astype(np.float32)
        sent.destroy()
        scratch.keep(numbered)
        product = z.copy() if turn == power - 1 else None
        basis = orthonormal(z)
    # A'A is about Z G+ Z' (Nystrom), for the last pass's Z, which is A'A times its basis, and G, which is gram
    values, axes = np.linalg.eigh(gram)
    half = (basis.T.astype(np.float64) @ product) @ (axes / np.sqrt(np.where(values > 1e-9 * max(float(values[-1]), 1e-30), values, np.inf)))
    values, rotation = np.linalg.eigh(half @ half.T)
    latent = basis @ rotation[:, np.argsort(-values)[:rank]].astype(np.float32)
    vectors = np.zeros((len(vocabulary) + 1, latent.shape[1]), np.float32)
    np.multiply(idf[:, None], latent, out=vectors[:-1], casting="same_kind")
    parts = [(i, t[a : a + CHUNK]) for i, t in enumerate(item_terms) for a in range(0, len(t), CHUNK)]
    sums = np.array([vectors[t].sum(0) for _, t in parts])
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    answers = [[vocabulary[w] for w in ws] for ws in asked]
    return chunks, Index(words, vectors, [i for i, _, _ in items], item_terms, answers, [i for i, _ in parts], np.r_[idf, 0.0].astype(np.float32), sums.astype(np.float32))


@dataclass
class Bounds:
    """What a stretch must hold to leak an item: ``need`` of its words, and ``least`` of those in ``rare``."""

    size: int
    need: int
    rare: np.ndarray
    least: int


def bounds_of(item: list[int], share: np.ndarray, likely: float) -> Bounds:
    """share: of each term among all words, for the choice of ``rare``; any choice gives right results.

    Of the item's words ``len(item) - need`` may be missing, so of R words at least R less that many are there. A word
    that the item has several times counts as often.
    """
    size, need = len(item) + max(2, len(item) // 4), len(item)
    if len(item) >= 5:
        need = max(1, int(np.ceil(likely * len(item) - 1e-9)))
    terms, times = np.unique(np.array(item, np.int64), return_counts=True)
    order = np.argsort(share[terms], kind="stable")
    terms = terms[order]
    least = np.cumsum(times[order]) - (len(item) - need)
    chance = (size + BLOCK) * np.cumsum(share[terms]) + 1e-9
    # how unlikely so many are in a stretch that has nothing to do with the item
    gain = np.where((least > chance) & (least > 0), least * np.log(np.maximum(least, 1) / chance) - least + chance, -1.0)
    at = int(gain.argmax()) if gain.max() > 0 else len(terms) - 1
    return Bounds(size, need, terms[: at + 1], int(least[at]))


def check_stretch(places: list[int], masks: list[int], words: list[int], item: list[int], answer: list[int], bounds: Bounds, begins: list[int], sure: float) -> tuple[float, bool, int]:
    """Largest share of the item's words found in order within a stretch; whether, where that is under ``sure``, a stretch with enough has the answer; where.

    places, masks, words: of the words of item and answer in the text; masks are their places in the item, as bits. begins: which of them
    stretches begin with, ascending. Neighbours are tried as one longer stretch first: what that doesn't reach none of them does.
    """
    full, n = (1 << len(item)) - 1, len(places)
    ends, end = [], 0
    for k in begins:
        end = max(end, k)
        while end < n and places[end] < places[k] + bounds.size:
            end += 1
        ends.append(end)
    best, where, found = 0, -1, False
    todo = [(0, len(begins))] if begins else []
    while todo:
        low, high = todo.pop()
        row = full
        for m in masks[begins[low] : ends[high - 1]]:
            u = row & m
            row = (row + u) | (row - u)
        most = len(item) - (row & full).bit_count()
        if most < bounds.need or most <= best and (best >= sure * len(item) or found or not answer):
            continue
        if high - low > 1:
            half = (low + high) // 2
            todo += [(half, high), (low, half)]
            continue
        if most > best:
            best, where = most, places[begins[low]]
        if best == len(item):
            break
        if answer and not found and best < sure * len(item):
            found = lcs(answer, words[begins[low] : ends[low]]) >= 0.8 * len(answer)
    share = best / len(item)
    return share, found and share < sure, where


class Searcher:
    def __init__(self, index: Index, sure: float, likely: float):
        self.index, self.sure = index, sure
        self.chunk_of = np.array(index.chunk_of)
        share = np.exp(-index.idf[:-1].astype(np.float64))
        share /= share.sum()
        self.bounds = [bounds_of(item, share, likely) for item in index.items]
        # terms of items and answers are numbered from 1, all others are 0
        own = np.unique(np.concatenate([np.array(t, np.int64) for t in [*index.items, *index.answers]]))
        own = own[own >= 0]
        self.local = np.zeros(len(index.idf), np.int32)
        self.local[own] = np.arange(1, len(own) + 1)
        # cell: a number for each item and term that belong together; masks: the term's places in the item, as bits of 64 each
        self.cell = np.zeros((len(index.items), len(own) + 1), np.int32)
        self.whole_masks = [0]
        counted = np.zeros((len(own) + 1, len(index.items)), np.uint8)
        rare = [False]
        for j, (item, answer, limits) in enumerate(zip(index.items, index.answers, self.bounds, strict=True)):
            places: dict[int, int] = {w: 0 for w in answer if w >= 0}
            for k, w in enumerate(item):
                places[w] = places.get(w, 0) | 1 << k
            chosen = set(limits.rare.tolist())
            for w, mask in places.items():
                self.cell[j, self.local[w]] = len(self.whole_masks)
                self.whole_masks.append(mask)
                rare.append(w in chosen)
            counted[self.local[limits.rare], j] = 1
        parts = -(-max(map(len, index.items)) // 64)
        self.masks = np.array([[m >> 64 * k & (1 << 64) - 1 for m in self.whole_masks] for k in range(parts)], np.uint64)
        self.rare_masks = np.where(np.array(rare), self.masks, np.uint64(0))
        # blocks that a stretch may touch; items with the same number stand together
        reach = np.array([-(-(limits.size - 1) // BLOCK) + 1 for limits in self.bounds])
        self.order = np.argsort(reach, kind="stable")
        self.reach = reach[self.order]
        self.need = np.array([limits.need for limits in self.bounds])
        self.least = np.array([limits.least for limits in self.bounds])
        self.counts = np.uint8 if reach.max() * BLOCK < 256 else np.uint32
        self.counted = np.ascontiguousarray(counted[:, self.order].astype(self.counts))

    def candidates(self, texts: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> blocks in which a stretch may begin that has enough of the item's words. Texts are in local numbers."""
        most = int(self.reach.max())
        flat, owner, first = [], [], []
        for i, ids in enumerate(texts):
            blocks = -(-len(ids) // BLOCK)
            padded = np.zeros(blocks * BLOCK, np.int32)
            padded[: len(ids)] = ids
            flat.append(padded)
            owner.append(np.full(blocks, i))
            first.append(np.arange(blocks))
        ids, owner, first = np.concatenate([*flat, np.zeros(most * BLOCK, np.int32)]).reshape(-1, BLOCK), np.concatenate(owner), np.concatenate(first)
        counts = self.counted[ids[:, 0]]
        for k in range(1, BLOCK):
            counts += self.counted[ids[:, k]]
        held, low = counts[: len(owner)].copy(), 0
        found: dict[tuple[int, int], list[int]] = {}
        for reach in range(1, most + 1):
            if reach > 1:
                held += counts[reach - 1 : reach - 1 + len(owner), low:]
            high = int(np.searchsorted(self.reach, reach + 1))
            if low == high:
                continue
            items = self.order[low:high]
            at, j = np.divmod(np.flatnonzero(held[:, : high - low] >= self.least[items].astype(self.counts)), high - low)
            held, low = np.ascontiguousarray(held[:, high - low :]), high
            for a in range(0, len(at), 1 << 13):
                block, item = at[a : a + (1 << 13)], items[j[a : a + (1 << 13)]]
                # a word of the item counts once, however often the stretch has it
                cell = self.cell[item[:, None], ids[block[:, None] + np.arange(reach)].reshape(len(block), -1)]
                present, rare = (sum(np.bitwise_count(np.bitwise_or.reduce(m[cell], 1)).astype(np.int64) for m in masks) for masks in (self.masks, self.rare_masks))
                fine = (present >= self.need[item]) & (rare >= self.least[item])
                for i, k, b in zip(owner[block[fine]].tolist(), item[fine].tolist(), first[block[fine]].tolist(), strict=True):
                    found.setdefault((i, k), []).append(b)
        return found

    def search(self, texts: list[np.ndarray], at_once: int = 1 << 15) -> list[tuple[int, int, float, float, bool, int]]:
        """(text, item, cosine, share, answer found, first word) of all leaks."""
        out, part, places, size = [], [], [], 0
        for i, ids in enumerate(texts):
            reach = 4 * max(map(len, self.index.items), default=0)
            # a very long text goes in parts that overlap by more than an item
            for a in range(0, max(len(ids), 1), at_once):
                piece = ids[a : a + at_once + reach]
                if len(piece):
                    part.append(piece)
                    places.append((i, a))
                    size += len(piece)
                if size >= at_once:
                    out += self._verified(part, places)
                    part, places, size = [], [], 0
        if part:
            out += self._verified(part, places)
        best: dict[tuple[int, int], tuple] = {}
        for r in out:
            if r[:2] not in best or r[3] > best[r[:2]][3]:
                best[r[:2]] = r
        return [best[k] for k in sorted(best)]

    def _verified(self, part: list[np.ndarray], places: list[tuple[int, int]]) -> list[tuple[int, int, float, float, bool, int]]:
        out = []
        local = [self.local[ids] for ids in part]
        for (i, j), blocks in self.candidates(local).items():
            item, limits = self.index.items[j], self.bounds[j]
            low = blocks[0] * BLOCK
            cells = self.cell[j, local[i][low : (blocks[-1] + 1) * BLOCK + limits.size]]
            held = np.flatnonzero(cells)
            begins = np.flatnonzero(np.isin((held + low) // BLOCK, blocks)).tolist()
            masks = [self.whole_masks[c] for c in cells[held].tolist()]
            held += low
            share, found, where = check_stretch(held.tolist(), masks, part[i][held].tolist(), item, self.index.answers[j], limits, begins, self.sure)
            if share >= self.sure or found:
                vector = self.index.vectors[part[i][where : where + limits.size]].sum(0)
                near = self.index.item_vectors[self.chunk_of == j] @ vector / max(float(np.linalg.norm(vector)), 1e-9)
                out.append((places[i][0], j, float(near.max()), share, found, places[i][1] + where))
        return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    answer_col: str | None = None,
    rank: int = 32,
    sure: float = 0.75,
    likely: float = 0.6,
    fit_docs: int | None = None,
    items_at_once: int = 1000,
) -> DataFrame:
    """One row per document and benchmark item that it leaks:
    ``id_col, item_col, cosine, overlap, answer_found, first_word``.

    overlap: the largest share of the item's words that stand in order within 1.25 times its length (2 words more, if that
    is longer), wherever that stretch begins. cosine: of the latent vectors of that stretch and the item. A leak
    has an overlap of ``sure``, or of ``likely`` together with the item's answer (``answer_col``, else
    the item's last sentence). Items without a word leak nowhere; those of under 5 words leak where all
    their words stand in order. Null and empty texts leak nothing. Repeated documents and items are reported row by row.
    No documents or no items give an empty result. Only the named columns are read. ``fit_docs`` bounds nothing any more and is
    there for callers that still name it: the index is fitted on all documents.

    Items are taken in blocks of ``items_at_once``, which bounds what is sent to the tasks; each block is one
    pass over the texts. Shuffled are counts of words and sums of the fit by terms.
    """
    spark = docs.sparkSession
    columns = [item_col, "text"] + ([answer_col] if answer_col else [])
    listed = benchmark.select(*columns).filter("text is not null")
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    out = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, cosine double, overlap double, answer_found boolean, first_word long"
    number = listed.count()
    blocks = max(1, -(-number // items_at_once))
    result = spark.createDataFrame([], out)
    for k in range(blocks):
        block = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64(item_col, "text"), F.lit(blocks)) == k)
        items = sorted(
            ((r[item_col], r["text"], r[answer_col] if answer_col else None) for r in block.collect() if words_of(r["text"])),
            key=lambda r: (str(r[0]), r[1]),
        )
        if not items or docs.isEmpty():
            continue
        chunks, index = fit_index(docs, items, text_col, id_col, rank)
        # arrays and lists only: tasks make the index of them, so they need no copy of this package
        sent = spark.sparkContext.broadcast(tuple(vars(index).values()))
        kind = to_arrow_type(listed.schema[item_col].dataType)

        def search(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value)
            searcher = Searcher(index, sure, likely)
            for b, i in ((b, i) for b in batches for i in range(b.num_rows)):
                ends = np.cumsum(np.frombuffer(b.column("sizes")[i].as_buffer(), np.uint32), dtype=np.int64)
                rows = searcher.search(np.split(unpacked(b.column("terms")[i], int(ends[-1])), ends[:-1]))
                rows = [r for r in rows if len(index.items[r[1]]) >= 5 or r[3] == 1]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("ids")[i].values.take(at),
                        pa.array([index.item_ids[r[1]] for r in rows], kind),
                        pa.array([r[2] for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.float64()),
                        pa.array([r[4] for r in rows], pa.bool_()),
                        pa.array([r[5] for r in rows], pa.int64()),
                    ],
                    names=[id_col, item_col, "cosine", "overlap", "answer_found", "first_word"],
                )

        result = result.unionByName(chunks.mapInArrow(search, out))
    return result
