"""Cross-tokenizer alignment with a dictionary of token groups.

A text is encoded by two tokenizers. Byte offsets where tokens of both end cut it into groups of a few
tokens of either. A group's two id sequences decide all that is inside it, so each distinct group is interned: its links, the pairs of tokens
whose bytes overlap, are expanded once per task that meets it, and the corpus statistics of its links once over all.

Texts are encoded in one pass, distinct words once a task. A task writes what a document is made of (keys of its distinct groups with their frequencies), its
dictionary (key, links, number of documents), and for each id pair the number of its documents that hold it linked: a document is within
one task, so pairs are counted once a document there and added up by Spark. Counts give each distinct group two sums, of its links' counts and of its
best links. Documents look these up by key: those of the groups in most documents, a fixed number, are broadcast, and all others joined; no key that is
left is in many documents.

Groups are known by 64-bit keys. Every occurrence carries a second, independent hash; should two groups have one key, these
differ, and all is done again with other keys.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.llm.common import Scratch, fitted, small

U = np.uint64
SPACE = "▁"
MADE = "kind int, row long, n_a long, n_b long, n_groups long, n_links long, sha string, keys binary, freqs binary, key long, check long, docs long, links array<long>"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for themselves, the others for those from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Encoder of a tokenizers JSON file with byte-level entries."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.model, of = Tokenizer.from_str(spec), byte_alphabet()
        self.model.encode_special_tokens = True
        self.bytes = [bytes(of.get(c, 0) for c in self.model.id_to_token(i) or "") for i in range(self.model.get_vocab_size())]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Encoder of a sentencepiece model; it puts a space in front by itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: whether no piece reaches from another character over to a word mark
        self.ends_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


SPACED = re.compile(r"^ | $|\s | \s")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str) -> list[str]:
    """``text`` cut at its single spaces between other characters; these spaces are in no part."""
    return BETWEEN.split(text) if SPACED.search(text) else text.split(" ")


def spread(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``width`` numbers for each entry, one after the other."""
    return np.repeat(start - (np.cumsum(width) - width), width) + np.arange(width.sum())


def overlaps(a: tuple[int, ...], b: tuple[int, ...], size_a: list[int], size_b: list[int]) -> list[int]:
    """Links of a group: (id of A << 32) + id of B for all tokens whose bytes overlap."""
    links, i, j, end_a, end_b = [], 0, 0, size_a[a[0]], size_b[b[0]]
    while True:
        links.append((a[i] << 32) + b[j])
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a:
            if (i := i + 1) == len(a):
                return links
            end_a += size_a[a[i]]
        if step_b:
            j += 1
            end_b += size_b[b[j]]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(U)


class Dictionary:
    """Groups and id pairs that one task has met since it last wrote them down."""

    def __init__(self, a: ByteLevel, b: Pieces, seed: int):
        self.size_a, self.size_b = [len(x) for x in a.bytes], [len(x) for x in b.bytes]
        rng = np.random.Generator(np.random.PCG64([13, seed]))
        self.salt = rng.integers(0, 1 << 63, (2, 4), dtype=np.uint64) * U(2) + U(1)
        self.clear()

    def clear(self) -> None:
        self.number, self.key, self.check, self.name, self.links = {}, [], [], [], []
        self.docs = np.zeros(1024, np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def keys(self, ids: tuple[np.ndarray, np.ndarray], begins: tuple[np.ndarray, np.ndarray], which: int) -> np.ndarray:
        """Hash of each group: of its ids, their places and which tokenizer they are of."""
        total = U(0)
        for side in (0, 1):
            x, at = ids[side], begins[side]
            place = np.arange(len(x)) - np.repeat(at, np.diff(np.r_[at, len(x)]))
            mixed = _mix((_unsigned(x) + U(1)) * self.salt[which, 2 * side] + _unsigned(place) * self.salt[which, 2 * side + 1])
            total = _mix(np.add.reduceat(mixed, at) + total * U(3) + U(side))
        return total

    def intern(self, keys: np.ndarray, checks: np.ndarray, groups) -> np.ndarray:
        """Numbers of distinct groups; ``groups(i)`` gives the ids of the ``i``-th."""
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            if (n := self.number.get(key)) is None:
                a, b = groups(i)
                n = self.number[key] = len(self.name)
                self.key.append(key)
                self.name.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
                self.links.append(np.array(overlaps(a, b, self.size_a, self.size_b), np.int64))
                self.check.append(int(checks[i]))
            out[i] = n
        if len(self.name) > len(self.docs):
            self.docs = np.r_[self.docs, np.zeros(len(self.name), np.int64)]
        return out

    def add_pairs(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.pairs.append((codes, counts))
        self.waiting += len(codes)
        if self.waiting > 1_000_000:
            self.pairs = [self.counted()]
            self.waiting = len(self.pairs[0][0])

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, at = np.unique(np.concatenate([c for c, _ in self.pairs]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in self.pairs])).astype(np.int64)


class Aligner:
    """Encodes texts, cuts them into groups and counts in a dictionary.

    No token of either reaches over a single space between two words, and tokens of both end there. So words are encoded
    one by one, each distinct one once, and a text is the sequence of its words' groups. Where pieces do reach across, a whole text is one word.
    """

    def __init__(self, spec: str, model: bytes, seed: int, keep: int = 300_000, keep_chars: int = 10_000_000):
        self.a, self.b, self.keep, self.keep_chars = ByteLevel(spec), Pieces(model), keep, keep_chars
        self.seen = Dictionary(self.a, self.b, seed)
        self.bytes_a, self.bytes_b = np.array(self.seen.size_a), np.array(self.seen.size_b)
        self.clash = False
        self.clear()

    def clear(self) -> None:
        self.seen.clear()
        self.known, self.names, self.chars = {}, [], 0
        # of each word: tokens of A and of B, whether both give its bytes back, and where its groups begin and how many they are
        self.sizes = np.zeros((1024, 5), np.int64)
        self.groups, self.used = np.zeros(1024, np.int64), 0

    @property
    def full(self) -> bool:
        return len(self.names) >= self.keep or len(self.seen.name) >= self.keep or self.chars >= self.keep_chars

    def encode(self, words: list[str], at_once: int = 1000) -> list[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        """(first word, word after the last, ids of A, ids of B, whether both give the bytes of a space and each word back) of stretches of ``words``.

        A stretch is one word, or many that are encoded as a line with single spaces between them.
        """
        plain = [w == w.strip() != "" for w in words] if self.b.ends_at_space else [False] * len(words)
        cuts = [0]
        for i in range(1, len(words) + 1):
            if i == len(words) or not (plain[i] and plain[i - 1]) or i - cuts[-1] >= at_once:
                cuts.append(i)
        return self._encoded(words, cuts)

    def _encoded(self, words: list[str], cuts: list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray, bool]]:
        lines = [" ".join(words[i:k]) for i, k in itertools.pairwise(cuts)]
        out = []
        for (i, k), line, a, b in zip(itertools.pairwise(cuts), lines, self.a([" " + x for x in lines]), self.b(lines), strict=True):
            want = (" " + line).encode("utf-8", "surrogatepass")
            same = all(b"".join(map(known.__getitem__, ids)) == want for known, ids in ((self.a.bytes, a), (self.b.bytes, b)))
            if same or k - i == 1:
                out.append((i, k, np.array(a, np.int64), np.array(b, np.int64), same))
            else:
                out += self._encoded(words, list(range(i, k + 1)))
        return out

    def learn(self, words: list[str]) -> None:
        """Groups of new words."""
        first = len(self.names)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.chars += sum(map(len, words))
        while first + len(words) > len(self.sizes):
            self.sizes = np.r_[self.sizes, np.zeros_like(self.sizes)]
        self.names += [""] * len(words)
        coded = [x for x in self.encode(words) if x[4]]
        if not coded:
            return
        ids = tuple(np.concatenate([x[side] for x in coded]) for side in (2, 3))
        ends = tuple(np.cumsum(size[x]) for size, x in zip((self.bytes_a, self.bytes_b), ids, strict=True))
        number = np.concatenate([np.arange(i, k) for i, k, *_ in coded])
        long = [len(words[i].encode("utf-8", "surrogatepass")) + 1 for i in number.tolist()]
        # words are as long in either, so each word ends where both end
        word_end, common = np.cumsum(long), np.intersect1d(*ends, assume_unique=True)
        begins = tuple(np.r_[0, np.searchsorted(e, common)[:-1] + 1] for e in ends)
        keys, checks = (self.seen.keys(ids, begins, which) for which in (0, 1))
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        stop = tuple(np.r_[b[1:], len(x)] for b, x in zip(begins, ids, strict=True))
        of = lambda i: tuple(tuple(ids[s][begins[s][at[i]] : stop[s][at[i]]].tolist()) for s in (0, 1))
        numbers = self.seen.intern(distinct, checks[at].view(np.int64), of)
        self.clash |= bool((np.array([self.seen.check[n] for n in numbers.tolist()], np.int64)[which] != checks.view(np.int64)).any())
        groups = numbers[which]
        while self.used + len(groups) > len(self.groups):
            self.groups = np.r_[self.groups, np.zeros_like(self.groups)]
        self.groups[self.used : self.used + len(groups)] = groups
        edges = np.r_[0, np.searchsorted(common, word_end) + 1]
        tokens = [np.diff(np.r_[0, np.searchsorted(e, word_end) + 1]) for e in ends]
        self.sizes[first + number] = np.column_stack([*tokens, np.ones(len(number), np.int64), self.used + edges[:-1], np.diff(edges)])
        self.used += len(groups)
        name = [self.seen.name[n] for n in groups.tolist()]
        for i, begin, end in zip((first + number).tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.names[i] = name[begin] if end == begin + 1 else ";".join(name[begin:end])

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, keys, frequencies) of each text."""
        out: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        split = [words_of(texts[i]) if self.b.ends_at_space else [texts[i]] for i in some]
        if new := set().union(*split).difference(self.known):
            self.learn(sorted(new))
        get, seen = self.known.__getitem__, self.seen
        coded = [(i, np.fromiter(map(get, w), np.int64, len(w))) for i, w in zip(some, split, strict=True)]
        coded = [(i, w) for i, w in coded if self.sizes[w, 2].all()]
        if not coded:
            return out
        # distinct words of each text, then its distinct groups, and how often each is there
        doc, many = np.repeat(np.arange(len(coded)), [len(w) for _, w in coded]), len(self.names)
        code, times = np.unique(doc * many + np.concatenate([w for _, w in coded]), return_counts=True)
        doc, word = code // many, code % many
        tokens = [np.bincount(doc, times * self.sizes[word, side], len(coded)).astype(np.int64) for side in (0, 1)]
        start, width = self.sizes[word, 3], self.sizes[word, 4]
        code, at = np.unique(np.repeat(doc, width) * len(seen.name) + self.groups[spread(start, width)], return_inverse=True)
        freq = np.bincount(at, np.repeat(times, width)).astype(np.int64)
        held_doc, group = code // len(seen.name), code % len(seen.name)
        numbers, at = np.unique(group, return_inverse=True)
        seen.docs[numbers] += np.bincount(at)
        links = [seen.links[n] for n in numbers.tolist()]
        width = np.array(list(map(len, links)))
        # distinct pairs of each text: links of its distinct groups
        codes, pair = np.unique(np.concatenate(links), return_inverse=True)
        place = spread((np.cumsum(width) - width)[at], width[at])
        pairs = np.unique(np.repeat(held_doc, width[at]) * len(codes) + pair[place]) % len(codes)
        seen.add_pairs(codes, np.bincount(pairs, minlength=len(codes)))
        n_groups, n_links = (np.bincount(held_doc, w, len(coded)).astype(np.int64) for w in (freq, width[at] * freq))
        keys = np.array([seen.key[n] for n in numbers.tolist()], np.uint64)[at]
        edges = np.searchsorted(held_doc, np.arange(len(coded) + 1))
        for k, (i, w) in enumerate(coded):
            mine = slice(edges[k], edges[k + 1])
            sha = hashlib.sha256(";".join(map(self.names.__getitem__, w.tolist())).encode()).hexdigest()
            out[i] = (int(tokens[0][k]), int(tokens[1][k]), int(n_groups[k]), int(n_links[k]), sha, keys[mine].tobytes(), freq[mine].astype(np.uint32).tobytes())
        return out


def _batch(schema: pa.Schema, number: int, **columns) -> pa.RecordBatch:
    given = {k: v if isinstance(v, pa.Array) else pa.array(v, schema.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(number, f.type) for f in schema], schema=schema)


def align_tokens(
    docs: DataFrame,
    byte_level: str,
    pieces: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    most_sent: int = 50_000,
    keep: int = 300_000,
    slice_chars: int = 500_000,
) -> DataFrame:
    """One row per document: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``byte_level`` (A) is the path of a tokenizers JSON file with byte-level entries, ``pieces`` (B) that of a sentencepiece model; the
    driver reads them and sends their contents. A encodes a space and the text, B the text, before which it puts a space. n_links: pairs of a token of A and
    one of B whose bytes overlap. An id pair's count is the number of documents that hold it linked. n_best: links whose count is the
    highest of their A id, ties included. count_sum: sum of all links' counts. groups_sha256: of ``a1,a2|b1;a3|b2``, the groups' ids in order.
    Null and empty texts, and those that a tokenizer doesn't give back byte by byte, have zeros and the empty string. Rows are
    documents: rows of equal or null ids are counted each for itself. No rows give none. Other columns are not read.

    Bounded: the ``most_sent`` groups in most documents are what is broadcast; a task holds ``keep`` words or groups or little more before it writes its
    dictionary down; texts are taken in slices of about ``slice_chars`` characters, and a longer one is encoded word by word like all others. Most
    of the work is done when this is called.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        sent = spark.sparkContext.broadcast((json.dumps(json.load(f)), g.read()))
    id_type = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "alignment")
    for seed in itertools.count():
        made = scratch.settle(rows.mapInArrow(encoder(sent, seed, keep, slice_chars, rows.schema["id"].dataType), f"{MADE}, id {id_type}"), "made")
        groups = made.filter("kind = 1").groupBy("key").agg(
            F.min("check").alias("low"), F.max("check").alias("high"), F.sum("docs").alias("docs"), F.first("links").alias("links")
        )
        groups = scratch.settle(groups, "groups")
        if groups.filter("low <> high or low is null").isEmpty():
            break
    # an A id has no more pairs than B has ids
    counted = made.filter("kind = 2").groupBy("key").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("key", 32))
    counted = counted.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a"))).select(F.col("key").alias("link"), "count", "best")
    counted = scratch.settle(counted, "pairs")
    links = groups.select("key", "docs", F.explode("links").alias("link")).join(small(counted), "link")
    scored = links.groupBy("key", "docs").agg(F.sum("count").alias("total"), F.count_if("best").alias("best"))
    scored = scratch.settle(scored, "scored")
    often = scored.orderBy(F.desc("docs"), "key").limit(most_sent).select("key", "total", "best").toArrow()
    known = sorted(zip(*(c.to_pylist() for c in often.columns), strict=True)) if often.num_rows else []
    table = spark.sparkContext.broadcast(np.array(known, np.int64).reshape(-1, 3))
    looked = made.filter("kind = 0").select("id", "row", "n_a", "n_b", "n_groups", "n_links", "sha", "keys", "freqs")
    shape = f"id {id_type}, row long, n_a long, n_b long, n_groups long, n_links long, sha string, total long, best long, key long, freq long"
    looked = scratch.settle(looked.mapInArrow(look_up(table, rows.schema["id"].dataType), shape), "looked")
    rest = looked.filter("key is not null").select("row", "key", "freq").join(scored.select("key", F.col("total").alias("t"), F.col("best").alias("b")), "key")
    rest = rest.groupBy("row").agg(F.sum(F.col("t") * F.col("freq")).alias("t"), F.sum(F.col("b") * F.col("freq")).alias("b"))
    rest = scratch.settle(fitted(rest, looked.count()), "rest")
    scratch.keep(looked, rest)
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return looked.filter("key is null").join(small(rest), "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        (F.col("best") + more("b")).alias("n_best"), (F.col("total") + more("t")).alias("count_sum"), F.col("sha").alias("groups_sha256"),
    )


def _arrow_schema(ddl: str, **more) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))] + list(more.items()))


def encoder(sent, seed: int, keep: int, slice_chars: int, id_kind):
    """Function of ``mapInArrow``: rows ``id, text`` -> rows of documents (kind 0), groups (1) and id pairs (2)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        schema = _arrow_schema(MADE, id=to_arrow_type(id_kind))
        aligner, row = Aligner(*sent.value, seed, keep), TaskContext.get().partitionId() << 36
        seen = aligner.seen

        def written() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(seen.name), 20_000):
                part = slice(at, at + 20_000)
                keys = np.array(seen.key[part], np.uint64)
                # without a second hash, the run is done again
                checks = [None if aligner.clash else c for c in seen.check[part]]
                yield _batch(schema, len(keys), kind=[1] * len(keys), key=keys.view(np.int64), check=checks, docs=seen.docs[: len(seen.name)][part], links=seen.links[part])
            codes, counts = seen.counted()
            for at in range(0, len(codes), 100_000):
                part = slice(at, at + 100_000)
                yield _batch(schema, len(codes[part]), kind=[2] * len(codes[part]), key=codes[part], docs=counts[part])
            aligner.clear()

        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = np.cumsum([len(t or "") + 16 for t in texts]) // slice_chars
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            for begin, end in itertools.pairwise(edges):
                found = list(zip(*aligner(texts[begin:end]), strict=True)) if end > begin else [()] * 7
                names = ("n_a", "n_b", "n_groups", "n_links", "sha", "keys", "freqs")
                number = end - begin
                yield _batch(schema, number, kind=[0] * number, row=np.arange(row, row + number), id=b.column("id").slice(begin, number), **dict(zip(names, found, strict=True)))
                row += number
                if aligner.full:
                    yield from written()
        yield from written()

    return encode


def look_up(table, id_kind):
    """Function of ``mapInArrow``: a document's sums over the groups that ``table`` (key, total, best) has, and a row for each other group."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own = ("id", "row", "n_a", "n_b", "n_groups", "n_links", "sha")
        ddl = "row long, n_a long, n_b long, n_groups long, n_links long, sha string, total long, best long, key long, freq long"
        schema = pa.schema([("id", to_arrow_type(id_kind)), *_arrow_schema(ddl)])
        known, total, best = (np.ascontiguousarray(table.value[:, i]) for i in range(3))
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                keys = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
                freqs = np.frombuffer(b"".join(b.column("freqs").to_pylist()), np.uint32).astype(np.int64)
                doc = np.repeat(np.arange(b.num_rows), [len(k) // 8 for k in b.column("keys").to_pylist()])
                at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                sums = [np.zeros(b.num_rows, np.int64) for _ in range(2)]
                for s, value in zip(sums, (total, best), strict=True):
                    np.add.at(s, doc[hit], value[at[hit]] * freqs[hit])
                yield _batch(schema, b.num_rows, **{c: b.column(c) for c in own}, total=sums[0], best=sums[1])
                left = np.flatnonzero(~hit)
                if len(left):
                    yield _batch(schema, len(left), row=b.column("row").to_numpy()[doc[left]], key=keys[left], freq=freqs[left])

    return look
