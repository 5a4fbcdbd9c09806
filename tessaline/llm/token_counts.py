"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole batch lie in one flat numpy array with a sequence number for
each symbol. In every round each sequence finds its lowest-rank adjacent pair, and
all sequences merge theirs at once; what survives is counted. Distinct pre-tokens
are encoded once per worker and then looked up.

A pre-token ends where no vocabulary piece can reach across: before a word mark
that follows another character, and between two characters that stand side by side
in no piece. So encoding the pre-tokens one by one equals encoding the whole text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_MARK = "▁"
NO_RANK = np.iinfo(np.int32).max


def read_piece_model(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece BPE model.

    Raises ValueError unless the model is of the kind this operator encodes: no
    user-defined or unused pieces, byte fallback, and text left as it is but for the
    word mark put in front and in place of spaces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) != 256 or any(map(model.is_unused, ids)):
        raise ValueError("needs a BPE model with byte fallback and without unused pieces")
    if model.normalize("  ﬁ  a\tb  ") != f"{WORD_MARK * 3}ﬁ{WORD_MARK * 2}a\tb{WORD_MARK * 2}":
        raise ValueError("needs a model with identity normalisation and a word mark in front")
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in ids
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]


class RankTable:
    """Merge table: symbol ids, ranks of merged symbols, and sorted pair keys."""

    def __init__(self, pieces: list[tuple[str, float]]):
        symbols = {piece: i for i, (piece, _) in enumerate(pieces)}
        for piece, _ in pieces:
            for ch in piece:
                symbols.setdefault(ch, len(symbols))
        self.symbols, self.width = symbols, len(symbols)
        order = {s: r for r, s in enumerate(sorted({score for _, score in pieces}, reverse=True))}
        self.rank = np.full(self.width, NO_RANK, np.int32)
        for i, (_, score) in enumerate(pieces):
            self.rank[i] = order[score]
        #: Tokens that a symbol gives if nothing more merges: bytes for one outside the vocabulary.
        self.cost = np.ones(self.width, np.int32)
        for s, i in symbols.items():
            if i >= len(pieces):
                self.cost[i] = len(s.encode())
        keys, merged = [], []
        for piece, _ in pieces:
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(symbols[piece])
        by_key = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[by_key], np.array(merged, np.int32)[by_key]
        # A symbol is safe to merge everywhere at once if nothing that it can be part of
        # next has a lower or equal rank, and no other symbol shares its rank.
        left, right = self.keys // self.width, self.keys % self.width
        self.safe = np.ones(self.width, bool)
        for part in (left, right):
            self.safe[part[self.rank[self.merged] <= self.rank[part]]] = False
        shared = np.bincount(self.rank[self.rank < NO_RANK])
        self.safe[self.rank < NO_RANK] &= shared[self.rank[self.rank < NO_RANK]] == 1
        self.pairs = {piece[i : i + 2] for piece, _ in pieces for i in range(len(piece) - 1)}

    def merge_of(self, a: int, b: int) -> int:
        k = a * self.width + b
        i = int(np.searchsorted(self.keys, k))
        return int(self.merged[i]) if i < len(self.keys) and self.keys[i] == k else -1

    def split(self, run: str) -> list[str]:
        """Cut a run where two neighbours stand side by side in no piece."""
        at = [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in self.pairs]
        return [run[a:b] for a, b in zip([0, *at], [*at, len(run)], strict=True)]

    def count_long(self, run: str) -> int:
        """One long sequence by a heap of pairs; the same result in n log n steps."""
        ids = [self.symbols.get(c, -1) for c in run]
        own = [0 if i >= 0 else len(c.encode()) for i, c in zip(ids, run, strict=True)]
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int) -> None:
            j = right[i]
            if i >= 0 and j < len(ids) and ids[i] >= 0 and ids[j] >= 0 and (z := self.merge_of(ids[i], ids[j])) >= 0:
                heapq.heappush(heap, (int(self.rank[z]), i, ids[i], ids[j], z))

        for i in range(len(ids) - 1):
            push(i)
        gone = [False] * len(ids)
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = right[i]
            if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], right[i] = z, True, right[j]
            if right[i] < len(ids):
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return sum(o if i < 0 else int(self.cost[i]) for i, o, g in zip(ids, own, gone, strict=True) if not g)

    def count_batch(self, runs: list[str], longest: int = 2000) -> np.ndarray:
        """Tokens of each run. Runs over ``longest`` characters go to ``count_long``."""
        out = np.zeros(len(runs), np.int64)
        short = []
        for i, run in enumerate(runs):
            if len(run) > longest:
                out[i] = self.count_long(run)
            elif run:
                short.append(i)
        if not short:
            return out
        text = "".join(runs[i] for i in short)
        seq = np.repeat(np.array(short), [len(runs[i]) for i in short])
        get = self.symbols.get
        ids = np.fromiter((get(c, -1) for c in text), np.int64, len(text))
        for i in np.flatnonzero(ids < 0):
            out[seq[i]] += len(text[i].encode())
        while len(ids):
            merged, rank = self._pairs(ids, seq)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(seq)])
            best = np.minimum.reduceat(rank, starts)
            done = np.repeat(best == NO_RANK, lengths)
            if done.any():
                over = done & (ids >= 0)
                np.add.at(out, seq[over], self.cost[ids[over]])
                ids, seq, merged, rank = ids[~done], seq[~done], merged[~done], rank[~done]
                best, lengths = best[best < NO_RANK], lengths[best < NO_RANK]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            first = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
            # of overlapping places every second one merges, from the left
            opens = np.r_[True, (at[1:] != at[:-1] + 1) | first[1:]]
            since = at - at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
            at = at[first | (self.safe[merged[at]] & (since % 2 == 0))]
            ids[at] = merged[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, seq = ids[stay], seq[stay]
        return out

    def _pairs(self, ids: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbol and rank of the pair that begins at each place."""
        merged = np.zeros(len(ids), np.int32)
        rank = np.full(len(ids), NO_RANK, np.int32)
        both = np.flatnonzero((seq[1:] == seq[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
        key = ids[both] * self.width + ids[both + 1]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        merged[both[found]] = self.merged[at[found]]
        rank[both[found]] = self.rank[merged[both[found]]]
        return merged, rank


class Counter:
    """Counts tokens of texts; keeps the counts of short pre-tokens, at most ``keep`` of them."""

    def __init__(self, table: RankTable, keep: int = 600_000):
        self.table, self.keep, self.known = table, keep, {}
        self.words = re.compile(f"{WORD_MARK}+[^{WORD_MARK}]*")

    def pretokens(self, text: str) -> list[str]:
        """Words without the word mark in front of each, or with all of them if a run is longer."""
        if "  " in text or WORD_MARK in text or text[:1] == " " or text[-1:] == " ":
            return [w[1:] for w in self.words.findall(WORD_MARK + text.replace(" ", WORD_MARK))]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        runs, owner = [], []
        for i, word in enumerate(words):
            for run in self.table.split(WORD_MARK + word):
                runs.append(run)
                owner.append(i)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, np.array(owner, np.int64), self.table.count_batch(runs))
        self.known.update(zip(words, total.tolist(), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > self.keep:
            self.known = {}
        split = [self.pretokens(t) if t else [] for t in texts]
        new = set().union(*split) - self.known.keys()
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in split]


def count_tokens(
    docs: DataFrame,
    pieces: list[tuple[str, float]],
    text_col: str = "text",
    count_col: str = "n_tokens",
    slice_chars: int = 1 << 20,
) -> DataFrame:
    """Add ``count_col``: the tokens of each whole text.

    ``pieces`` are the vocabulary's pieces and scores; the driver reads the model, so
    executors need no file. Its size is bounded by the vocabulary. Null and empty texts
    have no token. Equal rows give equal counts. Other columns stay; ``count_col`` is
    replaced if it is there. No shuffle: one pass over the input, texts taken in slices
    of about ``slice_chars`` characters.
    """
    kept = [c for c in docs.columns if c not in (text_col, count_col)]
    source = docs.select(*kept, text_col)
    shape = source.drop(text_col).withColumn(count_col, F.lit(0).cast("long")).schema
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(RankTable(sent.value))
        for batch in batches:
            texts, out, part, chars = batch.column(text_col).to_pylist(), [], [], 0
            for text in texts:
                part.append(text)
                chars += len(text or "")
                if chars >= slice_chars:
                    out += counter.counts(part)
                    part, chars = [], 0
            out += counter.counts(part)
            columns = [batch.column(c) for c in kept] + [pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, count_col])

    return source.mapInArrow(count, shape)
