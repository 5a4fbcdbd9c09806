"""Language identification by interpolated Kneser-Ney character models.

One model per language, all of the same order. n-grams are kept as 64-bit hashes in one
sorted array per order, with a column of counts for each language; lookups are binary searches over
whole batches. A text is read as words of letters, each between a start and an end mark, so
a word's score doesn't depend on its neighbours and is computed once per worker.

The language with the lowest cross-entropy per character wins. A text is rejected if even
that is far above what pieces of the same length have in texts held back from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
START, END = 2, 3
UNKNOWN = "und"
ENOUGH = 50  # pieces that a limit is read from, at least
MIX = np.uint64(0x9E3779B97F4A7C15)


def runs_of_letters(token: str) -> list[str]:
    """Maximal runs of letters (Unicode category L), lower-cased."""
    if token.isalpha():
        return [token.lower()]
    return "".join(c if c.isalpha() else " " for c in token).lower().split()


def flat_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with marks around each, and the place of each word's first letter or end."""
    # one more mark in front, so that the first word has a whole context as well
    text = "\x02" + "".join("\x02" * (ORDER - 1) + w + "\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + ORDER for w in words], np.int64)
    return codes, np.r_[0, np.cumsum(lengths)[:-1]] + ORDER


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """[n]: hash of the n code points that end at each place, from place ORDER - 1 on."""
    out, n = [np.zeros(len(codes) - ORDER + 1, np.uint64)], len(codes) - ORDER + 1
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            h = np.zeros(n, np.uint64)
            for j in range(k - 1, -1, -1):
                h = (h + codes[ORDER - 1 - j : ORDER - 1 - j + n] + np.uint64(1)) * MIX
                h ^= h >> np.uint64(29)
            out.append(h)
    return out


class KneserNey:
    """Models of several languages. log_probabilities() gives one column per language."""

    @classmethod
    def of(cls, parts: dict) -> KneserNey:
        """The model that has these ``vars()``: lists and arrays only, so they can be sent anywhere."""
        model = cls.__new__(cls)
        vars(model).update(parts)
        return model

    def __init__(self, texts: dict[str, list[str]], discount: float = 0.75):
        self.languages, self.discount = sorted(texts), discount
        count = len(self.languages)
        unique: list[list] = [[None] * count for _ in range(ORDER + 1)]
        letters: set[int] = set()
        for i, language in enumerate(self.languages):  # one at a time: only distinct n-grams stay in memory
            words = [w for t in texts[language] for token in t.split() for w in runs_of_letters(token)] or [""]
            codes, first = flat_codes(words)
            real = np.zeros(len(codes) + 1, np.int8)
            np.add.at(real, first, 1)
            np.add.at(real, first + np.array([len(w) + 1 for w in words]), -1)
            real = np.cumsum(real[:-1], dtype=np.int8).astype(bool)
            letters.update(np.unique(codes[real]).tolist())
            real = real[ORDER - 1 :]
            hashes = gram_hashes(codes)
            for n in range(1, ORDER + 1):
                keys, at, number = np.unique(hashes[n][real], return_index=True, return_counts=True)
                place = np.flatnonzero(real)[at]
                # context: the n-gram's beginning, which ends one place earlier; tail: all but its first character
                context = hashes[n - 1][place - 1] if n > 1 else np.zeros(len(keys), np.uint64)
                tail = hashes[n - 1][place] if n > 1 else np.zeros(len(keys), np.uint64)
                unique[n][i] = (keys, context, tail, number.astype(np.float64))
        self.size = len(letters) + 1
        self.keys, self.counts = [None] * (ORDER + 1), [None] * (ORDER + 1)
        self.contexts, self.totals, self.kinds = [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1)
        for n in range(1, ORDER + 1):
            rows = []
            for i in range(count):
                keys, context, _, number = unique[n][i]
                if n < ORDER:  # lower orders count the distinct n-grams that end in this one
                    longer = unique[n + 1][i][2]
                    tails, kinds = np.unique(longer, return_counts=True)
                    at = np.minimum(np.searchsorted(tails, keys), len(tails) - 1)
                    number = np.where(tails[at] == keys, kinds[at], 0).astype(np.float64)
                rows.append((keys, context, number))
            self.keys[n] = np.unique(np.concatenate([r[0] for r in rows]))
            self.contexts[n] = np.unique(np.concatenate([r[1] for r in rows]))
            self.counts[n] = np.zeros((len(self.keys[n]), count), np.float32)
            self.totals[n] = np.zeros((len(self.contexts[n]), count), np.float32)
            self.kinds[n] = np.zeros((len(self.contexts[n]), count), np.float32)
            for i, (keys, context, number) in enumerate(rows):
                self.counts[n][np.searchsorted(self.keys[n], keys), i] = number
                at = np.searchsorted(self.contexts[n], context)
                np.add.at(self.totals[n][:, i], at, number)
                np.add.at(self.kinds[n][:, i], at, number > 0)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of P(character | the three before), from place ORDER - 1 on."""
        hashes = gram_hashes(codes)
        n_places, count = len(hashes[1]), len(self.languages)
        p = np.full((n_places, count), 1.0 / self.size, np.float32)
        for n in range(1, ORDER + 1):
            context = np.r_[np.uint64(0), hashes[n - 1][:-1]] if n > 1 else np.zeros(n_places, np.uint64)
            at = np.minimum(np.searchsorted(self.keys[n], hashes[n]), len(self.keys[n]) - 1)
            number = np.where((self.keys[n][at] == hashes[n])[:, None], self.counts[n][at], np.float32(0))
            at = np.minimum(np.searchsorted(self.contexts[n], context), len(self.contexts[n]) - 1)
            known = (self.contexts[n][at] == context)[:, None]
            total = np.where(known, self.totals[n][at], np.float32(0))
            kinds = np.where(known, self.kinds[n][at], np.float32(0))
            d = np.float32(self.discount)
            safe = np.maximum(total, np.float32(1))
            p = np.where(total > 0, (np.maximum(number - d, 0) + d * kinds * p) / safe, p)
        return np.log(p)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Summed log probabilities of each word with its end mark, one column per language."""
        codes, first = flat_codes(words)
        logs = self.log_probabilities(codes).astype(np.float64)
        upto = np.r_[np.zeros((1, logs.shape[1])), np.cumsum(logs, 0)]
        a = first - (ORDER - 1)
        return upto[a + np.array([len(w) + 1 for w in words], np.int64)] - upto[a]


class Judge:
    """Scores texts; keeps the scores of short tokens, at most ``keep`` of them."""

    def __init__(self, model: KneserNey, limits: np.ndarray | None, keep: int = 200_000):
        self.model, self.limits, self.keep = model, limits, keep
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.table = np.zeros((1 << 12, len(self.model.languages) + 1))

    def learn(self, tokens: list[str], at_once: int = 20_000) -> None:
        for k in range(0, len(tokens), at_once):
            part = tokens[k : k + at_once]
            runs = [runs_of_letters(t) for t in part]
            words = [w for r in runs for w in r]
            sums = np.zeros((len(part), self.table.shape[1]))
            if words:
                owner = np.repeat(np.arange(len(part)), [len(r) for r in runs])
                np.add.at(sums[:, :-1], owner, self.model.score_words(words))
                np.add.at(sums[:, -1], owner, [len(w) + 1 for w in words])
            base = len(self.place)
            while base + len(part) > len(self.table):
                self.table = np.r_[self.table, np.zeros_like(self.table)]
            self.table[base : base + len(part)] = sums
            self.place.update(zip(part, range(base, base + len(part)), strict=True))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """[text]: summed log probabilities per language, then the number of characters."""
        if len(self.place) > self.keep:
            self.forget()
        split = [t.split() if t else [] for t in texts]
        new = set().union(*split) - self.place.keys()
        if new:
            self.learn(sorted(new))
        get, out = self.place.__getitem__, np.zeros((len(texts), self.table.shape[1]))
        for i, tokens in enumerate(split):
            if tokens:
                out[i] = self.table[np.fromiter(map(get, tokens), np.int64, len(tokens))].sum(0)
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, confidence, cross-entropy per character in bits, and acceptance of each text."""
        sums = self.sums(texts)
        n = np.maximum(sums[:, -1:], 1)
        entropy = -sums[:, :-1] / n
        best = entropy.argmin(1)
        own = entropy[np.arange(len(best)), best]
        # the odds of the languages after at most 50 characters
        odds = np.exp(-(entropy - own[:, None]) * np.minimum(n, 50))
        has = sums[:, -1] > 0
        bits = own / np.log(2)
        fine = has & (bits <= self.limits[length_class(n[:, 0]), best]) if self.limits is not None else has
        names = [self.model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        score = np.where(has, 1 / odds.sum(1), 0.0)
        return names, score.tolist(), [b if h else None for b, h in zip(bits.tolist(), has, strict=True)], fine.tolist()


def length_class(chars: np.ndarray) -> np.ndarray:
    """0 for 1 character, 1 for 2 and 3, 2 for 4 to 7, and so on; 20 at most."""
    return np.minimum(np.frexp(np.maximum(chars, 1))[1] - 1, 20)


def noise_like(text: str, letters: np.ndarray, rng: np.random.Generator) -> str:
    """``text`` with each letter replaced by one of ``letters``, all as likely."""
    drawn = iter(letters[rng.integers(0, len(letters), len(text))].tolist())
    return "".join(next(drawn) if c.isalpha() else c for c in text)


def piece_bits(judge: Judge, text: str, language: int) -> list[np.ndarray]:
    """[length class]: bits per character of the text's pieces of 1, 2, 4, ... tokens."""
    tokens, found = text.split(), [np.zeros(0)] * 21
    judge.sums([text])
    parts, width = judge.table[[judge.place[t] for t in tokens]][:, [language, -1]], 1
    while width < 2 * len(tokens):
        sums = np.add.reduceat(parts, np.arange(0, len(parts), width))
        sums = sums[sums[:, 1] > 0]
        classes = length_class(sums[:, 1])
        for k in np.unique(classes):
            found[k] = np.r_[found[k], -sums[classes == k, 0] / sums[classes == k, 1] / np.log(2)]
        width *= 2
    return found


def limits_of(judge: Judge, held: dict[str, list[str]], share: float = 0.99) -> np.ndarray:
    """[length class, language]: largest cross-entropy, in bits per character, that is accepted.

    Two samples are scored in pieces of 1, 2, 4, ... tokens: held back texts, and the same with their letters
    replaced by random ones of the language. The limit of a length class lies midway between the ``share`` quantile of the former
    and the 1 - ``share`` quantile of the latter, so an odd text doesn't move it. A class with few
    pieces takes the limit of the next shorter one, the shortest that of the next longer one.
    """
    limits = np.full((21, len(judge.model.languages)), np.inf)
    rng = np.random.Generator(np.random.PCG64(4))
    for i, language in enumerate(judge.model.languages):
        texts = held.get(language, [])
        letters = np.array(sorted({c for t in texts for c in t.lower() if c.isalpha()}) or ["a"])
        own = [piece_bits(judge, t, i) for t in texts if t.split()]
        noise = [piece_bits(judge, noise_like(t, letters, rng), i) for t in texts if t.split()]
        known = np.inf
        for k in range(21):
            good, bad = (np.concatenate([x[k] for x in found] or [np.zeros(0)]) for found in (own, noise))
            if min(len(good), len(bad)) >= ENOUGH:
                high = float(np.quantile(good, share))
                known = (high + max(high, float(np.quantile(bad, 1 - share)))) / 2
            limits[k, i] = known
        first = int(np.argmin(np.isinf(limits[:, i])))
        limits[:first, i] = limits[first, i]
    return limits


def fit(rows: list[tuple[str, str]]) -> tuple[KneserNey, np.ndarray]:
    """Models and rejection limits from (language, text) rows; every fifth text sets the limits."""
    by: dict[str, list[str]] = {}
    for language, text in sorted(rows):
        by.setdefault(language, []).append(text)
    model = KneserNey({k: [t for i, t in enumerate(v) if i % 5 or len(v) < 5] for k, v in by.items()})
    return model, limits_of(Judge(model, None), {k: v[::5] for k, v in by.items()})


def training_rows(labelled: DataFrame, id_col: str, most_docs: int) -> list[tuple[str, str]]:
    """At most about ``most_docs`` (lang, text) rows of each language, picked by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, int(min(1.0, most_docs / n) * (1 << 30))).otherwise(share)
    picked = labelled.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share)
    return [(r["lang"], r["text"]) for r in picked.select("lang", "text").limit(2 * most_docs * len(counts)).collect()]


def identify_languages(
    docs: DataFrame,
    training: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    most_docs: int = 160,
    slice_chars: int = 1 << 19,
) -> DataFrame:
    """Add ``lang_pred, score, bits_per_char, accepted`` to ``docs``.

    Learns from ``training(id, lang, text)`` alone: about ``most_docs`` whole texts of each language,
    the documented bound of the sample that the driver fits the models on. A text that is null or has
    no letter is ``und``, scores 0 and isn't accepted. All else gets the language with the lowest
    cross-entropy per character; ties go to the smaller name. accepted is false where that exceeds
    the language's limit for texts of that length, see ``limits_of``. With no training row everything is ``und``. Equal texts
    get equal results. Columns of the same names are replaced; all others stay.
    """
    rows = training_rows(
        training.select(F.col(id_col).alias("id"), "lang", F.col(text_col).alias("text")).filter("lang is not null and text is not null and id is not null"),
        "id",
        most_docs,
    )
    made = ["lang_pred", "score", "bits_per_char", "accepted"]
    kept = [c for c in docs.columns if c not in made]
    if not rows:
        return docs.select(*kept).withColumns(
            {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "bits_per_char": F.lit(None).cast("double"), "accepted": F.lit(False)}
        )
    # counts of n-grams: bounded by the sample; arrays and lists only, so that tasks need no copy of this package
    model, limits = fit(rows)
    sent = docs.sparkSession.sparkContext.broadcast((vars(model), limits))
    del rows, model
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["lang_pred string", "score double", "bits_per_char double", "accepted boolean"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, limits = sent.value
        judge = Judge(KneserNey.of(parts), limits)
        for b in batches:
            out, part, chars = ([], [], [], []), [], 0
            for i, text in enumerate(b.column(text_col)):
                part.append(text.as_py())
                chars += len(part[-1] or "")
                if chars >= slice_chars or i == b.num_rows - 1:
                    for o, x in zip(out, judge.judge(part), strict=True):
                        o.extend(x)
                    part, chars = [], 0
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in kept] + [pa.array(o, t) for o, t in zip(out, kinds, strict=True)], names=[*kept, *made]
            )

    return docs.select(*kept).mapInArrow(judge, shape)


def fold(id_: Column) -> Column:
    """crc32 of the id as text, mod 4."""
    return F.pmod(F.crc32(F.encode(id_.cast("string"), "UTF-8")), F.lit(4))
