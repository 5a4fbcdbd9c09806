"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score). All grades share one weight per feature, and the thresholds
are kept in order. Features are hashed: which words a text holds, and the share of its tokens of each
shape (case, digits and punctuation with repeats collapsed). A token's part of the score
is computed once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, SHAPES = 1 << 18, 1 << 10
REPEAT = re.compile(r"(.)\1+", re.DOTALL)


def word_feature(token: str) -> int:
    core = "".join(c for c in token.lower() if c.isalnum())
    return xxhash.xxh32_intdigest(core) % WORDS


def shape_feature(token: str) -> int:
    shape = "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c for c in token)
    return xxhash.xxh32_intdigest(REPEAT.sub(r"\1", shape)[:6]) % SHAPES


class Features:
    """(word, shape) features of tokens; keeps at most ``keep`` tokens."""

    def __init__(self, keep: int = 500_000):
        self.keep, self.known = keep, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word features, and the number of tokens of each shape."""
        tokens = text.split() if text else []
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = word_feature(t) * SHAPES + shape_feature(t)
        both = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        return np.unique(both // SHAPES), np.bincount(both % SHAPES, minlength=SHAPES)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Shared weights and ordered thresholds of a cumulative-link model."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, thresholds: np.ndarray):
        self.words, self.shapes, self.thresholds = words, shapes, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """[text, k]: P(grade >= k + 1)."""
        return logistic(score[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, features: list[tuple[np.ndarray, np.ndarray]], grades: list[int], levels: int, rounds: int = 400, rate: float = 0.05, screen: float = 4.0, least: int = 5) -> OrdinalModel:
        """Adam on the negative log likelihood of texts with these ``Features``; grades weigh by the root of their rarity.

        Words get a weight if they stand in ``least`` texts or more and the mean grade of those texts is
        ``screen`` standard errors off the mean of all, or more.
        """
        n, y = len(features), np.array(grades)
        row, col = np.repeat(np.arange(n), [len(w) for w, _ in features]), np.concatenate([w for w, _ in features])
        x = np.array([np.sqrt(s / max(1, s.sum())) for _, s in features], np.float32)
        number = np.bincount(col, minlength=WORDS)
        lean = np.abs(np.bincount(col, (y - y.mean())[row], WORDS))
        used = np.flatnonzero((number >= least) & (lean > screen * max(y.std(), 1e-9) * np.sqrt(number)))
        at = np.full(WORDS, -1)
        at[used] = np.arange(len(used))
        keep = at[col] >= 0
        row, col = row[keep], at[col[keep]]
        count = np.maximum(np.bincount(y, minlength=levels), 1)
        weight = np.sqrt(n / (levels * count))[y]
        weight /= weight.mean()
        share = np.clip(np.cumsum(count)[:-1] / n, 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
        p = {"w": np.zeros(len(used)), "s": np.zeros(SHAPES), "first": start[:1].copy(), "gap": np.log(np.maximum(np.diff(start), 1e-2))}
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        for t in range(1, rounds + 1):
            theta = np.r_[p["first"], p["first"] + np.cumsum(np.exp(p["gap"]))]
            eta = np.bincount(row, p["w"][col], n) + x @ p["s"]
            edge = np.c_[np.full(n, -np.inf), np.broadcast_to(theta, (n, levels - 1)), np.full(n, np.inf)]
            high, low = logistic(edge[np.arange(n), y + 1] - eta), logistic(edge[np.arange(n), y] - eta)
            prob = np.maximum(high - low, 1e-9)
            dh, dl = high * (1 - high) / prob, low * (1 - low) / prob
            d_eta = weight * (dh - dl) / n
            d_theta = np.zeros(levels + 1)
            np.add.at(d_theta, y + 1, -weight * dh / n)
            np.add.at(d_theta, y, weight * dl / n)
            d_theta = d_theta[1:-1]
            after = np.cumsum(d_theta[::-1])[::-1]
            grad = {"w": np.bincount(col, d_eta[row], len(used)), "s": x.T @ d_eta, "first": after[:1], "gap": after[1:] * np.exp(p["gap"])}
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
            p["w"] *= 1 - rate * 0.01
            p["s"] *= 1 - rate * 0.01
        words = np.zeros(WORDS)
        words[used] = p["w"]
        return cls(words, p["s"], np.r_[p["first"], p["first"] + np.cumsum(np.exp(p["gap"]))])


class Scorer:
    """Scores of texts under a model; keeps the parts of at most ``keep`` tokens."""

    def __init__(self, model: OrdinalModel):
        self.model, self.feature = model, Features()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            w, s = self.feature(text)
            out[i] = self.model.words[w].sum() + np.sqrt(s / max(1, s.sum())) @ self.model.shapes
        return out


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: toxic; 1: neither toxic nor good; 2: good."""
    return F.when(toxic == 1, 0).when(quality == 1, 2).otherwise(1)


def rate_quality(
    docs: DataFrame,
    ratings: DataFrame,
    levels: int = 3,
    text_col: str = "text",
    id_col: str = "doc_id",
    most_rated: int = 6000,
    keep_from: int = 1,
    keep_tail: float = 0.5,
) -> DataFrame:
    """One row per document: ``id_col, expected_grade, tails, grade, kept``.

    ratings: ``id, grade`` with grades 0 to levels - 1; rows with a null in either are left out, and several ratings of a
    document each count. tails: P(grade >= 1), P(grade >= 2), ...; expected_grade is their sum, grade the
    number of tails of 1/2 and more. kept: P(grade >= keep_from) is at least ``keep_tail``. The model is fitted on at most
    about ``most_rated`` rated texts, picked by a hash of the id: the documented bound of the sample. Every text is
    scored whole. Null and empty texts have no feature and get the score 0, between the thresholds as they lie. With no rating at all the
    outputs are null and everything is kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rated = ratings.toDF("id", "grade").filter(f"id is not null and grade between 0 and {levels - 1}")
    total = rated.count()
    share = int(min(1.0, most_rated / max(total, 1)) * (1 << 30))
    # at most most_rated rows and a few: small enough to be sent to every task
    picked = F.broadcast(rated.filter(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(1 << 30)) < share).limit(2 * most_rated))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").join(picked, "id").select("text", "grade")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature = Features()
        for b in batches:
            found = [feature(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("grade").cast(pa.int32()), pa.array([w.astype(np.int32) for w, _ in found], pa.list_(pa.int32())), pa.array([s.astype(np.int32) for _, s in found], pa.list_(pa.int32()))],
                names=["grade", "words", "shapes"],
            )

    # the driver gets distinct words as numbers, never texts; in an order of their own, so that the fit is the same in every run
    rows = sample.mapInArrow(features, "grade int, words array<int>, shapes array<int>").limit(4 * most_rated).toArrow()
    rows = sorted(zip(*(rows.column(c) for c in ("grade", "words", "shapes")), strict=True), key=lambda r: (r[0].as_py(), r[1].values.to_numpy().tobytes(), r[2].values.to_numpy().tobytes()))
    kind = dict(docs.dtypes)[id_col]
    shape = f"`{id_col}` {kind}, expected_grade double, tails array<double>, grade int, kept boolean"
    model = OrdinalModel.fit([(w.values.to_numpy(), s.values.to_numpy()) for _, w, s in rows], [g.as_py() for g, _, _ in rows], levels) if rows else None
    # arrays only, so that tasks need no copy of this package
    sent = spark.sparkContext.broadcast(model and (model.words.astype(np.float32), model.shapes, model.thresholds))
    del rows, model

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(OrdinalModel(*sent.value)) if sent.value is not None else None
        for b in batches:
            n = b.num_rows
            if scorer is None:
                made = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int32()), pa.array([True] * n, pa.bool_())]
            else:
                tails = scorer.model.tails(scorer([t.as_py() for t in b.column(text_col)]))
                made = [
                    pa.array(tails.sum(1)),
                    pa.array(list(tails), pa.list_(pa.float64())),
                    pa.array((tails >= 0.5).sum(1).astype(np.int32)),
                    pa.array(tails[:, keep_from - 1] >= keep_tail),
                ]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *made], names=[id_col, "expected_grade", "tails", "grade", "kept"])

    return docs.select(id_col, text_col).mapInArrow(rate, shape)
