"""Chroma audio fingerprints and their alignment.

A recording becomes frames of 12 pitch classes. Sixteen rectangle filters, evaluated on an integral
image of these frames, compare neighbouring times or pitches; each comparison is quantised to two
bits of a Gray code, and the 32 bits of a frame make one packed integer.

Two recordings are aligned by the integers they share: each shared one votes for the offset
between them, the histogram of votes gives the offset, and the share of differing bits at that offset decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import settle

FRAME, HOP, SPAN = 1024, 256, 16
LOW_HZ, HIGH_HZ = 60.0, 1900.0
STEP = 0.25  # quantiser thresholds at -STEP, 0 and STEP of the log ratio
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width): each kind at four places, wide ones for tall rectangles."""
    return [(kind, 3 * place, 12 - 3 * place if kind == 1 else 4 + 2 * (place % 2), (4, 8, 12, 16)[(kind + place) % 4]) for kind in range(4) for place in range(4)]


FILTERS = filters()


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """[frame, 12]: smoothed and normalised energy of the pitch classes."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    at = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(at * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.rint(12 * np.log2(hz[use] / 440)).astype(int) % 12
    energy = power[:, use] @ np.eye(12, dtype=np.float32)[pitch]
    if len(energy) >= 5:
        taps = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
        energy = sum(w * energy[k : len(energy) - 4 + k] for k, w in enumerate(taps))
    norm = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0.0)


def packed(frames: np.ndarray) -> np.ndarray:
    """Packed integers, one for each run of SPAN frames."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    # pitch classes are a circle: the image is repeated so that rectangles may reach round it
    image = np.zeros((len(frames) + 1, 25))
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([frames, frames], 1), 0), 1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        half_t, half_y = w // 2, h // 2
        if kind == 0:  # earlier against later
            a, b = area(0, half_t, y, y + h), area(half_t, w, y, y + h)
        elif kind == 1:  # lower against higher
            a, b = area(0, w, y, y + half_y), area(0, w, y + half_y, y + h)
        elif kind == 2:  # diagonals
            a = area(0, half_t, y, y + half_y) + area(half_t, w, y + half_y, y + h)
            b = area(half_t, w, y, y + half_y) + area(0, half_t, y + half_y, y + h)
        else:  # middle against both ends in time
            third = w // 4
            a = area(third, w - third, y, y + h)
            b = area(0, third, y, y + h) + area(w - third, w, y, y + h)
        value = np.log((a + 0.5) / (b + 0.5))
        out = (out << np.uint32(2)) | GRAY[np.digitize(value, (-STEP, 0.0, STEP))]
    return out.view(np.int32)


def pcm16(value: bytes) -> np.ndarray:
    """Samples of little-endian 16-bit mono PCM."""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2") / 32768


def fingerprints(media: DataFrame, id_col: str, media_col: str, rate: int, decode: Callable[[object], np.ndarray] = pcm16) -> DataFrame:
    """``id_col, prints array<int>`` of each recording; ``decode`` turns a value of ``media_col`` into samples.

    Null values and recordings shorter than the filters' reach have an empty array. One pass, no shuffle; a
    recording is held as a whole by the task that reads it.
    """
    kind = dict(media.dtypes)[id_col]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [packed(chroma(decode(v), rate)) if v is not None else np.zeros(0, np.int32) for v in (x.as_py() for x in b.column(media_col))]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(rows, pa.list_(pa.int32()))], names=[id_col, "prints"])

    return media.select(id_col, media_col).mapInArrow(compute, f"`{id_col}` {kind}, prints array<int>")


def align(prints: DataFrame, id_col: str, is_query: F.Column, most_error: float = 0.1, least_overlap: int = 16) -> DataFrame:
    """One row per recording: ``id_col, class_id, is_query, n_matches, matches``.

    Recordings with equal prints form a class; class_id is its smallest id, and copies are not paired. matches
    lists, for recordings that ``is_query`` holds for, the other classes that align with it as
    ``(class_id, offset, votes, bit_error)``, best first: bit errors of at most ``most_error`` over an overlap of
    ``least_overlap`` integers or half the shorter recording, whichever is less. An empty print is in a class with all other
    empty ones and matches nothing. Null ids get no class and no match. Ties of votes go to the smaller offset.

    Every integer votes, however many classes hold it. A stretch of equal integers, as silence gives, votes once, with
    its first place. Only queries stand on one side of the join, so the votes grow with their number times that of the recordings
    that share an integer with them; a much shared one is a skewed key of an inner join, whose two sides Spark deals anew.
    """
    rows = settle(prints.select(F.col(id_col).alias("id"), "prints", F.coalesce(is_query, F.lit(False)).alias("q"), F.xxhash64("prints").alias("node")), "audio-prints")
    kind = dict(rows.dtypes)["id"]
    classes = settle(
        rows.filter("id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.max("q").alias("q"), F.first("prints").alias("prints")), "audio-classes"
    )
    keys = (
        classes.select("node", "q", F.posexplode(F.arrays_zip("prints", F.concat(F.array(F.lit(None).cast("int")), F.slice("prints", 1, F.greatest(F.size("prints") - 1, F.lit(0)))).alias("last"))).alias("at", "x"))
        .filter(F.col("x.last").isNull() | (F.col("x.prints") != F.col("x.last")))
        .select("node", "q", "at", F.col("x.prints").alias("key"))
    )
    other = keys.select("key", F.col("node").alias("other"), F.col("at").alias("at_other"))
    votes = keys.filter("q").select("key", "node", "at").join(other, "key").filter("node <> other").groupBy("node", "other", (F.col("at_other") - F.col("at")).alias("offset")).agg(F.count("*").alias("votes"))
    best = (
        votes.groupBy("node", "other")
        .agg(F.max(F.struct(F.col("votes"), (-F.col("offset")).alias("back"))).alias("x"))
        .select("node", "other", "x.votes", (-F.col("x.back")).alias("offset"))
    )
    of = lambda n, *more: classes.select(F.col("node").alias(n), F.col("prints").alias(f"p_{n}"), *more)
    pair = best.join(of("node"), "node").join(of("other", F.col("rep").alias("class_id")), "other")
    begin, begin_other = F.greatest(F.lit(0), -F.col("offset")), F.greatest(F.lit(0), F.col("offset"))
    overlap = F.least(F.size("p_node") - begin, F.size("p_other") - begin_other)
    # bit_count takes 64 bits: a negative integer's sign must not count as 32 more
    bits = F.aggregate(
        F.zip_with(F.slice("p_node", begin + 1, overlap), F.slice("p_other", begin_other + 1, overlap), lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))),
        F.lit(0),
        lambda s, x: s + x,
    )
    enough = F.least(F.lit(least_overlap), F.ceil(F.least(F.size("p_node"), F.size("p_other")) / 2))
    matched = (
        pair.withColumn("overlap", overlap)
        .filter(F.col("overlap") >= enough)
        .withColumn("bit_error", bits / (F.col("overlap") * 32.0))
        .filter(F.col("bit_error") <= most_error)
        .groupBy("node")
        .agg(F.array_sort(F.collect_list(F.struct("bit_error", "class_id", "offset", "votes"))).alias("found"))
    )
    shape = f"array<struct<class_id:{kind},offset:int,votes:bigint,bit_error:double>>"
    listed = matched.select("node", F.transform("found", lambda m: F.struct(m["class_id"].alias("class_id"), m["offset"].alias("offset"), m["votes"].alias("votes"), m["bit_error"].alias("bit_error"))).cast(shape).alias("matches"))
    none = F.array().cast(shape)
    member = rows.select("id", "q", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    return (
        member.join(classes.select("node", F.col("rep").alias("class_id")).join(listed, "node", "left"), "node", "left")
        .withColumn("matches", F.when(F.col("q"), F.coalesce("matches", none)).otherwise(none))
        .select(F.col("id").alias(id_col), "class_id", F.col("q").alias("is_query"), F.size("matches").alias("n_matches"), "matches")
    )


def melody(vector: list[float] | None, rate: int = 4000, step: int = 256) -> np.ndarray:
    """A vector played as a melody: each value is a note of two octaves, by how far it is from 0.

    The synthetic tables hold no audio, so this stands in for decoding a media column.
    """
    v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in (() if vector is None else vector)])
    if not len(v):
        return np.zeros(0)
    z = v / max(float(np.sqrt((v**2).mean())), 1e-12)
    note = 48 + np.rint(24 / (1 + np.exp(-1.7 * z)))
    hz = np.repeat(440 * 2 ** ((note - 69) / 12), step)
    phase = 2 * np.pi * np.cumsum(hz) / rate
    return 0.5 * np.sin(phase) + 0.2 * np.sin(2 * phase)


def excerpt(vector: list[float] | None, rate: int = 4000, step: int = 256, cut: int = 3, noise: float = 0.05) -> np.ndarray:
    """What a listener records of a vector's melody: ``cut`` hops late, with noise that the vector itself seeds."""
    samples = melody(vector, rate, step)[cut * HOP :]
    seed = int(np.abs(np.nan_to_num(np.array([x or 0.0 for x in (() if vector is None else vector)]))).sum() * 1e6) % (1 << 31)
    return samples + noise * np.random.Generator(np.random.PCG64(seed)).standard_normal(len(samples))
