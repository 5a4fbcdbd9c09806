"""Fill-in-the-middle against a plain version, round trips and odd input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessaline.llm import fill_middle

TEXTS = ["", None, "one line", "one line\n", "\n", "\n\n\n", "a\nb\nc", "ünïcode 漢字\n😀 two\r\nthree still three\n", "x <P> y\nz", "<S>", "ends with <M>", "<\nP>\n<", "tail <\n<S", "l\n" * 5000, "w" * 200_000]


def plain(doc, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_equals_plain_and_restores(spark, percent, spm):
    rows = [(i * 31 + k, t) for i, t in enumerate(TEXTS) for k in range(4)] + [(None, "no\nid\nhere\n"), (5, "same id\nother\ntext"), (5, "same id\nother\ntext")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, n string, cut int, form string").repartition(3)
    made = fill_middle.fill_in_middle(df, percent=percent, spm_percent=spm)
    got = made.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plain(i, t, percent=percent, spm=spm), t or "") for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in got), key=str) == want
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


def test_other_units_and_marks(spark):
    """Words as units, marks of other lengths, ids that are text."""
    df = spark.createDataFrame([("a", "some words to cut in three parts"), ("b", "with |pre| in it")], "doc_id string, text string")
    marks = ("|pre|", "|suffix|", "|mid|")
    made = fill_middle.fill_in_middle(df, pattern=r"\S+\s*|\s+", marks=marks)
    got = {r["doc_id"]: r for r in made.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()}
    assert (got["a"]["n"], got["a"]["again"]) == (7, "some words to cut in three parts") and got["a"]["form"] != "plain" and got["b"]["form"] == "plain"
