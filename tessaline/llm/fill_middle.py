"""Fill-in-the-middle transformation: a text's units are cut in three, and the middle goes last.

Units are the matches of a pattern, lines at first. The tokenizers library's Split pre-tokenizer isolates them and gives their
code point offsets, without any training: the number of offsets is the number of units n, and offsets at two
drawn ranks are where prefix and middle end. Python sees the text and returns these three numbers; hashes, draws, slices and the
joined output are expressions of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")  # fixed values: what stands before prefix, suffix and middle
CUTS = "n long, first long, second long"


def draw(id_: Column, seed: int, k: int) -> Column:
    """The ``k``-th group of 8 hex digits, from 1, of the SHA-256 of seed, colon and id (``null`` for none), as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def cutter(pattern: str):
    """Pandas UDF: text and two draws -> n and the code points before the smaller and the larger of the draws modulo n + 1."""

    @F.pandas_udf(CUTS)
    def cut(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        units = Split(Regex(pattern), "isolated")
        for texts, h1, h2 in columns:
            out = np.zeros((len(texts), 3), np.int64)
            for i, (text, x, y) in enumerate(zip(texts, h1, h2, strict=True)):
                if text:
                    ends = np.array([0, *(end for _, (_, end) in units.pre_tokenize_str(text))])
                    n = len(ends) - 1
                    out[i] = n, *ends[sorted((x % (n + 1), y % (n + 1)))]
            yield pd.DataFrame(out, columns=["n", "first", "second"])

    return cut


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The whole text again, from what ``fill_in_middle`` made of it and its form."""
    before, after, last = marks

    def parts(opening: str, mark: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(opening) + 1), F.length(output))
        one = F.substring_index(body, mark, 1)
        rest = F.substring(body, F.length(one) + len(mark) + 1, F.length(body))
        two = F.substring_index(rest, last, 1)
        return one, two, F.substring(rest, F.length(two) + len(last) + 1, F.length(rest))

    prefix, suffix, middle = parts(before, after)
    suffix_, prefix_, middle_ = parts(after, before)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    pattern: str = LINES,
    marks: tuple[str, str, str] = MARKS,
    percent: int = 100,
    spm_percent: int = 50,
    seed: int = 7,
) -> DataFrame:
    """One row per document: ``id_col, n, form, prefix_chars, middle_chars, output``.

    n: matches of ``pattern`` in the whole text, which must cover it. Prefix and middle end after as many units as the smaller and the larger of two
    draws modulo n + 1 say; the rest is the suffix, and each of the three may be empty. form: ``psm`` (prefix, suffix, middle, each after its
    mark), ``spm`` (suffix, prefix, middle), or ``plain``, the text as it is: where it is empty, holds a mark, or is none of the ``percent``
    drawn. prefix_chars and middle_chars count code points, null if plain. Null texts are as empty ones. Draws hang on the id alone,
    so rows of one id are cut at like ranks, and rows without id as if it were ``null``. Very long texts are cut whole. No rows give
    none. Other columns are not read. No shuffle.
    """
    text, before = F.col("text"), dict(zip("psm", marks, strict=True))
    h1, h2, h3, h4 = (draw(F.col("id"), seed, k) for k in (1, 2, 3, 4))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (h3 % 100 >= percent)
    cut = rows.withColumn("cut", cutter(pattern)(text, h1, h2)).withColumn(
        "form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    )
    prefix = F.substring(text, F.lit(1), F.col("cut.first").cast("int"))
    middle = F.substring(text, (F.col("cut.first") + 1).cast("int"), (F.col("cut.second") - F.col("cut.first")).cast("int"))
    suffix = F.substring(text, (F.col("cut.second") + 1).cast("int"), F.length(text))
    p, s, m = F.concat(F.lit(before["p"]), prefix), F.concat(F.lit(before["s"]), suffix), F.concat(F.lit(before["m"]), middle)
    turned = F.col("form") != "plain"
    return cut.select(
        F.col("id").alias(id_col),
        F.col("cut.n").alias("n"),
        "form",
        F.when(turned, F.col("cut.first")).alias("prefix_chars"),
        F.when(turned, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(text).alias("output"),
    )
