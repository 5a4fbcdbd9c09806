"""URL filters by a sort-merge range join of reversed-host keys with nested rules.

A host's key is its labels in reverse order, each ended by a mark: ``net<mark>example<mark>``.
All keys under a rule's host begin with the rule's key, so a rule covers one interval of
keys. Pages and rules are sorted by key and swept once; a stack holds the rules whose interval
is open. Intervals nest, so the stack is a chain of ever longer hosts.

Pages are dealt into key ranges. A host with many pages is dealt over several ranges by page id, and
a rule is sent to each range that its interval meets, so every range is swept alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
BEYOND = "\U0010ffff"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one. No pattern: some of Java's recurse once a character and end the executor on a very long url."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def _upto(text: Column, marks: str) -> Column:
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_upto(_after_scheme(url), "/?#"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    rest = _after_scheme(url)
    return _upto(F.substring(rest, F.length(_upto(rest, "/?#")) + 1, F.length(rest)), "?#")


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK))


def host_key(host: str) -> str:
    return MARK.join(reversed(host.split("."))) + MARK


class Sweep:
    """Stack of the open rules over keys that come in ascending order."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        """rules: (key, path, name, verdict), in order of keys."""
        self.rules, self.next, self.stack = rules, 0, []

    def at(self, key: str) -> list[tuple[str, dict, list[int]]]:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        while self.next < len(self.rules) and self.rules[self.next][0] <= key:
            own, path, name, verdict = self.rules[self.next]
            self.next += 1
            if key.startswith(own):
                if not self.stack or self.stack[-1][0] != own:
                    self.stack.append((own, {}, []))
                paths = self.stack[-1][1]
                if path not in paths:
                    paths[path] = (name, verdict)
                    self.stack[-1][2][:] = sorted({len(p) for p in paths})
        return self.stack

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule; of equally long ones that with the longer host."""
        best = None
        for _, paths, lengths in self.at(key):
            for n in reversed(lengths):
                if n <= len(path) and (hit := paths.get(path[:n])):
                    if best is None or len(hit[0]) >= len(best[0]):
                        best = hit
                    break
        return best


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    url_col: str = "url",
    id_col: str = "page_id",
    default: str = "allow",
    rows_per_range: int = 200_000,
    ranges: int | None = None,
    most_sampled: int = 100_000,
) -> DataFrame:
    """One row per page: ``id_col, host, path, rule, verdict``.

    rules: (host, path, verdict), as a list or a DataFrame with these columns. A rule fits its
    host and all subdomains where the path begins with the rule's path; the longest rule (host
    and path together) wins, then the longer host, then the smaller verdict. Where none fits, rule is null and
    the verdict is ``default``. A null url, or one without ``://``, has an empty host and path. Urls may be of any length.
    Repeated pages and ids are judged row by row. Empty pages or rules are fine. Other columns are not read.

    Only a sample of keys comes to the driver, 50 a range and at most ``most_sampled``; it
    decides where ranges end, never what is judged. Each range is one task, which reads it as a stream.
    """
    spark = pages.sparkSession
    schema = "rule_host string, rule_path string, rule_verdict string"
    if isinstance(rules, DataFrame):
        listed = rules.toDF("rule_host", "rule_path", "rule_verdict")
    else:
        listed = spark.createDataFrame(rules, schema)
    listed = listed.filter("rule_host is not null").distinct()
    host = host_of(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path_of(F.col(url_col)).alias("path")).withColumn(
        "key", key_of(F.col("host"))
    )
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, -(-pages.count() // rows_per_range))
    salt = F.lpad(F.hex(F.pmod(F.xxhash64("id"), F.lit(1 << 20))), 5, "0")
    sample = (
        keyed.select("key", salt.alias("salt"), F.xxhash64("id", "key").alias("h")).orderBy("h").limit(min(50 * ranges, most_sampled)).collect()
    )
    points = sorted((r["key"], r["salt"]) for r in sample)
    bounds = sorted({points[i * len(points) // ranges] for i in range(1, ranges)}) if points else []
    flat = [k + "\x00" + s for k, s in bounds]  # sorts like the pairs: the mark is larger than \x00

    id_type = dict(keyed.dtypes)["id"]
    out = f"id {id_type}, host string, path string, key string, verdict string, name string, range int, kind int"

    def deal_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(flat, object)
        for b in batches:
            place = np.array([k + "\x00" + s for k, s in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)], object)
            at = np.searchsorted(edges, place, "right") if len(place) else np.array([], np.int64)
            null = pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("path"), b.column("key"), null, null, pa.array(at.astype(np.int32)), pa.array(np.ones(b.num_rows, np.int32))],
                names=["id", "host", "path", "key", "verdict", "name", "range", "kind"],
            )

    def deal_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(flat, object)
        for b in batches:
            rows = []
            for h, p, v in zip(*(b.column(c).to_pylist() for c in ("rule_host", "rule_path", "rule_verdict")), strict=True):
                key = host_key(h)
                first, last = np.searchsorted(edges, [key, key + BEYOND]) if flat else (0, 0)
                # a key equal to an edge's may have pages before that edge
                rows += [(h, p or "", key, v or "", h + (p or ""), int(r)) for r in range(int(first), int(last) + 1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string()] * 5 + [pa.int32()]
            got = [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(rows), schema_id), *got, pa.array([0] * len(rows), pa.int32())],
                names=["id", "host", "path", "key", "verdict", "name", "range", "kind"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    schema_id = to_arrow_type(keyed.schema["id"].dataType)
    both = keyed.withColumn("salt", salt).mapInArrow(deal_pages, out).unionByName(listed.mapInArrow(deal_rules, out))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rules_here, open_ = None, [], None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("key", "path", "verdict", "name", "range", "kind")}
            keep, names, verdicts = [], [], []
            for i in range(b.num_rows):
                if cols["range"][i] != current:
                    current, rules_here, open_ = cols["range"][i], [], None
                if cols["kind"][i] == 0:
                    rules_here.append((cols["key"][i], cols["path"][i], cols["name"][i], cols["verdict"][i]))
                    open_ = None
                    continue
                if open_ is None:
                    open_ = Sweep(rules_here)
                hit = open_.judge(cols["key"][i], cols["path"][i])
                keep.append(i)
                names.append(hit[0] if hit else None)
                verdicts.append(hit[1] if hit else default)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("host").take(at), b.column("path").take(at), pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    # within a range the rules come first, then the pages, each in order of keys
    return (
        both.repartitionById(ranges, F.col("range"))
        .sortWithinPartitions("range", "kind", "key", "verdict")
        .mapInArrow(sweep, f"id {id_type}, host string, path string, rule string, verdict string")
        .withColumnRenamed("id", id_col)
    )
