"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessaline.checks import more, whole  # noqa: F401
from tessaline.checks.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = ["agg1_feature_summary", "fx12_master_table", "win5_hampel_native", "bnd2_pseudo_candidates", "bnd5_matches", "nrm4_parameters_real", "cp4_binseg_l2_real", "cal6_benjamini_hochberg", "cal7_holm", "sc11_stable_hash", "src5_file_names", "str1_event_windows", "fx10_sample_entropy", "jn16_peaks_in_windows", "src2_natural_sort", "agg28_duplicated_rows", "rep3_covariances"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")


def rows(frame):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else v if isinstance(v, str) else str(bool(v)) if str(type(v).__name__) in ("bool", "bool_") else str(v) if hasattr(v, "year") else round(float(v), 5)
    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "orders", "customer", "part"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE[name]).df())


def test_entry_imports_without_the_corpus_package(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("tessaline.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "tessaline.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.corpus is None and "agg1_feature_summary" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
    monkeypatch.delitem(sys.modules, "__spark_entry__")
