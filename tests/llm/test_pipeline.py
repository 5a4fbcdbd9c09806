import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, left = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    from tests.llm.test_operators import brute_components

    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        if name == "language":
            assert len(rows) >= 0.98 * len(left)
        if name == "near_duplicates":
            component, _ = brute_components(list(left.items()), percent=80)  # the stage's own threshold; 85 is that of op3's query alone
            assert {r["doc_id"] for r in rows} == {i for i, c in component.items() if i == c}
        if name == "decontamination":
            items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            leaked = {i for i, t in left.items() if any(x in " ".join(t.lower().split()) for x in items)}
            assert not leaked & {r["doc_id"] for r in rows} and len(rows) >= len(left) - len(leaked) - 2
        if name == "mix":
            assert {r["doc_id"] for r in rows} <= set(left) and len(rows) > 0.3 * len(left)
        if name == "shards":
            assert sorted(out.columns) == ["doc_id", "shard", "size", "slot", "text_crc32"] and len(rows) == docs.count()
        else:
            assert out.columns == columns
            left = {r["doc_id"]: r["text"] for r in rows}
            docs = spark.createDataFrame(rows, out.schema)


def odd_documents(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, base), (5, base), (5, "quite another text under the same number as the copy above it"), (7, base + " x"), (8, base + " x")]
    rows += [(None, base), (None, "a text without any number that is like no other text of these"), (None, None), (9, ""), (9, "")]
    rows += [(10, "equal rows that stand here twice over in the table"), (10, "equal rows that stand here twice over in the table")]
    return spark.createDataFrame([(i, t, "en", None if i == 8 else "s", len(t or ""), "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, size int")


def test_near_duplicate_stage_judges_rows(spark):
    import corpus_pipeline as p

    got = [(r["doc_id"], r["text"]) for r in p.drop_near_duplicates(spark, odd_documents(spark), "").collect()]
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    # 9 of 10 shingles are shared with the longer ones, so all of that group are one; of equal rows one stays; empty texts stay
    assert sorted(map(str, got)) == sorted(map(str, [(1, base), (5, "quite another text under the same number as the copy above it"), (None, "a text without any number that is like no other text of these"), (None, None), (9, ""), (9, ""), (10, "equal rows that stand here twice over in the table")]))


def test_leak_stage_judges_rows(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "equal rows that stand here twice over in the table")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_documents(spark)
    left = p.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert len(left) == docs.count() - 2 and not [r for r in left if r["doc_id"] == 10] and left[0].asDict().keys() == set(p.COLUMNS)


def test_mix_stage_takes_rows_without_id(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark)
    got = p.mix(spark, docs, str(tmp_path)).collect()
    texts = {r["text"] for r in docs.collect() if r["text"]}
    # two sources of 9 and 1 rows: the large one is taken once at most, the small one three times
    assert {r["text"] for r in got} <= texts and [r["doc_id"] for r in got].count(8) == 3
    nameless = p.mix(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), str(tmp_path)).collect()
    assert nameless and {r["doc_id"] for r in nameless} == {None} and {r["text"] for r in nameless} <= texts


def test_empty_input(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item of words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_documents(spark).limit(0)
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "shards" or out.columns == p.COLUMNS)


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The operators that send fitted models run where workers can't import the package."""
    import subprocess
    import sys
    import textwrap

    code = """
        import os, sys
        sys.path.insert(0, ROOT)  # of the driver alone
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from tessaline.llm import decontaminate, language_id, quality
        docs = spark.createDataFrame([(i, "plain words of text number %d here" % i, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
        print(language_id.identify_languages(docs, docs).count(), language_id.identify_languages(docs, docs).filter("lang_pred <> 'und'").count())
        bench = spark.createDataFrame([(1, "words of text number 3 here")], "item_id long, text string")
        print(decontaminate.find_leaks(docs, bench, fit_docs=20).count())
        print(quality.rate_quality(docs, spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, grade int")).filter("expected_grade is not null").count())
    """
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    file = tmp_path / "run.py"
    file.write_text(f"ROOT = {root!r}\n" + textwrap.dedent(code))
    out = subprocess.run([sys.executable, str(file)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split()[:2] == ["40", "40"] and out.stdout.split()[3] == "40"
