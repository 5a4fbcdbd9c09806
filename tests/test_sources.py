from pyspark.sql import functions as F

from tessaline.sources import sessions, sinks


def write(path, rows, header="Time_seconds,ECG_filtered"):
    path.write_text(header + "\n" + "\n".join(rows) + "\n")


def test_session_files(spark, tmp_path):
    good = [f"{i / 500},{i % 7}" for i in range(300)]
    good[10] = f"{10 / 500},"
    write(tmp_path / "A101_session1_A.csv", good)
    write(tmp_path / "A101_session2_A.csv", [f"{i},{i if i % 2 else ''}" for i in range(50)])
    write(tmp_path / "notes.csv", ["1,2"])
    samples, files = sessions.read_session_csvs(spark, str(tmp_path))
    status = {r["stem"]: (r["status"], r["LabelMismatch"]) for r in files.collect()}
    assert status["A101_session1_A"] == ("processed", False) and status["A101_session2_A"] == ("failed", True) and status["notes"][0] == "skipped_bad_filename"
    filled = samples.filter("i = 10").first()
    assert samples.count() == 300 and filled["x"] == (9 % 7 + 11 % 7) / 2


def test_master_keeps_na_condition(spark):
    raw = spark.createDataFrame([("1", "NA", "Non_Anxiety", "true", "1.5"), ("2", "", "Non_Anxiety", "1", "x"), ("3", None, "Anxiety", "1.0", "inf")], "Session string, ConditionCode string, Condition string, WindowValid string, SDNN string")
    got = sessions.coerce_master(raw, ["SDNN"], ["SDNN"]).orderBy("Session").collect()
    assert [(r["ConditionCode"], r["WindowValid"], r["SDNN"]) for r in got] == [("NA", True, 1.5), ("NA", True, None), ("A", False, None)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("k", F.col("id") % 2)
    sinks.write_partitioned(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 10
    sinks.export_csv(df, str(tmp_path / "c"), ["id"], single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 10
    assert sinks.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0
    assert sinks.file_digests(spark, str(tmp_path / "c")).count() >= 1


def test_plain_and_pruned_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("ConditionCode,P,Note\nNA,0.5,\nA,NA,x\n,,y\n")
    got = sessions.read_plain_csv(spark, str(tmp_path / "t.csv"), ["P", "absent"]).collect()
    assert [(r["ConditionCode"], r["P"], r["Note"]) for r in got] == [("NA", 0.5, ""), ("A", None, "x"), ("", None, "y")]
    assert sessions.read_columns(spark, str(tmp_path / "t.csv"), ["Note", "none", "P"]).columns == ["Note", "P"]


def test_parts_or_combined(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/all")
    (tmp_path / "parts").mkdir()
    assert sessions.read_parts(spark, f"{tmp_path}/parts", "*.parquet", f"{tmp_path}/all").count() == 5
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/parts/w30")
    assert sessions.read_parts(spark, f"{tmp_path}/parts", "*.parquet", f"{tmp_path}/all").count() == 3


def test_places_of_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    got = sorted((r["g"], r["k"], r["place"]) for r in sessions.placed(rows.repartition(7), ["g", "k"]).collect())
    assert [p for _, _, p in got] == list(range(1, 1001)) and sessions.placed(rows.limit(0), ["g"]).count() == 0
