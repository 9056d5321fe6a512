from datetime import date, datetime, timedelta

from sucrogas.streaming import streams


def files_stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_weekly_means_and_spacing(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", datetime(2024, 1, 1) + timedelta(days=i), float(i)) for i in range(30)]
    spark.createDataFrame(rows[:15], "k string, t timestamp, v double").coalesce(1).write.parquet(f"{src}/0")
    spark.createDataFrame(rows[15:], "k string, t timestamp, v double").coalesce(1).write.parquet(f"{src}/1")
    s = spark.readStream.schema("k string, t timestamp, v double").parquet(f"{src}/*")
    q = streams.weekly_means(s, "k", "t", "v", "1 day").writeStream.format("memory").queryName("weeks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = {r.week_end: (r.n, r.mean) for r in spark.table("weeks").collect()}
    assert got[date(2024, 1, 7)] == (7, 3.0) and date(2024, 2, 4) not in got
    q = streams.spaced_events(s, "k", "t", 10).writeStream.format("memory").queryName("spaced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert sorted(r.t.day for r in spark.table("spaced").collect()) == [1, 11, 21]


def test_merge_each(spark, tmp_path):
    src, dim = str(tmp_path / "in"), str(tmp_path / "dim")
    spark.createDataFrame([("a", 1.0, date(2024, 1, 1))], "k string, x double, at date").coalesce(1).write.parquet(f"{src}/0")
    s = spark.readStream.schema("k string, x double, at date").parquet(f"{src}/*")
    streams.merge_each(s, dim, "k", ["x"], "at", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    spark.createDataFrame([("a", 2.0, date(2024, 3, 1))], "k string, x double, at date").coalesce(1).write.parquet(f"{src}/1")
    streams.merge_each(s, dim, "k", ["x"], "at", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.x, str(r.valid_to)) for r in spark.read.parquet(f"{dim}/1").collect()) == [(1.0, "2024-02-29"), (2.0, "9999-12-31")]
