"""Readers and writers: what is written comes back, and again after another write."""

import json

import pytest
from pyspark.sql import functions as F

from sparkpulse.operators import medallion, quality, rolling, text
from sparkpulse.sources import io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_with_a_header_and_a_schema_or_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\n2,\n')
    assert rows(io.read_csv(spark, str(tmp_path), "id int, name string")) == [(1, "x, y"), (2, None)]
    assert rows(io.read_csv(spark, str(tmp_path))) == [("1", "x, y"), ("2", None)]
    assert rows(io.read_csv(spark, str(tmp_path), "a string, b string", header=False))[2] == ("id", "name")


def test_a_malformed_row_fails_the_copy(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\nx,3\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        io.copy_into(spark, str(tmp_path), "id int, v int").collect()


def test_json_lines_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": null}\n')
    df = io.read_json_lines(spark, str(tmp_path / "in"), "a int, b struct<c:string>")
    assert rows(df.select("a", "b.c")) == [(1, "x"), (None, None)]
    for _ in range(2):
        io.export_json(df, str(tmp_path / "out"))
    assert sorted(json.loads(x).get("a", 0) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()) == [0, 1]


def test_a_json_stream_has_the_given_schema(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k": 1, "v": "x"}\n{"k": 2}\n')
    df = io.read_json_stream(spark, str(tmp_path / "in"), "k long, v string")
    assert df.isStreaming
    df.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("streamed")) == [(1, "x"), (2, None)]


def test_only_partitions_at_hand_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], "id int, plant string, day int")
    io.write_partitioned(df, str(tmp_path), ["plant", "day"])
    io.write_partitioned(df.where("id = 2").withColumn("id", F.lit(9)), str(tmp_path), ["plant", "day"])
    assert rows(io.read_parquet(spark, str(tmp_path)).select("id", "plant", "day")) == [(1, "a", 1), (3, "b", 1), (9, "a", 2)]
    assert not [f for f in tmp_path.rglob("*.parquet") if ".snappy." not in f.name]


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_text_goes_to_folders_by_hour(spark, tmp_path, kind):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-03-05 07:30:00' AS ts UNION ALL SELECT 2, TIMESTAMP '2024-03-05 08:00:00'")
    io.write_text_by_hour(df, str(tmp_path), "ts", kind)
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.glob("*/*/*/*")} == {"year=2024/month=03/day=05/hour=07", "year=2024/month=03/day=05/hour=08"}


def test_a_table_is_made_overwritten_from_itself_and_read_back(spark):
    spark.sql("DROP TABLE IF EXISTS made")
    io.create_table_as(spark.range(6).select("id", (F.col("id") % 2).alias("part")), "made", ["part"])
    assert spark.table("made").where("part = 1").count() == 3
    back = io.overwrite_table(spark.table("made").where("id > 1").select((F.col("id") * 10).alias("id"), "part"), "made", ["part"])
    assert rows(back) == [(20, 0), (30, 1), (40, 0), (50, 1)]
    assert rows(io.overwrite_table(spark.table("made").where("id < 0"), "made")) == []


def test_truncate_and_insert_keeps_surrogate_keys(spark):
    spark.sql("DROP TABLE IF EXISTS gold")
    spark.sql("CREATE TABLE gold (surrogate_key BIGINT, k INT, v STRING, created_at TIMESTAMP) USING parquet")
    keys = []
    for v in ("x", "y"):
        io.truncate_insert(spark.createDataFrame([(1, v), (2, v)], "k int, v string"), "gold", ["k"])
        keys.append(sorted(r.surrogate_key for r in spark.table("gold").collect()))
    assert keys[0] == keys[1] and rows(spark.table("gold").select("k", "v")) == [(1, "y"), (2, "y")] and spark.table("gold").where("created_at IS NULL").isEmpty()


def test_temporary_tables_go(spark):
    with io.Temporary() as temporary:
        df = temporary.stored(spark.range(3), "gone")
        files = df.inputFiles()
        assert df.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_bronze_rows_have_their_time_of_ingestion(spark):
    got = medallion.with_ingestion_time(spark.range(2), "loaded").first()
    assert got.loaded is not None and medallion.with_ingestion_time(spark.range(0)).columns == ["id", "ingestion_ts"]


def test_first_rows_and_the_verdict_of_a_suite(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "b"), (1, "a")], "k int, v string")
    assert [tuple(r) for r in rolling.first_n(df.repartition(3), 3, ["k", "v"]).collect()] == [(1, "a"), (1, "b"), (2, "b")]
    assert tuple(quality.overall(quality.validate(df, [])).first()) == (True, 0, 0)
    assert tuple(quality.overall(quality.validate(df, [quality.not_null("k"), quality.unique("k")])).first()) == (False, 2, 1)


def test_strongest_words_of_a_classifier(spark):
    df = spark.createDataFrame([(f"good nice {w}" if k % 2 else f"bad awful {w}", float(k % 2)) for k in range(40) for w in ("thing",)], "text string, y double")
    got = {r.word: r.weight for r in text.strongest_words(text.text_classifier(df, "text", "y"), 1).collect()}
    assert len(got) == 2 and max(got, key=got.get) in ("good", "nice") and min(got, key=got.get) in ("bad", "awful")


def test_briefs_join_news_in_order(spark):
    market = spark.createDataFrame([("abc", 1.5, 70.5, 95, "15%"), ("xyz", 2.0, None, 60, None), (None, 1.0, 1.0, 1, "x")], "ticker string, price double, pe double, score int, growth string")
    news = spark.createDataFrame([("ABC", 2, "second"), ("abc", 1, "first"), ("zzz", 1, "unknown"), ("abc", 3, None), (None, 1, "none")], "ticker string, day int, title string")
    got = {r.ticker: r for r in text.entity_brief(market, news, "ticker", "price", "pe", "score", ["growth"], "title", "day").collect()}
    assert set(got) == {"ABC", "XYZ"} and got["ABC"].price_text == "ABC Current Price: $1.5 (P/E: 70.5)" and got["ABC"].news == "first | second"
    assert got["XYZ"].news == "No recent news available." and got["ABC"].metrics.growth == "15%" and (got["ABC"].tier, got["XYZ"].tier) == ("HIGH", "MODERATE")
