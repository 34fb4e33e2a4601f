import json

import pytest
from pyspark.sql import functions as F

from leafloom.sources import records, sinks, tables
from leafloom.streaming import incremental


def test_jsonl_sources(spark, tmp_path, rows):
    p = tmp_path / "x.jsonl"
    p.write_text('{"idx": 1, "v": "a"}\n{"idx": 1, "v": "b"}\n{"idx": 2, "v"\n{"v": "no key"}\n')
    good, bad = records.good_and_bad(records.jsonl(spark, str(p), "idx bigint, v string", strict=False).cache())
    assert good.count() == 3 and bad.count() == 1
    with pytest.raises(Exception):
        records.jsonl(spark, str(p), "idx bigint, v string").collect()
    assert rows(records.last_records(spark, str(p), "idx bigint, v string", "idx")) == [(1, "b")]
    assert rows(records.done_keys(spark, str(p), "idx")) == [(1,)]
    c = tmp_path / "s.csv"
    c.write_text('leaf,verdict\nl1," Equivalent "\nl2,\nl3,other\n')
    assert [r.leaf for r in records.label_sheet(spark, str(c), ("equivalent",)).collect()] == ["l1"]
    assert records.state(str(tmp_path / "none.json")) == {}
    b = tmp_path / "b.jsonl"
    ok = {"status_code": 200, "body": {"choices": [{"message": {"content": "hi"}}]}}
    b.write_text("\n".join(json.dumps(x) for x in (
        {"custom_id": "t::0", "response": ok}, {"custom_id": "t::9", "response": ok}, {"custom_id": "t::1", "error": "e", "response": ok}, {"custom_id": "t::x", "response": ok}, {"custom_id": "t::2", "response": {"status_code": 500}})))
    assert rows(records.batch_results(spark, str(b), 5)) == [(0, "hi")]


def test_tables(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert tables.tolerant_table(spark, str(tmp_path), "t", {"id": "bigint", "x": "string"}).first().x is None
    df = tables.table(spark, str(tmp_path), "t", ["id"])
    assert tables.guarded(df, 3).count() == 3 and tables.not_empty(df) is df
    for f in (lambda: tables.guarded(df, 4), lambda: tables.not_empty(df.limit(0)), lambda: tables.split_table({})):
        with pytest.raises(ValueError):
            f()
    both = tables.split_table({"train": df, "test": df.withColumn("x", F.lit(1))})
    assert tables.one_split(both, "test").count() == 3 and both.filter("split = 'train' and x is null").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.5), ("overall", 1.0), ("a", None)], "g string, v double")
    assert sinks.markdown(df, "g", ("overall",)).splitlines()[2:] == ["| overall | 1.0000 |", "| a |  |", "| b | 0.5000 |"]
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(20), most=10)
    sinks.small_csv(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    sinks.label_sheet(df, str(tmp_path / "l"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "l")).columns == ["g", "v", "verdict"]
    sinks.parquet(df, str(tmp_path / "p"), ["g"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.jsonl(df, str(tmp_path / "j"))
    sinks.jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    sinks.requests(df.coalesce(1), str(tmp_path / "r"), rows_per_file=1)
    assert len(list((tmp_path / "r").glob("part-*"))) == 3
    with pytest.raises(ValueError):
        sinks.requests(df, str(tmp_path / "r"), most_bytes=1)
    assert sinks.row_files(df.select("g", F.lit("{}").alias("t")), str(tmp_path / "f"), "g", "t") == 3 and (tmp_path / "f" / "a.json").exists()


def test_incremental(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(src)
    run = lambda: incremental.process_new_files(spark, src, "k int, v string", lambda s: s.withColumn("n", F.length("v")), out, cp)
    run()
    run()
    assert spark.read.parquet(out).count() == 1
    spark.createDataFrame([(2, "bb")], "k int, v string").write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(out).count() == 2
    done = str(tmp_path / "done")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert incremental.append_missing(df, done, ["k"]) == 2 and incremental.append_missing(df, done, ["k"]) == 0
    paths = spark.createDataFrame([("x/checkpoint-9",), ("x/checkpoint-10",), ("x/other",)], "path string")
    assert incremental.latest_checkpoint(paths).first().path == "x/checkpoint-10"


def test_windows_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "e")
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as u union all select timestamp'2024-01-01 00:20:00', 'a' union all select timestamp'2024-01-01 02:00:00', 'a'")
    df.write.parquet(src)
    s = spark.readStream.schema("ts timestamp, u string").parquet(src)
    q = incremental.windowed_counts(s, "ts", "1 hour", "1 hour", ["u"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]
    d = incremental.deduplicated(s, ["u"], "ts").writeStream.format("memory").queryName("dd").trigger(availableNow=True).start()
    d.awaitTermination()
    assert spark.table("dd").count() == 1
    assert incremental.sessions(df, "ts", "30 minutes", ["u"]).count() == 2
