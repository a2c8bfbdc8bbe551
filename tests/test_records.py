import hashlib
import json

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import text
from atlasmill.operators import sinks, validation
from atlasmill.sources import jsonl
from atlasmill.streaming import resume


def test_jsonl_lines_and_status(spark, tmp_path):
    folder = tmp_path / "law"
    folder.mkdir()
    (folder / "train.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n{"a": 2}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6")
    try:
        rows = jsonl.placed(jsonl.read_rows(spark, str(tmp_path))).orderBy("source_line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.source_line, r.status) for r in rows] == [(1, "ok"), (3, "not_an_object"), (4, "bad_json"), (5, "ok")]
    assert {(r.domain, r.split) for r in rows} == {("law", "train")}
    with pytest.raises(Exception, match="train.jsonl:3"):
        jsonl.required(jsonl.read_rows(spark, str(tmp_path)).where("status != 'bad_json'")).collect()


def test_text_functions(spark):
    d = spark.createDataFrame([("Straße \x1c X", 'a "q"'), (None, "b")], "p string, c string")
    got = d.select(text.normalized("p").alias("n"), text.sample_hash("p", "c").alias("h"), text.atomic_id("p", "c").alias("i")).collect()
    want = lambda *v: hashlib.sha256(json.dumps(v, ensure_ascii=False).encode()).hexdigest()
    assert tuple(got[0]) == ("strasse x", want("strasse x", 'a "q"'), want("Straße \x1c X", 'a "q"')) and tuple(got[1]) == (None, None, None)
    j = spark.createDataFrame([(x,) for x in ('{"a":1}', '{"a":1,"a":2}', '{"a":NaN}', "[1]", '{"a":1} x')], "j string")
    assert [r[0] for r in j.select(text.strict_json("j")).collect()] == ["ok", "duplicate_key", "not_finite", "not_an_object", "bad_json"]
    assert spark.range(1).select(text.redacted(F.lit("k sk-abcdefgh1234 z"))).first()[0] == "k [REDACTED] z"
    assert spark.range(1).select(text.similarity(F.lit("abcd"), F.lit("bcde"))).first()[0] == pytest.approx(0.75)


def test_validation(spark):
    d = spark.sql("SELECT 'x' AS s, array('a','b') AS ds, array(named_struct('domains', array('a','b'), 'confidence', 0.1D), named_struct('domains', array('b','c'), 'confidence', 0.9D)) AS cs, map('a', array('1','2'), 'b', array('3','4')) AS m, array('u', 'U ') AS same")
    v, u = validation, ["x", "a", "b", "c"]
    got = d.select(
        v.domains_fit(F.col("ds"), F.col("s"), u, 3), v.domains_fit(F.col("ds"), F.lit("a"), u, 3), v.domains_fit(F.lit(None).cast("array<string>"), F.col("s"), u, 3),
        v.combinations_fit(F.col("cs"), F.col("s"), u, 3), v.covers_domains(F.col("m"), F.col("ds"), 2), v.distinct_texts(F.col("same"), 2, 3),
        v.quote_inside(F.lit("b  c"), F.lit("a b c")), v.quote_inside(F.lit(" "), F.lit("a")), v.decisions_cover(F.array(F.lit("b"), F.lit("a")), F.col("ds")),
    ).first()
    assert tuple(got) == (True, False, False, True, True, False, True, False, True)
    assert [c.confidence for c in d.select(v.by_confidence(F.col("cs"))).first()[0]] == [0.9, 0.1]


def test_sinks_and_resume(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5, [1, 2]), (2, None, None)], "k long, x double, a array<int>")
    sinks.write_csv(d, str(tmp_path / "csv"))
    assert sorted(line for f in (tmp_path / "csv").glob("*.csv") for line in f.read_text().splitlines()[1:]) == ['1,0.5,"[1,2]"', "2,,"]
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(d.withColumn("x", F.lit(float("nan"))), str(tmp_path / "json"))
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(d.withColumn("y", F.array(F.struct(F.lit(float("inf")).alias("z")))), str(tmp_path / "json2"))
    sinks.write_jsonl(d, str(tmp_path / "json3"))
    assert spark.read.json(str(tmp_path / "json3")).count() == 2
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        d.select("k", "x").write.mode("append").parquet(src)
        resume.resume(spark.readStream.schema("k long, x double").parquet(src), out, "k", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_order_of_and_windowed_counts(spark, tmp_path):
    d = spark.sql("SELECT array(named_struct('type', 'b', 'n', 1), named_struct('type', 'a', 'n', 2)) AS r")
    assert [x.type for x in d.select(validation.in_order_of(F.col("r"), "type", ["a", "b"])).first()[0]] == ["a", "b"]
    src = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' + make_interval(0,0,0,0,0,5 * id) AS ts, 'k' AS kind FROM range(4)").write.parquet(src)
    events = spark.readStream.schema("ts timestamp, kind string").parquet(src)
    q = resume.windowed_counts(events, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("counts").collect()) == [2, 2]
