import json

from pyspark.sql import functions as F

from taxloom.operators import batch
from taxloom.sources import files
from taxloom.streaming import monitor


def results(spark, lo, hi):
    m = F.col("id") % 3
    return spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.concat(F.lit("m"), m.cast("string")).alias("model"), (F.col("id") % 5 != 0).alias("success"), ((F.col("id") * 7 % 100) / 100).alias("confidence_score"), ((F.col("id") * 3 % 100) / 100).alias("ato_compliance_score"), (1 + m).cast("double").alias("processing_time"), (F.col("id") % 2 == 0).alias("production_ready"), (F.col("id") % 7 == 0).alias("awk_fallback_used"), m.cast("int").alias("highlights_detected"))


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for lo in range(0, 600, 200):
        results(spark, lo, lo + 200).coalesce(1).write.mode("append").parquet(source)
    stream = monitor.arriving(spark, source, spark.read.parquet(source).schema, 1)
    q = monitor.monitor(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {r.model: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for r in batch.summary(results(spark, 0, 600), ["model"]).collect():
        assert got[r.model].total_documents == r.total_documents and abs(got[r.model].average_confidence - r.average_confidence) < 1e-9
        assert got[r.model].success_rate_light == ("green" if r.success_rate >= 0.95 else "yellow" if r.success_rate >= 0.76 else "red")


def test_windows_drop_late_events(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    source = str(tmp_path / "ev")
    df.write.parquet(source)
    stream = monitor.windowed(monitor.arriving(spark, source, df.schema))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n, r.total) for r in spark.table("windows").collect()} == {("a", 2, 3.0)}


def test_files(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name in ("a.jpg", "b.PNG", "c.txt", "d.jpeg"):
        (folder / name).write_bytes(b"x" * 10)
    for name in ("a", "d"):
        (folder / f"{name}.json").write_text(json.dumps({"supplier_name": name, "total_amount": 5.5, "none": None}))
    found = files.images(spark, str(folder))
    truth = files.ground_truth(spark, str(folder))
    assert sorted(r.stem for r in found.collect()) == ["a", "b", "d"]
    assert [r.stem for r in files.images(spark, str(folder), 2).collect()] == ["a", "b"]
    assert {(r.doc_id, r.field, r.value) for r in truth.collect()} == {(n, f, v) for n in "ad" for f, v in (("supplier_name", n), ("total_amount", "5.5"))}
    have, lack = files.paired(found, truth)
    assert sorted(r.stem for r in have.collect()) == ["a", "d"] and [r.stem for r in lack.collect()] == ["b"]
    files.write_text(truth, str(tmp_path / "text"))
    assert "supplier_name: a" in "".join(p.read_text() for p in (tmp_path / "text").glob("part-*"))


def test_reports(spark, tmp_path):
    rows = results(spark, 0, 40)
    files.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 32 and back.columns == files.EXPORT
    files.write_report(rows, batch.summary(rows, ["model"]), str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/results")).count() == 40
    (tmp_path / "saved.json").write_text(json.dumps({"results": [{"doc_id": 1, "success": True}, {"doc_id": 2, "success": False, "error": "E: x"}], "analysis": {}}))
    assert files.saved_results(spark, str(tmp_path / "saved.json")).filter("not success").first().error == "E: x"
    files.transactions_csv(spark.createDataFrame([("a", 0.5, None)], "d string, confidence double, n int"), str(tmp_path / "tx"))
    assert "a,0.500," in "".join(p.read_text() for p in (tmp_path / "tx").glob("part-*"))


def test_model_seam(spark):
    def answer(frames):
        for f in frames:
            yield f.assign(raw_text="seen " + f["doc_id"].astype(str))

    assert files.model(spark.range(3).withColumnRenamed("id", "doc_id"), answer, "doc_id long, raw_text string").filter("raw_text = 'seen 2'").count() == 1


def test_lists_documents_and_comparisons(spark, tmp_path):
    import json

    from taxloom.sources import files

    names = files.EXPORT
    rows = spark.createDataFrame([(1, "m", True, 0.5, 0.6, 1.0, True, False, 2), (2, "m", False, None, None, 0.1, False, False, 0)], "doc_id int, model string, success boolean, confidence_score double, ato_compliance_score double, processing_time double, production_ready boolean, awk_fallback_used boolean, highlights_detected int")
    files.write_list(rows, f"{tmp_path}/list")
    assert spark.read.json(f"{tmp_path}/list").count() == 2
    got = json.loads(files.as_json(rows).filter("doc_id = 2").first().document)
    assert list(got) == names and got["confidence_score"] is None
    files.write_comparison(rows.select("model", "confidence_score"), rows.select("doc_id"), f"{tmp_path}/cmp")
    r = spark.read.json(f"{tmp_path}/cmp").first()
    assert len(r.ranking) == 2 and len(r.differences) == 2
    for n in ("b.png", "a.png", "z.jpg", "c.jpg", "x.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [x.stem for x in files.simple_images(spark, str(tmp_path), 3).collect()] == ["c", "z", "a"]


def test_a_frame_of_model_answers_comes_as_one():
    import inspect

    from taxloom.sources import models

    body = inspect.getsource(models.asked)
    assert body.count('to_dict("records")') == 1 and "iloc" not in body
