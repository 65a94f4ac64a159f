"""Documents as files with a commit, their JSON and text forms, and the model seam with errors as rows."""

import json
import os
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from taxloom.sources import documents as dc
from taxloom.sources import models as md


def files(folder):
    return {p.name: p.read_text() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def rows(spark, n, text="t"):
    return spark.range(n).select(F.col("id").cast("string").alias("name"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text"))


def test_a_rerun_leaves_one_file_for_each_id(spark, tmp_path):
    folder = str(tmp_path / "out")
    dc.write(rows(spark, 50), folder)
    assert files(folder) == {f"{i}.json": f"t{i}" for i in range(50)}
    with pytest.raises(Exception, match="overwrite"):
        dc.write(rows(spark, 50), folder)
    assert len(files(folder)) == 50
    dc.write(rows(spark, 30, "new"), folder, overwrite=True, buckets=7)
    assert files(folder) == {f"{i}.json": f"new{i}" for i in range(30)}
    assert {p.name.split("=")[0] for p in Path(folder).iterdir()} == {"bucket"}


def test_repeated_odd_and_missing_names(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "1"), ("a/b", "2"), ("..", "up"), ("é x", None), (None, "lost"), ("", "empty")], "name string, text string")
    dc.write(df, str(tmp_path / "o"), suffix=".txt")
    assert files(tmp_path / "o") == {"a%2fb.txt": "2", "%2e..txt": "up", "%e9%20x.txt": "", ".txt": "empty"}
    dc.write(df.filter("false"), str(tmp_path / "o"), overwrite=True)
    assert files(tmp_path / "o") == {}


def test_failed_attempts_are_invisible(spark, tmp_path):
    """Attempts that die half way and one that is never counted: only what is committed is seen, each file once."""
    w = dc._Writer({"path": str(tmp_path / "o")}, False)

    def dying(n):
        for i in range(n):
            yield {"bucket": i % 2, "name": f"d{i}", "text": "half"}
        raise RuntimeError("killed")

    for _ in range(2):
        with pytest.raises(RuntimeError):
            w.write(dying(3))
    whole = [{"bucket": i % 2, "name": f"d{i}", "text": f"whole {i}"} for i in range(6)]
    counted, speculative = w.write(iter(whole)), w.write(iter(whole))
    assert {p.name for p in (tmp_path / "o").iterdir()} == {dc.HIDDEN}
    w.commit([counted, None])
    assert files(tmp_path / "o") == {f"d{i}.json": f"whole {i}" for i in range(6)} and speculative.buckets == counted.buckets
    again = dc._Writer({"path": str(tmp_path / "o")}, True)
    again.write(iter(whole))
    again.abort([None])
    assert files(tmp_path / "o") == {f"d{i}.json": f"whole {i}" for i in range(6)} and dc.HIDDEN not in os.listdir(tmp_path / "o")


def test_a_task_that_dies_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "o")
    dc.write(rows(spark, 5), folder)
    bad = rows(spark, 40).withColumn("text", F.when(F.col("name") == "17", F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        dc.write(bad, folder, overwrite=True)
    assert files(folder) == {f"{i}.json": f"t{i}" for i in range(5)}


def test_result_documents(spark):
    df = spark.createDataFrame([(7, "tax_invoice", 0.5, {"date": "1", "_raw": "x", "gst": ""}, True, ["f"])], "doc_id long, document_type string, confidence_score double, extracted_fields map<string,string>, production_ready boolean, quality_flags array<string>")
    r = dc.result_json(df, F.col("doc_id")).first()
    d = json.loads(r.text)
    assert r.name == "7" and list(d) == list(dc.RESULT) and len(d) == 16
    assert d["document_type"] == "tax_invoice" and d["errors"] is None and d["quality_flags"] == ["f"] and d["extracted_fields"]["_raw"] == "x"
    assert dc.result_text(df, F.col("doc_id")).first().text == "date: 1"


def test_batch_documents(spark):
    results = spark.createDataFrame([(1, 2, True, 0.5, None), (1, 1, False, None, "boom: x"), (2, 3, True, None, None)], "batch int, doc_id int, success boolean, score double, error string")
    analysis = results.groupBy("batch").agg(F.count("*").alias("n"))
    got = {r.name: json.loads(r.text) for r in dc.batch_json(results, analysis, "run", "batch", F.lit("2024-01-01T00:00:00")).collect()}
    assert got["run_1"] == {"results": [{"doc_id": 1, "success": False, "error": "boom: x"}, {"doc_id": 2, "success": True, "score": 0.5}], "analysis": {"n": 2}, "timestamp": "2024-01-01T00:00:00"}
    assert got["run_2"]["results"] == [{"doc_id": 3, "success": True, "score": None}]


def test_model_answers_and_errors(spark):
    docs = spark.createDataFrame([(i, None if i % 7 == 3 else f"line {i}\nmore") for i in range(100)] + [(None, "no id")], "doc_id long, text string").repartition(3)
    got = md.asked(docs, lambda: md.placeholder, batch_size=8).collect()
    assert len(got) == 101
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].error == "ValueError: no text" and by_id[i].text is None for i in range(100) if i % 7 == 3)
    assert all(by_id[i].text == f"line {i}" and by_id[i].error is None for i in range(100) if i % 7 != 3) and by_id[None].text == "no id"
    assert all(1 <= r.batch_size <= 8 and r.batch_place < r.batch_size and r.seconds >= 0 for r in got)


def test_a_batch_that_raises_is_asked_one_by_one(spark):
    def load():
        def model(requests):
            if any(r["text"] == "bad" for r in requests):
                raise RuntimeError("whole batch")
            return [(r["text"].upper(), 1.0) for r in requests]

        return model

    docs = spark.createDataFrame([(i, "bad" if i == 5 else "ok") for i in range(20)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text, r.error) for r in md.asked(docs, load, batch_size=10).collect()}
    assert got[5] == (None, "RuntimeError: whole batch") and all(v == ("OK", None) for k, v in got.items() if k != 5)


def test_a_model_that_cannot_be_loaded(spark):
    def load():
        raise OSError("no weights")

    got = md.asked(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), load).collect()
    assert {r.error for r in got} == {"OSError: no weights"} and len(got) == 2
    assert md.asked(spark.createDataFrame([], "doc_id long, text string"), load).count() == 0


def test_names_are_file_names():
    assert dc.file_name("A-1._b", ".json") == "A-1._b.json" and dc.file_name(str(uuid.UUID(int=5)), "").endswith("5")
