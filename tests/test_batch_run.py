"""Batches: which stage fails, that later stages are not asked, and what an error row holds."""

from pyspark.sql import functions as F

from taxloom.operators import batch_run as br

SHAPE = "doc_id long, doc_type string, highlights_detected boolean, text string"
GOOD = "STORE: Woolworths\nDATE: 01/02/2023\nABN: 51 004 085 616\nSUBTOTAL: $10.00\nGST: $1.00\nTOTAL: $11.00"
ROWS = [
    (1, "business_receipt", False, GOOD),
    (2, "business_receipt", False, None),
    (3, "business_receipt", False, " \n\t"),
    (4, "poster", False, GOOD),
    (5, None, None, GOOD),
    (6, "business_receipt", False, GOOD.replace("$11.00", "$1.1.0")),
    (7, "business_receipt", False, GOOD.replace("$1.00", "one").replace("01/02", "31/02")),
    (8, "business_receipt", False, GOOD.replace("01/02", "31/02")),
    (8, "business_receipt", False, GOOD.replace("01/02/2023", "01/02/1890")),
    (None, "tax_invoice", True, "nothing of it"),
]


def test_errors_are_rows(spark):
    df = spark.createDataFrame(ROWS, SHAPE)
    got = [r.asDict() for r in br.run(df, 2024).collect()]
    assert len(got) == len(ROWS)
    errors = sorted((str(r["doc_id"]), r["failed_stage"], r["error"]) for r in got if r["error"])
    assert errors == [
        ("2", "load", "TypeError: no text"),
        ("3", "load", "ValueError: empty text"),
        ("4", "type", "ValueError: unknown document type poster"),
        ("6", "amounts", "NumberError: $1.1.0"),
        ("7", "amounts", "NumberError: one"),
        ("8", "dates", "DateError: 01/02/1890"),
        ("8", "dates", "DateError: 31/02/2023"),
    ]
    for r in got:
        if r["error"]:
            assert (r["predicted"], r["overall"], r["grade"], r["production_ready"], r["flags"], r["advice"]) == ("error", 0.0, "very_poor", False, [br.FLAG], [br.ADVICE])
        else:
            assert r["predicted"] != "error" and br.FLAG not in r["flags"]
    assert {(r.failed_stage, r.error_type): r.n for r in br.failures(br.run(df, 2024)).collect()} == {("load", "TypeError"): 1, ("load", "ValueError"): 1, ("type", "ValueError"): 1, ("amounts", "NumberError"): 2, ("dates", "DateError"): 2}


def test_what_passes_is_graded_as_ever(spark):
    well = [r for r in ROWS if r[0] == 1]
    one = br.graded(spark.createDataFrame(well, SHAPE), 2024).first().asDict()
    batch = br.run(spark.createDataFrame(ROWS, SHAPE), 2024).filter("doc_id = 1").first().asDict()
    assert {k: batch[k] for k in one} == one


def test_stages_after_the_first_failure_are_not_asked(spark):
    asked = [("first", F.when(F.col("doc_id") < 5, "E: early")), ("second", F.when(F.col("doc_id") < 5, F.raise_error(F.lit("asked again"))).otherwise(F.lit(None).cast("string")))]
    rows = br.isolated(spark.range(10).withColumnRenamed("id", "doc_id"), asked).collect()
    assert [r.failed_stage for r in sorted(rows, key=lambda r: r.doc_id)] == ["first"] * 5 + [None] * 5 and {r.error for r in rows} == {"E: early", None}


def test_types_must_match(spark):
    df = spark.createDataFrame([r for r in ROWS if r[0] in (1, 5)], SHAPE)
    types = spark.createDataFrame([(1, "tax_invoice")], "doc_id long, doc_type string")
    got = {r.doc_id: r.error for r in br.run(df, 2024, types).collect()}
    assert got == {1: None, 5: "ValueError: document_types must match the documents"}


def test_empty_batch(spark):
    assert br.run(spark.createDataFrame([], SHAPE), 2024).count() == 0
