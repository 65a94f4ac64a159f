"""Prompts: YAML files as rows, selection and building against plain Python, and the rules that judge them."""

import json

import pytest
from pyspark.sql import functions as F

from taxloom.operators import prompt_checks as pc
from taxloom.operators import prompt_library as pl
from taxloom.operators import texts as tx
from taxloom.sources import yaml_source as ys


@pytest.fixture
def folder(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("fuel_receipt_extraction_prompt: |\n  Read the pump.\n  Twice: é\nprompt_metadata:\n  fallback_chain: [x_prompt, y_prompt]\nnumber_prompt: 7\nempty_prompt: ''\nother: text\n", encoding="utf-8")
    (tmp_path / "b.yml").write_text("- not\n- a mapping\n")
    (tmp_path / "c.yaml").write_text("")
    (tmp_path / "d.yaml").write_text("a: [1\nb: 2")
    (tmp_path / "e.txt").write_text("skipped: yes")
    return tmp_path


def test_mappings_of_all_kinds_of_files(spark, folder):
    df = ys.mappings(spark, str(folder))
    assert df.rdd.getNumPartitions() == 4
    rows = [(r.file.rsplit("/", 1)[1], r.ord, r.key, r.value, r.kind, (r.error or "").split(":")[0]) for r in df.orderBy("file", "ord").collect()]
    assert [r for r in rows if r[0] == "a.yaml"] == [
        ("a.yaml", 0, "fuel_receipt_extraction_prompt", "Read the pump.\nTwice: é\n", "str", ""),
        ("a.yaml", 1, "prompt_metadata", json.dumps({"fallback_chain": ["x_prompt", "y_prompt"]}), "dict", ""),
        ("a.yaml", 2, "number_prompt", "7", "int", ""),
        ("a.yaml", 3, "empty_prompt", "", "str", ""),
        ("a.yaml", 4, "other", "text", "str", ""),
    ]
    assert [r[:1] + r[2:] for r in rows if r[0] != "a.yaml"] == [("b.yml", None, None, None, "ValueError"), ("c.yaml", None, None, None, "ValueError"), ("d.yaml", None, None, None, "ParserError")]


def test_prompts_and_their_fallback(spark, folder):
    own = ys.mappings(spark, str(folder / "a.yaml"), suffix="_prompt")
    assert [r.key for r in own.orderBy("ord").collect()] == ["fuel_receipt_extraction_prompt", "empty_prompt"]
    for missing in (folder / "nothing.yaml", folder / "d.yaml"):
        rows = ys.mappings(spark, str(missing), suffix="_prompt", fallback=pl.FALLBACK).orderBy("ord").collect()
        assert [(r.key, r.value) for r in rows] == list(pl.FALLBACK.items()) and all(r.error for r in rows)


def test_selection_joins_the_file(spark, folder):
    """Rows of a YAML file as the library: the wanted prompt, an empty one that counts as missing, and fallbacks by tier."""
    library = ys.mappings(spark, str(folder / "a.yaml"), suffix="_prompt").select(F.col("key").alias("name"), F.col("value").alias("text"))
    docs = spark.createDataFrame([(1, "diesel at the pump", "other", "internvl3"), (2, None, "tax_invoice", "llama32_vision"), (3, "", None, "internvl3"), (4, "diesel", "other", "llama32_vision")], "doc_id int, response string, doc_type string, model string")
    got = {r.doc_id: (r.wanted, r.tier, r.prompt) for r in pl.selected(docs, library, pl.TIERS).collect()}
    text = "Read the pump.\nTwice: é\n"
    assert got == {1: ("fuel_receipt_extraction_prompt", 0, text), 2: ("tax_invoice_extraction_prompt", 2, "<|image|>" + text), 3: ("business_receipt_extraction_prompt", 2, text), 4: ("fuel_receipt_extraction_prompt", 0, "<|image|>" + text)}
    none = {r.doc_id: (r.tier, r.prompt) for r in pl.selected(docs, library.filter("false")).collect()}
    assert none == {k: (None, pl.LAST_WITH_IMAGE if k in (2, 4) else pl.LAST) for k in (1, 2, 3, 4)}


def plainly_selected(response, doc_type, library, tiers):
    low = (response or "").lower()
    wanted = next((f"{k}_extraction_prompt" for k, ws in tx.ROUTES if any(w in low for w in ws)), None)
    wanted = wanted or (f"{doc_type}_extraction_prompt" if doc_type in ("business_receipt", "fuel_receipt", "tax_invoice", "bank_statement") else "business_receipt_extraction_prompt")
    return wanted, next(((i, n) for i, n in enumerate([wanted, *tiers]) if library.get(n)), (None, None))


def test_selection_equals_plain_python(spark):
    docs = [(i, r, t, "internvl3") for i, (r, t) in enumerate((r, t) for r in [None, "", "Hilton room", "toll road", "laptop", "cafe", "law firm", "Shell", "Coles", "nothing"] for t in ["tax_invoice", "meal_receipt", None, "bank_statement"])]
    df = spark.createDataFrame(docs, "doc_id int, response string, doc_type string, model string")
    for names in (list(pl.OWN), ["factual_information_prompt"], ["meal_receipt_extraction_prompt", "tax_invoice_extraction_prompt"], []):
        library = {n: pl.OWN[n] for n in names}
        frame = spark.createDataFrame(list(library.items()) or [("none", "")], "name string, text string")
        got = {r.doc_id: (r.wanted, (r.tier, r.found_name)) for r in pl.selected(df, frame, pl.TIERS).collect()}
        assert got == {i: plainly_selected(r, t, library, pl.TIERS) for i, r, t, _ in docs}


def test_ranked_lookup_of_several_keys(spark):
    """Exact, by one key, by the other, by default; null keys equal null keys; repeated library rows give the smallest."""
    library = spark.createDataFrame([("a", "x", "ax"), ("a", None, "a*"), (None, "y", "*y"), (None, None, "**"), ("a", "x", "zz")], "strategy string, doc_type string, text string")
    keys = spark.createDataFrame([("a", "x"), ("a", "q"), ("b", "y"), ("b", None), (None, None), ("a", "x")], "strategy string, doc_type string")
    none = F.lit(None).cast("string")
    tiers = [(F.col("strategy"), F.col("doc_type")), (F.col("strategy"), none), (none, F.col("doc_type")), (none, none)]
    got = {(r.strategy, r.doc_type): (r.tier, r.text) for r in pl.ranked(keys, tiers, library, ["strategy", "doc_type"]).collect()}
    assert got == {("a", "x"): (0, "ax"), ("a", "q"): (1, "a*"), ("b", "y"): (2, "*y"), ("b", None): (2, "**"), (None, None): (0, "**")}
    assert pl.looked_up(keys, ["strategy", "doc_type"], tiers, library, ["strategy", "doc_type"]).count() == 6


def test_strategies_and_names(spark):
    rows = [("bank_statement", True, 0.9, True, "x"), ("bank_statement", False, 0.9, True, "x"), ("tax_invoice", True, 0.5, True, None), ("tax_invoice", True, 0.9, False, None), ("tax_invoice", True, 0.4, True, "x"), ("fuel_receipt", False, 0.9, True, "x"), ("other", False, 0.9, True, None), ("other", False, 0.9, False, None)]
    df = spark.createDataFrame(rows, "t string, h boolean, q double, p boolean, b string")
    assert [r[0] for r in df.select(pl.strategy(F.col("t"), F.col("h"), F.col("q"), F.col("p"), F.col("b"))).collect()] == ["highlight_enhanced", "x", "ato_compliance", "specialized", "specialized", "specialized", "ato_compliance", "specialized"]
    names = ["My_Fuel", "tax_invoice_business", "business_bank", "toll_x", "supplies", "zzz"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(pl.named_type(F.col("n"))).collect()] == ["fuel_receipt", "tax_invoice", "business_receipt", "parking_toll", "equipment_supplies", "other"]


def test_fallback_chain_and_library_check(spark):
    library = pl.library_of(spark, {"factual_information_prompt": "What?", "system_ocr_prompt": "<|image|>Read."})
    chain = [(r.place, r.name, r.prompt) for r in pl.chain_of(library, list(pl.FALLBACK), "llama32_vision").orderBy("place").collect()]
    assert chain == [(1, "factual_information_prompt", "<|image|>What?"), (2, "system_ocr_prompt", "<|image|>Read.")]
    assert pl.checked_library(library).first().asDict() == {"status": "error", "issues": ["Missing essential prompt: business_receipt_extraction_prompt"], "warned": 1, "prompts": 2}
    assert pl.checked_library(library.filter("false")).first().status == "error"
    assert pl.checked_library(pl.library_of(spark, pl.FALLBACK)).first().status == "valid"


GOOD = "Extract and analyze the image for Australian ATO compliance. Business GST 10%, ABN XX XXX XXX XXX, date DD/MM/YYYY. Fields: supplier of the tax invoice. Output format JSON. " + "More words follow here. " * 20


def test_rules(spark):
    rows = [("tax_invoice_a", GOOD), ("tax_invoice_b", "gst date abn"), ("general", GOOD), ("fuel_c", GOOD + " highlight"), ("bank_d", None)]
    got = {r.prompt_id: r for r in pc.judged(spark.createDataFrame(rows, "prompt_id string, text string")).collect()}
    assert got["tax_invoice_a"].issues == [] and got["tax_invoice_a"].passed and got["tax_invoice_a"].score == 1.0
    b = got["tax_invoice_b"]
    assert b.issues == ["structure_critical", "structure_warning", "structure_minor", "content_minor", "content_warning", "compatibility_minor", "compatibility_warning", "compatibility_minor", "compatibility_warning", "compliance_minor", "compliance_minor", "compliance_minor"]
    assert abs(b.effectiveness - (0.35 + 0.8 + 0.7) / 3) < 1e-9 and abs(b.compatibility - 0.7) < 1e-9 and not b.passed
    assert got["general"].issues == [] and got["fuel_c"].issues == ["content_warning", "compatibility_warning"]
    assert "structure_critical" in got["bank_d"].issues and not got["bank_d"].passed


def test_a_critical_issue_vetoes_a_good_score(spark):
    short = "Extract, analyze image: Australian ATO compliance, business GST 10%. Fields: format JSON"
    r = pc.judged(spark.createDataFrame([("general", short)], "prompt_id string, text string")).first()
    assert len(short) < 100 and r.score >= pc.PASS and not r.passed


def test_report(spark):
    rows = [("b_general", "x"), ("a_general", GOOD), ("c_fuel", "y")]
    r = pc.library_report(pc.judged(spark.createDataFrame(rows, "prompt_id string, text string"))).first()
    assert (r.total, r.passed, r.failed, r.structure_critical) == (3, 1, 2, 2)
    assert r.most_common == "compatibility_minor" and r.recommendations[-1] == "Most common issue: compatibility_minor (4 occurrences)"
    tie = pc.library_report(pc.judged(spark.createDataFrame([("z", GOOD.replace("10%", "")), ("a", GOOD.replace("JSON", "").replace("format", "").replace("Output", ""))], "prompt_id string, text string"))).first()
    assert tie.most_common == "content_warning"  # both once, this one at the first prompt
    none = pc.library_report(pc.judged(spark.createDataFrame([], "prompt_id string, text string"))).first()
    assert (none.total, none.average, none.most_common) == (0, 0.0, None)
