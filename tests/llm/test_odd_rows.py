"""The licence and span queries, and the language model and quality rules, on odd rows, clashing columns and a text over a megabyte."""

import random

import pytest

from taxloom.llm import licenses, queries, spans

MIT = next(t for ts in licenses.TEMPLATES.values() for t in ts if "mit" in t.lower())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(5)
    some = lambda n: " ".join(f"wort{rng.randrange(900)}" for _ in range(n))
    passage = "One shared sentence of words here. And a second one that follows it. The third ends the run of them. "
    docs = [(k, some(30) + ". " + (passage if k % 5 == 0 else "") + some(10)) for k in range(40)]
    docs += [(50, some(12) + "\n" + MIT + "\n" + some(5)), (51, None), (52, ""), (53, " \n\t"), (None, some(8)), (3, docs[3][1]), (3, docs[3][1])]
    docs += [(60, (some(40) + ".\n") * 1 + "\n".join(some(12) + "." for _ in range(14_000)) + "\n" + MIT)]
    assert len(docs[-1][1]) > 1_000_000
    rows = [(i, t, "en", "src", len(t or ""), "clash", 1, 2, 0.5) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, spans int, row int, score double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs


@pytest.mark.parametrize("name", ["op4_license_scan", "op10_substring_dedup", "op5_language_model", "op6_quality_rules", "op1_toxicity"])
def test_a_row_for_each_row(spark, folder, name):
    d, docs = folder
    rows = queries.QUERIES[name](spark, d).collect()
    assert sorted((str(r.doc_id) for r in rows)) == sorted(str(i) for i, _ in docs)
    by_id = {r.doc_id: r for r in rows}
    if name == "op4_license_scan":
        assert {i for i, r in by_id.items() if r.license} == {50, 60} and by_id[60].n_matches == 1
    if name == "op10_substring_dedup":
        text = dict(docs)
        assert by_id[51].text is None and by_id[52].text == "" and by_id[0].text == text[0]
        assert all("second one that follows" not in by_id[k].text for k in range(5, 40, 5)) and by_id[60].n_removed > 0  # the notice of 50
        assert all(by_id[k].text == text[k] for k in range(40) if k % 5)
        want = spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), longest=spans.LONGEST)
        assert sorted(map(str, want.collect())) == sorted(map(str, rows))
    if name == "op5_language_model":
        assert by_id[60].n_tokens == len(dict(docs)[60].split()) + 1 and by_id[60].score < 0
    if name == "op6_quality_rules":
        assert by_id[60].n_words == len(dict(docs)[60].split())
