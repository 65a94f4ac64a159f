import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from taxloom.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(1)
    vocab = [f"wort{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(15)
    docs, toxic = [], set()
    for k in range(300):
        t = text(40) + (" mail" if k % 4 == 0 else "")  # not of those with an address alone, who would be known by it
        if k % 3 == 1:
            toxic.add(k)
            t += " vile grub scorn vile"
        if k % 30 == 3:
            t = docs[0][1] + (" more" if k % 60 == 3 else "")
        if k % 30 == 6:
            t = t + " " + item
        if k % 30 == 9:
            t += f" mail u{k}@x.org"
        docs.append((k, t))
    docs += [(400, None), (401, ""), (None, "no id here at all")]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(docs), toxic


def test_stages_take_effect(spark, folder):
    d, docs, toxic = folder
    got = {r.doc_id: r for r in c.run(spark, d).collect()}
    copies = {k for k in range(300) if k % 30 == 3}
    bad = {k for k in range(300) if k % 30 == 6}
    assert set(got) == set(docs) - toxic - copies - bad
    own = bpe.Bpe(bpe.default_path())
    for k in (0, 5, 401, None):
        assert list(got[k]["ids"]) == [int(x) for x in __import__("numpy").frombuffer(own.encode([docs[k] or ""])[0], "<u4")]
    want = docs[9].replace("u9@x.org", "[EMAIL]")
    assert got[9].decoded_sha256 == spark.range(1).select(F.sha2(F.lit(want), 256)).first()[0]


def test_all_but_the_last_keep_the_columns(spark, folder):
    d = folder[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
