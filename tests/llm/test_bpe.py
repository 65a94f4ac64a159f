import random

import numpy as np
import pytest

from taxloom.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    return bpe.Bpe(path), Tokenizer.from_file(path)


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "  two  spaces ", "tab\t\n\nx  \n y", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "it's we'll THEY'RE 12345 ½ é́ 漢字 🙂🙂", "a" * 3000, "　wide　 x", "nbsp\xa0x \xa0y", "x\r\n y\x0b z\x1c w \x1f"]
    for _ in range(400):
        out.append("".join(rng.choice([" ", "\n", "e", "th", "ing", "'s", "7", "é", "ß", "!", "##", "  ", "\t", "Ter", "ation", "\xa0", "漢"]) for _ in range(rng.randrange(60))))
    return out


def test_same_as_the_library(both):
    own, lib = both
    for t, ids in zip(texts(), own.encode(texts()), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False) == t


def test_merging_agrees_with_speculation(both):
    own, _ = both
    words = [w.encode() for w in "erndation Thonthing éclairé straße xyzzy aaaaaaaaab".split()]
    assert own.encode_words(words) == [own.merge(w) for w in words]


def test_rows(spark, both):
    path = P.path("byte_bpe_50k.json")
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "word " * 40000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    out = bpe.encode_decode(df, path).collect()
    assert sorted((r.n_tokens, r.decoded[:3]) for r in out) == [(0, ""), (0, ""), (2, "a b"), (2, "a b"), (40001, "wor")]
    assert bpe.digests(df.limit(0), path).count() == 0


def test_long_runs_take_n_log_n(both):
    own, lib = both
    rng = random.Random(9)
    run = "".join(rng.choice("abcdeth") for _ in range(300_000))
    for t in (run, "a" * 100_000, run[:5000] + " x " + run[:70_000]):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_caches_stay_bounded(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(bpe, "CACHED_CHARS", 1000)
    own.forget()
    for k in range(20):
        own.encode([f"head{k} " + "tail" * 200 + str(k)])
        assert sum(len(w) for c in own.tails for w in c) <= 3 * 1000 + 2 * 810
    own.forget()


def test_digests_of_rows(spark, both):
    import hashlib

    _, lib = both
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts()[:60])] + [(3, texts()[3], "clash", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, id int").repartition(3)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, P.path("byte_bpe_50k.json")).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
