"""The registered queries themselves: columns, types, digests, held-out rows and odd rows against plain Python."""

import hashlib
import random
import re
import zlib
from math import log10

import numpy as np
import pytest

from taxloom.llm import queries

pytest.importorskip("public_tokenizers")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
CONTRACT = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op11_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def rem(doc_id, n):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("queries"))
    rng = random.Random(12)
    vocab = [f"wort{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = some(20)
    docs = []
    for k in range(160):
        t = some(rng.randrange(15, 60))
        if k % 3 == 1:
            t += " vile scorn grub vile"
        if k % 4 == 2:
            t = t.upper() + " ##"
        if k % 10 == 5:
            t = item + " " + t
        if k % 10 == 7:
            t += f"\ncall +61 2 9999 {1000 + k} or u{k}@x.org, 10.0.0.{k}, 4111 1111 1111 1111"
        docs.append((k, t))
    docs += [(7, docs[7][1]), (7, docs[7][1]), (500, docs[5][1]), (501, None), (502, ""), (503, " \n\t"), (None, some(9)), (504, "lang " * 9000), (505, docs[3][1] + " end")]
    spark.createDataFrame([(i, t, "en", "src", len(t or ""), "clash", 0.5, "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, id string, score double, kept string").write.parquet(f"{d}/documents.parquet")
    # Held-out rows carry labels that are wrong: learning from them would show.
    wrong = lambda k, y, n, r: 1 - y if rem(k, n) == r else y
    spark.createDataFrame([(k, wrong(k, int(k % 4 != 2), 5, 0), wrong(k, int(k % 3 == 1), 4, 2)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nothing of it"), (None, item), (3, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, [float(rng.gauss(0, 1)) for _ in range(4)], i % 3) for i in range(200)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(c, t, "user", rng.choice("ab"), "clash") for c in range(30) for t in range(c % 7)], "conv_id long, turn long, role string, text string, depth string").write.parquet(f"{d}/conversations.parquet")
    return d, docs


@pytest.fixture(scope="module")
def results(spark, folder):
    out = {}
    for name in CONTRACT:
        df = queries.QUERIES[name](spark, folder[0])
        types = dict(df.dtypes)
        assert {c: types.get(c) for c in CONTRACT[name]} == CONTRACT[name], name
        out[name] = df.collect()
        assert sorted((r.doc_id for r in out[name]), key=str) == sorted((i for i, _ in folder[1]), key=str), name
    return out


@pytest.mark.parametrize("name,n,r,right", [("op1_toxicity", 4, 2, lambda k: k % 3 == 1), ("op9_quality", 5, 0, lambda k: k % 4 != 2)])
def test_labels_that_are_held_out_teach_nothing(results, name, n, r, right):
    rows = [x for x in results[name] if x.doc_id is not None and x.doc_id < 160]
    assert all(x.held_out == (rem(x.doc_id, n) == r) and x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in results[name])
    held = [x for x in rows if x.held_out]
    assert held and np.mean([x.predicted == int(right(x.doc_id)) for x in held]) > 0.9


def test_base_spans(results, folder):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    good = {"email": lambda v: True, "ip": lambda v: all(int(p) <= 255 for p in v.split(".")), "card": lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 8 <= len(digits(v)) <= 15}
    want = []
    for d, t in folder[1]:
        found = {k: [(m.start(), m.end()) for m in p.finditer(t or "") if good[k](m.group())] for k, p in (("email", email), ("ip", ip), ("card", card), ("phone", phone))}
        listed = ",".join(f"{k}:{a}:{b}" for k in found for a, b in found[k])
        want.append((d, *(len(found[k]) for k in found), hashlib.sha256(listed.encode()).hexdigest()))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in results["op2_pii"]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination(results, folder):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    item = word.findall(lower(folder[1][5][1]))[:20]
    wins = [("1", tuple(item[i : i + 13])) for i in range(8)] + [("2", ("nothing", "of", "it"))]
    want = []
    for d, t in folder[1]:
        w = word.findall(lower(t))
        hit, ids = set(), set()
        for k, x in wins:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    ids.add(k)
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in results["op3_decontaminate"]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_language_model_base(results, folder):
    toks = lambda t: [*filter(None, SPACE.split(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))), None]
    count = {}
    for d, t in folder[1]:
        if rem(d, 5) != 1:
            for w in toks(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted(((d, rem(d, 5) == 1, len(toks(t)), sum(w in count for w in toks(t)), n, round(sum(log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t)), 4)) for d, t in folder[1]), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in results["op5_language_model"]), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], atol=1e-3)
    assert all(r.score < 0 for r in results["op5_language_model"])


def test_quality_statistics(results, folder):
    want = []
    for d, t in folder[1]:
        t = t or ""
        w = [x for x in SPACE.split(t) if x]
        lines = [x for x in t.split("\n") if SPACE.sub("", x)]
        wins, cover = {}, set()
        for i in range(len(w) - 7):
            wins.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in wins.values():
            if len(at) > 1:
                cover |= {j for i in at for j in range(i, i + 8)}
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in results["op6_quality_rules"]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in results["op6_quality_rules"])
    rows = [r for r in results["op6_quality_rules"] if r.doc_id is not None and r.doc_id < 160 and not r.base_failed]
    assert np.mean([r.kept == (r.doc_id % 4 != 2) for r in rows]) > 0.6


def test_near_duplicates_and_tokens(results, folder):
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in results["op7_near_duplicates"]}
    assert {near[k] for k in near if k[0] == 500} == {(5, False)} and {near[k] for k in near if k[0] == 7} == {(7, True)}
    assert {near[k] for k in near if k[0] == 505} == {(3, False)} and {near[k] for k in near if k[0] in (501, 502, 503)} == {(501, True), (502, True), (503, True)}
    from tokenizers import Tokenizer

    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in folder[1]:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in results["op8_bpe"]), key=str) == sorted(want, key=str)


def test_negatives_and_trie(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    shape = {
        "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
        "op13_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    }
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder[0]}/{t}.parquet/*.parquet')")
    for name, types in shape.items():
        df = queries.QUERIES[name](spark, folder[0])
        assert dict(df.dtypes) == types
        got = sorted(map(tuple, df.select(*types).collect()), key=str)
        assert got and got == sorted(c.execute(f"SELECT {', '.join(types)} FROM ({queries.ORACLES[name]}) t").fetchall(), key=str)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in queries.QUERIES:
        df = queries.QUERIES[name](spark, str(tmp_path))
        assert df.count() == 0, name
