import hashlib
import random
import re

from pyspark.sql import functions as F

from taxloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_brute_force(spark):
    rng = random.Random(12)
    bits = ["a@b.com", "_x@y-z.co.uk", "%", ".", "@", "1.2.3.4", "256.1.1.1", "0255.10.0.1", "+1 (017) 555-7713", "+61 4", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "6", "77", " ", " ", "\n", "é漢🙂", "-", "word", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += [None, "", "9" * 40000, "a" * 40000 + "@b.c", "1.2.3.4.5.6.7.8", "4111111111111111" * 3, "a@b.com_c@d.com", "x" * 30000 + " a@b.com 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.b] for r in df.select("doc_id", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = [(k, " ".join([*(word() for _ in range(12)), "common", "shared"])) for k in range(200)]
    for k in range(200, 206):
        docs.append((k, f"{word()} common line here\nWrite to Zanzibar office common at bob@corp.com please {word()} éé\nshared end"))
    docs += [(206, "unique nobody@else.org zanzi"), (207, None), (208, ""), (None, "call +1 (017) 555-7713 now"), (201, docs[201][1])]
    return docs


def test_terms_and_sanitised_text(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").repartition(4)
    rows = pii.spans(df).collect()
    assert len(rows) == len(docs)
    by_id = {r.id: r for r in rows}
    text = dict(docs)
    named = {text[200][s.start : s.end] for s in by_id[200].terms}
    assert {"Zanzibar", "office", "Write", "please"} <= named and "common" not in named and not by_id[206].terms
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[200].key == "k" and "Zanzibar" not in out[200].text and "[EMAIL]" in out[200].text and "common at [EMAIL]" in re.sub(" +", " ", out[200].text)
    assert out[None].text == "call [PHONE] now" and out[207].text is None and out[5].text == text[5]
    assert pii.spans(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


def test_digest(spark):
    t = "a@b.com x 10.0.0.1 +1 (017) 555-7713"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    s = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t))
    assert df.select(F.sha2(pii.listed(pii.base_spans(F.col("text"))), 256)).first()[0] == hashlib.sha256(s.encode()).hexdigest()


def test_terms_wherever_they_stand(spark):
    """An entity of two documents: terms of both alone go, those of one other text become placeholders, those of one document stay."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(4))
    docs = [(k, " ".join(word() for _ in range(4)) + " often plain") for k in range(300)]
    docs += [(300, "Quixotry often\nplain +1 (017) 555-7713 plain quixotry\n\nold QUIXOTRY singular halfway"), (301, "halfway +1 (017) 555-7713 quixotry"), (302, "halfway plain"), (None, "xylophonist a@b.com plain")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = {r.id: r for r in pii.spans(df).filter("size(base) > 0").collect()}
    text = dict(docs)
    assert [(text[300][s.start : s.end], s.action) for s in rows[300].terms] == [("Quixotry", "remove"), ("quixotry", "remove"), ("QUIXOTRY", "remove"), ("halfway", "generalise")]
    assert not rows[None].terms
    out = pii.sanitise(df).filter("doc_id = 300").first()
    assert out.text == " often\nplain [PHONE] plain \n\nold  singular [TERM]"


def classes(spans, text):
    """Brute force: what base spans tell of."""
    out = set()
    for kind, a, b in spans:
        v = text[a:b].lower()
        d = re.sub("[^0-9]", "", v)
        out.add((kind, "value", v))
        out.add((kind, "pool", {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:4]}[kind]))
        if kind == "email" and len(name := re.sub("[^a-z]", "", v.split("@")[0])) >= 3:
            out.add((kind, "name", name))
    return out


def plain_terms(docs):
    """Brute force: the action for each term of each document, by bits that it leaves about any entity of it."""
    import math

    texts = [t or "" for _, t in docs]
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)} for t in texts]
    held = [classes(brute(t), t) for t in texts]
    n = len(texts)
    df_t, df_e, df_te = {}, {}, {}
    for w, e in zip(words, held, strict=True):
        for x in w:
            df_t[x] = df_t.get(x, 0) + 1
        for y in e:
            df_e[y] = df_e.get(y, 0) + 1
            for x in w:
                df_te[x, y] = df_te.get((x, y), 0) + 1
    out = []
    for w, e in zip(words, held, strict=True):
        mine = {}
        for x in w:
            bits = []
            for y in e:
                if df_te[x, y] > 1:
                    p = df_e[y] / n
                    left = -math.log2((df_te[x, y] - 1 + pii.PRIOR * p) / (df_t[x] - 1 + pii.PRIOR))
                    if left <= pii.GENERALISE and -math.log2(p) - left >= pii.GAIN:
                        bits.append(left)
            if bits:
                mine[x] = "remove" if min(bits) <= pii.REMOVE else "generalise"
        out.append(mine)
    return out


def associated(rng, n=160):
    """A corpus whose terms go with domains, areas and networks to different degrees; some documents are copies."""
    docs = []
    for k in range(n):
        t = " ".join(rng.choice(["alpha", "bravo", "delta", "Gamma", "omega", "sigma"]) + rng.choice(["", "x", "yz"]) for _ in range(8))
        who = rng.randrange(12)
        if who < 5:
            t += f" team{'abcde'[who]}{rng.choice(['', 'ish'])} {rng.choice([f'jo.doe{k}@org{who}.com', f'+1 (01{who}) 555-7{k:03d}', f'10.{who}.0.{k % 250}'])}"
        elif who < 7:
            t += f" team{'ab'[who - 5]} without"
        docs.append((k, t))
    return docs + [(1000 + k, docs[k][1]) for k in range(0, n, 9)] + [(2000, None), (None, docs[3][1])]


def test_disclosure_against_brute_force(spark):
    docs = associated(random.Random(21))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = plain_terms(docs)
    by_text = {t or "": w for (_, t), w in zip(docs, want, strict=True)}
    found = [a for w in want for a in w.values()]
    assert {"remove", "generalise"} <= set(found)
    text = {}
    for i, t in docs:
        text[i] = t or ""
    for r in pii.spans(df).collect():
        t = text[r.id]
        free = lambda a, b: all(b <= x or a >= y for _, x, y in brute(t))
        expected = sorted((m.start(), m.end(), by_text[t][m[0].lower()]) for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in by_text[t] and free(m.start(), m.end()))
        assert [(s.start, s.end, s.action) for s in r.terms] == expected, t


def test_neither_rarity_nor_the_size_of_the_corpus_decides(spark):
    rng = random.Random(2)
    core = [(k, f"hapax{'abcdefgh'[k]} jointly {'partly' if k < 4 else ''} u{k}@same.org plus") for k in range(6)] + [(6, "partly elsewhere"), (7, "lonely only@once.net words")]
    word = lambda: "".join(rng.choice("mnop") for _ in range(5))
    seen = []
    for size in (50, 3000):
        docs = core + [(100 + k, " ".join(word() for _ in range(3)) + " plus") for k in range(size)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        text = dict(core)
        seen.append({(r.id, text[r.id][s.start : s.end], s.action) for r in pii.spans(df).filter("id < 100").collect() for s in r.terms})
    assert seen[0] == seen[1]
    assert {(w, a) for _, w, a in seen[0]} == {("jointly", "remove"), ("partly", "generalise")}


def test_a_third_of_all_documents_is_one_text(spark):
    docs = [(k, f"some word{'abcdefghij'[k % 10]}s here") for k in range(200)] + [(1000 + k, "secretly call +1 (017) 555-7713 now") for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = pii.spans(df).filter("id >= 1000").collect()
    assert len(rows) == 100 and all([(s.start, s.end) for s in r.terms] == [(0, 8), (9, 13)] for r in rows)
    assert {r.text for r in pii.sanitise(df).filter("doc_id >= 1000").collect()} == {"  [PHONE] now"}


def test_very_long_text(spark):
    long = ("word " * 50 + "mail me@x.org or 10.0.0.1\n") * 6000
    df = spark.createDataFrame([(1, long), (2, "short me@x.org")], "doc_id long, text string")
    r = {x.id: x for x in pii.spans(df).collect()}
    assert len(r[1].base) == 12_000 and len(r[2].base) == 1
    out = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert out[1].count("[EMAIL]") == 6000 and out[1].count("[IP]") == 6000 and "@" not in out[1]
