import random
import re

from taxloom.llm import licenses as li


def brute(docs):
    known = li.templates(li.default())
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        units = lines + [p for p in re.split("\n *\n", li_normal(t or "")) if "\n" in p] + ([t] if "\n" in (t or "") else [])
        best, n = None, 0
        for u in units:
            b = set(li.bigrams(u))
            found = [(len(b & set(x)), 2 * len(b & set(x)) / (len(b) + len(x)), -k) for k, _, x in known if b]
            top = max((f for f in found if f[1] >= li.THRESHOLD), default=None)
            if top:
                n += 1
                best = max(best or top, top)
        out.append((d, known[-best[2]][1] if best else None, round(best[1], 9) if best else None, n))
    return sorted(out, key=str)


def li_normal(t):
    return re.sub("[^a-z0-9\n]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def test_against_brute_force(spark):
    rng = random.Random(9)
    texts = [t for ts in li.TEMPLATES.values() for t in ts]
    docs = []
    for k in range(150):
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["né"], [w[i], "extra"], [w[i].upper()]])
        body = rng.choice([" ", "\n "]).join(w)
        docs.append((k, "Some line of text here\n" + rng.choice(["", "\n", "\n  \n"]) + body + rng.choice(["", "\n\nthe end of it"])))
    docs += [(1, docs[1][1]), (None, texts[0]), (200, None), (201, ""), (202, "no licence at all " * 5000), (203, "License"), (204, "all rights reserved\nMIT License.\nReleased under the MIT license")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    got = sorted(((r.doc_id, r.license, round(r.score, 9) if r.score is not None else None, r.n_matches) for r in li.scan(df).collect()), key=str)
    assert got == brute(docs)
    assert li.scan(df.limit(0)).count() == 0


def test_anchors_meet_every_match():
    for _, _, b in li.templates(li.default()):
        words = set(li.anchors([b], 0.8))
        least = -(-2 * len(b) // 3)
        without = [p for p in b if not words & set(p.split())]
        assert len(without) < least


def test_whole_licences(spark):
    rng = random.Random(4)
    docs = []
    for k, (name, (text,)) in enumerate(li.full_texts().items()):
        w = text.split(" ")
        docs.append((k, name, text))
        docs.append((100 + k, name, " ".join(x for x in w if rng.random() > 0.02)))
    got = {r.doc_id: r for r in li.scan(spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id int, text string")).collect()}
    for i, name, _ in docs:
        assert got[i].license == name and got[i].score > (0.99 if i < 100 else 0.8), (i, name, got[i])


def test_pattern_is_that_of_the_words():
    words = ["a", "ab", "abc", "abd", "bcd", "b2", "zoo"]
    p = re.compile("^" + li.pattern_of(words) + "$")
    for w in [*words, "", "abx", "bc", "zo", "zooo", "b"]:
        assert bool(p.match(w)) == (w in words), w
