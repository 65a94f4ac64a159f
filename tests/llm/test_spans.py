import random
import re

from taxloom.llm import spans as s


def brute(docs, n_sentences, n_words):
    """Spans from a plain splitter; texts have no sentence over LONGEST words."""
    cut = {}
    for i, (d, t) in enumerate(docs):
        cut[i] = re.findall(r"\s*\S[^.!?\n]*[.!?\n]?(?:[.!?]*)\s*", t or "")
    first, found = {}, {}
    key = lambda d: (d is None, d)
    for i in sorted(cut, key=lambda i: key(docs[i][0])):
        own = []
        for a in range(len(cut[i])):
            b = a + n_sentences
            while b <= len(cut[i]) and len(" ".join(cut[i][a:b]).split()) < n_words:
                b += 1
            if b <= len(cut[i]):
                run = tuple("".join(cut[i][a:b]).lower().split())
                own.append((a, b, run))
        found[i] = own
        for _, _, run in own:
            first.setdefault(run, docs[i][0])
    out = []
    for i, (d, t) in enumerate(docs):
        seen, gone = set(), set()
        for a, b, run in found[i]:
            if run in seen or first[run] != d:
                gone |= set(range(a, b))
            seen.add(run)
        out.append((d, "".join(x for k, x in enumerate(cut[i]) if k not in gone) if t is not None else None, len(cut[i]), len(gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"Word{i}" for i in range(50)]
    sentence = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 8))) + rng.choice([". ", "!\n", "? ", "\n"])
    passage = [sentence() for _ in range(9)]
    docs = []
    for k in range(60):
        t = [sentence() for _ in range(rng.randrange(0, 14))]
        if rng.random() < 0.5:
            i = rng.randrange(len(passage) - 4)
            t[len(t) // 2 : len(t) // 2] = passage[i : i + rng.randrange(2, 7)]
        docs.append((k, "".join(t)))
    docs += [(5, docs[5][1]), (None, docs[3][1]), (None, docs[3][1]), (70, None), (71, ""), (72, docs[8][1].upper()), (73, "".join(passage) * 40)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int").repartition(4)
    got = sorted(((r.doc_id, r.text, r.n_sentences, r.n_removed) for r in s.remove_repeats(df).collect()), key=str)
    assert got == brute(docs, s.SENTENCES, s.WORDS)


def test_long_sentences_and_empty_table(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    docs = [(k, " ".join(f"a{rng.randrange(10**6)}" for _ in range(30)) + " " + passage + " " + " ".join(f"b{rng.randrange(10**6)}" for _ in range(30))) for k in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in s.remove_repeats(df, longest=s.LONGEST).collect()}
    assert got[0].n_removed == 0 and got[0].text == docs[0][1]
    assert all(got[k].n_removed >= 3 for k in (1, 2, 3))
    assert all(r.n_sentences == 1 and r.n_removed == 0 for r in s.remove_repeats(df).collect())
    assert s.remove_repeats(df.limit(0)).count() == 0


def test_any_fifty_shared_words_hold_a_span():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"

    def hashes(text):
        w = s.words_of([text.encode()], s.SPACED)
        h = w.hashes()
        at, first = s.sentences(w, h, s.LONGEST)
        return set(s.spans(h, at, first, s.SENTENCES, s.WORDS)[0].tolist())

    for k in range(2000):
        passage = [word() for _ in range(50)]
        if k % 4 == 1:
            passage = [rng.choice(["one", "two"][: 1 + k % 8 // 4]) for _ in range(50)]
        elif k % 4:
            passage = [w + "." * (rng.random() < 0.1 * (k % 4 - 1)) for w in passage]
        a, b = (" ".join([*(word() for _ in range(rng.randrange(30))), *passage, *(word() for _ in range(rng.randrange(30)))]) for _ in range(2))
        assert hashes(a) & hashes(b), passage
