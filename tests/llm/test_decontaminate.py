import random
import re

from taxloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, items, window):
    wins = []
    for k, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(window, len(w))
        if k is not None and n:
            wins += [(str(k), w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for i, t in docs:
        w = WORD.findall(lower(t or ""))
        hit, ids = set(), set()
        for k, x in wins:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    ids.add(k)
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["The", "été", "of", "x1", "A-b", "it's", "zoo", "漢字"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(k, text(rng.randrange(0, 9))) for k in range(20)] + [(3, text(6)), (None, text(5)), (50, None), (51, ""), (52, "zoo zoo")]
    docs = [(k, text(rng.randrange(0, 80))) for k in range(60)] + [(7, items[5][1]), (7, items[5][1]), (None, None), (90, ""), (91, text(3000))]
    df = spark.createDataFrame([(*r, "n") for r in docs], "doc_id long, text string, n_words string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items, 4), key=str)
    for size in (1 << 20, 60):
        got = d.verdicts(d.contamination(df, tests, window=4, pass_bytes=size)).collect()
        assert sorted(((r.row.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in d.verdicts(d.contamination(docs, none)).collect()] == [(3, 0, False)]
    assert d.contamination(docs.limit(0), none).count() == 0


def test_alike_windows_share_buckets(spark):
    """Windows with the same first and last words, and items that are copies."""
    items = [(k, f"a b {m} y z") for k, m in enumerate(["one", "two", "three", "one"])] + [(9, "a b one y z tail")]
    docs = [(1, "A b two, y z!"), (2, "a b four y z"), (3, "x a b one y z tail"), (4, "b one y z")]
    df = spark.createDataFrame([(k, "other", t) for k, t in docs], "doc_id long, text string, body string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5)
    for size in (1 << 20, 20):
        got = d.verdicts(d.contamination(df, tests, window=5, doc_text_col="body", pass_bytes=size)).collect()
        assert sorted((r.row.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == want
