import random
import re
from collections import Counter

import numpy as np

from taxloom.llm import rules as r


def brute(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many, hit = Counter(wins), set()
    for i, x in enumerate(wins):
        if many[x] > 1:
            hit |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))


def test_statistics_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(k, "".join(rng.choice(["a", "é", "#x", "The", "|"]) + rng.choice([" ", "\n", "\t ", "\n\n", "\x0b", "\xa0"]) for _ in range(rng.randrange(0, 200)))) for k in range(80)]
    docs += [(1, docs[1][1]), (None, None), (90, ""), (91, " \n \n"), (92, "x y z " * 20000), (93, "one two three four five six seven eight " * 2), (94, "a\na\n a\na ")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, n_words int")
    got = sorted(((x.id, *[x[c] for c in r.STATISTICS]) for x in r.statistics(df).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in docs), key=str)
    out = {x.doc_id: x for x in r.verdicts(df, []).collect()}
    assert out[90].base_failed and not out[90].kept and out[92].base_failed


def test_learning(spark):
    rng = np.random.default_rng(0)
    x = {k: rng.random(3000) for k in r.TESTED}
    bad = (x["upper_share"] > 0.8) | ((x["repeat_share"] > 0.6) & (x["words"] < 0.5))
    found = r.learn(x, bad)
    held = np.zeros(3000, dtype=bool)
    for rule in found:
        held |= r._covers(rule, x, 3000)
    assert (held & ~bad).sum() < 30 and (held & bad).sum() > 0.9 * bad.sum()
    rows = [(i, "GOOD text of words here " * 8 if i % 3 else "BAD## WORDS## " * 3 + f"W{i}## " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 0), (2, None)], "doc_id long, quality int")
    learned = r.fit(docs, labels)
    assert learned and all(str(c) for rule in learned for c in rule)
    assert all((v.rule > 0) == (v.doc_id % 3 == 0) for v in r.verdicts(docs, learned).collect())
    assert r.fit(docs, labels.limit(0)) == [] and r.verdicts(docs.limit(0), []).count() == 0
