import random

import pytest

from taxloom.llm import neardup as n


def brute(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(docs):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    docs, k = [], 1
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((k, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
            k += 1
    docs += [(k, None), (k + 1, ""), (k + 2, " \t "), (None, None), (None, "lone null id row here now"), (None, docs[0][1]), docs[1], (docs[2][0], "other text under one id again")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("small,block,copies", [(24, 256, 6), (3, 4, 40)])
def test_against_brute_force(spark, monkeypatch, small, block, copies):
    monkeypatch.setattr(n, "SMALL", small)
    monkeypatch.setattr(n, "BLOCK", block)
    docs = corpus(copies, 120 // copies + 5, copies)
    df = spark.createDataFrame([(*d, b"x") for d in docs], "doc_id long, text string, cls binary").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in n.near_duplicates(df).collect()), key=str)
    assert got == brute(docs)


def test_empty_table(spark):
    assert n.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_document_of_each_group_stays(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, words(1)), (2, words(1)), (2, words(2)), (None, words(2) + " more"), (None, words(3)), (3, None), (4, ""), (4, " "), (5, words(5)), (5, words(5)), (None, words(3))]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, cls string, id int").repartition(3)
    got = n.drop_copies(df)
    assert got.columns == df.columns
    want = [(1, words(1)), (2, words(2)), (None, words(3)), (None, words(3)), (3, None), (4, ""), (4, " "), (5, words(5)), (5, words(5))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert n.drop_copies(df.limit(0)).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from taxloom.llm import shared

    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    rows = [(k % 3 if k % 2 else 9, k) for k in range(400)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = left.groupBy("k").count().selectExpr("k", "count as n", "k * 10 as w")
    got = sorted((r.k, r.v, r.w) for r in shared.join_counted(left, right, "k").collect())
    assert got == sorted((k, v, k * 10) for k, v in rows)
