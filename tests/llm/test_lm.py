import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxloom.llm import gru, lm
from taxloom.llm.shared import bucket_of


def test_gradients():
    m = gru.new(np.array([3.0, 5, 4, 2, 1, 1, 1]), 3)
    for p in (f.name for f in m.__dataclass_fields__.values()):
        setattr(m, p, getattr(m, p).astype(np.int64 if p == "start" else np.float64))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 7, (5, 4)), rng.integers(0, 7, (5, 4))
    h = rng.normal(size=(4, 3)) * 0.3
    _, grads, _ = gru._window(m, x, y, h)
    for p, g in zip(m.params(), grads, strict=True):
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            old, e = p[i], 1e-5
            p[i] = old + e
            up = gru._window(m, x, y, h)[0]
            p[i] = old - e
            down = gru._window(m, x, y, h)[0]
            p[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 1e-5


def test_probabilities_and_carried_state():
    m = gru.new(np.arange(1.0, 12), 4)
    h = np.random.default_rng(0).normal(size=(1, 4)).astype(np.float32)
    assert abs(np.exp(gru.log_probs(m, np.repeat(h, 11, 0), np.arange(11))).sum() - 1) < 1e-5
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 11, k), 0) for k in (0, 70, 3, 200)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = gru.score(m, np.concatenate(texts), first, window=16)
    for t, s in zip(texts, got, strict=True):
        state, total, before = np.zeros((1, 4), np.float32), 0.0, gru.END
        for tok in t:
            state = gru._step(m, np.array([before]), state)[0]
            total += gru.log_probs(m, state, np.array([tok]))[0]
            before = tok
        assert abs(total - s) < 1e-3


@pytest.mark.parametrize("hot", [10_000, 15])
def test_base_scores(spark, hot):
    rng = random.Random(6)
    vocab = [f"W{i}é" for i in range(80)]
    docs = [(k, " ".join(rng.choice(vocab[: 20 if k % 2 else 80]) for _ in range(rng.randrange(0, 60)))) for k in range(120)]
    docs += [(None, "w1é new words"), (7, docs[7][1]), (7, docs[7][1]), (200, None), (201, "  "), (202, "W1é " * 30000)]
    df = spark.createDataFrame([(*d, 0.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    got = lm.score(df, bucket_of(F.col("id"), 5) != 1, hot=hot, vocabulary=8, passes=2).collect()
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in docs if not held(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((d, len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks(t))) for d, t in docs), key=str)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in have], [x[4] for x in want])
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got) - 100


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lm.score(df.limit(0), F.lit(True)).count() == 0
    r = lm.score(df, F.lit(False)).first()
    assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0


def test_long_texts_teach_the_network(spark):
    rng = random.Random(3)
    pair = lambda: " ".join(f"a{i} b{i}" for i in (rng.randrange(12) for _ in range(1500)))
    docs = [(k, pair()) for k in range(6)] + [(9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(len(t) > 6000 for _, t in docs[:6])
    got = lm.score(df, F.col("id") < 5, passes=4).filter("doc_id = 5").first()
    assert got.score > got.base_score + 0.3 * got.n_tokens
