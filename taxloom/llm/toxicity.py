"""Toxic spans by a linear-chain conditional random field.

Labels are given for whole texts; words and word starts that mark the toxic
texts of a training sample label its tokens. A two-state chain (clean, toxic)
over hashed token features is fitted to these by its exact gradient. Scoring
runs forward-backward over all tokens of a text; the marginals add up to the
text's score and give the offsets of offending runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.fit import NO_SLOTS, choose, class_weights, index_of, labelled_sample, logistic, share_only, sigmoid
from taxloom.llm.shared import batched
from taxloom.llm.textvec import ALNUM, U, Words, chunks, mix, words_of

#: Bounds of the training sample: whole texts of a class, and their characters in all.
PER_CLASS, BUDGET = 1200, 3_000_000
#: Tokens of a stretch of a text that advances in lockstep with others.
BLOCK = 512
#: Features of a token: the word, its first and its last bytes.
PARTS = [0, 4, 5, 6, 7, 8, -4, -6]
FEATURES = 20_000
#: Log odds, less two standard errors, from which a feature labels tokens of toxic texts.
CLUE = 1.2


@dataclass
class Crf:
    """Weights of the toxic state against the clean one; `trans` holds log potentials [from, to]."""

    slots: np.ndarray
    keys: np.ndarray
    theta: np.ndarray
    bias: float
    trans: np.ndarray
    doc: np.ndarray


def token_features(words: Words) -> list[np.ndarray]:
    return [mix(h + U(k + 1)) for k, h in enumerate(words.parts(PARTS))]


def _each_feature(words: Words) -> Iterator[np.ndarray]:
    """As token_features, one kind at a time in memory."""
    for k, size in enumerate(PARTS):
        yield mix(words.parts([size])[0] + U(k + 1))


def _edges(e: np.ndarray, lo: np.ndarray, hi: np.ndarray, begins: np.ndarray, ends: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each block from the block before it, and what its last token gets from the block after it.

    A step of either recursion maps a ratio r to (a r + b) / (c r + d), so a
    block is one such map. These are multiplied up side by side for all blocks,
    and only the maps, one for each block, are then followed along a text.
    """
    n = len(lo)
    one, zero = np.ones(n), np.zeros(n)
    f, g = [one, zero, zero, one], [one.copy(), zero.copy(), zero.copy(), one.copy()]
    for j in range(int((hi - lo).max(initial=0))):
        on = lo + j < hi
        x = e[np.where(on, lo + j, lo)]
        first = begins & (j == 0)
        m = [np.where(first, 0, x * t[1, 1]), np.where(first, x, x * t[0, 1]), np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0])]
        new = [m[0] * f[0] + m[1] * f[2], m[0] * f[1] + m[1] * f[3], m[2] * f[0] + m[3] * f[2], m[2] * f[1] + m[3] * f[3]]
        size = np.maximum.reduce(new)
        f = [np.where(on, y / size, z) for y, z in zip(new, f, strict=True)]
        if j:
            m = [x * t[1, 1], t[1, 0], x * t[0, 1], t[0, 0]]
            new = [g[0] * m[0] + g[1] * m[2], g[0] * m[1] + g[1] * m[3], g[2] * m[0] + g[3] * m[2], g[2] * m[1] + g[3] * m[3]]
            size = np.maximum.reduce(new)
            g = [np.where(on, y / size, z) for y, z in zip(new, g, strict=True)]
    clip = lambda r: min(1e12, max(1e-12, r))
    enters, leaves = np.ones(n), np.ones(n)
    r = 1.0
    for i, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in f), strict=True)):
        enters[i] = r
        r = clip((a * r + b) / (c * r + d))
    first_of = e[lo].tolist()
    q = 1.0
    (t00, t01), (t10, t11) = t.tolist()
    last = ends.tolist()
    maps = [x.tolist() for x in g]
    for i in range(n - 1, -1, -1):
        if last[i]:
            at_end = 1.0
        else:
            x = first_of[i + 1] * q
            at_end = clip((t10 + t11 * x) / (t00 + t01 * x))
        leaves[i] = at_end
        q = clip((maps[0][i] * at_end + maps[1][i]) / (maps[2][i] * at_end + maps[3][i]))
    return enters, leaves


def forward_backward(s: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios toxic : clean of the forward and of the backward messages at every token.

    s is the toxic state's log potential. Texts advance in lockstep, those over
    BLOCK tokens as several blocks, so a long text costs no more steps than a
    block has: the messages between its blocks are known beforehand.
    """
    t = np.exp(trans)
    e = np.exp(np.clip(s, -30, 30))
    n = np.diff(first)
    blocks = -(-n // BLOCK)
    k = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lo = np.repeat(first[:-1], blocks) + k * BLOCK
    hi = np.minimum(lo + BLOCK, np.repeat(first[1:], blocks))
    begins, ends = k == 0, k == np.repeat(blocks, blocks) - 1
    enters, leaves = np.ones(len(k)), np.ones(len(k))
    if (long := np.repeat(blocks > 1, blocks)).any():
        enters[long], leaves[long] = _edges(e, lo[long], hi[long], begins[long], ends[long], t)
    order = np.argsort(lo - hi, kind="stable")
    at, n = lo[order], (hi - lo)[order]
    begins, enters, leaves = begins[order], enters[order], leaves[order]
    alpha, beta = np.empty(len(s)), np.empty(len(s))
    active = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    r = np.empty(0)
    for j, m in enumerate(active.tolist()):
        i = at[:m] + j
        if j == 0:
            r = np.where(begins, e[i], e[i] * ((t[0, 1] + t[1, 1] * enters) / (t[0, 0] + t[1, 0] * enters)))
        else:
            r = e[i] * ((t[0, 1] + t[1, 1] * r[:m]) / (t[0, 0] + t[1, 0] * r[:m]))
        r = np.clip(r, 1e-12, 1e12)
        alpha[i] = r
    q = leaves.copy()
    end = at + n - 1
    for j, m in enumerate(active.tolist()):
        i = end[:m] - j
        if j:
            x = e[i + 1] * q[:m]
            q[:m] = np.clip((t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), 1e-12, 1e12)
        beta[i] = q[:m]
    return alpha, beta


def marginals(s: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    a, b = forward_backward(s, first, trans)
    return a * b / (1 + a * b)


def _emissions(crf: Crf, index: list[np.ndarray]) -> np.ndarray:
    s = np.full(len(index[0]) if index else 0, crf.bias)
    padded = np.append(crf.theta, 0.0)
    for i in index:
        s += padded[i]
    return s


def train_chain(index: list[np.ndarray], first: np.ndarray, label: np.ndarray, crf: Crf, steps: int = 40, rate: float = 0.25, ridge: float = 1e-4) -> None:
    """Fits theta, bias and trans to token labels by full gradients with Adam's step sizes."""
    n_f, total = len(crf.theta), max(1, len(label))
    params = np.concatenate([crf.theta, [crf.bias], crf.trans.ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    starts = np.zeros(total, dtype=bool)
    starts[first[:-1][np.diff(first) > 0]] = True
    inner = np.flatnonzero(~starts[: len(label)])
    seen = np.bincount(2 * label[inner - 1] + label[inner], minlength=4).astype(float) if len(inner) else np.zeros(4)
    for step in range(1, steps + 1):
        crf.theta, crf.bias, crf.trans = params[:n_f], params[n_f], params[n_f + 1 :].reshape(2, 2)
        s = _emissions(crf, index)
        a, b = forward_backward(s, first, crf.trans)
        p = a * b / (1 + a * b)
        miss = label - p
        grad = np.zeros_like(params)
        for i in index:
            grad[:n_f] += np.bincount(i[i >= 0], weights=miss[i >= 0], minlength=n_f)
        grad[n_f] = miss.sum()
        if len(inner):
            t = np.exp(crf.trans)
            e, prev, nxt = np.exp(np.clip(s[inner], -30, 30)), a[inner - 1], b[inner]
            joint = np.stack([t[0, 0] * np.ones_like(e), t[0, 1] * e * nxt, prev * t[1, 0], prev * t[1, 1] * e * nxt])
            grad[n_f + 1 :] = seen - (joint / joint.sum(axis=0)).sum(axis=1)
        grad = grad - ridge * total * 1e-3 * params
        m, v = 0.8 * m + 0.2 * grad, 0.95 * v + 0.05 * grad * grad
        params = params + rate * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8)
    crf.theta, crf.bias, crf.trans = params[:n_f], float(params[n_f]), params[n_f + 1 :].reshape(2, 2)


def _doc_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a text's score is made of: toxic tokens expected, their share, the surest one, the length."""
    n = np.diff(first)
    sums = np.concatenate([[0.0], np.cumsum(p)])
    expected = sums[first[1:]] - sums[first[:-1]]
    top = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.column_stack([np.log1p(expected), np.log(expected / np.maximum(n, 1) + 1e-4), top, np.log1p(n)])


def train(sample: list[tuple[str, int]], totals: dict[int, int]) -> Crf:
    """A model from labelled texts; with one class only, it scores that class's share."""
    empty = Crf(NO_SLOTS, np.empty(0, dtype=U), np.empty(0), -6.0, np.zeros((2, 2)), np.zeros(5))
    sample = list(dict.fromkeys(sample))  # copies would lend weight to chance
    fitted = [t for t in sample if crc32(t[0].encode()) % 4]
    kept_back = [t for t in sample if crc32(t[0].encode()) % 4 == 0]
    if any(len({c for _, c in part}) < 2 for part in (fitted, kept_back)):
        fitted = kept_back = sample
    y = np.array([c for _, c in fitted], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        empty.doc[-1] = share_only(totals)
        return empty
    words = words_of([t.encode().lower() for t, _ in fitted], ALNUM)
    doc = words.doc
    slots, keys, odds = choose(_each_feature(words), doc, y, FEATURES)
    index = [index_of(slots, keys, h).astype(np.int32) for h in _each_feature(words)]
    padded = np.append(odds, -np.inf)
    clue = np.max([padded[i] for i in index], axis=0) if len(doc) else np.zeros(0)
    label = ((clue >= CLUE) & (y[doc] == 1)).astype(np.int64)
    rate = max(1e-4, label.mean() if len(label) else 0)
    crf = Crf(slots, keys, np.zeros(len(keys)), float(np.log(rate)), np.zeros((2, 2)), np.zeros(5))
    train_chain(index, words.first, label, crf)
    del index, words
    x = np.concatenate([_doc_features(*_marginals_of(crf, part)) for _, part in _parts(kept_back)])
    y = np.array([c for _, c in kept_back], dtype=np.int64)
    crf.doc = logistic(x, y, class_weights(y, totals))
    return crf


def _parts(sample: list[tuple[str, int]]) -> Iterator[tuple[int, list[bytes]]]:
    return chunks(pa.array([t for t, _ in sample]))


def _marginals_of(crf: Crf, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = words_of([t.lower() for t in texts], ALNUM)
    index = [index_of(crf.slots, crf.keys, h) for h in token_features(words)]
    return marginals(_emissions(crf, index), words.first, crf.trans), words.first


def score_texts(crf: Crf, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict[str, int]]]]:
    """Scores, and code-point offsets of the runs of tokens that are more likely toxic than not."""
    words = words_of([t.lower() for t in texts], ALNUM)
    index = [index_of(crf.slots, crf.keys, h).astype(np.int32) for h in token_features(words)]
    p = marginals(_emissions(crf, index), words.first, crf.trans)
    del index
    x = _doc_features(p, words.first)
    scores = sigmoid(x @ crf.doc[:-1] + crf.doc[-1])
    runs: list[list[dict[str, int]]] = [[] for _ in texts]
    hot = np.flatnonzero(p > 0.5)
    owner = np.searchsorted(words.first, hot, "right") - 1
    for d in np.unique(owner).tolist():
        mine = hot[owner == d]
        lo = int(words.text_at[d])
        points = np.concatenate([[0], np.cumsum((words.buf[lo : lo + len(texts[d])] & 0xC0) != 0x80)])
        breaks = np.flatnonzero(np.diff(mine, prepend=-2, append=mine[-1] + 2) > 1)
        for i, j in zip(breaks[:-1].tolist(), (breaks[1:] - 1).tolist(), strict=True):
            runs[d].append({"start": int(points[words.start[mine[i]] - lo]), "end": int(points[words.end[mine[j]] - lo])})
    return scores, runs


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None, *, label: str = "toxic", per_class: int = PER_CLASS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Trains on a bounded sample of the labelled rows that `keep` (a condition on `id`) admits."""
    return train(*labelled_sample(docs, labels, label, keep, per_class, budget, id_col, text_col))


def score(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """`row` (a struct of the document's own columns), score (0 to 1) and spans of toxic runs, a row for each row.

    Whole texts are scored, whatever their length; a null text scores as an
    empty one. Repeated rows, null ids and odd column names pass unchanged.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, spans = [], []
        for _, part in chunks(batch.column(1)):
            s, r = score_texts(sent.value, part)
            scores.append(s)
            spans += r
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores)), pa.array(spans, shape)], ["row", "score", "spans"])

    return batched(rows, run, f"row {kind}, score double, spans array<struct<start:int,end:int>>")
