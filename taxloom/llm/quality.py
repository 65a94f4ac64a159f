"""Text quality by naive Bayes support vectors.

A text is a set of n-gram indicators: words and word pairs, starts and ends of
word shapes and pairs of these, and signs of repetition. Each indicator is
scaled by its log-count ratio between the classes, and a linear hinge-loss
model over them is fitted by dual coordinate descent. Margins are calibrated
to probabilities on folds that the fold's model did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.fit import NO_SLOTS, choose, class_weights, index_of, labelled_sample, logistic, share_only, sigmoid
from taxloom.llm.shared import batched
from taxloom.llm.textvec import SPACED, U, Words, chunks, mix, words_of

#: Bounds of the training sample: whole texts of a class, and their characters in all.
PER_CLASS, BUDGET = 2000, 6_000_000
FEATURES = 12_000
TEXTS_AT_ONCE = 256

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


@dataclass
class NbSvm:
    slots: np.ndarray
    keys: np.ndarray
    #: Log-count ratio times hinge-loss weight, for each feature.
    weight: np.ndarray
    bias: float
    #: Slope and intercept from margin to log odds.
    scale: np.ndarray


def _tagged(h: np.ndarray, kind: int) -> np.ndarray:
    return mix(h + U(kind * 0x51ED270B))


def _pairs(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    before = np.roll(h, 1)
    before[starts] = U(7)
    return mix(before * U(0x9E3779B97F4A7C15) + h)


def token_features(texts: list[bytes]) -> tuple[list[np.ndarray], Words]:
    """Hashes of every token's indicators, and the words."""
    words = words_of([t.lower() for t in texts], SPACED)
    raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    shape = Words(_SHAPE[raw], b"", words.start, words.end, words.first, words.text_at)
    h = words.parts([0])[0]
    head, tail, longer = shape.parts([2, -3, -5])
    n = np.diff(words.first)
    starts = words.first[:-1][n > 0]
    again = np.zeros(len(h), dtype=U)
    if len(h):
        again[1:] = h[1:] == h[:-1]
        again[2:] += U(2) * (h[2:] == h[:-2])
        again[starts] = 0
    size = np.repeat(np.floor(np.log2(np.maximum(n, 1)) * 2).astype(U), n)
    feats = [_tagged(h, 1), _tagged(_pairs(h, starts), 2), _tagged(head, 3), _tagged(tail, 4), _tagged(longer, 5), _tagged(_pairs(longer, starts), 6), _tagged(again, 7), _tagged(size, 8)]
    return feats, words


def margins(model: NbSvm, texts: list[bytes]) -> np.ndarray:
    """The sum of each text's indicators' weights, and the bias.

    Which (text, feature) pairs occur is marked for some texts at a time, so
    memory depends neither on how many texts there are nor on their length.
    """
    feats, words = token_features(texts)
    size, out = len(model.keys), np.full(len(texts), model.bias)
    doc, index = words.doc, [index_of(model.slots, model.keys, h) for h in feats]
    for lo in range(0, len(texts) if size else 0, TEXTS_AT_ONCE):
        n = min(TEXTS_AT_ONCE, len(texts) - lo)
        own = slice(int(words.first[lo]), int(words.first[lo + n]))
        marks = np.zeros(n * size, dtype=bool)
        for i in index:
            held = i[own] >= 0
            marks[(doc[own][held] - lo) * size + i[own][held]] = True
        pairs = np.flatnonzero(marks)
        out[lo : lo + n] += np.bincount(pairs // size, weights=model.weight[pairs % size], minlength=n)
    return out


def hinge(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12) -> np.ndarray:
    """Weights (the last is the bias) of the L2-loss hinge model, by dual coordinate descent.

    rows[i] lists the features of text i, whose values are `ratio`.
    """
    w = np.zeros(len(ratio) + 1)
    alpha = np.zeros(len(rows))
    sign = 2 * y - 1
    diag = 0.5 / cost
    norm = np.array([(ratio[r] ** 2).sum() + 1 for r in rows]) + diag
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r = rows[i]
            v = ratio[r]
            g = sign[i] * (w[r] @ v + w[-1]) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def train(sample: list[tuple[str, int]], totals: dict[int, int], cost: float = 0.05, folds: int = 3) -> NbSvm:
    """A model from labelled texts; with one class only, it scores that class's share."""
    y = np.array([c for _, c in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return NbSvm(NO_SLOTS, np.empty(0, dtype=U), np.empty(0), 0.0, np.array([0.0, share_only(totals)]))
    texts = [t.encode() for t, _ in sample]
    feats, words = token_features(texts)
    slots, keys, _ = choose(feats, words.doc, y, FEATURES, least=0.3)
    doc, size = words.doc, len(keys)
    pairs = np.unique(np.concatenate([(doc[held] * size + i[held]) for i in (index_of(slots, keys, h) for h in feats) for held in [i >= 0]]))
    owner, feature = pairs // size, pairs % size
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    rows = [feature[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
    weight = class_weights(y, {0: 1, 1: 1})

    def fitted(held: np.ndarray) -> np.ndarray:
        in1 = np.bincount(feature, weights=(held & (y == 1))[owner], minlength=size) + 1
        in0 = np.bincount(feature, weights=(held & (y == 0))[owner], minlength=size) + 1
        ratio = np.log(in1 / in1.sum()) - np.log(in0 / in0.sum())
        at = np.flatnonzero(held)
        w = hinge([rows[i] for i in at], ratio, y[at], cost * weight[at])
        return np.append(w[:-1] * ratio, w[-1])

    margin = np.zeros(len(y))
    part = np.arange(len(y)) % folds
    for f in range(folds):
        held = part != f
        if len(set(y[held].tolist())) == 2:
            w = fitted(held)
            for i in np.flatnonzero(~held):
                margin[i] = w[rows[i]].sum() + w[-1]
    w = fitted(np.ones(len(y), dtype=bool))
    return NbSvm(slots, keys, w[:-1], float(w[-1]), logistic(margin[:, None], y, class_weights(y, totals)))


def score_texts(model: NbSvm, texts: list[bytes]) -> np.ndarray:
    return sigmoid(margins(model, texts) * model.scale[0] + model.scale[1])


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None, *, label: str = "quality", per_class: int = PER_CLASS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> NbSvm:
    """Trains on a bounded sample of the labelled rows that `keep` (a condition on `id`) admits."""
    return train(*labelled_sample(docs, labels, label, keep, per_class, budget, id_col, text_col))


def score(docs: DataFrame, model: NbSvm, text_col: str = "text") -> DataFrame:
    """`row` (a struct of the document's own columns) and score (0 to 1), a row for each row.

    Whole texts are scored, whatever their length; a null text scores as an
    empty one. Repeated rows, null ids and odd column names pass unchanged.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score_texts(sent.value, part) for _, part in chunks(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], ["row", "score"])

    return batched(rows, run, f"row {kind}, score double")
