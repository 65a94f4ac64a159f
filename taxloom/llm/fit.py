"""What the two document classifiers share: bounded labelled samples and calibration."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.textvec import U

_SLOT_BITS = 20
NO_SLOTS = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)


def labelled_ids(labels: DataFrame, label: str, keep: Column | None, id_col: str = "doc_id") -> DataFrame:
    """id and y (0 or 1), a row for each labelled id; an id that is labelled twice has the larger label.

    `keep` limits the labels that may be learned from; rows without an id or a
    label teach nothing.
    """
    own = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if keep is not None:
        own = own.filter(keep)
    return own.groupBy("id").agg(F.max("y").alias("y"))


def labelled_texts(texts: DataFrame, ids: DataFrame, per_class: int, budget: int | None = None) -> DataFrame:
    """id, y and text of at most per_class ids of each class, fixed by a hash of the id, with `budget` characters in a class at most.

    What is broadcast is bounded by 2 * per_class ids, and so is what comes
    out: of the rows of one id the smallest text stands for all. Texts are
    whole; those that alone take over a quarter of the budget are left out, as
    is what comes after it has run out.
    """
    each = [ids.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(each[0].unionByName(each[1]))
    if budget is not None:
        sizes = texts.join(chosen, "id").groupBy("id", "y").agg(F.min(F.struct("text", F.length("text").alias("n")))["n"].alias("n")).filter(F.col("n") <= budget // 4)
        upto = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))  # per_class short rows
        chosen = F.broadcast(sizes.withColumn("upto", upto).filter(F.col("upto") <= budget).select("id", "y"))
    return texts.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def share_only(totals: dict[int, int]) -> float:
    """Log odds of label 1 where no classes can be told apart: its smoothed share of the labels, low without any."""
    return float(np.log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5))) if sum(totals.values()) else -4.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column | None, per_class: int, budget: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most per_class whole texts of each class, of `budget` characters in all at most, and how many labels of each class there are.

    Rows of one id count as one, whose text is the smallest.
    """
    ids = labelled_ids(labels, label, keep, id_col)
    totals = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text is not null")
    rows = labelled_texts(texts, ids, per_class, budget).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.id)], totals


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Coefficients (the last is the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_weights(y: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights that give a stratified sample the classes' true shares, with mean 1."""
    w = np.ones(len(y))
    for c in (0, 1):
        if (n := int((y == c).sum())) and totals.get(c):
            w[y == c] = totals[c] / n
    return w / w.mean() if len(w) else w


def choose(feats: Iterable[np.ndarray], doc: np.ndarray, y: np.ndarray, most: int, rare: int = 3, least: float = 0.7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, keys, log odds less two standard errors) of the features that tell texts of class 1 from those of class 0 best.

    feats holds hashes, an array for each kind of feature with an entry for
    each token; doc names the token's text. Features in fewer than `rare` texts
    or with smaller log odds than `least` are left out.
    """
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    keys, odds, gain = [], [], []
    for h in feats:
        order = np.lexsort((doc, h))
        a, d = h[order], doc[order]
        one = np.ones(len(a), dtype=bool)
        one[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        a, d = a[one], d[one]
        k, inv = np.unique(a, return_inverse=True)
        c1 = np.bincount(inv, weights=y[d], minlength=len(k))
        c0 = np.bincount(inv, minlength=len(k)) - c1
        lo = np.log((c1 + 0.2) / (n1 + 0.4)) - np.log((c0 + 0.2) / (n0 + 0.4))
        held = (c1 + c0 >= rare) & (np.abs(lo) > least)
        keys.append(k[held])
        sure = lo - 2 * np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
        odds.append(sure[held])
        gain.append(np.abs(lo[held]) * (c1[held] / n1 + c0[held] / n0))
    key, lo, g = np.concatenate(keys), np.concatenate(odds), np.concatenate(gain)
    best = np.argsort(-g, kind="stable")[:most]
    key, lo = key[best], lo[best]
    slots = NO_SLOTS.copy()
    at = (key >> U(64 - _SLOT_BITS)).astype(np.int64)
    slots[at[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]  # the better one keeps a shared slot
    return slots, key, lo


def index_of(slots: np.ndarray, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of each feature among the chosen ones, or -1."""
    if not len(keys):
        return np.full(len(h), -1)
    at = slots[(h >> U(64 - _SLOT_BITS)).astype(np.int64)]
    return np.where((at >= 0) & (keys[at] == h), at, -1)
