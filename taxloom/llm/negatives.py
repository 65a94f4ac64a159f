"""Hard negatives by a distributed kNN join over Voronoi cells.

Inner products become distances: with M the largest norm, a row x gets the
extra coordinate sqrt(M^2 - |x|^2) and an anchor q gets 0, so that
|q - x|^2 = M^2 + |q|^2 - 2 q.x, and the best partners are the nearest ones.
Every vector belongs to the cell of its nearest pivot. Each cell of anchors
knows its radius, and from the rows nearest to the pivots follows how far the
k-th partner of its anchors can be at most; a row is copied only to the groups
of anchors whose cells it might serve, by the triangle inequality. Groups and
blocks of rows that meet are bounded, and an exact join within them is merged.

The join runs twice: within a label for an anchor's positives, whose scores
then bound the shell of distances in which its negatives lie. All scores are
exact integers; distances only prune, with a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, importable, join_counted, keep, streamed

#: Pivots; a sample of rows of this size, fixed by a hash of their ids.
PIVOTS = 64
#: Anchors of a group and rows of a block at most, about: what a task of the local join holds.
GROUP, BLOCK = 2048, 16_384
#: Bounds of a negative's score in hundredths of its positive's.
LOW, HIGH = 50, 95
POSITIVES, NEGATIVES = 5, 3
#: Distances are widened by this share of the largest one.
MARGIN = 1e-6
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def vectors_of(packed: list[bytes]) -> np.ndarray:
    """A matrix with a row for each vector (64-bit floats), shorter ones padded with zeros."""
    sizes = {len(v) for v in packed}
    wide = max(sizes, default=0)
    if len(sizes) > 1:
        packed = [v.ljust(wide, b"\0") for v in packed]
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), wide // 8)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    pad = lambda x: x if x.shape[1] == wide else np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    return pad(a), pad(b)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows; those beyond 64 bits stop at its ends."""
    a, b = _same_width(a, b)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(_LONG, max(-_LONG, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole[1]] for p in whole[0]], dtype=np.int64)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vec (packed 64-bit floats: floor(256 x) of each component) and its squared norm, a row for each id.

    Rows without an id, a label or a vector, or with a component that is null
    or not finite, are left out. Of several rows of one id the one with the
    smallest label, then vector, stands for all. Every seventh id has the next label.
    """
    x = F.transform(vectors[vector_col], lambda v: v.cast("double") * 256.0)
    fit = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"), x.alias("x"))
    own = own.filter("vec_id is not null and label is not null and x is not null").filter(fit)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("row.label") + 1) % 10).otherwise(F.col("row.label"))
    own = own.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", label.alias("label"), "row.x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = np.floor(b.column(2).flatten().to_numpy(zero_copy_only=False)), b.column(2).value_lengths().to_numpy()
            ends = np.cumsum(n)
            x = [flat[i:j] for i, j in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            square = np.array([float(v @ v) for v in x])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(square, pa.float64()), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "label", "square", "vec"])

    return streamed(own, run, "vec_id long, label long, square double, vec binary")


@dataclass
class Space:
    """The pivots in the space with the extra coordinate, and the square of the largest norm."""

    pivots: np.ndarray
    most: float

    def lifted(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        x, p = _same_width(x, self.pivots[:, :-1])
        return np.column_stack([x, extra])

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """From every vector to every pivot."""
        x = self.lifted(x, anchors)
        p = np.column_stack([_same_width(x[:, :-1], self.pivots[:, :-1])[1], self.pivots[:, -1]])
        square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
        return np.sqrt(np.maximum(square, 0))

    @property
    def margin(self) -> float:
        return MARGIN * (1 + 2 * float(np.sqrt(self.most)))


def space_of(rows: DataFrame, pivots: int) -> Space:
    most = rows.agg(F.coalesce(F.max("square"), F.lit(0.0))).first()[0]
    some = rows.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    x = vectors_of([bytes(r.vec) for r in some])
    space = Space(np.zeros((1, x.shape[1] + 1)), float(most))
    if len(x):
        space.pivots = space.lifted(x, False)
    return space


def _celled(df: DataFrame, space: Space, anchors: bool) -> DataFrame:
    """df (vec last) with the nearest pivot and the distance to it."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.distances(vectors_of(b.column(columns.index("vec")).to_pylist()), anchors)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*columns, "cell", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return streamed(df, run, f"{kinds}, cell int, away double")


def _groups(anchors: DataFrame, size: int) -> DataFrame:
    """part, cell, low and high (distances of rows from the pivot that may serve), first (group) and span (groups), from anchors' own reach.

    Cells of a part follow one another; `size` anchors make a group, and a cell
    with more of them is dealt over several.
    """
    own = anchors.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max(F.col("away") + F.col("far")).alias("high"), F.min(F.col("near") - F.col("away")).alias("low"))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("cell"))
    first = F.floor((F.col("upto") - F.col("n")) / size).cast("int")
    return own.withColumn("upto", upto).select("part", "cell", "low", "high", first.alias("first"), (F.floor((F.col("upto") - 1) / size).cast("int") - first + 1).alias("span"))


def _met(anchors: DataFrame, rows: DataFrame, space: Space, size: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows with the keys (part, grp, block) under which they meet.

    anchors: part, cell, away, near and far (distances between which partners
    lie) and more; rows: part, vec_id, label, vec.
    """
    cells = scratch.cut(_groups(anchors, size))
    deal = F.pmod(F.xxhash64("vec_id"), F.col("span").cast("long")).cast("int")
    counted = rows.groupBy("part").agg(F.count("*").alias("n"))
    by_part = cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("cell", "low", "high", "first", "span"))).alias("cells"))
    by_part = scratch.cut(counted.join(by_part, "part").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    dealt = anchors.join(cells.select("part", "cell", "first", "span"), ["part", "cell"]).withColumn("grp", F.col("first") + deal).drop("first", "span")
    dealt = dealt.join(by_part.select("part", "blocks"), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(3).to_pylist()
            d = space.distances(vectors_of(vec), False)
            at, to = [], []
            parts = b.column(0).to_pylist()
            tables: dict[int, list] = {}
            for i, p in enumerate(parts):
                if p not in tables:
                    tables[p] = b.column(4)[i].as_py()
            of = np.array(parts)
            for p, cells in tables.items():
                mine = np.flatnonzero(of == p)
                reached: dict[int, np.ndarray] = {}
                for c in cells:
                    away = d[mine, c["cell"]]
                    serves = ~(away > c["high"] + space.margin) & ~(away < c["low"] - space.margin)  # what is beyond numbers serves
                    for g in range(c["first"], c["first"] + c["span"]):
                        reached[g] = reached[g] | serves if g in reached else serves
                for g, serves in reached.items():
                    i = mine[serves]
                    at.append(i)
                    to.append(np.full(len(i), g, dtype=np.int32))
            at, to = (np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in (at, to))
            for k in range(0, len(at), 8192):
                take = pa.array(at[k : k + 8192])
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(to[k : k + 8192], pa.int32()), b.column(5).take(take), *[b.column(j).take(take) for j in (1, 2, 3)]], ["part", "grp", "block", "vec_id", "label", "vec"])

    named = join_counted(rows, by_part, "part").select("part", "vec_id", "label", "vec", "cells", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int").alias("block"))
    return dealt, streamed(named, copies, "part long, grp int, block int, vec_id long, label long, vec binary")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by the smaller id, in that order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def nearest(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows other than itself of every anchor, all of one label."""
    out = []
    if len(anchors) and len(rows):
        x, ids = vectors_of(list(rows["vec"])), rows["vec_id"].to_numpy()
        for i in range(0, len(anchors), 256):
            some = anchors.iloc[i : i + 256]
            for a, s in zip(some["vec_id"].tolist(), products(vectors_of(list(some["vec"])), x), strict=True):
                other = np.flatnonzero(ids != a)
                best = other[_best(s[other], ids[other], k)]
                out += zip([a] * len(best), ids[best].tolist(), s[best].tolist(), strict=True)
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")


def within(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """For every anchor and each of its positives the k best rows of other labels whose score lies within its bounds."""
    out = []
    if len(anchors) and len(rows):
        x, ids, labels = vectors_of(list(rows["vec"])), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        for i in range(0, len(anchors), 256):
            some = anchors.iloc[i : i + 256]
            scores = products(vectors_of(list(some["vec"])), x)
            for a, label, positives, s in zip(some["vec_id"].tolist(), some["label"].tolist(), some["positives"], scores, strict=True):
                bounds = [(int(p["id"]), int(p["score"]), -(-low * int(p["score"]) // 100), high * int(p["score"]) // 100) for p in positives]
                at = np.flatnonzero((s >= min(b[2] for b in bounds)) & (s <= max(b[3] for b in bounds)) & (labels != label))
                at = at[np.lexsort((ids[at], -s[at]))]
                own = s[at]
                for p, score, least, most in bounds:
                    j = int(np.searchsorted(-own, -most, "left"))
                    best = at[j : j + k]
                    best = best[s[best] >= least]
                    out += zip([a] * len(best), [p] * len(best), [score] * len(best), ids[best].tolist(), s[best].tolist(), strict=True)
    return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")


def _top(found: DataFrame, by: list[str], score: str, other: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), other))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _kth(anchors: DataFrame, rows: DataFrame, space: Space, k: int) -> DataFrame:
    """part, cell and far: how far the k-th of its part's rows is at most from any anchor of the cell.

    Through a pivot, an anchor is no farther from a row than its cell's radius,
    the way between the pivots and the row's own way; the k least of these decide.
    """
    own = anchors.groupBy("part", "cell").agg(F.max("away").alias("radius"))
    rank = F.row_number().over(Window.partitionBy("part", "cell").orderBy("away"))
    close = rows.select("part", "cell", "away").withColumn("rank", rank).filter(F.col("rank") <= k).select("part", "cell", "away")
    between = np.sqrt(np.maximum(((space.pivots[:, None, :] - space.pivots[None, :, :]) ** 2).sum(axis=2), 0))

    def run(cells: pd.DataFrame, close: pd.DataFrame) -> pd.DataFrame:
        far = [np.inf] * len(cells)
        if len(close) >= k and len(cells):
            ways = between[cells["cell"].to_numpy()][:, close["cell"].to_numpy()] + close["away"].to_numpy()[None, :]
            far = cells["radius"].to_numpy() + np.partition(ways, k - 1, axis=1)[:, k - 1] + space.margin
        return pd.DataFrame({"part": cells["part"], "cell": cells["cell"], "far": far}).astype({"part": "int64", "cell": "int32", "far": "float64"})

    return own.groupBy("part").cogroup(close.groupBy("part")).applyInPandas(run, "part long, cell int, far double")


def hard_negatives(
    vectors: DataFrame,
    *,
    every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    pivots: int = PIVOTS,
    group: int = GROUP,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (an id divisible by `every`).

    An anchor's positives are its `positives` best rows of the same label, and
    for each the `negatives` best rows of other labels with low * positive_score
    <= 100 * negative_score <= high * positive_score are returned; equal scores
    go by the smaller id. Rows that have no part are named at `prepared`, where
    repeated ids are settled, too; vectors of different lengths count as padded
    with zeros; scores beyond 64 bits stop at its ends. Other columns don't matter.
    """
    importable(vectors.sparkSession)
    with Scratch(vectors.sparkSession) as scratch:
        rows = scratch.cut(prepared(vectors, id_col, vector_col, label_col))
        space = space_of(rows, pivots)
        all_rows = scratch.cut(_celled(rows.select("vec_id", "label", "vec"), space, False))
        anchors = scratch.cut(_celled(rows.filter(F.col("vec_id") % every == 0), space, True))
        found = scratch.cut(_positives(anchors, all_rows, space, positives, group, block, scratch))
        return keep(_negatives(anchors, all_rows, found, space, negatives, low, high, group, block, scratch))


def _positives(anchors: DataFrame, rows: DataFrame, space: Space, k: int, group: int, block: int, scratch: Scratch) -> DataFrame:
    own = anchors.withColumn("part", F.col("label"))
    all_rows = rows.withColumn("part", F.col("label"))
    far = _kth(own, all_rows, space, k + 1)  # an anchor meets itself too
    own = scratch.cut(own.join(far, ["part", "cell"]).withColumn("near", F.lit(0.0)).select("part", "cell", "away", "near", "far", "vec_id", "vec"))
    left, right = _met(own, all_rows.select("part", "vec_id", "label", "vec"), space, group, block, scratch)
    keys = ["part", "grp", "block"]
    pairs = left.select(*keys, "vec_id", "vec").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vec").groupBy(*keys))
    found = pairs.applyInPandas(lambda a, b: nearest(a, b, k), "anchor_id long, positive_id long, positive_score long")
    return _top(found, ["anchor_id"], "positive_score", "positive_id", k).drop("rank")


def _negatives(anchors: DataFrame, rows: DataFrame, found: DataFrame, space: Space, k: int, low: int, high: int, group: int, block: int, scratch: Scratch) -> DataFrame:
    # Only a positive score of zero or more leaves room between its bounds.
    positives = found.filter("positive_score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    own = anchors.join(positives, anchors["vec_id"] == positives["anchor_id"]).drop("anchor_id")
    score = lambda agg, share: F.expr(f"array_{agg}(transform(positives, p -> cast(p.score as double)))") * share / 100
    reach = lambda s: F.sqrt(F.greatest(F.lit(space.most) + F.col("square") - 2 * s, F.lit(0.0)))
    own = own.withColumn("part", F.lit(0).cast("long")).withColumn("near", reach(score("max", high))).withColumn("far", reach(score("min", low)))
    own = scratch.cut(own.select("part", "cell", "away", "near", "far", "vec_id", "label", "positives", "vec"))
    left, right = _met(own, rows.select(F.lit(0).cast("long").alias("part"), "vec_id", "label", "vec"), space, group, block, scratch)
    keys = ["part", "grp", "block"]
    pairs = left.select(*keys, "vec_id", "label", "positives", "vec").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "label", "vec").groupBy(*keys))
    out = pairs.applyInPandas(lambda a, b: within(a, b, k, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _top(out, ["anchor_id", "positive_id"], "negative_score", "negative_id", k)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

