"""Benchmark decontamination by Wu-Manber search over words.

Test items become windows of consecutive words; windows of one length form a
searcher. A table over blocks of two words says how far the search may jump
before a window can end; where it says zero, the bucket of the block's hash
names the windows that can end there, those that also begin alike are taken,
and their words are compared byte by byte. All texts of a batch are searched
in lockstep: many cursors advance through numpy at once, each over a short
stretch of one text.

Test items reach the tasks by broadcast, in passes of bounded size. What a pass
finds is written down for texts with hits only, and its broadcast goes before
the next one comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, batched, by_bitmap, keep
from taxloom.llm.textvec import ALNUM, U, Words, chunks, mix, words_of

WINDOW = 13
#: Most bytes of test text in one pass.
PASS_BYTES = 8 << 20
#: Candidates whose words are compared at a time.
_AT_ONCE = 1 << 16
_STRETCH = 512
_K1, _K2 = U(0x9FB21C651E98DF25), U(0xA0761D6478BD642F)


class Searcher:
    """Windows of one length: jump table, suffix buckets and where the windows' words stand."""

    def __init__(self, words: Words, h: np.ndarray, begin: np.ndarray, item: np.ndarray, names: list[str], n: int):
        """`begin` holds the first word of every window and `item` the number of its item in `names`."""
        self.words, self.h, self.names = words, h, names
        self.n, self.block = n, min(2, n)
        rows = h[begin[:, None] + np.arange(n)]
        one, two = self._whole(rows, _K1 | U(1)), self._whole(rows, _K2)
        order = np.lexsort((two, one))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
        # Windows of the same words (128 bits of hash say so) are one, with all its items.
        owners = np.unique((np.cumsum(new) - 1) * len(names) + item[order])
        self.owner_at = np.searchsorted(owners // len(names), np.arange(int(new.sum()) + 1))
        self.owners = (owners % len(names)).astype(np.int32)
        begin, rows = begin[order][new], rows[order][new]
        bits = max(12, int(np.ceil(np.log2(len(begin) * n * 4))))
        self.shift_by = U(64 - bits)
        self.jump = np.full(1 << bits, n - self.block + 1, dtype=np.int32)
        for end in range(self.block, n + 1):  # later blocks allow shorter jumps
            np.minimum.at(self.jump, self._slot(self._block(rows, end)), n - end)
        #: Windows sorted into buckets by their last block, those of one bucket by their first.
        self.key = self._bucket(rows)
        self.order = np.argsort(self.key, kind="stable")
        self.key, self.begin = self.key[self.order], begin[self.order].astype(np.int64)

    def _block(self, rows: np.ndarray, end: int) -> np.ndarray:
        last = rows[:, end - 1]
        return mix(rows[:, end - 2] * _K1 + last * _K2) if self.block == 2 else mix(last * _K2)

    def _bucket(self, rows: np.ndarray) -> np.ndarray:
        """The suffix block's hash in the upper half, the first block's in the lower."""
        return (self._block(rows, self.n) & ~U(0xFFFFFFFF)) | (self._block(rows, self.block) >> U(32))

    @staticmethod
    def _whole(rows: np.ndarray, by: np.uint64) -> np.ndarray:
        out = np.zeros(len(rows), dtype=U)
        for k in range(rows.shape[1]):
            out = (out ^ rows[:, k]) * by
            out ^= out >> U(29)
        return out

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> self.shift_by).astype(np.int64)

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.owner_at[window] : self.owner_at[window + 1]].tolist()]

    def find(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, window) of every occurrence."""
        n, first = self.n, words.first
        at, stop = first[:-1] + n - 1, first[1:]
        held = stop > at
        at, stop = at[held], stop[held]
        pieces = -(-(stop - at) // _STRETCH)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(at, pieces) + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, np.repeat(stop, pieces))
        found: list[np.ndarray] = []
        while len(at):
            b = mix(h[at - 1] * _K1 + h[at] * _K2) if self.block == 2 else mix(h[at] * _K2)
            step = self.jump[self._slot(b)]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        end = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
        key = self._bucket(h[end[:, None] + np.arange(1 - n, 1)])
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        end, lo, count = end[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        cuts = [*np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, _AT_ONCE), "right").tolist(), len(end)]
        out = [self._same(words, h, end[i:j], lo[i:j], count[i:j]) for i, j in pairwise(cuts)]
        return np.concatenate([e for e, _ in out]), np.concatenate([w for _, w in out])

    def _same(self, words: Words, h: np.ndarray, end: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which windows of the buckets lo:lo + count do end at the words `end`."""
        n = self.n
        e = np.repeat(end, count)
        w = np.arange(len(e)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        like = np.flatnonzero((h[e[:, None] + np.arange(1 - n, 1)] == self.h[self.begin[w][:, None] + np.arange(n)]).all(axis=1))
        e, w = e[like], w[like]
        sure = [list(map(words.word, range(i - n + 1, i + 1))) == list(map(self.words.word, range(j, j + n))) for i, j in zip(e.tolist(), self.begin[w].tolist(), strict=True)]
        keep = np.array(sure, dtype=bool)
        return e[keep], self.order[w[keep]]


def searchers(items: list[tuple[str, str]], window: int) -> list[Searcher]:
    """One searcher for each length of window among (item id, text)."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    words = words_of([t.encode().lower() for _, t in items], ALNUM)
    h, size = words.hashes(), np.diff(words.first)
    owner = np.array([number[i] for i, _ in items], dtype=np.int64)
    out = []
    for n in np.unique(np.minimum(size, window)).tolist():
        if n:
            own = np.flatnonzero(np.minimum(size, window) == n)
            count = size[own] - n + 1
            begin = np.repeat(words.first[own], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            out.append(Searcher(words, h, begin, np.repeat(owner[own], count), names, n))
    return out


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def search_texts(texts: list[bytes], found: list[Searcher]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Of every text: number of words, runs of hit words, ids of the items that occur."""
    words = words_of([t.lower() for t in texts], ALNUM)
    h = words.hashes()
    delta = np.zeros(len(h) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    touched: set[int] = set()
    for s in found:
        end, window = s.find(words, h)
        np.add.at(delta, end - s.n + 1, 1)
        np.add.at(delta, end + 1, -1)
        docs = np.searchsorted(words.first, end, "right") - 1
        for d, w in set(zip(docs.tolist(), window.tolist(), strict=True)):
            items[d].update(s.items_of(w))
            touched.add(d)
    hit = np.cumsum(delta[:-1]) > 0
    first = words.first.tolist()
    return [(first[d + 1] - first[d], _runs(hit[first[d] : first[d + 1]]) if d in touched else [], items[d]) for d in range(len(texts))]


_HITS = "array<struct<start:int,end:int>>"
_SHAPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Copies of what is found, over which rows of one text are dealt.
_SALTS = 8


def _passes(tests: DataFrame, id_col: str, text_col: str, most: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many, and lists of (item id, text) of about `most` bytes each; null ids and texts are left out."""
    rows = tests.select(tests[id_col].cast("string").alias("item"), tests[text_col].alias("text")).filter("item is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / most))
    part = lambda b: rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
    return n, ([(r.item, r.text) for r in part(b).collect()] for b in range(n))


def _searched(texts: pa.Array, found: list[Searcher]) -> tuple[pa.Array, pa.Array, pa.Array]:
    got = [x for _, part in chunks(texts) for x in search_texts(part, found)]
    ranges = pa.array([[{"start": s, "end": e} for s, e in runs] for _, runs, _ in got], _SHAPE)
    return pa.array([n for n, _, _ in got], pa.int64()), ranges, pa.array([sorted(ids) for _, _, ids in got], pa.list_(pa.string()))


def contamination(docs: DataFrame, tests: DataFrame, *, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", doc_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Which words of every document lie in windows of the test items.

    `text_col` is the tests' text and `doc_text_col` the documents'. Returns
    `row` (a struct of the document's own columns, whatever they are named),
    n_words, hits (array of word ranges, ends exclusive, apart and ascending)
    and items (ids as strings, ascending), a row for each row of docs; so
    repeated rows, null ids and odd column names pass unchanged. Null and empty
    texts have no words and no hits. Test items without an id or a word match
    nothing; items of the same id count as one.
    """
    context = docs.sparkSession.sparkContext
    place = docs.columns.index(doc_text_col)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    out = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, hits {_HITS}, items array<string>"
    n, each = _passes(tests, id_col, text_col, pass_bytes)
    if n == 1:
        sent = context.broadcast(searchers(next(each), window))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column(0)
            return pa.RecordBatch.from_arrays([own, *_searched(own.field(place), sent.value)], ["row", "n_words", "hits", "items"])

        return batched(rows, run, out)
    return _merged(rows, place, _found_in_passes(docs, each, window, doc_text_col), out)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _found_in_passes(docs: DataFrame, each: Iterator[list[tuple[str, str]]], window: int, text_col: str) -> DataFrame:
    """k1, k2 (hashes of a text), hits and items of texts with hits, one pass over the documents after the other."""
    context = docs.sparkSession.sparkContext
    text = docs[text_col]
    texts = docs.filter(text.isNotNull()).select(*_keys(text), text.alias("text"))
    found = []
    with Scratch(docs.sparkSession) as scratch:
        for items in each:
            sent = context.broadcast(searchers(items, window))

            def run(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
                _, hits, ids = _searched(batch.column(2), sent.value)
                return pa.RecordBatch.from_arrays([*batch.columns[:2], hits, ids], ["k1", "k2", "hits", "items"])

            hit = batched(texts, run, f"k1 long, k2 long, hits {_HITS}, items array<string>").filter("size(items) > 0")
            found.append(scratch.cut(hit.dropDuplicates(["k1", "k2"])))
            sent.destroy()
        items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        return keep(reduce(DataFrame.unionByName, found).groupBy("k1", "k2").agg(F.flatten(F.collect_list("hits")).alias("hits"), items))


def _merged(rows: DataFrame, place: int, found: DataFrame, out: str) -> DataFrame:
    """Rows with what the passes found in their texts; only rows that a bitmap of 1 MB lets through are shuffled."""
    text = F.col("row")[rows.schema["row"].dataType.names[place]]
    near, far = by_bitmap(rows.select("row", *_keys(text)), found, "k1")
    none = F.expr(f"cast(array() as {_HITS})").alias("hits"), F.expr("cast(array() as array<string>)").alias("items")
    far = far.select("row", *none)
    # Rows of one text may be many: they are dealt out by their partitions.
    salted = near.withColumn("salt", F.spark_partition_id() % _SALTS)
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = salted.join(copies, ["k1", "k2", "salt"], "left").select("row", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ranges = [], []
        for at, part in chunks(batch.column(0).field(place)):
            size = np.diff(words_of([t.lower() for t in part], ALNUM).first).tolist()
            for n, old in zip(size, batch.column(1).slice(at, len(part)).to_pylist(), strict=True):
                marks = np.zeros(n if old else 0, dtype=bool)
                for r in old:
                    marks[r["start"] : r["end"]] = True
                counts.append(n)
                ranges.append([{"start": s, "end": e} for s, e in _runs(marks)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ranges, _SHAPE), batch.column(2)], ["row", "n_words", "hits", "items"])

    return batched(far.unionByName(met), run, out)


def verdicts(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated (a hit, and at least one word in `share` hit) to contamination()'s rows."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["start"])
    out = found.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))

