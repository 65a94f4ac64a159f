"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed, the hashes are counted
over all documents, and sentences that lie in any occurrence but the first of
a repeated run are removed. The first occurrence is that of the smallest id,
and in it the earliest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, batched, by_bitmap, join_counted, keep
from taxloom.llm.textvec import SPACED, U, Words, chunks, span_hashes, words_of

#: A span is the shortest run of at least so many sentences and so many words.
SENTENCES, WORDS = 3, 8
#: The option `longest`: sentences of more words are cut after the word of the least hash in each run of CUT words.
#: With LONGEST, copies agree on the first cut or sentence end within 12 words of a passage's edges, and inside no gap
#: exceeds 12: so 50 shared words hold 26 between such ends, and with them a run of 3 sentences and 8 words.
LONGEST, CUT = 12, 6


def _cuts(h: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The word of the least hash (the last of equal ones) in every run of CUT words inside a long sentence; -1 is no such."""
    n = len(h) - CUT + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    least, at = h[:n].copy(), np.arange(n)
    for k in range(1, CUT):
        lower = h[k : n + k] <= least
        least[lower] = h[k : n + k][lower]
        at[lower] = np.flatnonzero(lower) + k
    return at[(sentence[:n] >= 0) & (sentence[:n] == sentence[CUT - 1 :])]


def sentences(words: Words, h: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First word of every sentence (and the number of words at the end), and each text's first sentence.

    A sentence ends at a word that ends in . ! or ?, at a line feed, and at the
    end of the text. Those of more than `longest` words are cut by content, so
    that copies are cut alike wherever they stand.
    """
    n = len(h)
    if not n:
        return np.zeros(1, dtype=np.int64), np.zeros(len(words.first), dtype=np.int64)
    ends = np.isin(words.buf[words.end - 1], np.frombuffer(b".!?", dtype=np.uint8))
    feeds = np.cumsum(words.buf == 10)
    ends[:-1] |= feeds[words.start[1:]] > feeds[words.end[:-1] - 1]
    last = words.first[1:][np.diff(words.first) > 0] - 1
    ends[last] = True
    if longest is not None:
        stop = np.flatnonzero(ends)
        length = np.diff(stop, prepend=-1)
        ends[_cuts(h, np.repeat(np.where(length > longest, np.arange(len(stop)), -1), length))] = True
    at = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return at, np.searchsorted(at, words.first)


def spans(h: np.ndarray, at: np.ndarray, first: np.ndarray, n_sentences: int, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first sentence, end sentence) of every span that fits its text."""
    start = np.arange(len(at) - 1)
    limit = np.repeat(first[1:], np.diff(first))
    end = np.maximum(start + n_sentences, np.searchsorted(at, at[:-1] + n_words))
    held = end <= limit
    start, end = start[held], end[held]
    return span_hashes(h, at[start], at[end]), start, end


def _span_lists(docs: DataFrame, n_sentences: int, n_words: int, longest: int | None) -> DataFrame:
    """k1, k2, id and the distinct span hashes of each row."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, texts in chunks(batch.column(3)):
            w = words_of([t.lower() for t in texts], SPACED)
            h = w.hashes()
            at, first = sentences(w, h, longest)
            hashes, start, _ = spans(h, at, first, n_sentences, n_words)
            cuts = np.searchsorted(start, first)
            out += [np.unique(hashes[cuts[d] : cuts[d + 1]]).view(np.int64) for d in range(len(texts))]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["k1", "k2", "id", "spans"])

    return batched(docs.select("k1", "k2", "id", "text"), run, f"k1 long, k2 long, id {kind}, spans array<long>")


def _without(text: bytes, known: np.ndarray, n_sentences: int, n_words: int, longest: int | None) -> tuple[bytes, int, int]:
    """The text without repeated sentences, its sentences and how many went."""
    w = words_of([text.lower()], SPACED)
    h = w.hashes()
    at, first = sentences(w, h, longest)
    total = len(at) - 1
    hashes, start, end = spans(h, at, first, n_sentences, n_words)
    later = np.ones(len(hashes), dtype=bool)
    later[np.unique(hashes, return_index=True)[1]] = False
    gone = later | np.isin(hashes, known)
    if not gone.any():
        return text, total, 0
    delta = np.zeros(total + 1, dtype=np.int64)
    np.add.at(delta, start[gone], 1)
    np.add.at(delta, end[gone], -1)
    removed = np.cumsum(delta[:-1]) > 0
    edges = np.append(w.start[at[:-1]], len(text))
    edges[0] = 0
    kept = [text[edges[i] : edges[i + 1]] for i in np.flatnonzero(~removed)]
    return b"".join(kept), total, int(removed.sum())


def remove_repeats(docs: DataFrame, *, n_sentences: int = SENTENCES, n_words: int = WORDS, longest: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text without repeated sentences, n_sentences and n_removed, a row for each row of docs.

    Words are compared without ASCII case and without regard to white space; a
    text in which nothing repeats is returned byte for byte. Rows of one id
    count as one document, and so do all rows without an id, which comes after
    every other. Null texts stay null, with no sentences; texts with fewer
    sentences than a span has lose nothing.

    A passage is found if it holds a whole run of `n_sentences` sentences.
    With `longest`, longer sentences count as several, cut by their words, so
    that passages with few or no sentence ends are found too.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    own = own.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "id", "text").alias("k2"), "id", "text")
    with Scratch(docs.sparkSession) as scratch:
        lists = scratch.cut(_span_lists(own, n_sentences, n_words, longest).filter("size(spans) > 0"))
        each = lists.select("k1", "k2", "id", F.explode("spans").alias("span"))
        repeated = scratch.cut(each.groupBy("span").agg(F.min("id").alias("origin"), F.count("*").alias("n")).filter("n > 1"))
        gone = join_counted(each, repeated, "span").filter(~F.col("id").eqNullSafe(F.col("origin")))
        known = keep(gone.groupBy("k1", "k2").agg(F.collect_set("span").alias("known")))
    near, far = by_bitmap(own, known, "k1")
    rows = near.join(known, ["k1", "k2"], "left").select("id", "text", "known").unionByName(far.select("id", "text", F.lit(None).cast("array<bigint>").alias("known")))
    kind = own.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, totals, counts = [], [], []
        for t, k in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            text = t.as_py()
            listed = np.array(k.as_py() or [], dtype=np.int64).view(U)
            new, total, n = _without(text or b"", listed, n_sentences, n_words, longest)
            texts.append(None if text is None else new.decode())
            totals.append(total)
            counts.append(n)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(counts, pa.int64())], ["id", "text", "n_sentences", "n_removed"])

    return batched(rows, run, f"id {kind}, text string, n_sentences long, n_removed long").withColumnRenamed("id", id_col)
