"""Language-model scores of whole documents.

Words are counted over all training texts, as 64-bit hashes. The most frequent
ones are broadcast (a fixed number, whatever the corpus); counts of all others
reach the documents through a join. The recurrent model knows the top of that
list; a word outside its vocabulary has the model's probability of such a word
times the word's smoothed share among them, so scores are over whole texts.

The counts, and with them the vocabulary and the output biases, cover all
training texts, and so do the network's weights: every training token is
learned from once. In each of ROUNDS rounds the tasks start from the same
weights, stream through parts of texts by truncated backpropagation, and their
weights are averaged by the number of tokens.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm import gru
from taxloom.llm.shared import Scratch, batched, keep, streamed
from taxloom.llm.textvec import SPACED, U, chunks, mix, words_of

#: Words whose counts are broadcast, and words of the network's vocabulary.
HOT, VOCABULARY = 300_000, 2_000
HIDDEN = 16
#: Adam's step size in the first round; it falls to a fifth of that.
RATE = 0.01
#: Tokens of a part of a text; rounds after each of which the tasks' weights are averaged. Each part belongs to one round.
PART, ROUNDS = 256, 4
#: Tokens that a task learns from at least in a round, about, and tokens that it gathers before it goes through them.
SHARD, FEED = 1 << 18, 1 << 20
END_HASH = 0x2545F4914F6CDD1D


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    w = words_of([t.lower() for t in texts], SPACED)
    return w.hashes(), w.first


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash) and n over a `text` column; the end of every text counts as END_HASH."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sums = np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
        for _, part in chunks(batch.column(0), 4 << 20):
            k, n = np.unique(_hashes(part)[0], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
        keys, sums = np.append(keys, U(END_HASH)), np.append(sums, batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["word", "n"])

    return batched(texts.select("text"), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of at most `most` words, the most frequent first.

    A histogram of the counts' logarithms tells down to which count all words
    fit, so no task sends more than its own share of them.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    left, least = most, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.level
    if least is None:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    top = words.filter(level >= least).toArrow()
    h, n = top.column("word").to_numpy().view(U), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


@dataclass
class Model:
    """What tasks need: hot words (sorted hashes) with counts and tokens, totals and the network."""

    hot: np.ndarray
    counts: np.ndarray
    #: Token of every hot word; UNK outside the vocabulary.
    token: np.ndarray
    total: int
    distinct: int
    ends: int
    net: gru.Gru
    #: Smoothed mass of the words outside the vocabulary.
    outside: float
    #: Whether every counted word is hot.
    whole: bool

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hot or not, place) of each word."""
        if not len(self.hot):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return self.hot[at] == h, at

    def tokens(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts, each closed by END, and each text's first."""
        known, at = self.lookup(h)
        flat = np.where(known, self.token[at] if len(self.hot) else gru.UNK, gru.UNK)
        n = np.diff(first)
        cuts = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(cuts[-1]), gru.END)
        out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = flat
        return out, cuts


def untrained(counts: DataFrame, *, hot: int = HOT, vocabulary: int = VOCABULARY, hidden: int = HIDDEN) -> Model:
    """A model from the counts of all training words, whose network gives each token its share."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.filter(F.col("word") != END_HASH)
    ends = counts.filter(F.col("word") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    h, n = most_frequent(words, hot)
    token = np.full(len(h), gru.UNK)
    token[:vocabulary] = np.arange(2, 2 + min(vocabulary, len(h)))
    inside = n[:vocabulary]
    beyond = int(total - ends - inside.sum())
    net = gru.new(np.concatenate([[ends, beyond], inside]).astype(float), hidden)
    order = np.argsort(h)
    n_beyond = max(0, distinct - (ends > 0) - len(inside))
    model = Model(h[order], n[order], token[order], int(total), int(distinct), int(ends), net, beyond + 0.5 * (n_beyond + 1), len(h) + (ends > 0) >= distinct)
    return model


def _drawn(tokens: list[bytes], keys: np.ndarray, rounds: int, turn: int) -> tuple[list[np.ndarray], list[int]]:
    """The parts of texts whose turn it is, and the token before each."""
    flat = np.frombuffer(b"".join(tokens), dtype=np.uint16)
    size = np.array([len(t) // 2 for t in tokens])
    first = np.cumsum(size) - size
    n = -(-size // PART)
    doc = np.repeat(np.arange(len(tokens)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    own = mix(keys[doc] + U(0x9E3779B97F4A7C15) * (k + 1).astype(U)) % U(rounds) == turn
    doc, k = doc[own], k[own]
    lo = first[doc] + PART * k
    hi = np.minimum(lo + PART, first[doc] + size[doc])
    return [flat[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], np.where(k == 0, gru.END, flat[lo - 1]).tolist()


def train(model: Model, rows: DataFrame, *, rounds: int = ROUNDS, shard: int = SHARD, passes: int = 1) -> None:
    """Fits the model's network to all of `rows` (`key`, and `tokens` as 16-bit integers).

    A task holds one feed of tokens, however much it reads. Tasks are at most
    twice the cluster's cores, so what is averaged does not grow with the
    corpus. Which parts a task sees depends on the input's partitions, and
    with them the weights do a little.
    """
    context = rows.sparkSession.sparkContext
    tasks = int(np.clip(model.total // (rounds * shard), 1, 2 * context.defaultParallelism))
    for turn in range(rounds):
        sent = context.broadcast(model.net)
        rate = RATE * (1 - 0.8 * turn / rounds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(copy.deepcopy(sent.value), rate)
            held, before, size, seen = [], [], 0, 0

            def learn() -> None:
                for _ in range(passes):
                    trainer.feed(held, before)

            for batch in batches:
                if not batch.num_rows:
                    continue
                more, ahead = _drawn(batch.column(1).to_pylist(), batch.column(0).to_numpy().view(U), rounds, turn)
                held += more
                before += ahead
                size += sum(map(len, more))
                if size >= FEED:
                    learn()
                    held, before, seen, size = [], [], seen + size, 0
            if size:
                learn()
            if seen + size:
                flat = np.concatenate([p.ravel() for p in trainer.m.params()]).astype(np.float64)
                n = float(seen + size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * n), pa.array(np.full(len(flat), n))], ["at", "w", "n"])

        got = streamed(rows.select("key", "tokens").coalesce(tasks), run, "at int, w double, n double").groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
        if not got.num_rows:
            continue
        flat = np.empty(got.num_rows)
        flat[got.column("at").to_numpy()] = got.column("w").to_numpy()
        lo = 0
        for p in model.net.params():
            p[...] = flat[lo : lo + p.size].reshape(p.shape)
            lo += p.size


def _part(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    """key, id, learn, n_tokens, and over words with a known count: n_known, sums of log10(c + 0.5); the rest as lists; tokens."""
    ends = log10(model.ends + 0.5)
    n_tokens, n_known, base, outer, n_unk, tail_h, tail_n, tail_len, tokens = [], [], [], [], [], [], [], [], []
    for _, texts in chunks(batch.column(3)):
        h, first = _hashes(texts)
        known, at = model.lookup(h)
        c = np.where(known, model.counts[at] if len(model.hot) else 0, 0)
        sure = known | model.whole  # a word that is not hot has count 0 where all are
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        logs = np.where(sure, np.log10(c + 0.5), 0.0)
        t, cuts = model.tokens(h, first)
        unk = np.delete(t, cuts[1:] - 1) == gru.UNK
        size = len(texts)
        n_tokens.append(np.diff(first) + 1)
        n_known.append(np.bincount(doc, weights=c > 0, minlength=size).astype(np.int64) + (model.ends > 0))
        base.append(np.bincount(doc, weights=logs, minlength=size) + ends)
        outer.append(np.bincount(doc, weights=logs * unk, minlength=size))
        n_unk.append(np.bincount(doc, weights=unk, minlength=size).astype(np.int64))
        order = np.flatnonzero(~sure)
        d, x = doc[order], h[order]
        by = np.lexsort((x, d))
        d, x = d[by], x[by]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
        here = np.flatnonzero(new)
        tail_h.append(x[here].view(np.int64))
        tail_n.append(np.diff(np.append(here, len(d))))
        tail_len.append(np.bincount(d[here], minlength=size))
        raw = t.astype(np.uint16)
        tokens += [raw[i:j].tobytes() for i, j in itertools.pairwise(cuts.tolist())]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(tail_len))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (tail_h, tail_n)]
    columns = [*batch.columns[:3], *(pa.array(np.concatenate(x)) for x in (n_tokens, n_known, base, outer, n_unk)), *lists, pa.array(tokens, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "id", "learn", "n_tokens", "n_known", "base", "outer", "n_unk", "tail", "times", "tokens"])


def _with_network(rows: DataFrame, net: gru.Gru) -> DataFrame:
    """rows with lp, the network's log10 probability of their tokens, in place of these."""
    sent = rows.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in rows.columns if c != "tokens"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column(len(kept)).to_pylist()
        cuts = np.cumsum([0, *(len(t) // 2 for t in tokens)])
        lp = gru.score(sent.value, np.frombuffer(b"".join(tokens), dtype=np.uint16), cuts) / log(10)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lp)], [*kept, "lp"])

    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return batched(rows.select(*kept, "tokens"), run, f"{shape}, lp double")


def score(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, vocabulary: int = VOCABULARY, hidden: int = HIDDEN, **training) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score, a row for each row of docs.

    `learn` is a condition on `id` that marks the training rows. Texts are
    lower-cased in ASCII and cut at white space; null texts are empty, and an
    empty text still has its end. Repeated rows count each time, null ids are
    ids of their own text. Without training rows every probability is that of
    an unseen word. The vocabulary has less than 65,000 words.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    own = own.select(F.xxhash64("id", "text").alias("key"), "id", F.coalesce(learn, F.lit(False)).alias("learn"), "text")
    with Scratch(spark) as scratch:
        counts = scratch.cut(word_counts(own.filter("learn")))
        model = untrained(counts, hot=hot, vocabulary=vocabulary, hidden=hidden)
        sent = spark.sparkContext.broadcast(model)
        kind = own.schema["id"].dataType.simpleString()
        shape = f"key long, id {kind}, learn boolean, n_tokens long, n_known long, base double, outer double, n_unk long, tail array<long>, times array<long>, tokens binary"
        rows = scratch.cut(batched(own, lambda b: _part(b, sent.value), shape))
        train(model, rows.filter("learn"), **training)
        scored = _with_network(rows.drop("tail", "times"), model.net)
        add = F.lit(0.0).alias("logs"), F.lit(0).cast("long").alias("known")
        if not model.whole:
            each = rows.filter("size(tail) > 0").select("key", "id", F.posexplode(F.arrays_zip("tail", "times")).alias("k", "w"))
            each = each.select("key", "id", F.col("w.tail").alias("word"), F.col("w.times").alias("times"), (F.col("k") == 0).cast("long").alias("copies"))
            c = F.coalesce("n", F.lit(0))
            met = each.join(counts, "word", "left").select("key", "id", "copies", (F.col("times") * F.log10(c + 0.5)).alias("logs"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"))
            sums = met.groupBy("key", "id").agg(F.sum("logs").alias("s"), F.sum("known").alias("k"), F.sum("copies").alias("copies"))
            # Copies of a row share a key: each has its part of the sum.
            sums = sums.select(F.col("key").alias("k1"), F.col("id").alias("k2"), (F.col("s") / F.col("copies")).alias("s"), F.expr("k div copies").alias("k"))
            scored = scored.join(sums, (scored["key"] == sums["k1"]) & scored["id"].eqNullSafe(sums["k2"]), "left")
            add = F.coalesce("s", F.lit(0.0)).alias("logs"), F.coalesce("k", F.lit(0)).cast("long").alias("known")
        rows = scored.select("*", *add)
        norm = log10(model.total + 0.5 * (model.distinct + 1))
        base = F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(norm)
        lm = F.col("lp") + F.col("outer") + F.col("logs") - F.col("n_unk") * F.lit(log10(model.outside))
        return keep(rows.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), lm.alias("score")))
