"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

Each permutation keeps both its minimum and its maximum, so a signature of 128
values costs 64 hash evaluations. Texts with equal shingle sets fall into one
class first; signatures are banded for class representatives only.

Buckets of a band are handled by size, without ever emitting all pairs of a
large one:

* rows of hot bands, classes and components stay where they are: what they are
  joined with is small, and that of the hottest ones is broadcast;
* small buckets yield their pairs;
* of a large bucket, members whose shared shingles are too few for any link
  leave first, by an exact bound. The rest yields a star around the member
  with the smallest share of shingles of its own. What stars and small buckets
  leave outside the component of a bucket's centre is compared with the bucket
  block by block: a task gets two bounded blocks, counts all intersections at
  once and emits only a spanning forest of the links that it finds.

Pairs are filtered by the signatures' estimate (five standard errors below the
threshold) and confirmed on full sets. Components come from alternating
minimum-label steps, all of them joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, batched, by_bitmap, join_counted, keep
from taxloom.llm.textvec import SPACED, U, chunks, combine, mix, words_of

PERMUTATIONS = 64
BANDS, ROWS = 30, 3
#: Buckets up to this size yield all their pairs: at most (SMALL - 1) / 2 for each member.
SMALL = 24
#: Members in one block of a large bucket, on average, and shingles of all of them.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Pairs of a bucket's centre that share a copy of its shingles.
STAR = 512

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << U(1)) | U(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and each text's first."""
    w = words_of([t.lower() for t in texts], SPACED)
    h = w.hashes()
    sh, pos = combine(h, w.first, words)
    doc = np.searchsorted(w.first, pos, "right") - 1
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    whole = np.zeros(len(short), dtype=U)
    for k in range(words - 1):
        held = n_words[short] > k
        whole[held] = mix(whole[held] + h[w.first[short[held]] + k] + U(k + 1))
    sh, doc = np.concatenate([sh, whole]), np.concatenate([doc, short])
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    keep = np.ones(len(sh), dtype=bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    sh, doc = sh[keep], doc[keep]
    return sh, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(sh: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum and maximum under every permutation, for texts that have shingles: values in 2 * PERMUTATIONS columns."""
    full = np.flatnonzero(np.diff(first))
    at = first[:-1][full]
    out = np.zeros((len(first) - 1, 2 * PERMUTATIONS), dtype=U)
    if len(full):
        for k in range(PERMUTATIONS):
            x = sh * _MUL[k] + _ADD[k]
            out[full, k] = np.minimum.reduceat(x, at)
            out[full, PERMUTATIONS + k] = np.maximum.reduceat(x, at)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    """A key for every band; its rows come from different permutations."""
    keys = np.empty((len(sig), BANDS), dtype=U)
    for b in range(BANDS):
        acc = np.full(len(sig), b + 1, dtype=U)
        for r in range(ROWS):
            acc = mix(acc + sig[:, (b * ROWS + r) * 37 % (2 * PERMUTATIONS)])
        keys[:, b] = acc
    return keys


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """id, n_shingles, cls (16 bytes that name the shingle set), bands and sig (16 bits a value)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, cls, bands, sigs = [], [], [], []
        for _, texts in chunks(batch.column(1)):
            sh, first = shingle_sets(texts, words)
            sig = signatures(sh, first)
            keys, low = _bands(sig).view(np.int64), (sig >> U(7)).astype(np.uint16)
            n = np.diff(first)
            sizes += n.tolist()
            for i in range(len(texts)):
                some = n[i] > 0
                cls.append(hashlib.blake2b(sh[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() if some else None)
                bands.append(keys[i] if some else None)
                sigs.append(low[i].tobytes() if some else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["id", "n_shingles", "cls", "bands", "sig"])

    return batched(docs, run, f"id {kind}, n_shingles long, cls binary, bands array<long>, sig binary")


def _having(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in ids."""
    return by_bitmap(docs, ids, "id")[0].join(ids, "id", "left_semi")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls and set (sorted 64-bit hashes) of the wanted classes, from one text of each."""
    ids = classes.select("id", "cls").join(wanted, "cls", "left_semi").select("id")
    texts = _having(docs, ids.filter("id is not null").distinct()).unionByName(docs.filter("id is null"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cls, sets = [], []
        for _, part in chunks(batch.column(0)):
            sh, first = shingle_sets(part, words)
            for i in range(len(part)):
                own = sh[first[i] : first[i + 1]]
                if len(own):
                    cls.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sets.append(own.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "set"])

    made = batched(texts.select("text"), run, "cls binary, set array<long>")
    return made.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])


def _with_ends(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """a, b and the value of each from `table` (a row for each cls).

    Pairs (a, b, salt) of a centre are many: each of its salts has a copy of its value.
    """
    a = pairs.select("a", "salt").distinct().join(table.select(F.col("cls").alias("a"), F.col(value).alias(f"{value}_a")), "a")
    b = table.select(F.col("cls").alias("b"), F.col(value).alias(f"{value}_b"))
    return pairs.join(a, ["a", "salt"]).join(b, "b").select("a", "b", "salt", f"{value}_a", f"{value}_b")


def _estimated(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures do not rule the threshold out."""
    n = 2 * PERMUTATIONS
    least = n * (threshold - 5 * (threshold * (1 - threshold) / n) ** 0.5)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, n) for k in (3, 4))
        return batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b", "salt"])

    return batched(_with_ends(pairs, sigs, "sig"), run, "a binary, b binary, salt int")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.values.to_numpy().view(U), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that link on full sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for p, q in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True):
            both = np.concatenate([p, q])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(p) + len(q) - common))
        return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return batched(_with_ends(pairs, sets, "set").drop("salt"), run, "a binary, b binary")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """cls and comp (the smallest cls reachable) of every end of an edge (a, b).

    Alternates two steps until neither changes an edge: every larger neighbour
    is tied to the node's smallest neighbour, then every smaller one is.
    """
    ordered = lambda d: d.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state_of = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.cut(ordered(edges))
    before = state_of(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = ordered(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a")
        last, now = now, scratch.cut(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        scratch.drop(last)
        state = state_of(now)
        if state == before:
            break
        before = state
    ends = now.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("cls"), F.col("b").alias("comp")).unionByName(ends)


def _merged(comps: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """Components after more links (a, b): the links join whole components, so only these are connected anew."""
    of = lambda end: comps.select(F.col("cls").alias(end), F.col("comp").alias(f"comp_{end}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    links = scratch.cut(ends.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")))
    joined = components(links, scratch).select(F.col("cls").alias("old"), F.col("comp").alias("new"))
    known = comps.join(joined, comps["comp"] == joined["old"], "left").select("cls", F.coalesce("new", "comp").alias("comp"))
    alone = joined.join(comps, joined["old"] == comps["cls"], "left_anti").select(F.col("old").alias("cls"), F.col("new").alias("comp"))
    return known.unionByName(alone)


def _common(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of incidence matrices."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def cells(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        held = np.flatnonzero(shared[at] == values)
        held = held[np.argsort(at[held], kind="stable")]
        return row[held], at[held]

    if len(shared):
        (ra, ca), (rb, cb) = cells(a, left), cells(b, right)
        for lo in range(0, len(shared), width):
            dense = []
            for r, c, n in ((ra, ca, len(left)), (rb, cb, len(right))):
                i, j = np.searchsorted(c, [lo, lo + width])
                m = np.zeros((n, width), dtype=np.float32)
                m[r[i:j], c[i:j] - lo] = 1
                dense.append(m)
            out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _forest(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between two blocks that join components, no more than make a forest."""
    p, q = ([np.asarray(x).view(U) for x in side["set"]] for side in (left, right))
    common = _common(p, q)
    sizes = np.array([len(x) for x in p])[:, None] + np.array([len(x) for x in q])[None, :]
    linked = 100 * common >= percent * (sizes - common)
    comp_l, comp_r, cls_l, cls_r = left["comp"].tolist(), right["comp"].tolist(), left["cls"].tolist(), right["cls"].tolist()
    root = {c: c for c in (*comp_l, *comp_r)}

    def find(c: bytes) -> bytes:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = find(comp_l[i]), find(comp_r[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((cls_l[i], cls_r[j]))
    return out


def _central(large: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Members (band, cls) of large buckets that may link there, with the bucket's centre as lead and its members left, n.

    A shingle that no other class has is in no intersection. A text of n
    shingles, s of them shared, that links with one of m has
    100 * s >= percent * (n + m - s), and 100 * m >= percent * n.
    """
    each = sets.select("cls", F.explode("set").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("cls").alias("cls")).filter("n = 1").groupBy("cls").agg(F.count("*").alias("own"))
    sized = sets.select("cls", F.size("set").alias("size")).join(alone, "cls", "left").select("cls", "size", F.coalesce("own", F.lit(0)).alias("own"))
    members = scratch.cut(large.join(sized, "cls"))
    least = members.groupBy("band").agg(F.min("size").alias("least"), F.count("*").alias("n"))
    partner = F.greatest(100 * F.col("least"), percent * F.col("size"))
    shared = F.col("size") - F.col("own")
    able = scratch.cut(join_counted(members, least, "band").filter(10000 * shared >= percent * (100 * (F.col("size") - shared) + partner)).drop("n"))
    lead = able.groupBy("band").agg(F.min(F.struct((F.col("own") / F.col("size")).alias("share"), "cls")).alias("first"), F.count("*").alias("n"))
    lead = lead.filter("n > 1").select("band", F.col("first.cls").alias("lead"), "n")
    out = scratch.cut(join_counted(able.select("band", "cls"), lead, "band"))
    scratch.drop(members, able)
    return out


def _block_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame | None:
    """Links that join members of large buckets to others of their bucket, where components still differ.

    Those outside the centre's component are dealt out in blocks, and so is
    the whole bucket; every block of the former meets every one of the latter.
    Blocks are bounded by members and by shingles.
    """
    sized = sets.select("cls", F.size("set").cast("long").alias("size"))
    tagged = members.drop("n").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).join(sized, "cls")
    centre = comps.select(F.col("cls").alias("lead"), F.col("comp").alias("main"))
    leads = members.groupBy("lead").agg(F.count("*").alias("n")).join(centre, "lead", "left")
    tagged = scratch.cut(join_counted(scratch.cut(tagged), leads, "lead").drop("n").withColumn("out", F.col("comp") != F.coalesce("main", "lead")))
    out = F.when(F.col("out"), F.col("size")).otherwise(0)
    counts = tagged.groupBy("band").agg(F.count("*").alias("n"), F.count_if("out").alias("n_out"), F.sum("size").alias("size"), F.sum(out).alias("size_out")).filter("n_out > 0")
    blocks = lambda n, size: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_SHINGLES)).cast("int")
    counts = counts.select("band", "n", blocks("n", "size").alias("blocks"), blocks("n_out", "size_out").alias("out_blocks"))
    rest = scratch.cut(join_counted(tagged, counts, "band").select("band", "cls", "comp", "out", "blocks", "out_blocks"))
    if rest.isEmpty():
        return None
    place = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.filter("out").select("band", "cls", "comp", F.lit(True).alias("left"), place("out_blocks").alias("i"), each("blocks").alias("j"))
    right = rest.select("band", "cls", "comp", F.lit(False).alias("left"), each("out_blocks").alias("i"), place("blocks").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["left"]], pdf[~pdf["left"]]
        found = _forest(a, b, percent) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["a", "b"])

    return left.unionByName(right).join(sets, "cls").groupBy("band", "i", "j").applyInPandas(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept, a row for each row of docs.

    Two texts link if 100 * intersection >= percent * union of their sets of
    `words`-word shingles (ASCII-lower-cased; a shorter text is one shingle);
    component_id is the smallest id reachable through links. Rows of one id
    stay rows of their own, and all that carry the component's id are kept.
    Null ids never name a component: such rows are kept only where no id is in
    reach. Texts without words (null, empty, blank) link with nothing.

    A link at the threshold itself escapes all bands with probability 1e-7.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        prints = scratch.cut(_fingerprints(own, words))
        classes = scratch.cut(prints.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
        # Signatures and bands are kept for classes only.
        rows = scratch.cut(prints.select("id", "n_shingles", "cls"))
        scratch.drop(prints)
        banded = classes.select("cls", F.explode("bands").alias("band"))
        buckets = scratch.cut(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"))
        members = scratch.cut(join_counted(banded, buckets, "band"))
        small = members.filter(f"n <= {SMALL}").groupBy("band").agg(F.sort_array(F.collect_list("cls")).alias("m"))
        firsts = small.select(F.posexplode("m").alias("k", "a"), "m")
        pairs = firsts.select("a", F.explode(F.expr("slice(m, k + 2, size(m))")).alias("b"), F.lit(0).alias("salt"))
        large = members.filter(f"n > {SMALL}").select("band", "cls")
        any_large = not buckets.filter(f"n > {SMALL}").isEmpty()
        if any_large:
            sets = scratch.cut(_sets(own, classes, large.select("cls").distinct(), words))
            large = _central(large, sets, percent, scratch)
            salt = F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / STAR)).cast("int")
            pairs = pairs.unionByName(large.filter("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"), salt.alias("salt")))
        pairs = pairs.groupBy("a", "b").agg(F.min("salt").alias("salt"))
        likely = scratch.cut(_estimated(pairs, classes.select("cls", "sig"), percent / 100))
        scratch.drop(buckets, members)
        wanted = likely.select(F.col("a").alias("cls")).unionByName(likely.select(F.col("b").alias("cls"))).distinct()
        if any_large:
            wanted = wanted.join(sets.select("cls"), "cls", "left_anti")
        more_sets = scratch.cut(_sets(own, classes, wanted, words))
        edges = scratch.cut(_confirmed(likely, sets.unionByName(more_sets) if any_large else more_sets, percent))
        comps = components(edges, scratch)
        scratch.drop(likely, more_sets, edges)
        if any_large:
            more = _block_links(large, comps, sets, percent, scratch)
            if more is not None:
                comps = _merged(comps, more, scratch)
        named = scratch.cut(classes.select("cls", "id", "n").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
        if any_large:
            scratch.drop(sets, large)
        least = named.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
        by_class = scratch.cut(join_counted(named.withColumnRenamed("n", "rows"), least, "comp").select("cls", F.col("rows").alias("n"), "component_id"))
        scratch.drop(classes, named)
        worded = join_counted(rows.filter("cls is not null"), by_class, "cls").select("id", "n_shingles", "component_id")
        out = worded.unionByName(rows.filter("cls is null").select("id", "n_shingles", F.col("id").alias("component_id")))
        return keep(out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest id, with the same columns.

    A document is an id and a text: other texts of its id are documents of
    their own, of equal ones the smaller hash of the text stays, rows that
    repeat both stay or go together. Documents without an id come after all
    others. Texts without words are nobody's copies and stay.
    """
    text = docs[text_col]
    own = F.struct(docs[id_col].isNull().alias("none"), docs[id_col].alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    rows = docs.select(own.alias("id"), text.alias("text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    gone = near_duplicates(rows.select("id", "text"), id_col="id", **parameters).filter("not kept").select("id").distinct()
    gone = keep(gone)
    near, far = by_bitmap(rows.select("id", "row"), gone, "id")
    return near.join(gone, "id", "left_anti").unionByName(far).select("row.*")
