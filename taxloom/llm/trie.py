"""A prefix trie over conversations, without a tree in any one place.

Every turn has a hash, every prefix of a conversation a polynomial rolling
fingerprint of its turns' hashes, by numpy scans over sorted partitions that
are stitched at their edges. Rows with the same depth and fingerprint are
candidates for one node. Turns of one hash are compared as texts, and turns of
one fingerprint with those of the node's first conversation, one by one; as the
prefixes before them are compared as well, equal nodes hold equal sequences.
What only collided gets keys of its own, from where it parts.

For the rollup each node belongs to the path of its longest conversation, so a
path is a stretch of that conversation down to its end, and paths hang in a
tree that is low: totals of paths go up round by round, and running sums along
the paths give each node's subtree. Sums and fingerprints along a conversation
or path cross partitions by carries, so a long one needs no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, join_counted, keep, streamed
from taxloom.llm.textvec import U, mix, powers

#: A conversation starts with fewer than HEADS turns of the first in its block of BLOCK ids.
BLOCK, HEADS = 5, 9
#: Ids of one piece of a list that is digested, and bits of a fingerprint and of a turn's hash (fewer only in tests).
PIECE, BITS = 8192, 64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64), pa.int64())


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _weight(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A turn's number in fingerprints: of its hash and its place among turns of that hash."""
    return mix(h.view(U) + k.astype(U) * U(0xD1B54A32D192ED03))


def _raised(n: np.ndarray) -> np.ndarray:
    """Powers of the fingerprints' base, also with negative exponents."""
    up, down = powers(int(np.abs(n).max(initial=0)) + 1)
    return np.where(n >= 0, up[np.maximum(n, 0)], down[np.maximum(-n, 0)])


def running(df: DataFrame, group: str, order: list[Column], columns: list[str], scratch: Scratch, sums: list[str] = [], rolling: bool = False, spread: list[Column] | None = None) -> DataFrame:  # noqa: B006
    """`columns` of df (integers) with `pos`, a row's place in its group's order from 0, and running sums, the row included.

    `sums` replaces these columns by their running sums; `rolling` adds `g`, the
    fingerprint of the group's turns (columns h and k) up to the row. Rows are
    dealt by ranges of the group and of `spread` (else of the order); a group
    that lies in several partitions is carried on from one to the next, of which
    the driver gets two short rows for each partition.
    """
    kept = [group, *[c for c in columns if c != group]]
    rows = df.repartitionByRange(group, *(spread or order)).sortWithinPartitions(group, *order).select(*kept, F.spark_partition_id().cast("long").alias("pid"))
    totals = [*sums, *(["g"] if rolling else [])]
    names = [*kept, "pid", "pos", *(["g"] if rolling else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        at, carry, closed = 0, {c: U(0) for c in totals}, False

        def out(following: int | None) -> pa.RecordBatch:
            nonlocal closed
            own = held[group]
            ends = np.append(own[1:] != own[:-1], following is None or following != own[-1])
            edge = np.zeros(len(own), dtype=bool)
            if not closed and ends.any():
                edge[int(np.argmax(ends))], closed = True, True
            edge[-1] |= following is None
            return pa.RecordBatch.from_arrays([*[_signed(held[c]) for c in names], pa.array(edge)], [*names, "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            new = {c: _numbers(b.column(i)) for i, c in enumerate([*kept, "pid"])}
            own = new[group]
            goes_on = bool(held) and held[group][-1] == own[0]
            if held:
                yield out(int(own[0]))
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(first, len(own)))
            pos = np.arange(len(own)) - np.repeat(first, sizes)
            if goes_on:
                pos[: sizes[0]] += at
            new["pos"] = pos
            for c in totals:
                x = _weight(new["h"], new["k"]) * _raised(pos) if c == "g" else new[c].view(U)
                add = np.cumsum(x)
                add -= np.repeat(add[first] - x[first], sizes)
                if goes_on:
                    add[: sizes[0]] += carry[c]
                new[c], carry[c] = add, add[-1]
            at, held = int(pos[-1]) + 1, new
        if held:
            yield out(None)

    kinds = ", ".join(f"{c} long" for c in names)
    table = scratch.cut(streamed(rows, scan, f"{kinds}, edge boolean"))
    before: dict[int, dict[int, tuple]] = {}
    so_far: dict[int, tuple] = {}
    for r in sorted(table.filter("edge").select(group, "pid", "pos", *totals).distinct().collect(), key=lambda r: (r[1], r[2])):
        n, values = so_far.get(r[0], (0, [0] * len(totals)))
        if n:
            before.setdefault(r[1], {})[r[0]] = (n, values)
        shift = int(_raised(np.array([n]))[0])
        so_far[r[0]] = (n + r.pos + 1, [(v + r[c] * (shift if c == "g" else 1)) % (1 << 64) for c, v in zip(totals, values, strict=True)])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {c: _numbers(b.column(i)) for i, c in enumerate(names)}
            for pid in np.unique(own["pid"]).tolist():
                for g, (n, values) in before.get(pid, {}).items():
                    mine = (own["pid"] == pid) & (own[group] == g)
                    for c, v in zip(totals, values, strict=True):
                        own[c][mine] = (own[c][mine].view(U) * (_raised(np.array([n]))[0] if c == "g" else U(1)) + U(v)).view(np.int64)
                    own["pos"][mine] += n
            yield pa.RecordBatch.from_arrays([_signed(own[c]) for c in names], names)

    return streamed(table.select(*names), carried, kinds).drop("pid")


def _turns(conversations: DataFrame, bits: int, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    own = conversations.select(conversations[id_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"), *[F.coalesce(conversations[c].cast("string"), F.lit("")).alias(to) for c, to in ((role_col, "role"), (text_col, "text"))])
    return own.filter("conv is not null").withColumn("h", F.xxhash64("role", "text").bitwiseAND((1 << bits) - 1 if bits < 64 else -1))


def _told_apart(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns with k, 0 but where different turns share a hash: then their place among these."""
    kinds = turns.groupBy("h", "role", "text").agg(F.lit(1).alias("one"))
    shared = scratch.cut(kinds.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    if shared.isEmpty():
        return turns.withColumn("k", F.lit(0).cast("long"))
    of = kinds.join(shared, "h").groupBy("h").agg(F.sort_array(F.collect_list(F.struct("role", "text"))).alias("all"))
    placed = scratch.cut(of.select("h", F.posexplode("all").alias("k", "t")).select("h", "t.role", "t.text", F.col("k").cast("long").alias("k")))
    return turns.join(placed, ["h", "role", "text"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))


def _conversations(scanned: DataFrame) -> DataFrame:
    """conv, n (turns), head (the turns that it takes from its block's first, as structs), skip (own turns that these replace), the fingerprints before and after, and len."""
    first = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "h", "k", "bytes", "g"))
    own = scanned.groupBy("conv").agg((F.max("pos") + 1).alias("n"), F.sort_array(F.collect_list(first)).alias("own"))
    own = own.withColumn("skip", F.crc32(F.col("conv").cast("string")) % HEADS).withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    heads = own.select(F.col("conv").alias("base"), F.col("own").alias("theirs"))
    both = own.join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("theirs", F.lit(1), F.col("skip").cast("int")), F.slice("own", 1, 0)))
    last = lambda items, n: F.when(n > 0, F.element_at(items, F.greatest(n, F.lit(1)).cast("int"))["g"]).otherwise(F.lit(0).cast("long"))
    size = F.size("head").cast("long")
    skipped = F.when(F.col("n") > F.col("skip"), F.col("skip")).otherwise(F.lit(0).cast("long"))
    length = size + F.greatest(F.col("n") - F.col("skip"), F.lit(0))
    return both.select("conv", "n", "skip", "head", size.alias("heads"), last(F.col("head"), size).alias("gb"), last(F.col("own"), skipped).alias("gh"), length.alias("len"))


def _prefixes(scanned: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, len, depth, h, k, bytes, key and pkey (fingerprints with and without the last turn) of every rebuilt turn."""
    each = convs.select("conv", "len", "head", F.posexplode("head").alias("at", "t"))
    before = F.when(F.col("at") > 0, F.element_at("head", F.greatest("at", F.lit(1)))["g"]).otherwise(F.lit(0).cast("long"))
    heads = each.select("conv", "len", (F.col("at") + 1).cast("long").alias("depth"), "t.h", "t.k", "t.bytes", F.col("t.g").alias("key"), before.alias("pkey"))
    joined = join_counted(scanned, convs.select("conv", "n", "skip", "heads", "gb", "gh", "len"), "conv").filter("pos >= skip")
    names = ["conv", "len", "pos", "skip", "heads", "h", "k", "bytes", "g", "gb", "gh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = {c: _numbers(b.column(i)) for i, c in enumerate(names)}
            depth = own["heads"] + own["pos"] - own["skip"] + 1
            key = own["gb"].view(U) + _raised(own["heads"] - own["skip"]) * (own["g"].view(U) - own["gh"].view(U))
            before = key - _weight(own["h"], own["k"]) * _raised(depth - 1)
            yield pa.RecordBatch.from_arrays([_signed(x) for x in (own["conv"], own["len"], depth, own["h"], own["k"], own["bytes"], key, before)], ["conv", "len", "depth", "h", "k", "bytes", "key", "pkey"])

    return heads.unionByName(streamed(joined.select(*names), run, ", ".join(f"{c} long" for c in heads.columns)))


def _nodes_of(prefixes: DataFrame) -> DataFrame:
    return prefixes.groupBy("depth", "key", "pkey", "h", "k").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("bytes").alias("bytes"), F.max(F.struct("len", (-F.col("conv")).alias("minus"))).alias("longest"))


def _verified(prefixes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(prefixes, nodes) in which a depth and a key stand for one sequence of turns.

    A node's turn and the key before it are compared with those of its first
    conversation. Where they differ, that conversation's keys are hashed anew
    from there on with what tells it apart, and all are compared once more.
    """
    while True:
        nodes = scratch.cut(_nodes_of(prefixes))
        clash = scratch.cut(nodes.groupBy("depth", "key").agg(F.count("*").alias("kinds"), F.min(F.struct("conv_id", "pkey", "h", "k")).alias("first")).filter("kinds > 1"))
        if clash.isEmpty():
            return prefixes, nodes
        other = nodes.join(clash, ["depth", "key"]).filter(~((F.col("pkey") == F.col("first.pkey")) & (F.col("h") == F.col("first.h")) & (F.col("k") == F.col("first.k"))))
        other = other.select("depth", "key", "pkey", "h", "k", F.xxhash64("pkey", "h", "k", "depth").alias("token"))
        parts = prefixes.join(other, ["depth", "key", "pkey", "h", "k"]).groupBy("conv").agg(F.min(F.struct("depth", "token")).alias("parts"))
        both = prefixes.join(parts, "conv", "left")
        anew = lambda c, since: F.when(since, F.xxhash64(c, "parts.token")).otherwise(F.col(c)).alias(c)
        prefixes = scratch.cut(both.select("conv", "len", "depth", "h", "k", "bytes", anew("key", F.col("depth") >= F.col("parts.depth")), anew("pkey", F.col("depth") > F.col("parts.depth"))))


def _ends(convs: DataFrame, prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """depth, key and digest of the ids of the conversations that end at a node."""
    zero = F.lit(0).cast("long")
    ends = prefixes.filter("depth = len").select("depth", "key", "conv").unionByName(convs.filter("len = 0").select(zero.alias("depth"), zero.alias("key"), "conv"))
    rows = ends.repartitionByRange("depth", "key", "conv").sortWithinPartitions("depth", "key", "conv")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of nodes whose ids all lie within the partition; of its first and last node, pieces of the list."""
        open_, first = None, True
        ids: list[int] = []
        found: list[tuple] = []

        def piece(whole: bool) -> None:
            text = ",".join(map(str, ids))
            found.append((*open_, ids[0], hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text))
            ids.clear()

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["depth", "key", "at", "sha", "piece"])

        cut = False  # whether pieces of the open node are out already
        for b in batches:
            for node in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if open_ is not None and node[:2] != open_:
                    if ids:
                        piece(not first and not cut)
                    first, cut = False, False
                open_ = node[:2]
                ids.append(node[2])
                if len(ids) >= PIECE:
                    piece(False)
                    cut = True
            yield out()
        if ids:
            piece(False)
        yield out()

    pieces = scratch.cut(streamed(rows, gathered, "depth long, key long, at long, sha string, piece string"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, hashlib.sha256()
        names = ["depth", "key", "sha"]
        one = lambda node, state: pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names)
        for b in batches:
            for depth, key, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (depth, key) != open_:
                    if open_ is not None:
                        yield one(open_, state)
                    open_, state = (depth, key), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
        if open_ is not None:
            yield one(open_, state)

    cut = pieces.filter("piece is not null").repartition("depth", "key").sortWithinPartitions("depth", "key", "at").select("depth", "key", "piece")
    return pieces.filter("sha is not null").select("depth", "key", "sha").unionByName(streamed(cut, digested, "depth long, key long, sha string"))


def _rolled_up(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """path, parent, attach, leaves and saved with what hangs below each path, from paths' own.

    A path whose children are all summed hands its totals to its parent, in
    rounds, as many as the tree of paths is high.
    """
    children = paths.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("waits"))
    rest = scratch.cut(paths.join(children, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0).cast("long"))))
    done = [rest.filter("waits = 0")]
    while not rest.filter("waits > 0").isEmpty():
        handed = done[-1].groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("got"), F.sum("leaves").alias("more"), F.sum("saved").alias("most"))
        left = rest.filter("waits > 0").join(handed, "path", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        rest = scratch.cut(left.select("path", "parent", "attach", plus("leaves", "more"), plus("saved", "most"), (F.col("waits") - F.coalesce("got", F.lit(0))).alias("waits")))
        done.append(rest.filter("waits = 0"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("waits")


def prefix_trie(conversations: DataFrame, *, bits: int = BITS, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Rows without an id belong to no conversation. Null turns come first, equal
    turns go by role and then text (both null as empty), and repeated rows are
    turns each. Without conversations there is no node, not even the root.
    Other columns don't matter.
    """
    with Scratch(conversations.sparkSession) as scratch:
        return keep(_trie(conversations, scratch, bits, id_col, turn_col, role_col, text_col))


def _trie(conversations: DataFrame, scratch: Scratch, bits: int, *columns: str) -> DataFrame:
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    turns = _told_apart(_turns(conversations, bits, *columns), scratch).withColumn("bytes", F.octet_length("text").cast("long"))
    by_turn = F.asc_nulls_first("turn")
    scanned = running(turns, "conv", [by_turn, F.col("role"), F.col("text")], ["h", "k", "bytes"], scratch, rolling=True, spread=[by_turn, F.col("role"), F.substring("text", 1, 64)])
    convs = scratch.cut(_conversations(scanned))
    prefixes = _prefixes(scanned, convs)
    if bits < 64:
        prefixes = prefixes.withColumns({c: F.col(c).bitwiseAND((1 << bits) - 1) for c in ("key", "pkey")})
    prefixes, found = _verified(scratch.cut(prefixes), scratch)
    all_convs = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max(F.struct("len", (-F.col("conv")).alias("minus"))).alias("longest")).filter("n_convs > 0")
    root = all_convs.select(zero.alias("depth"), zero.alias("key"), none.alias("pkey"), "n_convs", "conv_id", zero.alias("bytes"), "longest")
    nodes = found.drop("h", "k").unionByName(root).withColumn("path", -F.col("longest.minus")).withColumn("plen", F.col("longest.len")).drop("longest")
    nodes = scratch.cut(nodes.withColumn("node", F.struct("depth", "key")))

    # Paths, where each hangs, and what is below.
    worth = (F.col("n_convs") - 1) * F.col("bytes")
    tops = nodes.groupBy("path").agg(F.min(F.struct("depth", "pkey")).alias("top"), F.sum(worth).alias("saved"))
    tops = scratch.cut(tops.select("path", (F.col("top.depth") - 1).alias("attach"), F.struct((F.col("top.depth") - 1).alias("depth"), F.col("top.pkey").alias("key")).alias("node"), "saved"))
    held = tops.filter("attach >= 0")
    parents = scratch.cut(held.groupBy("node").agg(F.count("*").alias("n")).join(nodes.select("node", F.col("path").alias("parent"), F.col("conv_id").alias("above")), "node"))
    hung = scratch.cut(join_counted(held, parents, "node").select("path", "parent", "above", "attach", "saved"))
    alone = tops.filter("attach < 0").select("path", none.alias("parent"), none.alias("above"), "attach", "saved")
    paths = hung.unionByName(alone).withColumn("leaves", F.lit(1).cast("long"))
    totals = _rolled_up(paths.select("path", "parent", "attach", "leaves", "saved"), scratch)
    below = totals.filter("parent is not null").groupBy(F.col("parent").alias("path"), F.col("attach").alias("depth")).agg(F.count("*").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    # Each node's subtree: what hangs at it and at the nodes after it on its path.
    last = (F.col("depth") == F.col("plen")).cast("long")
    or_none = lambda c: F.coalesce(c, zero)
    valued = nodes.join(below, ["path", "depth"], "left").select(
        "path", "depth", "key", "conv_id", "n_convs", (1 - last + or_none(F.col("n"))).alias("n_children"), (last + or_none(F.col("leaves"))).alias("n_leaves"), (worth + or_none(F.col("saved"))).alias("saved_tokens")
    )
    summed = running(valued, "path", [F.desc("depth")], ["depth", "key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], scratch, sums=["n_leaves", "saved_tokens"])
    above = nodes.filter("depth < plen").select("path", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    above = above.unionByName(hung.select("path", (F.col("attach") + 1).alias("depth"), F.col("above").alias("parent_conv_id")))
    out = summed.join(above, ["path", "depth"], "left").join(_ends(convs, prefixes, scratch), ["depth", "key"], "left")
    ends = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
