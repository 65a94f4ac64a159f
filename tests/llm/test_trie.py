import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from taxloom.llm import trie
from taxloom.llm.shared import Scratch

SHAPE = "conv_id long, turn long, role string, text string, depth string, path long"


def brute(rows):
    own = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    members, whole = {}, {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    kids, leaves, saved, out = {}, {}, {}, []
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        own_kids = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in own_kids) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in own_kids)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(whole[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), up, len(members[node]), len(own_kids), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some(rng, n=60, words=3, turns=12):
    """Conversations of few different turns, so that prefixes meet."""
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["é" * k for k in range(words)] + [None]), "clash", 1))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    return sorted(map(tuple, trie.prefix_trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("seed,bits", [(1, 64), (2, 64), (3, 3)])
def test_equal_to_brute_force(spark, seed, bits):
    """Also with hashes and fingerprints of three bits, where nearly everything collides and has to be split."""
    rows = some(random.Random(seed), words=2 + seed)
    assert run(spark, rows, bits=bits) == brute(rows)


def test_one_conversation_holds_a_third_of_all_rows(spark):
    rng = random.Random(7)
    rows = some(rng, 40, turns=9)
    rows += [(10, t, "user", f"turn {t % 7}", "", 0) for t in range(len(rows) // 2)]
    rows += [(k, t, "user", f"turn {t % 7}", "", 0) for k in range(1000, 1040) for t in range(k - 999)]  # prefixes of one another
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "first", "", 0), (1, 0, None, None, "", 0), (1, 0, None, None, "", 0), (1, 0, "a", "z", "", 0), (1, 0, "a", "b", "", 0), (None, 0, "user", "nobody", "", 0), (7, 3, "user", "x" * 3_000_000, "", 0), (7, 1, "", "", "", 0)]
    rows += [(5 * k + 4, 0, "user", "alone", "", 0) for k in range(60)]  # short ones without a first: most have no turn left
    got = run(spark, rows)
    assert got == brute(rows) and any(r[1] == 0 for r in got)
    assert run(spark, [r for r in rows if r[0] is None] or rows) == []


def test_many_conversations_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(5 * k, t, "user", "same", "", 0) for k in range(150) for t in range(9)] + some(random.Random(1), 20)
    assert run(spark, rows) == brute(rows)


def test_running_sums_cross_partitions(spark):
    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(40), i, rng.randrange(-(1 << 62), 1 << 62), rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "grp long, at long, h long, v long").withColumn("k", F.lit(0).cast("long"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with Scratch(spark) as scratch:
            got = {(r.grp, r.at): (r.pos, r.v, r.g) for r in trie.running(df, "grp", [F.col("at")], ["at", "h", "k", "v"], scratch, sums=["v"], rolling=True).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    import numpy as np

    pos, total, print_ = {}, {}, {}
    for g, at, h, v in sorted(rows, key=lambda r: (r[0], r[1])):
        n = pos.get(g, 0)
        w = int(trie._weight(np.array([h]), np.array([0]))[0]) * int(trie.powers(n + 1)[0][n])
        pos[g], total[g], print_[g] = n + 1, total.get(g, 0) + v, (print_.get(g, 0) + w) % (1 << 64)
        want = print_[g] - (1 << 64) if print_[g] >> 63 else print_[g]
        assert got[g, at] == (n, total[g], want)
