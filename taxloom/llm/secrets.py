"""Secrets in texts by patterns and by how little a primed compressor knows of a string.

Base spans (assignments, access keys, hex runs) come from regular expressions.
A string is novel if zstandard, primed with the corpus' most frequent
identifiers, needs nearly a byte for each of its characters more to compress
the code around it with the string than without it. Every base span is so
measured, and of all other strings that follow a sensitive word in their line
those that do not compress are reported as well.

Identifiers are counted over all texts; the dictionary has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, batched, streamed
from taxloom.llm.textvec import U, chunks, words_of

#: Kinds of base spans as listed, and the kind that compression adds.
KINDS, NOVEL = ["assign", "access", "hex"], "novel"
#: Bytes of the dictionary; it holds the most frequent identifiers, the most frequent ones last.
DICTIONARY = 32 << 10
#: Code points of the text on either side that count as surrounding code, and how far before a string a sensitive word may stand.
AROUND, NEAR = 160, 64
#: Marginal bytes for a character from which a string is novel, and characters that it has at least.
LEAST, LENGTH = 0.8, 16
#: Identifiers that a task counts before it hands them on.
FLUSH = 200_000

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Every fourth character of a run of 32 or more gives a run of 8 or more.
_HEX_SPARSE = re.compile(r"[0-9a-f]{8}")
#: Words that make what follows in their line sensitive; a letter on either side makes them part of another word.
SENSITIVE_WORDS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "signature", "session", "cert", "salt"]
SENSITIVE = re.compile(r"(?<![A-Za-z])(?:" + "|".join(SENSITIVE_WORDS) + r")(?![A-Za-z])", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature", "session", "cert", "salt")
#: Identifiers: runs of ASCII letters and underscores.
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F]] = True
SPANS = "array<struct<kind:string,start:int,end:int,size:int,marginal:int>>"

Span = tuple[str, int, int, int, int]


def identifier_counts(texts: DataFrame) -> DataFrame:
    """word and n: how often each identifier of 4 to 24 letters and underscores occurs in a `text` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, names = np.empty(0, dtype=U), np.empty(0, dtype=np.int64), np.empty(0, dtype=object)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sums)], ["word", "n"])

        for b in batches:
            for _, part in chunks(b.column(0)):
                w = words_of(part, _LETTERS)
                fits = np.flatnonzero((w.end - w.start >= 4) & (w.end - w.start <= 24))
                k, first, n = np.unique(w.hashes()[fits], return_index=True, return_counts=True)
                known = np.searchsorted(keys, k)
                old = (known < len(keys)) & (keys[np.minimum(known, max(0, len(keys) - 1))] == k) if len(keys) else np.zeros(len(k), dtype=bool)
                sums[known[old]] += n[old]
                new = np.array([w.word(i).decode() for i in fits[first[~old]].tolist()], dtype=object)
                keys, sums, names = (np.concatenate([x, y]) for x, y in ((keys, k[~old]), (sums, n[~old]), (names, new)))
                order = np.argsort(keys)
                keys, sums, names = keys[order], sums[order], names[order]
                if len(keys) >= FLUSH:
                    yield batch()
                    keys, sums, names = keys[:0], sums[:0], names[:0]
        yield batch()

    return streamed(texts.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, *, size: int = DICTIONARY, text_col: str = "text") -> bytes:
    """The corpus' most frequent identifiers, equal counts by name, as many as `size` bytes hold; the most frequent stand last."""
    most = size // 5
    level = F.floor(F.log2("n") * 16).cast("int")
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.cut(identifier_counts(docs.select(docs[text_col].alias("text"))))
        # A histogram of the counts' logarithms tells which words are in for sure, and on which level the rest are.
        left, last = most, None
        for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
            if r["count"] > left:
                last = r.level
                break
            left -= r["count"]
        top = counts.collect() if last is None else counts.filter(level > last).collect() + counts.filter(level == last).orderBy(F.desc("n"), "word").limit(left).collect()
    top.sort(key=lambda r: (-r.n, r.word))
    out, used = [], 0
    for r in top:
        used += len(r.word) + 1
        if used > size:
            break
        out.append(r.word)
    return " ".join(reversed(out)).encode()


def compressor(primed: bytes) -> zstandard.ZstdCompressor:
    options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(primed) < 8:  # zstandard's own bound
        return zstandard.ZstdCompressor(**options)
    known = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=known, **options)


def marginal(z: zstandard.ZstdCompressor, text: str, start: int, end: int) -> int:
    """Bytes that text[start:end] adds to the compressed code around it, which has no other copy of it."""
    own = text[start:end]
    before = text[max(0, start - AROUND) : start].replace(own, "")
    after = text[end : end + AROUND].replace(own, "")
    raw = [x.encode("utf-8", "surrogatepass") for x in (before, own, after)]
    return len(z.compress(raw[0] + raw[1] + raw[2])) - len(z.compress(raw[0] + raw[2]))


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start and end of the secret inside) in code points, by kind as listed and then by start."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_SPARSE.search(text[::4]):
        out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings of LENGTH characters or more that follow a sensitive word in their line and are more than a number."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    found: dict[int, int] = {}
    last = 0
    for word in SENSITIVE.finditer(text):
        if word.end() < last:  # inside a string that follows a word already
            continue
        stop = word.end() + NEAR
        line = text.find("\n", word.end(), stop)
        for m in _CANDIDATE.finditer(text, word.end()):
            if m.start() >= (line if line >= 0 else stop):
                break
            own, last = m.group(), m.end()
            if len(own) >= LENGTH and re.search("[A-Za-z]", own):
                found[m.start()] = m.end()
    return sorted(found.items())


def spans_of(z: zstandard.ZstdCompressor, text: str) -> list[Span]:
    """(kind, start, end, characters of the secret, its marginal bytes) by start and then kind as listed, NOVEL last."""
    base = base_spans(text)
    out = [(kind, a, b, d - c, marginal(z, text, c, d)) for kind, a, b, c, d in base]
    held = sorted((a, b) for _, a, b, _, _ in base)
    starts, reach = [a for a, _ in held], np.maximum.accumulate([b for _, b in held]) if held else []
    for a, b in candidates(text):
        k = int(np.searchsorted(starts, b, "left"))  # base spans that start before its end
        if k and reach[k - 1] > a:
            continue
        m = marginal(z, text, a, b)
        if m >= LEAST * (b - a):
            out.append((NOVEL, a, b, b - a, m))
    rank = {k: i for i, k in enumerate([*KINDS, NOVEL])}
    return sorted(out, key=lambda s: (s[1], rank[s[0]]))


def scan(docs: DataFrame, primed: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `spans` of every row of docs: kind, start, end (code points, ends exclusive), size and marginal bytes of the secret.

    Whole texts are searched; null and empty ones have no spans, and rows that
    are repeated, have no id or have other columns by any name are rows like all others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(primed)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    made: list[zstandard.ZstdCompressor] = []
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("marginal", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(compressor(sent.value))
        found = [[dict(zip(("kind", "start", "end", "size", "marginal"), s, strict=True)) for s in spans_of(made[0], t.as_py() or "")] for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    return batched(own, run, f"id {own.schema['id'].dataType.simpleString()}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != NOVEL)


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
