"""Byte-level BPE by speculation: propose greedily, verify pairs, merge only what fails.

A sequence of tokens is the BPE encoding of its bytes exactly when every token
encodes to itself and every adjacent pair survives on its own. So a word is
first cut by greedy longest match; all adjacent pairs of a batch are then
verified together in numpy, and only words with a failing pair are merged rank
by rank. Verified words are kept in a bounded cache while a task lasts.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from taxloom.llm.shared import batched

#: Fixed: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches in one of the two generations of a task's cache, and their characters.
CACHED_WORDS, CACHED_CHARS = 100_000, 8 << 20
_CHUNK = 2 << 20
#: Longest words that are merged side by side, and how many of them at a time.
_SHORT, _SIDE_BY_SIDE = 40, 2048
_NEVER = 1 << 60


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary: proposal, verification and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        self.id_of: dict[bytes, int] = {}
        for text, i in vocab.items():
            raw = bytes(alphabet[c] for c in text)
            self.bytes_of[i] = raw
            self.id_of[raw] = i
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        n = len(self.bytes_of)
        #: Merge k makes token made[k]; `age` orders tokens by when a merge makes them, bytes first.
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.age = np.zeros(n, dtype=np.int64)
        #: When the merge of a pair (as one integer) comes, and what it makes.
        self.rank: dict[int, int] = {}
        pairs, made = [], []
        for k, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.left[z], self.right[z], self.age[z] = x, y, k + 1
            self.rank[x << 32 | y] = k + 1
            pairs.append(x << 32 | y)
            made.append(z)
        self.made = [-1, *made]
        self.made_array = np.array(self.made)
        self.of_byte = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)])
        #: The longest token that starts with each three bytes.
        self.reach: dict[bytes, int] = {}
        for raw in self.id_of:
            if len(raw) > 2:
                self.reach[raw[:3]] = max(len(raw), self.reach.get(raw[:3], 0))
        order = np.argsort(pairs)
        self.pair_keys = np.array(pairs)[order]
        self.pair_ages = np.arange(1, len(pairs) + 1)[order]
        #: A token is sound if merging its own bytes gives it back.
        self.sound = np.ones(n, dtype=bool)
        z = np.array(made)
        held = self._survives(self.left[z], self.right[z], self.age[z])
        for t, ok in zip(made, held, strict=True):
            self.sound[t] = ok and self.sound[self.left[t]] and self.sound[self.right[t]]
        self.pattern = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        """Empties the caches: Spark reuses its Python workers, so what they keep would weigh on later stages."""
        #: Verified stretches that start a text, and those that follow a space.
        self.heads: list[dict[str, bytes | None]] = [{}, {}]
        self.tails: list[dict[str, bytes | None]] = [{}, {}]
        #: Characters in the first generation of each.
        self.weight = {"": 0, " ": 0}

    def _survives(self, x: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether no merge older than `before` joins the end of x to the start of y.

        The two tokens are taken apart in the reverse order of their merges;
        at every step a merge across the boundary must not come sooner than
        the merge that is undone next. On the same rank the left one goes first.
        """
        ok = np.ones(len(x), dtype=bool)
        at = np.arange(len(x))
        x, y, before = x.copy(), y.copy(), before.copy()
        while len(at):
            key = x << 32 | y
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            joins = (self.pair_keys[k] == key) & (self.pair_ages[k] < before)
            ok[at[joins]] = False
            ax, ay = self.age[x], self.age[y]
            going = ~joins & (np.maximum(ax, ay) > 0)
            at, x, y, ax, ay = at[going], x[going], y[going], ax[going], ay[going]
            undo_x = ax > ay
            before = np.where(undo_x, ax, ay + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get = self.id_of.get
        if (t := get(word)) is not None:
            return [t]
        out, at, n, reach = [], 0, len(word), self.reach.get
        while at < n:
            end = at + reach(word[at : at + 3], 2)
            if end > n:
                end = n
            while (t := get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, leftmost on a tie.

        Pairs wait in a heap, tokens form a linked list, so a word of n bytes
        takes n log n steps.
        """
        rank, made = self.rank.get, self.made
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1]))]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                ahead[k] = i
                if q := rank(ids[i] << 32 | ids[k]):
                    heappush(heap, q << 32 | i)
            if (h := ahead[i]) >= 0 and (q := rank(ids[h] << 32 | ids[i])):
                heappush(heap, q << 32 | h)
        return [t for t in ids if t >= 0]

    def _ages(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """When the merge of each pair comes; _NEVER if none does."""
        key = x << 32 | y
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_ages[k], _NEVER)

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """As merge, for many words at once: in every step each word that still can makes its next merge.

        Words of like length share an array; those over _SHORT bytes go one by one.
        """
        out: list[list[int]] = [[]] * len(words)
        order = sorted((i for i, w in enumerate(words) if len(w) <= _SHORT), key=lambda i: len(words[i]))
        for lo in range(0, len(order), _SIDE_BY_SIDE):
            part = order[lo : lo + _SIDE_BY_SIDE]
            for i, ids in zip(part, self._side_by_side([words[i] for i in part]), strict=True):
                out[i] = ids
        for i, w in enumerate(words):
            if len(w) > _SHORT:
                out[i] = self.merge(w)
        return out

    def _side_by_side(self, words: list[bytes]) -> list[list[int]]:
        n, longest = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        held = np.arange(longest)[None, :] < size[:, None]
        ids = np.full((n, longest + 1), -1)
        ids[:, :longest][held] = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ages = np.full((n, longest + 1), _NEVER)
        pairs = held[:, 1:]
        ages[:, : longest - 1][pairs] = self._ages(ids[:, : longest - 1][pairs], ids[:, 1:longest][pairs])
        going, column = np.arange(n), np.arange(longest)
        done = ids.copy()
        while len(going):
            rows = np.arange(len(going))
            at = ages.argmin(axis=1)
            best = ages[rows, at]
            stop = best == _NEVER
            if stop.any():
                done[going[stop], : ids.shape[1]] = ids[stop]
                done[going[stop], ids.shape[1] :] = -1
                go = ~stop
                going, ids, ages, at, best = going[go], ids[go], ages[go], at[go], best[go]
                if not len(going):
                    break
                rows = np.arange(len(going))
            # What follows the merged pair moves up by one.
            source = column + (column > at[:, None])
            ids, ages = np.take_along_axis(ids, source, 1), np.take_along_axis(ages, source, 1)
            ids[rows, at] = self.made_array[best]
            after = np.where(at + 1 < ids.shape[1], ids[rows, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            ages[rows, at] = np.where(after >= 0, self._ages(ids[rows, at], after), _NEVER)
            inner = at > 0
            ages[rows[inner], at[inner] - 1] = self._ages(ids[rows[inner], at[inner] - 1], ids[rows[inner], at[inner]])
            column = column[:-1]
        counts = (done >= 0).sum(axis=1).tolist()
        return [row[:k] for row, k in zip(done.tolist(), counts, strict=True)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), dtype=bool)
        bad[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        never = np.full(len(pairs), 1 << 60)
        fine = self._survives(pairs >> 32, pairs & 0xFFFFFFFF, never)
        bad[owner[inner[~fine[back]]]] = True
        failing = np.flatnonzero(bad).tolist()
        for i, ids in zip(failing, self.merge_many([words[i] for i in failing]), strict=True):
            proposed[i] = ids
        return proposed

    def _learn(self, caches: list[dict[str, bytes | None]], need: set[str], lead: str) -> None:
        """Makes the first cache hold all of `need`, stretches without spaces; None marks those that need their neighbours.

        A full cache becomes the second one, from which used entries come back.
        """
        if len(caches[0]) > CACHED_WORDS or self.weight[lead] > CACHED_CHARS:
            caches[:] = [{}, caches[0]]
            self.weight[lead] = 0
        cache, older = caches
        new = need - cache.keys()
        self.weight[lead] += sum(map(len, new))
        again = new & older.keys()
        cache.update((part, older[part]) for part in again)
        new -= again
        # Letters only are one piece; all else is for the pattern to cut.
        plain = [part for part in new if part.isalpha()]
        mixed = [(part, None if not part or part[0].isspace() or part[-1].isspace() else [p.encode() for p in self.pattern.findall(lead + part)]) for part in new.difference(plain)]
        words = dict.fromkeys((lead + part).encode() for part in plain)
        for _, pieces in mixed:
            words.update(dict.fromkeys(pieces or ()))
        ids = dict(zip(words, self.encode_words(list(words)), strict=True))
        for part in plain:
            cache[part] = array("I", ids[(lead + part).encode()]).tobytes()
        for part, pieces in mixed:
            cache[part] = None if pieces is None else array("I", [t for p in pieces for t in ids[p]]).tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, by whole-text pre-tokenization."""
        pieces = [p.encode() for p in self.pattern.findall(text)]
        words = list(dict.fromkeys(pieces))
        ids = {w: np.array(i, dtype="<u4").tobytes() for w, i in zip(words, self.encode_words(words), strict=True)}
        return b"".join([ids[p] for p in pieces])

    def _with_added(self, text: str) -> bytes:
        out = []
        cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        for part in cut.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers.

        Nothing here refers to itself, so the search for such garbage, which
        would go through all caches again and again, rests meanwhile.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        special = [any(a in t for a in self.added) for t in texts]
        parts = [None if s else t.split(" ") for t, s in zip(texts, special, strict=True)]
        need: set[str] = set()
        heads: set[str] = set()
        for p in parts:
            if p:
                heads.add(p[0])
                need.update(p[1:])
        self._learn(self.heads, heads, "")
        self._learn(self.tails, need, " ")
        head, tail = self.heads[0], self.tails[0]
        out = []
        for t, p in zip(texts, parts, strict=True):
            if p is None:
                out.append(self._with_added(t))
                continue
            got = [head[p[0]], *map(tail.__getitem__, p[1:])]
            out.append(self._plain(t) if None in got else b"".join(got))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def default_path() -> str:
    """The public byte-level vocabulary that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _sliced(texts: list[str]):
    at = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > _CHUNK and i > at:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    yield texts[at:]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids and decoded, a row for each row.

    A null text counts as empty; an empty text has no tokens. Rows with equal
    or null ids stay apart, other columns are not read. `path` names a
    byte-level BPE file; every executor must be able to open it.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = vocabulary(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids = [x for part in _sliced(texts) for x in bpe.encode(part)]
        decoded = [bpe.decode(x) for x in ids]
        counts = np.array([len(x) // 4 for x in ids])
        flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), lists, pa.array(decoded, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return _run(docs, run, path, id_col, text_col, "n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, with SHA-256 digests in place of the ids and the decoded text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = vocabulary(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        counts, of_ids, of_text = [], [], []
        for part in _sliced(texts):
            for x in bpe.encode(part):
                counts.append(len(x) // 4)
                of_ids.append(hashlib.sha256(x).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(x).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, run, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, run, path: str, id_col: str, text_col: str, more: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return batched(rows, run, f"id {kind}, {more}", done=lambda: vocabulary(path).forget()).withColumnRenamed("id", id_col)
