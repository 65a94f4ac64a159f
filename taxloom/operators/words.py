"""Which of many words occur in a text.

`sought` runs one automaton of all words along the texts of a batch, side by
side in numpy, and keeps what is held as bits, which compiled code tests.
`present` is a column expression for words in any number: they become one
pattern in the shape of a trie that is looked for at every place.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a mask, and most words for which masks are made.
BITS, MOST_SOUGHT = 62, 1500
#: Bytes of a text that are walked in one go; longer ones go in pieces that overlap, side by side.
_PIECE = 256


def listed(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.expr("cast(array() as array<string>)")


def _escaped(c: str) -> str:
    return c if c.isalnum() or c == " " else "\\" + c


def _either(ways: list[tuple[str, str]]) -> str:
    """A pattern for any of (first character, rest), halved until few are left, so that few are tried."""
    if len(ways) <= 2:
        both = "|".join(_escaped(c) + rest for c, rest in ways)
        return f"(?:{both})" if len(ways) > 1 else both
    left, right = ways[: len(ways) // 2], ways[len(ways) // 2 :]
    return f"(?:(?=[{''.join(_escaped(c) for c, _ in left)}]){_either(left)}|{_either(right)})"


def _trie(words: list[str]) -> str:
    """A pattern for sorted words of which none starts with another."""
    if words == [""]:
        return ""
    return _either([(c, _trie([w[1:] for w in words if w[0] == c])) for c in dict.fromkeys(w[0] for w in words)])


def present(low: Column, words: list[str]) -> Column:
    """An array of those of `words` that occur in a text, in any order, some more than once.

    Words with which others start are looked for one by one; of the rest no two
    can start at the same place.
    """
    if not words:
        return listed([])
    every = sorted(set(words))
    starts = [w for w, after in zip(every, every[1:]) if after.startswith(w)]
    rest = [w for w in every if w not in set(starts)]
    found = F.regexp_extract_all(low, F.lit(f"(?=({_trie(rest)}))"), F.lit(1))
    return F.concat(found, F.filter(listed(starts), lambda w: low.contains(w))) if starts else found


def among(words: list[str], found: Column) -> Column:
    """Those of `words` that `present` found, once each, in their order."""
    return F.array_intersect(listed(words), found)


def quoted(value: str) -> str:
    """A text as SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Automaton:
    """Steps from state to state with each byte of a text; states from `ends` on tell that words end there."""

    def __init__(self, words: tuple[str, ...]):
        keys = [w.encode() for w in words]
        used = sorted(set(b"".join(keys)))
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        size = len(used) + 1
        step, told, fail = [[0] * size], [0], [0]
        for k, key in enumerate(keys):
            at = 0
            for c in self.classes[list(key)].tolist():
                if not step[at][c]:
                    step.append([0] * size)
                    told.append(0)
                    fail.append(0)
                    step[at][c] = len(step) - 1
                at = step[at][c]
            told[at] |= 1 << k if key else 0
        todo = deque(x for x in step[0] if x)
        while todo:
            at = todo.popleft()
            told[at] |= told[fail[at]]
            for c, to in enumerate(step[at]):
                if to:
                    fail[to] = step[fail[at]][c]
                    todo.append(to)
                else:
                    step[at][c] = step[fail[at]][c]
        order = sorted(range(len(step)), key=lambda x: told[x] > 0)
        place = np.empty(len(step), np.int64)
        place[order] = np.arange(len(step))
        self.size, self.root = size, int(place[0]) * size
        self.steps = (place[np.array(step)][order] * size).astype(np.int32).ravel()
        self.ends = sum(not t for t in told) * size
        self.every = sum(1 << k for k, key in enumerate(keys) if not key)
        columns = -(-len(words) // BITS)
        cut = lambda bits: [bits >> BITS * j & (1 << BITS) - 1 for j in range(columns)]
        self.told = np.array([cut(told[x]) for x in order], np.int64).reshape(-1, columns)
        self.always = np.array(cut(self.every), np.int64)
        self.overlap = max(map(len, keys), default=1) - 1

    def walk(self) -> Callable[[pa.Array], np.ndarray]:
        """A function from texts to a row of masks for each; a null holds nothing. It names nothing of this package, so workers need not find it."""
        classes, steps, told, always, size_, root, ends, overlap, piece = self.classes, self.steps, self.told, self.always, self.size, self.root, self.ends, self.overlap, _PIECE

        def masks(texts: pa.Array) -> np.ndarray:
            wide = pa.types.is_large_string(texts.type)
            n, kind = len(texts), np.int64 if wide else np.int32
            out = np.zeros((n, told.shape[1]), np.int64)
            bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
            there = np.asarray(texts.is_valid())
            out[there] = always
            held = texts.buffers()[2]
            data = classes[np.frombuffer(held, np.uint8)[: bounds[-1]]] if held is not None else np.zeros(0, np.uint8)
            length = np.where(there, bounds[1:] - bounds[:-1], 0)
            pieces = np.maximum(1, -(-(length - overlap) // piece))
            text = np.repeat(np.arange(n), pieces)
            begin = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * piece
            size = np.minimum(length[text] - begin, piece + overlap)
            order = np.argsort(-size, kind="stable")
            at, text, size = (bounds[text] + begin)[order], text[order], size[order]
            running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
            state, seen = np.full(len(at), root, np.int32), []
            for j, k in enumerate(running.tolist()):
                state = steps[state[:k] + data[at[:k] + j]]
                hit = np.flatnonzero(state >= ends)
                if len(hit):
                    seen.append((text[hit], state[hit] // size_))
            if seen:
                owner, where = (np.concatenate(x) for x in zip(*seen, strict=True))
                order = np.argsort(owner, kind="stable")
                owner, where = owner[order], where[order]
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[owner[first]] |= np.bitwise_or.reduceat(told[where], first, axis=0)
            return out

        return masks


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]) -> _Automaton:
    return _Automaton(words)


class Held:
    """Which of some words the text of a row holds, as bits of a column that `sought` adds."""

    def __init__(self, words: list[str], column: str):
        self.words, self.column = tuple(dict.fromkeys(words)), column
        self.place = {w: (f"{column}.m{k // BITS}", k % BITS) for k, w in enumerate(self.words)}

    def masks(self, low: str) -> Column:
        """The column, of a column of texts in lower case."""
        walk, names = _automaton(self.words).walk(), [f"m{k}" for k in range(-(-len(self.words) // BITS))]

        def found(texts: pa.Array) -> pa.Array:
            masks = walk(texts)
            return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(masks[:, k])) for k in range(len(names))], names=names)

        return F.arrow_udf(found, "struct<" + ", ".join(f"{x}: bigint" for x in names) + ">")(low)

    def has(self, word: str) -> str:
        """Whether a word is held, in SQL."""
        column, bit = self.place[word]
        return f"(({column} & {1 << bit}L) <> 0)"

    def count(self, words: list[str]) -> Column:
        """How many of the words are held."""
        of: dict[str, int] = {}
        for w in words:
            column, bit = self.place[w]
            of[column] = of.get(column, 0) | 1 << bit
        return F.expr(" + ".join(f"bit_count({c} & {bits}L)" for c, bits in of.items()) or "0")

    def listed(self, words: list[str]) -> Column:
        """An array of the words that are held, in their order; of an empty text if none is."""
        return F.expr("split(concat_ws('\\u0001', " + ", ".join(f"IF({self.has(w)}, {quoted(w)}, NULL)" for w in words) + "), '\\u0001')")


def sought(rows: DataFrame, words: dict[str, list[str]]) -> tuple[DataFrame, dict[str, Held]]:
    """rows with masks of the words that the texts (in lower case) of each named column hold, and how to read them; nothing is held by a null."""
    held = {low: Held(own or [""], f"held_{low}") for low, own in words.items()}
    return rows.withColumns({h.column: h.masks(low) for low, h in held.items()}), held
