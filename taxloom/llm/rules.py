"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

Statistics are column expressions. Sequential covering learns from a bounded
sample of labelled rows: a rule grows threshold conditions by information
gain, is pruned on rows it did not grow from, and is taken if it stays precise
there; the rows it covers leave, and the next rule starts. The list is emitted
as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.fit import labelled_ids, labelled_texts

#: Bound of the labelled rows learned from, of each class.
PER_CLASS = 3000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: shares, so that they hold at every length, and the length itself.
TESTED = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.value if self.at_least else c <= self.value

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:g}"


def _removed(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted by hash, then the union of the repeated ones."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = F.transform(
        F.filter(
            F.zip_with(placed, F.concat(F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: p["a"]["h"] == p["b"]["h"],
        ),
        lambda p: F.array(p["a"]["i"], p["b"]["i"]),
    )
    places = F.array_sort(F.array_distinct(F.flatten(at)))
    start = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda acc, p: F.struct((acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"), p.alias("last")), lambda acc: acc["total"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id` and the statistics of every whole text (all long), a row for each row.

    A null text has no words and no lines; texts may be of any length.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    one = docs.select(docs[id_col].alias("id"), text.alias("text"))
    two = one.select(
        "id",
        "text",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    three = two.select(
        "id",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        (F.length("text") - F.length(_removed(F.col("text"), SYMBOLS))).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).alias("n_upper"),
        (F.length("text") - F.length(_removed(F.col("text"), "!"))).alias("n_bangs"),
        (F.length("text") - F.length(_removed(F.col("text"), "."))).alias("n_stops"),
    )
    n = F.size("hashes")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("hashes", i + k) for k in range(WINDOW)]))
    four = three.select("*", n.alias("n_words"), F.size(F.array_distinct("hashes")).alias("n_distinct"), F.when(n >= WINDOW, windows).otherwise(F.expr("cast(array() as array<bigint>)")).alias("windows"))
    five = four.select("*", (F.size("windows") > F.size(F.array_distinct("windows"))).alias("repeats"))
    six = five.withColumn("n_repeat_words", F.when(F.col("repeats"), _covered(F.col("windows"))).otherwise(0))
    names = [*STATISTICS, "n_lines", "n_upper", "n_bangs", "n_distinct", "n_stops"]
    return six.select("id", *[F.col(c).cast("long").alias(c) for c in names])


def tested(stats: DataFrame) -> DataFrame:
    return stats.select("*", *[F.expr(e).cast("double").alias(k) for k, e in TESTED.items()])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    held = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (held & ~bad).any():
        p0, n0 = int((held & bad).sum()), int((held & ~bad).sum())
        best, found = 1e-9, None
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[held], np.linspace(0, 1, 65)))
            cuts = np.unique(np.concatenate([cuts, (cuts[1:] + cuts[:-1]) / 2]))
            for up in (True, False):
                for t in cuts.tolist():
                    sel = held & (v >= t if up else v <= t)
                    p = int((sel & bad).sum())
                    if p < 3:
                        continue
                    gain = p * (log2(p / int(sel.sum())) - log2(p0 / (p0 + n0)))
                    if gain > best:
                        best, found = gain, Condition(name, up, t)
        if found is None:
            break
        rule.append(found)
        held &= found.holds(x)
    return rule


def _covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for c in rule:
        held &= c.holds(x)
    return held


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.95, most_rules: int = 12, most_conditions: int = 3, seed: int = 5) -> list[list[Condition]]:
    """An ordered list of rules, each a conjunction that marks bad rows."""
    rng = np.random.default_rng(seed)
    rules: list[list[Condition]] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most_rules and (left & bad).sum() >= 6:
        grows = rng.random(len(bad)) < 2 / 3
        g, p = left & grows, left & ~grows
        if not (g & bad).any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], most_conditions)
        pruned = {k: v[p] for k, v in x.items()}

        def worth(r: list[Condition], pruned=pruned, p=p) -> float:
            sel = _covers(r, pruned, int(p.sum()))
            hit = int((sel & bad[p]).sum())
            return (2 * hit - int(sel.sum())) / max(1, int(sel.sum()))

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])
        if not rule or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, *, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """Rules for texts of label 0, from a bounded sample of labelled rows; none if a class is missing.

    Rows of one id count as one, whose text is the smallest.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = labelled_texts(own, labelled_ids(labels, label, keep, id_col), per_class)
    taken = tested(statistics(rows.select(F.struct("id", "y").alias("id"), "text"), "id")).select("id.*", *TESTED).collect()
    taken.sort(key=lambda r: (r.id, *r[2:]))
    bad = np.array([r.y == 0 for r in taken], dtype=bool)
    if not bad.any() or bad.all():
        return []
    return learn({k: np.array([r[k] for r in taken]) for k in TESTED}, bad)


def decision(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional expression over tested() columns: the number of the rule that fires, or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        when = rule[0].column()
        for c in rule[1:]:
            when = when & c.column()
        out = F.when(when, k) if out is None else out.when(when, k)
    return F.lit(0) if out is None else out.otherwise(0)


def verdicts(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the statistics, base_failed, rule (0: none fired) and kept, a row for each row of docs.

    Repeated rows and null ids stay rows of their own; empty texts fail the
    base test for too few words.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = tested(statistics(docs, id_col, text_col)).select("*", failed.alias("base_failed"), decision(rules).alias("rule"))
    return rows.select(F.col("id").alias(id_col), *STATISTICS, "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"))
