"""Quality rules learnt as decision lists over statistics of a text.

Sequential covering: a rule is a conjunction of thresholds, grown one condition at a time on two thirds of the labelled
rows by information gain and cut back from its end on the other third; the rows that it covers are taken out and the next
rule is learnt from the rest. The list becomes one ordered conditional expression, so applying it is plain Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadfit.llm.common import sampled_labels, sampled_texts, texts_of

SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = " \t\n\x0b\x0c\r"
PER_CLASS = 5000  # bound of the labelled rows that are learnt from, by class
THRESHOLDS = 48  # candidates of a statistic
CONDITIONS = 4
RULES = 16
PRECISION = 0.9  # that a rule must have on the rows it was not grown on

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct_words", "n_top_word", "n_ends"]
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text, in order. Words are runs without blanks and ASCII line and tab characters.

    n_repeat_words are words that lie in a window of three words that the text holds twice or more; n_dup_lines are
    lines with a word that equal an earlier line; n_marks are ! and ?; n_ends are words that end in . ! or ?; n_top_word
    is how often the commonest word stands. A null text has zeros.
    """
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    codes, distinct = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        _, pairs = np.unique(codes[:-1] * np.int64(len(distinct)) + codes[1:], return_inverse=True)
        _, windows, often = np.unique(pairs[:-1] * np.int64(len(distinct)) + codes[2:], return_inverse=True, return_counts=True)
        twice = often[windows] > 1
        for shift in range(3):
            repeated[shift:len(words) - 2 + shift] |= twice
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        int(repeated.sum()), len(lines), sum(1 for c in text if c.isupper()), text.count("!") + text.count("?"),
        len(distinct), int(np.bincount(codes).max()) if words else 0,
        sum(1 for w in words if w.endswith((b".", b"!", b"?"))),
    )


def text_counts(text: Column) -> Column:
    """Struct of COUNTS of whole texts."""

    @F.pandas_udf(COUNTS_SCHEMA)
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(t) for t in texts], columns=COUNTS)

    return count(text)


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def statistics(c: Column) -> dict[str, Column]:
    """The statistics that rules speak of, from a struct of COUNTS."""
    return {
        "words": c["n_words"].cast("double"),
        "word_length": ratio(c["word_chars"], c["n_words"]),
        "symbols_per_word": ratio(c["n_symbols"], c["n_words"]),
        "dup_line_share": ratio(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": ratio(c["n_repeat_words"], c["n_words"]),
        "upper_share": ratio(c["n_upper"], c["word_chars"]),
        "marks_per_word": ratio(c["n_marks"], c["n_words"]),
        "distinct_share": ratio(c["n_distinct_words"], c["n_words"]),
        "top_word_share": ratio(c["n_top_word"], c["n_words"]),
        "ends_per_word": ratio(c["n_ends"], c["n_words"]),
        "words_per_line": ratio(c["n_words"], c["n_lines"]),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self, stats: dict[str, Column]) -> Column:
        x = stats[self.statistic]
        return x >= self.threshold if self.at_least else x < self.threshold

    def covers(self, table: np.ndarray, names: Sequence[str]) -> np.ndarray:
        x = table[:, names.index(self.statistic)]
        return x >= self.threshold if self.at_least else x < self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: np.ndarray, names: Sequence[str]) -> np.ndarray:
    out = np.ones(len(table), bool)
    for c in rule:
        out &= c.covers(table, names)
    return out


def grow(table: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    """Conditions of most information gain (bad rows kept times gain in log precision), until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(table), bool)
    while len(rule) < CONDITIONS and (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for j, name in enumerate(names):
            x, y = table[inside, j], bad[inside]
            cuts = np.unique(np.quantile(x[y], np.linspace(0, 1, THRESHOLDS)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(x, np.linspace(0, 1, THRESHOLDS))]))
            order = np.argsort(x, kind="stable")
            below = np.searchsorted(x[order], cuts, "left")
            bad_below = np.concatenate([[0], np.cumsum(y[order])])[below]
            for at_least, p, n in ((True, p0 - bad_below, n0 - (below - bad_below)), (False, bad_below, below - bad_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, at_least, float(cuts[k])), float(gain[k])
        if best is None:
            break
        rule.append(best)
        inside &= best.covers(table, names)
    return tuple(rule)


def prune(rule: Rule, table: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    """The beginning of the rule that has the best (p - n) / (p + n) on rows it was not grown on; of equals the shortest."""
    def worth(r: Rule) -> float:
        inside = covered(r, table, names)
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn_list(table: np.ndarray, bad: np.ndarray, names: Sequence[str], precision: float = PRECISION) -> list[Rule]:
    """Rules for the bad rows, in the order in which they were learnt. Each third row prunes and judges."""
    judge = np.arange(len(table)) % 3 == 0
    open_ = np.ones(len(table), bool)
    rules: list[Rule] = []
    while len(rules) < RULES and (bad & open_ & ~judge).sum() >= 5:
        rule = grow(table[open_ & ~judge], bad[open_ & ~judge], names)
        if not rule:
            break
        rule = prune(rule, table[open_ & judge], bad[open_ & judge], names)
        inside = covered(rule, table, names) & open_
        p, n = (bad & inside & judge).sum(), (~bad & inside & judge).sum()
        if p < 2 or p / (p + n) < precision:
            break
        rules.append(rule)
        open_ &= ~inside
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> list[Rule]:
    """Rules that reject, from a bounded sample of labelled rows: at most per_class of each class, numbers only. Of several
    texts of one id that of the smallest hash is learnt from.

    Without labelled rows of both classes there are no rules and nothing is rejected.
    """
    sample, sizes = sampled_labels(labels, label, per_class)
    if not sizes.get(0) or not sizes.get(1):
        return []
    counted = sampled_texts(docs, sample, {"counts": text_counts(F.col("text"))})
    stats = statistics(F.col("counts"))
    names = [*stats]
    rows = counted.select("doc_id", "label", *(c.alias(n) for n, c in stats.items()))
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    table = np.array([[r[n] for n in names] for r in rows], float).reshape(-1, len(names))
    return learn_list(table, np.array([r["label"] == 0 for r in rows], bool), names)


def rejecting_rule(rules: Sequence[Rule], counts: Column) -> Column:
    """Number (from 1) of the first rule of the list that covers a text; null where none does."""
    stats = statistics(counts)
    out = F.lit(None).cast("int")
    for k, rule in reversed([*enumerate(rules, 1)]):
        test = rule[0].column(stats)
        for c in rule[1:]:
            test &= c.column(stats)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def judge_documents(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, COUNTS..., base_failed, rule, kept) of every row of docs.

    base_failed: under 50 words, or over half of the words lie in repeated windows. A text that passes is kept unless a
    learnt rule covers it; rule is that rule's number. A null or empty text has zeros and fails; a null doc_id stays
    null; repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored. No shuffle.
    """
    counted = texts_of(docs).select("doc_id", text_counts(F.col("text")).alias("counts"))
    # the counts must not be computed once for each use
    counted = counted.select("doc_id", "counts.*").select("doc_id", *COUNTS, F.struct(*COUNTS).alias("counts"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), rejecting_rule(rules, F.col("counts")).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
