"""Quality rules: a decision list learned by sequential covering, emitted as ordered Spark conditional expressions.

``document_statistics`` measures every whole text.  ``learn_rules`` grows conjunctions of thresholds on those
statistics over labelled rows by information gain, prunes each on rows kept aside, and stops when a pruned rule is
no longer precise enough.  ``rule_expression`` turns the list into one ``CASE WHEN`` that Catalyst compiles.

Defined results: a null text has no words and fails the base rule; empty texts likewise; with no usable labelled
row of either class the list is empty and only the base rule decides; labels with a null id or quality are not used;
repeated labels and documents count repeatedly; further columns are ignored.  Learning uses at most ``max_rows`` labels,
those with the smallest hash of the id, and of their documents at most ``max_rows`` that the base rule leaves, in the
same order: this bound is a parameter, everything else covers all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattix.llm.common import release_memory

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct_words", "n_lines", "n_upper", "n_digits", "n_marks"]
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in BASE + MORE])
#: Characters that count as symbols, as white space, and as sentence marks.
SYMBOLS, SPACES, MARKS = "#*$%&|<>", " \t\n\x0b\x0c\r", ".!?"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_words(codes: np.ndarray, n_codes: int) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(codes)
    if n < 4 or n_codes == n:
        return 0
    if n_codes < 2_000_000:
        windows = (codes[:-2] * n_codes + codes[1:-1]) * n_codes + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * n_codes + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * np.int64(n_codes) + codes[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * (len(BASE) + len(MORE))
    ids: dict[bytes, int] = {}
    words = text.encode("utf-8", "surrogatepass").split()
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(codes, len(ids)),
        len(ids),
        len(lines),
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        sum(map(text.count, "0123456789")),
        sum(map(text.count, MARKS)),
    )


def _statistics(text: pd.Series) -> pd.DataFrame:
    values = text.to_numpy()
    out = np.array([measure(t) for t in values], np.int64).reshape(-1, len(BASE + MORE))
    release_memory()
    return pd.DataFrame(out, columns=BASE + MORE)


document_statistics = F.pandas_udf(_statistics, STATISTICS)
#: The same, computed where it stands: Spark takes no filter on its result below a join, where it would measure all rows,
#: and then the joined ones again by a second Python worker of the same task.
_statistics_here = F.pandas_udf(_statistics, STATISTICS).asNondeterministic()


def base_failed(s: str = "") -> Column:
    n, r = F.col(f"{s}n_words"), F.col(f"{s}n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


#: The quantities that rules put thresholds on: a count over another, both as measured.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeats_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, s: str = "") -> Column:
        a, b = FEATURES[self.feature]
        value = F.col(f"{s}{a}").cast("double")
        if b:
            value = F.when(F.col(f"{s}{b}") > 0, value / F.col(f"{s}{b}")).otherwise(F.lit(0.0))
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def feature_arrays(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    out = {}
    for name, (a, b) in FEATURES.items():
        x = rows[a].to_numpy(float)
        out[name] = np.divide(x, rows[b].to_numpy(float), out=np.zeros(len(x)), where=rows[b].to_numpy() > 0) if b else x
    return out


def _matches(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.of(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int, candidates: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < max_conditions and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, best_gain = None, 1e-9
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, candidates)))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                t = (lo + hi) / 2
                above = v > t
                for up, m in ((True, above), (False, ~above)):
                    p, n = y[m].sum(), (~y[m]).sum()
                    if p:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        if gain > best_gain:
                            best, best_gain = Condition(name, up, float(t)), gain
        if best is None:
            break
        rule += (best,)
        inside &= best.of(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix with the largest (p - n) / (p + n) on the rows kept aside; the shorter of equals."""
    def value(r: Rule) -> float:
        m = _matches(r, x, len(bad))
        p, n = bad[m].sum(), (~bad[m]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (value(r), -len(r)), default=())


def cover(rows: pd.DataFrame, bad: np.ndarray, *, precision: float = 0.9, max_rules: int = 24, max_conditions: int = 4, candidates: int = 96) -> list[Rule]:
    """Sequential covering of the bad rows.  ``rows`` holds the statistics in a fixed order; every third row prunes."""
    rules: list[Rule] = []
    x = feature_arrays(rows)
    aside = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    least = max(3, int(0.001 * bad.sum()))
    while len(rules) < max_rules:
        g, q = left & ~aside, left & aside
        if bad[g].sum() < least or bad[q].sum() < 1:
            break
        rule = _prune(_grow({k: v[g] for k, v in x.items()}, bad[g], max_conditions, candidates), {k: v[q] for k, v in x.items()}, bad[q])
        if not rule:
            break
        m = _matches(rule, x, len(bad)) & left
        hit = m & aside
        # Laplace's estimate on the rows kept aside, and the plain share on all rows that the rule meets
        if (bad[hit].sum() + 1) / (hit.sum() + 1.25) < precision or bad[m].mean() < precision:
            break
        rules.append(rule)
        left &= ~m
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(__id, __quality, statistics) of the labelled documents that the base rule leaves, at most ``max_rows``; only texts of
    the labels that are used are measured, and each once."""
    some = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__quality"))
        .where("__id is not null and __quality is not null")
        .orderBy(order := F.xxhash64(F.lit(7), "__id"), "__id", "__quality")
        .limit(max_rows)
    )
    stats = (
        docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
        .join(F.broadcast(some), "__id")
        .select("__id", "__quality", _statistics_here("__text").alias("s"))
        .select("__id", "__quality", "s.*")
    )
    # an order and a limit at once are one pass, and the same rows whatever the tasks' timing
    return stats.where(~base_failed()).orderBy(order, "__id", "__quality", *BASE, *MORE).limit(max_rows)


def learn_rules(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, **options) -> list[Rule]:
    """Rules for documents of quality 0, from at most ``max_rows`` labels (a fixed bound, so the broadcast is small)."""
    got = labelled_statistics(docs, labels, max_rows).toPandas()
    got = got.sort_values(["__id", "__quality", *BASE], ignore_index=True)
    got = got.iloc[pd.util.hash_pandas_object(got["__id"], index=False).argsort(kind="stable")].reset_index(drop=True)
    return cover(got[BASE + MORE], got["__quality"].to_numpy() == 0, **options) if len(got) else []


def rule_expression(rules: list[Rule], s: str = "") -> Column:
    """The number of the first rule that fits, from 1; null where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        fits = rule[0].column(s)
        for c in rule[1:]:
            fits &= c.column(s)
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in rules]


def judge(docs: DataFrame, rules: list[Rule], *, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns plus struct ``__q`` of statistics, ``__base_failed``, ``__rule`` and ``__kept``."""
    out = docs.select(*(docs[f"`{c}`"] for c in keep or docs.columns), document_statistics(text).alias("__q"))
    out = out.withColumn("__base_failed", base_failed("__q.")).withColumn("__rule", rule_expression(rules, "__q."))
    return out.withColumn("__kept", ~F.col("__base_failed") & F.col("__rule").isNull())
