"""Quality rules: counts of whole texts, a fixed base rule, and an isolation forest over rule statistics.

A statistic counts as far as it exceeds what is usual in good rows. The forest grows trees of
random splits over these excesses in a bounded sample of labelled rows; a document that few
splits set apart from the others has a short path and is anomalous. The limit of the anomaly
score comes from all labelled rows.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.tables import least_hashed, stored, text_digest, without_texts

REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
FIT_ROWS = 20_000
TREES = 100
TREE_ROWS = 256
#: Quantile of a statistic in good rows up to which it is usual.
USUAL = 0.998
BINS = 4096

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_digits", "n_same_next"]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in runs of ``window`` words that occur twice or more, first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for j in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n] + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + window, np.int64)
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + window, -1)
    return int((np.cumsum(twice) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of _COUNTS for a whole text; a null text has no words."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(_UPPER.findall(text)),
        len(data) - len(data.translate(None, b"!?")),
        len(lines),
        len(data) - len(data.translate(None, b"0123456789")),
        sum(map(operator.eq, words, words[1:])),
    )


def rule_counts(text: Column) -> Column:
    """Struct of the counts as longs."""

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([counts_of(t) for t in texts], columns=_COUNTS, dtype="int64")

    return count(text)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """Ratios that do not depend on the length of a text."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "upper": F.col("n_upper") / words,
        "marks": F.col("n_marks") / words,
        "digits": F.col("n_digits") / chars,
        "same_next": F.col("n_same_next") / words,
        "word_length": F.least(F.col("word_chars") / words, F.lit(50.0)),
    }


class IsolationForest:
    """Trees as arrays: feature (-1 at a leaf), limit, first child (the second follows), path length of a leaf."""

    def __init__(
        self, rows: np.ndarray, usual: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 23
    ):
        rng = np.random.default_rng(seed)
        self.usual = usual
        rows = np.maximum(rows - usual, 0)
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grown(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def average_path(n: int) -> float:
        """Mean path length of an unsuccessful search in a random tree of n rows."""
        return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grown(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, limit, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth >= self.depth or not len(varied):
                path[node] = depth + self.average_path(len(own))
                continue
            f = int(rng.choice(varied))
            cut = float(rng.uniform(low[f], high[f]))
            feature[node], limit[node], child[node] = f, cut, len(feature)
            below = own[:, f] <= cut
            for part in (own[below], own[~below]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1)
                limit.append(0.0)
                child.append(0)
                path.append(0.0)
        return np.array(feature), np.array(limit), np.array(child), np.array(path)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1; higher means shorter paths."""
        rows = np.maximum(rows - self.usual, 0)
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, limit, child, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                beyond = rows[every, np.maximum(f, 0)] > limit[node]
                node = np.where(f < 0, node, child[node] + beyond)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(self.average_path(self.size), 1e-9))


def learn_forest(counted: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> IsolationForest | None:
    """A forest over at most ``limit`` labelled rows that pass the base rule, those with the smallest hashes."""
    own = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    rows = counted.where(~base_failed()).join(own, "doc_id")
    rows = least_hashed(rows, limit, F.xxhash64("doc_id", F.lit(13)), "doc_id")
    found = rows.select(*[c.alias(k) for k, c in statistics().items()], "__quality").toPandas().to_numpy(np.float64)
    good = found[found[:, -1] == 1, :-1]
    return IsolationForest(found[:, :-1], np.quantile(good, USUAL, axis=0)) if len(good) else None


def anomaly(forest: IsolationForest | None) -> Column:
    """Anomaly score of a row of statistics; 0 without a forest."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        rows = np.stack([c.to_numpy(np.float64) for c in columns], axis=1)
        return pd.Series(forest.scores(rows) if forest else np.zeros(len(rows)))

    return score(*statistics().values())


def calibrated_limit(scored: DataFrame, labels: DataFrame, bins: int = BINS) -> float:
    """The score limit with the least share of good rows above it plus share of bad rows below.

    Counted over all labelled rows that pass the base rule; the highest of equal limits. 1 (no
    row is rejected) without rows of both labels.
    """
    own = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    rows = scored.where(~base_failed()).join(own, "doc_id").groupBy(F.ceil(F.col("anomaly") * bins).cast("int").alias("bin"))
    # at most as many rows as bins
    found = rows.agg(F.sum(1 - F.col("__quality")).alias("bad"), F.sum("__quality").alias("good")).collect()
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in found:
        good[r["bin"]], bad[r["bin"]] = r["good"], r["bad"]
    if not good.sum() or not bad.sum():
        return 1.0
    lost = 1 - np.cumsum(good) / good.sum() + np.cumsum(bad) / bad.sum()
    return (len(lost) - 1 - int(np.argmin(np.round(lost[::-1], 12)))) / bins


def learnt(counted: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[IsolationForest | None, float]:
    """Forest and score limit for a written table of doc_id and counts."""
    forest = learn_forest(counted, labels, fit_rows)
    return forest, calibrated_limit(stored(counted.withColumn("anomaly", anomaly(forest)), "anomaly"), labels)


def _judged(counted: DataFrame, forest: IsolationForest | None, limit: float) -> DataFrame:
    judged = counted.withColumns({"anomaly": anomaly(forest), "base_failed": base_failed()})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))


def with_verdict(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id with the counts, base_failed, anomaly and kept, for every row of ``docs``.

    A null text has no words and fails the base rule. Without labels the base rule decides
    alone. Repeated rows stay repeated; a null doc_id is judged like any other but never learnt
    from. Other columns are ignored.
    """
    counted = docs.select("doc_id", rule_counts(F.col("text")).alias("c")).select("doc_id", "c.*")
    counted = stored(counted, "counts")
    return _judged(counted, *learnt(counted, labels, fit_rows))


def filtered(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`with_verdict` keeps."""
    counted = docs.select("doc_id", text_digest().alias("digest"), rule_counts(F.col("text")).alias("c"))
    counted = stored(counted.select("doc_id", "digest", "c.*"), "counts")
    forest, limit = learnt(counted.drop("digest"), labels, fit_rows)
    judged = _judged(counted, forest, limit)
    return without_texts(docs, judged.where(~F.coalesce("kept", F.lit(False))))
