"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics: one vectorised pass per text gives counts and ratios (`STATISTICS`).
2. Rules: boosted trees on a bounded labelled sample; every root-to-node path is a conjunctive rule.
3. Weights: L1-penalised logistic regression over the 0/1 rule matrix keeps few rules.
4. Scoring: the kept rules are Spark column expressions over the statistics.

Only the fit is bounded (`SAMPLE_ROWS` labelled rows, the smallest by a hash of doc_id); scoring covers every whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import free_name, whole

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper", "digits", "spaces", "other_ascii", "non_ascii", "bars", "shouts", "marks",
    "stops", "commas", "lines", "line_repeats", "distinct_words", "top_word", "same_next", "bare_marks", "title_words",
)
SAMPLE_ROWS = 8000
ACCEPT = 0.7

_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#$%&*^~_=<>{}[]\\/@+"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _statistics(text: str) -> tuple[float, ...]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    h = np.bincount(data, minlength=256) / n
    words, lines = text.split(), text.split("\n")
    count, w = Counter(words), max(1, len(words))
    space = h[9:14].sum() + h[32]
    bare = sum(k for word, k in count.items() if not any(map(str.isalnum, word)))
    title = sum(k for word, k in count.items() if word[0].isupper())
    return (
        float(np.log1p(len(data))), float(np.log1p(len(words))), (1 - space) * n / w, h[65:91].sum(), h[48:58].sum(), space, h[_PUNCT].sum(), h[128:].sum(),
        h[ord("|")], h[ord("!")], h[_MARKS].sum(), h[ord(".")], h[ord(",")], len(lines) / w, 1 - len(set(lines)) / len(lines), len(count) / w,
        max(count.values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:])) / w, bare / w, title / w,
    )


_STATS_TYPE = T.StructType([T.StructField(x, T.DoubleType()) for x in STATISTICS])


@F.pandas_udf(_STATS_TYPE)
def statistics(text: pd.Series) -> pd.DataFrame:
    """The statistics of each whole text; a null or empty text gives zeros (no words, one empty line)."""
    return pd.DataFrame([_statistics(t or "") for t in text], columns=STATISTICS, dtype="float64")


@dataclass(frozen=True)
class RuleModel:
    """Intercept plus a weight for each rule; a rule is a tuple of (statistic index, at most?, cut)."""

    intercept: float
    rules: tuple[tuple[boosting.Rule, float], ...]

    def column(self, stats: str) -> Column:
        """The probability of label 1 from the struct column of statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(_holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def _holds(rule: boosting.Rule, stats: str) -> Column:
    out = F.lit(True)
    for f, at_most, cut in rule:
        value = F.col(f"{stats}.{STATISTICS[f]}")
        out = out & ((value <= F.lit(cut)) if at_most else (value > F.lit(cut)))
    return out


def _matrix(rules: list[boosting.Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, at_most, cut in rule:
            out[:, j] *= (x[:, f] <= cut) if at_most else (x[:, f] > cut)
    return out


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Weights by accelerated proximal gradient; the intercept carries no penalty."""
    n = len(y)
    a = np.hstack([np.ones((n, 1), np.float32), m])
    v = np.ones(a.shape[1], np.float32)
    for _ in range(12):  # largest eigenvalue by power iteration
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * n / max(1e-9, float(np.linalg.norm(a.T @ (a @ v))))
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = z - step * (a.T @ (boosting.sigmoid(a @ z) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / u * (new - w), u
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.001) -> RuleModel:
    """Fit rules and weights; without rows of both classes the score is the constant share of label 1 (1/2 without rows)."""
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return RuleModel(float(np.log(share / (1 - share))), ())
    _, grown = boosting.fit(x, y, trees=trees, depth=depth, rate=0.3, least=max(5, len(y) // 400), row_share=0.7)
    rules = list(dict.fromkeys(r for t in grown for r in boosting.paths(t)))
    m = _matrix(rules, x)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold on the same rows count once
    rules, m = [rules[i] for i in sorted(first)], m[:, sorted(first)]
    b, w = _lasso(m, y.astype(np.float64), penalty)
    return RuleModel(b, tuple((r, float(k)) for r, k in zip(rules, w) if abs(k) > 1e-6))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learn `quality` from at most sample_rows labelled rows that are not held out (null labels and ids take no part).

    A document with several labels counts once, with the largest; of documents with equal ids the one with the least statistics counts.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(picked), "doc_id").select("doc_id", "label", statistics(whole("_text")).alias("s"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "s")).alias("one")).select("one.label", "one.s.*").toPandas()
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)  # row order from the cluster varies, the fit must not
    return fit(rows[list(STATISTICS)].to_numpy(float), (rows["label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: RuleModel, accept: float = ACCEPT) -> DataFrame:
    """docs with `_score` (0 to 1) and `_accepted` added; every row is scored, null text as empty, long texts as a whole.

    Equal texts score equally, whatever their doc_id; rows that repeat are each scored. An empty table gives an empty result.

    All columns of docs stay, but for columns of these two names, which are replaced.
    """
    stats = free_name(docs, "_stats")
    out = docs.withColumn(stats, statistics(whole()))
    out = out.withColumn("_score", model.column(stats)).drop(stats)
    return out.withColumn("_accepted", F.col("_score") >= accept)


def accepted(docs: DataFrame, model: RuleModel, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that reach the score, with all their columns as they were."""
    stats = free_name(docs, "_stats")
    return docs.withColumn(stats, statistics(whole())).where(model.column(stats) >= accept).drop(stats)
