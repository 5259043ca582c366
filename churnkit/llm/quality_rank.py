"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in its features; a pair (better, worse) is won with probability
``sigmoid(score(better) - score(worse))``, so the weights come from logistic loss on feature
differences.  The scores' threshold is the quantile at which the share of all labelled training
documents above it is the share of good labels; the reported score is the sigmoid of the
distance from it, so 0.5 is the threshold.

The fit takes at most ``max_labelled`` labelled rows (features only, some 30 numbers each), drawn by
the hash of doc_id, and ``pairs`` pairs of them.  Everything else covers all rows.

Edge cases: null texts are scored as empty ones; label rows without id or label are left
out and a document with conflicting labels is bad; repeated rows get equal scores; without labels
of both kinds all scores are 0.5; empty tables give no rows; labels, lang, source and doc_id
never enter a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import exact_quantiles
from .common import text_of, written

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[^\W\d_]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile(r"\d")
_END = re.compile(r"[.!?…]$")
_CAP = re.compile(r"[A-ZÀ-ÖØ-Þ][^\WA-ZÀ-ÖØ-Þ]*")


def features(text: str) -> list[float]:
    """Shares and logarithms that describe a text's form; whole text, any length."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    count = Counter(words)
    lower = Counter()
    for w, k in count.items():
        lower[w.strip(".,!?;:\"'()").lower()] += k
    pairs = Counter(zip(words, words[1:]))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    sizes = np.array([len(w) for w in count], dtype=float) if count else np.zeros(1)
    times = np.array(list(count.values()), dtype=float) if count else np.ones(1)
    mean = float((sizes * times).sum() / times.sum())
    dup_lines = m - len(set(lines)) if lines else 0
    letters = len(_LETTER.findall(text))
    share = [
        len(_UPPER.findall(text)) / max(1, letters), letters / chars, len(_SYMBOL.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars, (text.count("!") + text.count("?")) / n, (text.count(".") + text.count(",")) / n,
        text.count("|") / n, dup_lines / m, 1 - len(count) / n, runs / n,
        sum(k for k in pairs.values() if k > 1) / n, max(lower.values(), default=0) / n,
        sum(bool(_END.search(x)) for x in lines) / m, float((times * (sizes > 12)).sum() / times.sum()),
        float((times * (sizes < 3)).sum() / times.sum()), sum(k for w, k in count.items() if _CAP.fullmatch(w)) / n,
    ]
    return [*share, *(x ** 0.5 for x in share), np.log1p(len(words)), np.log1p(m), mean / 10, np.log1p(n / m), 1.0 if len(words) < 5 else 0.0]


def features_of(text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t), dtype=np.float32) for t in s])

    return run(text)


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int, l2: float = 1e-3, steps: int = 25, seed: int = 7):
    """Weights (mean, scale, w) by Newton's method on the logistic loss of feature differences."""
    both = np.concatenate([better, worse])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    d = ((better[rng.integers(len(better), size=pairs)] - worse[rng.integers(len(worse), size=pairs)]) / scale)
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + l2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def held_out(modulus: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``rest`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def rank_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, pairs: int = 60_000,
                 text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    src = docs.select("doc_id", text_of(docs, text_col).alias("__t"))
    rows = written(src.select("doc_id", held_out(3, 1).alias("held_out"), features_of(F.col("__t")).alias("x")), "rank-features")
    told = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    known = rows.where("not held_out").join(told, "doc_id").select("doc_id", "x", "quality")
    n, good = known.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1)).first()
    labelled = known
    if n > max_labelled:  # a share by hash, then exactly the bound
        share = 1.2 * max_labelled / n
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # in the order of a hash, so that the same rows give the same fit
    known = known.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "x").limit(max_labelled)
    got = known.select("x", "quality").toPandas()
    x = np.array(got["x"].tolist(), dtype=float) if len(got) else np.empty((0, 1))
    y = got["quality"].to_numpy() == 1 if len(got) else np.zeros(0, bool)
    if y.any() and not y.all():
        mean, scale, w = fit_pairs(x[y], x[~y], pairs)
    else:
        mean, scale, w = 0.0, 1.0, None

    @F.pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        if w is None or not len(s):
            return pd.Series(np.zeros(len(s)))
        return pd.Series((((np.array(s.tolist(), dtype=float) - mean) / scale) * w).sum(axis=1))

    cut = 0.0
    if w is not None:  # over all labelled training rows, however few the fit took
        scored = written(labelled.select("doc_id", score("x").alias("z")), "rank-scores")
        cut = exact_quantiles(scored, "z", [1 - good / n], tie="doc_id").first()["q0"]
    z = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), score("x") - F.lit(cut)))
    return (rows.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
