"""Quality rules with risk-controlled thresholds.

Each rule is a share of a text that grows with its faults.  Within each stratum the labelled
good documents that pass the base rules are the holdout: for every rule and every candidate cutoff
the number of them that the cutoff would reject is counted over all labelled rows.  The exact
(Clopper-Pearson) upper bound of the false rejection rate must not exceed ``alpha`` divided by
the number of rules, at a confidence of ``1 - delta`` that Bonferroni's correction spreads over all
strata, rules and candidates.  Of the cutoffs that hold, the strictest is taken, so with probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the rules.  A stratum
with too few labels gets no cutoff (its rules reject nothing).

Edge cases: null texts have no words and fail the base rules; a null stratum is a stratum
of its own; label rows without id or label are left out, and a document with
conflicting labels counts as bad; repeated rows are measured and, when labelled,
counted each; ties at a cutoff are kept (a rule rejects above it only); empty tables give
no rows; other columns are not touched.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

SYMBOLS = re.compile(r"[#*$%&|<>]")
_SEPARATORS = re.compile(r"[\x20\x09-\x0D]")
WINDOW = 8
#: rule -> share in 1/1000 of ... (see :func:`shares`)
RULES = ("symbols", "dup_lines", "repeats", "upper", "long_words", "marks")
#: candidate cutoffs of every rule, in thousandths
CANDIDATES = (0, 2, 5, 10, 15, 20, 30, 40, 50, 60, 80, 100, 125, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_long_words long, n_marks long"


def repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words within windows of ``window`` words that are found twice or more (exact, by doubling)."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    gram, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while size < window:
        pair = gram[:-size] * (int(gram.max()) + 1) + gram[size:]
        gram, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size * 2
    twice = np.bincount(gram)[gram] > 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space: exactly the six separators
    chars = len(text) - len(_SEPARATORS.findall(text))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    letters_up = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
    return (len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated(ids), len(lines),
            letters_up, sum(len(w) > 30 for w in words), text.count("!") + text.count("?"))


def measures(text: Column) -> Column:
    """Struct of counts of a text, from one pass over it."""
    @F.pandas_udf(_BASE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in s], columns=[c.split()[0] for c in _BASE.split(", ")])

    return run(text)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shares() -> list[Column]:
    """Thousandths per rule, in the order of :data:`RULES`."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    of = lambda a, b: F.least(F.lit(1000.0), 1000.0 * F.col(a) / b)
    return [of("n_symbols", chars), of("n_dup_lines", lines), of("n_repeat_words", words), of("n_upper", chars),
            of("n_long_words", words), of("n_marks", chars)]


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact upper confidence bound of a proportion with ``k`` of ``n``: the p where P(X <= k) = delta."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if 0 < p < 1 and beta_share(1 - p, n - k, k + 1) > delta else (lo, p)
    return hi


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz's method): P(X <= k) of n draws
    at p is the share of ``1 - p`` for ``(n - k, k + 1)``.  Its cost does not grow with the counts but for their square root."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14 or m > 1_000_000:
            return front * out


def select_cutoffs(counts: dict, alpha: float, delta: float) -> dict:
    """stratum -> cutoff per rule (None: no cutoff holds), from ``{stratum: (n, [[rejected per candidate]])}``."""
    tests = max(1, len(counts)) * len(RULES) * len(CANDIDATES)
    out = {}
    for stratum, (n, rejected) in counts.items():
        out[stratum] = [next((c for c, k in zip(CANDIDATES, ks) if n and k / n <= alpha / len(RULES)
                              and upper_bound(k, n, delta / tests) <= alpha / len(RULES)), None) for ks in rejected]
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.06, delta: float = 0.05,
                  text_col: str = "text") -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` per row of ``docs``; strata must be few (a bounded set)."""
    src = docs.select("doc_id", docs[stratum].cast("string").alias("stratum"), text_of(docs, text_col).alias("__t"))
    rows = written(src.withColumn("m", measures(F.col("__t"))).select("doc_id", "stratum", "m.*")
                   .withColumn("base_failed", base_failed()), "rules-counts")
    good = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    holdout = rows.where("not base_failed").join(good, "doc_id")
    x = shares()
    sums = [F.sum((v > c).cast("long")).alias(f"k_{i}_{j}") for i, v in enumerate(x) for j, c in enumerate(CANDIDATES)]
    counts = {r["stratum"]: (r["n"], [[r[f"k_{i}_{j}"] for j in range(len(CANDIDATES))] for i in range(len(x))])
              for r in holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    keep = F.lit(True)
    for s, cuts in select_cutoffs(counts, alpha, delta).items():
        ok = F.lit(True)
        for v, c in zip(x, cuts):
            if c is not None:
                ok = ok & (v <= c)
        keep = F.when(F.col("stratum").eqNullSafe(F.lit(s)), ok).otherwise(keep)
    return (rows.withColumn("kept", ~F.col("base_failed") & keep)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
