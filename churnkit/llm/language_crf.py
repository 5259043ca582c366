"""Language ID of code-switched text by a linear-chain conditional random field.

Every word is a position of the chain; runs over 40 letters, as in scripts without spaces, are cut into
consecutive positions of equal length.  A position's emission score for a language is the sum of learned
weights of its affixes, character n-grams and lexicon entry; learned transitions connect
neighbouring words.  Forward-backward gives each word's distribution over languages; a
document's language is the one with the largest expected number of words, and its score is that
share.

* **Fit** (driver, NumPy): at most ``per_language`` training documents per language, drawn by hash,
  each with one window of ``window`` words.  Windows of different languages are spliced
  into code-switched chains, whose words carry their window's language, so transitions are learned
  as well.  The conditional likelihood is maximised by AdaGrad on the exact
  forward-backward gradient.
* **Prediction** (Spark tasks): words are cut into blocks; a block's transfer matrix is the product
  of its steps, blocks are chained per document, and marginals are computed within all blocks at
  once.  That is exact for texts of any length, and work and memory follow the words.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties fall to the
language that sorts first; repeated rows get equal results; without training rows every text
is ``und``; empty tables give no rows; lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keeping_columns
from .quality_rank import held_out

_WORDS = re.compile(r"[^\W\d_]+")
#: weights are addressed by a hash of the feature
SLOTS = 1 << 16
BLOCK = 32
#: letters of a position of the chain
LONGEST = 40


def words_of(text: str) -> list[str]:
    """Lower-case words of letters, long runs in pieces; empty if the text has no letter."""
    words = _WORDS.findall(text.lower())
    if words and not words[0].isalpha():
        words = [w for w in words if any(map(str.isalpha, w))]
    if words and max(map(len, words)) > LONGEST:
        words = [w[len(w) * i // n:len(w) * (i + 1) // n] for w in words for n in [-(-len(w) // LONGEST)] for i in range(n)]
    return words


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _slots(data: np.ndarray, first: np.ndarray, last: np.ndarray, kind: bytes = b"") -> np.ndarray:
    """``crc32(kind + data[first:last]) % SLOTS`` of many stretches of bytes at once."""
    c = np.full(len(first), zlib.crc32(kind) ^ 0xFFFFFFFF, dtype=np.uint32)
    size = last - first
    least, most = (int(size.min()), int(size.max())) if len(size) else (0, 0)
    for k in range(least):
        c = _CRC[(c ^ data[first + k]) & 0xFF] ^ (c >> 8)
    for k in range(least, most):
        on = np.flatnonzero(size > k)
        c[on] = _CRC[(c[on] ^ data[first[on] + k]) & 0xFF] ^ (c[on] >> 8)
    return (~c % SLOTS).astype(np.int64)


def features_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words' affixes (1 to 3), bigrams, trigrams and lexicon entry, word after word, and where each word's begin."""
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    head = np.cumsum(n + 2) - (n + 2) + 1                             # a word's first letter
    entry = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    count = 6 + (n + 1) + n + (entry >= 0)
    ends = np.cumsum(count)
    starts = ends - count
    flat = np.empty(int(count.sum()), dtype=np.int64)
    for k in (1, 2, 3):
        m = np.minimum(k, n)
        flat[starts + k - 1] = _slots(data, at[head], at[head + m], b"p")
        flat[starts + k + 2] = _slots(data, at[head + n - m], at[head + n], b"s")
    for width, many, place in ((2, n + 1, starts + 6), (3, n, starts + 6 + n + 1)):
        i = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        c = np.repeat(head - 1, many) + i
        flat[np.repeat(place, many) + i] = _slots(data, at[c], at[c + width])
    known = np.flatnonzero(entry >= 0)
    flat[ends[known] - 1] = [zlib.crc32(f"L{x}".encode()) % SLOTS for x in entry[known]]
    return flat, starts


class Model:
    """Languages, emission weights (SLOTS x languages), log transitions and log start."""

    def __init__(self, langs, weights, trans, start, lexicon):
        self.langs, self.weights, self.trans, self.start, self.lexicon = langs, weights, trans, start, lexicon


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[str, list[str]]], epochs: int = 4, rate: float = 0.4, l2: float = 1e-5, seed: int = 3) -> Model | None:
    """CRF from (language, words of a window); None without samples."""
    langs = sorted({lang for lang, words in samples if words})
    if not langs:
        return None
    n = len(langs)
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, Counter] = {}
    for lang, words in samples:
        for w in set(words):
            counts.setdefault(w, Counter())[at[lang]] += 1
    # words seen mostly in one language; an entry says which
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if sum(c.values()) >= 5 and c.most_common(1)[0][1] >= 0.8 * sum(c.values())}
    rng = np.random.default_rng(seed)
    spans = [(at[lang], words[i:i + k]) for lang, words in samples if words
             for i, k in [(0, len(words) // 2 or 1), (len(words) // 2 or 1, len(words))] if words[i:i + k]]
    weights, trans, start = np.zeros((SLOTS, n)), np.zeros((n, n)), np.zeros(n)
    g_w, g_t, g_s = (np.full_like(x, 1e-2) for x in (weights, trans, start))
    vocabulary = sorted({w for _, words in spans for w in words})
    memo: dict[str, np.ndarray] = {}
    for i in range(0, len(vocabulary), 4096):
        part = vocabulary[i:i + 4096]
        flat, starts = features_of(part, lexicon)
        memo.update(zip(part, np.split(flat, starts[1:])))
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        i = 0
        while i < len(order):
            k = int(rng.integers(1, 4))  # one to three spans make a chain
            chain = [spans[j] for j in order[i:i + k]]
            i += k
            ys = np.concatenate([np.full(len(w), y) for y, w in chain])
            slots = []
            for _, words in chain:
                slots += map(memo.__getitem__, words)
            flat, row = np.concatenate(slots), np.repeat(np.arange(len(slots)), list(map(len, slots)))
            e = np.zeros((len(slots), n))
            np.add.at(e, row, weights[flat])
            gamma, pairs = _marginals(e, trans, start)
            err = gamma
            err[np.arange(len(ys)), ys] -= 1
            np.subtract.at(pairs, (ys[:-1], ys[1:]), 1)
            used, inv = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(used), n))
            np.add.at(grad, inv, err[row])
            grad = grad / len(ys) + l2 * weights[used]
            g_w[used] += grad ** 2
            weights[used] -= rate * grad / np.sqrt(g_w[used])
            for x, g, d in ((trans, g_t, pairs / len(ys)), (start, g_s, err[0] / len(ys))):
                g += d ** 2
                x -= 0.1 * rate * d / np.sqrt(g)
    return Model(langs, weights.astype(np.float32), trans, start, lexicon)


def _marginals(e: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain forward-backward of one chain: word marginals, and expected transitions."""
    m, n = e.shape
    x, t = np.exp(e - e.max(axis=1, keepdims=True)), np.exp(trans)
    a, b = np.empty((m, n)), np.ones((m, n))
    v = np.exp(start) * x[0]
    a[0] = v / v.sum()
    for i in range(1, m):
        v = (a[i - 1] @ t) * x[i]
        a[i] = v / v.sum()
    for i in range(m - 2, -1, -1):
        v = t @ (x[i + 1] * b[i + 1])
        b[i] = v / v.sum()
    g = a * b
    g /= g.sum(axis=1, keepdims=True)
    p = a[:-1, :, None] * t[None] * (x[1:] * b[1:])[:, None, :]
    p /= p.sum(axis=(1, 2), keepdims=True)
    return g, p.sum(axis=0)


def expected_words(rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, model: Model) -> np.ndarray:
    """Expected words per language of each document, by blocks.

    ``rows`` are the words of all documents one after the other, as rows of ``table`` (emissions).
    """
    n = len(model.langs)
    out = np.zeros((len(lengths), n))
    lengths = np.asarray(lengths)
    per = -(-lengths // BLOCK)
    total = int(per.sum())
    if not total:
        return out
    doc = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    index = np.arange(total) - first[doc]                      # block number within its document
    fill = np.minimum(BLOCK, lengths[doc] - index * BLOCK)     # words in the block
    offset = (np.cumsum(lengths) - lengths)[doc] + index * BLOCK
    pos = offset[:, None] + np.arange(BLOCK)[None, :]
    live = np.arange(BLOCK)[None, :] < fill[:, None]
    e = table[rows[np.where(live, pos, 0)]]                    # blocks x BLOCK x n, already exp
    t = np.exp(model.trans)
    t /= t.max()
    start = np.exp(model.start - model.start.max())
    begins = index == 0
    # transfer matrices: state of the word before the block -> state of its last word
    m = np.broadcast_to(np.eye(n), (total, n, n)).copy()
    for k in range(BLOCK):
        on = np.flatnonzero(live[:, k])
        if not len(on):
            break
        step = (m[on].reshape(-1, n) @ t).reshape(-1, n, n)
        if k == 0:  # a document's first word comes from the start, whatever the state before
            step[begins[on]] = start
        step *= e[on, k][:, None, :]
        m[on] = step / step.max(axis=(1, 2), keepdims=True)
    # chain the blocks of each document, forward and backward
    into, back = np.full((total, n), 1.0 / n), np.ones((total, n))
    deep = int(per.max())
    for j in range(1, deep):
        b = first[per > j] + j
        prev = np.einsum("bi,bij->bj", into[b - 1], m[b - 1])
        into[b] = prev / prev.sum(axis=1, keepdims=True)
    for j in range(deep - 2, -1, -1):
        b = first[per > j + 1] + j
        nxt = np.einsum("bij,bj->bi", m[b + 1], back[b + 1])
        back[b] = nxt / nxt.sum(axis=1, keepdims=True)
    # marginals within every block, independently
    alpha, v = np.empty_like(e), into
    for k in range(BLOCK):
        step = v @ t
        if k == 0:
            step = np.where(begins[:, None], start, step)
        v = step * e[:, k]
        v = v / v.sum(axis=1, keepdims=True)
        alpha[:, k] = v
    beta = back
    for k in range(BLOCK - 1, -1, -1):
        if k < BLOCK - 1:
            step = (e[:, k + 1] * beta) @ t.T
            beta = np.where(live[:, k + 1][:, None], step / step.sum(axis=1, keepdims=True), back)
        g = alpha[:, k] * beta
        g = np.where(live[:, k][:, None], g / g.sum(axis=1, keepdims=True), 0)
        for c in range(n):
            out[:, c] += np.bincount(doc, weights=g[:, c], minlength=len(lengths))
    return out


class Tagger:
    """Predicts documents; keeps the emissions of known words in one table (bounded)."""

    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit = model, limit
        self._reset()

    def _reset(self):
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, len(self.model.langs)))

    def _learn(self, words: set[str]) -> None:
        if len(self.rows) + len(words) > self.limit and self.rows:
            self._reset()
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        e = np.concatenate([self._emissions(new[i:i + 4096]) for i in range(0, len(new), 4096)])
        n = len(self.rows)
        if n + len(new) > len(self.table):
            self.table = np.concatenate([self.table[:n], e, np.empty((n + len(new), e.shape[1]))])
        else:
            self.table[n:n + len(new)] = e
        self.rows.update(zip(new, range(n, n + len(new))))

    def _emissions(self, words: list[str]) -> np.ndarray:
        flat, starts = features_of(words, self.model.lexicon)
        e = np.add.reduceat(self.model.weights[flat].astype(np.float64), starts, axis=0)
        return np.exp(np.clip(e - e.max(axis=1, keepdims=True), -60, 0))

    def predict(self, texts, at_once: int = 200_000) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[list[str]] = []

        def settle():
            self._learn({w for words in held for w in words} if len(held) > 1 else set(held[0]))
            lengths = np.array(list(map(len, held)))
            rows = np.fromiter(map(self.rows.__getitem__, itertools.chain.from_iterable(held)), dtype=np.int64, count=int(lengths.sum()))
            n = expected_words(rows, lengths, self.table, self.model)
            for k, row in zip(lengths, n):
                best = int(row.argmax())
                out.append((self.model.langs[best], float(min(1.0, row[best] / k))) if k else ("und", 0.0))
            held.clear()

        size = 0
        for t in texts:
            held.append(words_of(t or ""))
            size += len(held[-1])
            if size >= at_once:
                settle()
                size = 0
        if held:
            settle()
        return out


def training_windows(docs: DataFrame, text_col: str, lang_col: str, per_language: int, window: int,
                     train: Column) -> list[tuple[str, list[str]]]:
    """At most ``per_language`` windows of each language, drawn by the hash of doc_id.

    Ids only are counted and ranked first (a share by hash before the rank, so that no task ranks
    a whole language); texts are read for the drawn rows and cut to a window in the tasks.
    """
    lang = docs[lang_col].cast("string")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    src = docs.where(lang.isNotNull() & train & docs[text_col].isNotNull()).select(
        lang.alias("lang"), draw.alias("draw"), docs[text_col].cast("string").alias("text"))
    n = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return []
    share = F.lit(0)
    for k, c in n.items():
        share = F.when(F.col("lang") == k, F.lit(int(min(1.0, 3 * per_language / c) * (1 << 30)))).otherwise(share)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, draws: pd.Series) -> pd.Series:
        out = []
        for t, d in zip(texts, draws):
            words = words_of(t)
            at = int(d) % max(1, len(words) - window + 1)
            out.append(words[at:at + window])
        return pd.Series(out)

    drawn = src.where(F.col("draw") < share).select("lang", "draw", cut("text", "draw").alias("words"))
    drawn = drawn.where(F.size("words") > 0)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("words")))
    got = drawn.withColumn("r", rank).where(F.col("r") <= per_language).select("lang", "words").toPandas()
    return sorted((lang, list(words)) for lang, words in zip(got["lang"], got["words"]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 600, window: int = 40,
          rows: Column | None = None) -> Model | None:
    return fit(training_windows(docs, text_col, lang_col, per_language, window, F.lit(True) if rows is None else rows))


def predict(text: Column, model: Model | None, spark) -> Column:
    """Struct ``lang_pred, score`` of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value) if shared.value is not None else None  # ends with the task
        for s in it:
            found = tagger.predict(s) if tagger else [("und", 0.0)] * len(s)
            yield pd.DataFrame(found, columns=["lang_pred", "score"]).astype({"score": "float64"})

    return run(text)


def language_id(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row; rows with crc32(doc_id) mod 4 = 2 are held out."""
    model = train(docs, text_col, lang_col, rows=~held_out(4, 2), **options)
    p = predict(docs[text_col].cast("string"), model, docs.sparkSession)
    return docs.select("doc_id", held_out(4, 2).alias("held_out"), p.alias("__p")).select("doc_id", "held_out", "__p.lang_pred", "__p.score")


@keeping_columns
def confident(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """``docs`` without rows that have no letter or no language with ``min_score`` of the words."""
    model = train(docs, rows=~held_out(4, 2), **options)
    p = predict(docs["text"].cast("string"), model, docs.sparkSession)
    return (docs.withColumn("__lang", p).where((F.col("__lang.lang_pred") != "und") & (F.col("__lang.score") >= min_score))
            .select(*docs.columns))
