"""Line dedup over levelled sorted runs of line hashes.

The store keeps sorted runs ``(hi, lo) -> documents`` in levels, each a table bucketed and
sorted by the hash, so that runs meet in merge joins without a shuffle.  A batch

1. merge-anti-joins the runs' *settled* hashes (already found in enough documents): such
   lines need no further entry, so a very common line costs one entry in all,
2. adds the rest as a run of its own at level 0, and
3. when a level holds ``fan`` runs, they are compacted into one run of the next level.

:meth:`LineRuns.frequent` merges what is left.  Lines are known by 128-bit hashes.

Edge cases: a null or empty text is one empty line; empty lines (keys under ``min_chars``
code points) are never dropped; a line repeated inside a document counts once for it; each row
counts as a document, repeated rows too; an empty table leaves no run; a text that loses
all lines becomes empty; very long texts are split whole in one task; other columns are kept as they are,
also one that bears a name of this module's own columns (:func:`with_lines_dropped`).
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import batches, content_key, keeping_columns, partitions, text_of, written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ENDS = b" \t\n\x0b\x0c\r"
_HASH = "hi long, lo long"


def line_hashes(text: str, min_chars: int) -> list[tuple[int, int] | None]:
    """For each line its key's 128-bit hash as two signed numbers; None where the key is too short."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n"):
        key = line.strip(_ENDS)
        if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
            continue
        d = xxhash.xxh3_128_intdigest(key)
        out.append((((d >> 64) ^ (1 << 63)) - (1 << 63), ((d & (1 << 64) - 1) ^ (1 << 63)) - (1 << 63)))
    return out


def batch_counts(docs: DataFrame, text_col: str, min_chars: int, n_batches: int) -> DataFrame:
    """``batch, hi, lo, docs``: documents per line hash, summed up per Arrow batch before any shuffle."""
    def run(it):
        for b in batches(it, 2048):
            n: dict = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for h in set(line_hashes(t, min_chars)):
                    if h is not None:
                        n[k, *h] = n.get((k, *h), 0) + 1
            if n:
                k, hi, lo = zip(*n)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                                                  pa.array(n.values(), pa.int64())], names=["batch", "hi", "lo", "docs"])

    t = text_of(docs, text_col)
    batch = F.pmod(F.xxhash64(t, F.lit(11)), F.lit(n_batches)).cast("int")
    return docs.select(t.alias("t"), batch.alias("b")).mapInArrow(run, f"batch int, {_HASH}, docs long")


class LineRuns:
    """Levelled runs of ``(hi, lo, docs)``; a run's hashes are unique in it."""

    def __init__(self, spark: SparkSession, threshold: int, fan: int = 4):
        self.spark, self.threshold, self.fan = spark, threshold, fan
        self.buckets = partitions(spark)
        self.levels: list[list[str]] = [[]]
        self._names: list[str] = []
        self._home = checkpoint_dir(spark)

    def _run(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (counts.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo")
         .option("path", f"{self._home}/{name}").saveAsTable(name))
        self._names.append(name)
        return name

    def _merged(self, runs: list[str]) -> DataFrame:
        # read by path: a union of bucketed tables claims a partitioning that its columnar form lacks
        files = self.spark.read.schema(f"{_HASH}, docs long").parquet(*(f"{self._home}/{r}" for r in runs))
        return files.repartition(self.buckets, "hi", "lo").groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, raw: DataFrame) -> None:
        """Take in a batch of ``(hi, lo, docs)`` rows (hashes may repeat)."""
        fresh = raw.repartition(self.buckets, "hi", "lo").groupBy("hi", "lo").agg(F.sum("docs").alias("docs"))
        for r in self.runs():
            settled = self.spark.table(r).where(F.col("docs") >= self.threshold).select("hi", "lo")
            fresh = fresh.join(settled.hint("merge"), ["hi", "lo"], "left_anti")
        self.levels[0].append(self._run(fresh))
        level = 0
        while len(self.levels[level]) >= self.fan:
            run = self._run(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)

    def frequent(self) -> DataFrame:
        """Hashes found in at least ``threshold`` documents."""
        if not self.runs():
            return self.spark.createDataFrame([], _HASH)
        return self._merged(self.runs()).where(F.col("docs") >= self.threshold).select("hi", "lo")

    def close(self) -> None:
        """Forget the table names; the files stay with the checkpoint folder."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def frequent_lines(docs: DataFrame, min_docs: int, text_col: str = "text", min_chars: int = 1,
                   n_batches: int = 4, fan: int = 3) -> DataFrame:
    """Hashes of line keys found in at least ``min_docs`` rows, stored in the shared folder."""
    counts = batch_counts(docs, text_col, min_chars, n_batches)
    stored = written(counts.repartition(partitions(docs.sparkSession), "batch", "hi", "lo"), "line-batches")
    runs = LineRuns(docs.sparkSession, min_docs, fan)
    try:
        for k in range(n_batches):
            runs.add(stored.where(F.col("batch") == k).drop("batch"))
        return written(runs.frequent(), "line-frequent")
    finally:
        runs.close()


class HashTable:
    """128-bit hashes as two sorted arrays, 16 bytes each hash."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        order = np.lexsort((lo, hi))
        self.hi, self.lo = hi[order], lo[order]

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Which of the given hashes are in the table."""
        out = np.zeros(len(hi), dtype=bool)
        at, end = np.searchsorted(self.hi, hi, "left"), np.searchsorted(self.hi, hi, "right")
        one = end - at == 1
        out[one] = self.lo[at[one]] == lo[one]
        for i in np.flatnonzero(end - at > 1):      # hashes that share 64 bits
            out[i] = (self.lo[at[i]:end[i]] == lo[i]).any()
        return out


def _table(frequent: DataFrame, n: int) -> HashTable:
    hi, lo = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i, r in enumerate(frequent.toLocalIterator()):
        hi[i], lo[i] = r.hi, r.lo
    return HashTable(hi, lo)


def _joined(text: str, keep) -> tuple[str, int, int]:
    lines = text.split("\n")
    left = [x for x, k in zip(lines, keep) if k]
    return "\n".join(left), len(lines), len(lines) - len(left)


def _strip(texts: list[str], table: HashTable, min_chars: int) -> list[tuple[str, int, int]]:
    """(text, lines, dropped lines) of texts without the lines that the table holds."""
    keys = [line_hashes(t, min_chars) for t in texts]
    flat = np.array([h for k in keys for h in k if h is not None], dtype=np.int64).reshape(-1, 2)
    gone = iter(table.holds(flat[:, 0], flat[:, 1]).tolist())
    return [_joined(t, [h is None or not next(gone) for h in k]) for t, k in zip(texts, keys)]


def drop_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", min_chars: int = 1,
               broadcast_rows: int = 500_000) -> DataFrame:
    """``docs`` with a struct column ``__lines(text, n_lines, n_dropped)``.

    Up to ``broadcast_rows`` frequent hashes (16 bytes each) go to every task; more are
    joined to the lines by hash and gathered per row (at most as many as the text has lines).
    """
    kind = "text string, n_lines long, n_dropped long"
    text = text_of(docs, text_col)
    n = frequent.count()
    if n <= broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast(_table(frequent, n))

        @F.pandas_udf(kind)
        def strip(s: pd.Series) -> pd.DataFrame:
            rows = [r for i in range(0, len(s), 256) for r in _strip(s.iloc[i:i + 256].tolist(), shared.value, min_chars)]
            return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        return docs.withColumn("__lines", strip(text))

    def explode(it):
        for b in batches(it):
            rows = [(a, c, *h) for t, a, c in zip(*(b.column(i).to_pylist() for i in range(3)))
                    for h in set(line_hashes(t, min_chars)) if h is not None]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["__k1", "__k2", "hi", "lo"])

    @F.pandas_udf(kind)
    def strip_own(s: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for t, o in zip(s, own):
            drop = set() if o is None else {(x["hi"], x["lo"]) for x in o}
            out.append(_joined(t, [h is None or h not in drop for h in line_hashes(t, min_chars)]))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    keyed = docs.withColumns(dict(zip(["__k1", "__k2"], content_key(text))))
    hits = (keyed.select(text.alias("t"), "__k1", "__k2").mapInArrow(explode, f"__k1 long, __k2 long, {_HASH}")
            .dropDuplicates().join(frequent, ["hi", "lo"])
            .groupBy("__k1", "__k2").agg(F.collect_list(F.struct("hi", "lo")).alias("__own")))
    return (keyed.join(hits, ["__k1", "__k2"], "left")
            .withColumn("__lines", strip_own(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "__own"))
            .drop("__k1", "__k2", "__own"))


def line_dedup(docs: DataFrame, min_docs: int = 10, text_col: str = "text", min_chars: int = 1,
               n_batches: int = 4, fan: int = 3) -> DataFrame:
    """``docs`` with ``__lines``: the text without lines whose key is found in ``min_docs`` rows or more."""
    return drop_lines(docs, frequent_lines(docs, min_docs, text_col, min_chars, n_batches, fan), text_col, min_chars)


@keeping_columns
def with_lines_dropped(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with its text cleaned and, if there is one, ``n_chars`` brought up to date."""
    out = line_dedup(docs, **options)
    put = {"text": F.col("__lines.text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.length("__lines.text").cast(docs.schema["n_chars"].dataType)
    return out.withColumns(put).select(*docs.columns)
