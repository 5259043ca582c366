"""Vector compression to short codes by limb-split exact matrix products.

A vector's components become integers ``floor(scale * x)`` and the vector is cut into equal
consecutive parts.  Each part position has a codebook that starts as that part of the first
rows and is refined for some rounds (assign every part to its nearest entry, replace each
entry by the floor of its parts' mean); a code is the index of the nearest entry per part.

Squared distances are ``|x|^2 - 2 x.c + |c|^2`` in whole numbers.  The dot products come from
float64 matrix products: both sides are broken into limbs so narrow that no product sum reaches
2**53, each pair of limbs is one exact product, and the shifted results are added up in int64.
The first smallest distance wins, so ties go to the lower index and the result does not
depend on the machine's BLAS, on the batches or on the partitions.

Every round is one map pass over the stored vectors and an aggregate of at most
``parts * entries`` rows per task; sums are sent as 32-bit limbs in longs, so they are exact too.
Only the codebooks (``entries`` times the dimension) pass the driver.

Edge cases: rows whose vector is null, empty, holds null or non-finite components, or cannot be
cut into equal parts are dropped; so are vectors of another length than the most frequent one
(of equally frequent lengths the longest).  Fewer rows than ``entries`` give smaller codebooks; repeated rows
and repeated ids are rows each (the first rows go by id, nulls last, then by vector).
Components so large that int64 could overflow take a slower exact path over Python integers,
and errors beyond 2**63 - 1 are given as 2**63 - 1.  Null ids and labels are kept, null labels are one
label; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import attach
from .common import written

#: rows scored at once: their distances to one codebook of 256 entries take 8 MB
ROWS = 4096
LONG_MAX = (1 << 63) - 1
_SUM_BITS = 32


def limbs(a: np.ndarray, width: int) -> list[np.ndarray]:
    """Whole numbers in float64 as limbs ``a = sum(limb[i] << width * i)``; all but the last in [0, 2**width)."""
    if not a.size or np.abs(a).max() <= 2.0 ** width:
        return [a]
    out, rest = [], a.astype(np.int64)
    while np.abs(rest).max() > 1 << width:
        out.append((rest & ((1 << width) - 1)).astype(np.float64))
        rest = rest >> width
    return [*out, rest.astype(np.float64)]


def exact_dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` in int64 from float64 products that stay below 2**53 (exact if the result fits int64)."""
    width = (53 - math.ceil(math.log2(max(2, x.shape[1])))) // 2
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    right = limbs(c, width)
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (width * (i + j))
    return out


def fits_int64(largest: float, dim: int) -> bool:
    """Whether squared distances between vectors of ``dim`` components up to ``largest`` stay below 2**63."""
    return dim * (2 * int(largest)) ** 2 < 1 << 63


def nearest(x: np.ndarray, c: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of ``c``, ties to the lower index.

    ``small`` promises that int64 holds every distance; else Python integers are used."""
    if small:
        xi, ci = x.astype(np.int64), c.astype(np.int64)
        d = (xi * xi).sum(axis=1)[:, None] - 2 * exact_dots(x, c) + (ci * ci).sum(axis=1)[None, :]
    else:
        xi, ci = _whole(x), _whole(c)
        d = (xi * xi).sum(axis=1)[:, None] - 2 * xi.dot(ci.T) + (ci * ci).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _whole(a: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    out = np.empty(a.shape, dtype=object)
    out.ravel()[:] = [int(v) for v in a.ravel()]
    return out


def _part_sums(x: np.ndarray, at: np.ndarray, k: int, small: bool) -> np.ndarray:
    """Sum of the rows of ``x`` per index, as Python integers; one column of counts in front."""
    out = np.zeros((k, x.shape[1] + 1), dtype=object)
    out[:, 0] = np.bincount(at, minlength=k).astype(object)
    if small:     # |x| < 2**31, so ROWS of them add up below 2**53
        for j in range(x.shape[1]):
            out[:, j + 1] = np.bincount(at, weights=x[:, j], minlength=k).astype(np.int64).astype(object)
    else:
        np.add.at(out[:, 1:], at, _whole(x))
    return out


def integer_vectors(vectors: DataFrame, vector_col: str = "embedding", parts: int = 4, scale: float = 1024.0) -> DataFrame:
    """``id, label, n, v`` of the usable rows; ``v`` holds the whole numbers ``floor(scale * x)`` as doubles."""
    src = vectors.select("vec_id", "label", F.col(vector_col).cast("array<double>").alias("v"))

    def run(it):
        for b in it:
            col = b.column(2)
            n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)    # null components become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            ends = np.cumsum(n)
            keep = (n > 0) & (n % parts == 0) & (bad[ends] == bad[ends - n])
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(flat * scale)[np.repeat(keep, n)]
            offsets = np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int32)
            take = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(n[keep], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(whole))], names=["vec_id", "label", "n", "v"])

    kinds = [src.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return src.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, n long, v array<double>")


def _matrices(it, dim: int):
    """Blocks of at most ROWS rows: the batch's slice and its vectors as one matrix."""
    for b in it:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _shared(spark, books: list[np.ndarray], small: bool):
    """The codebooks (Python integers, so means stay exact) for the tasks: as float64 where that holds them."""
    return spark.sparkContext.broadcast([b.astype(np.float64) if small else b for b in books])


def _new_entries(rows: DataFrame, books: list[np.ndarray], dim: int, small: bool, n_limbs: int) -> list[np.ndarray]:
    """One round: assign all parts, then replace every used entry by the floor of its parts' mean."""
    parts, k, width = len(books), len(books[0]), dim // len(books)
    shared = _shared(rows.sparkSession, books, small)
    low = (1 << _SUM_BITS) - 1

    def run(it):
        sums = [np.zeros((k, width + 1), dtype=object) for _ in range(parts)]
        for _, x in _matrices(it, dim):
            for p, book in enumerate(shared.value):
                xp = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                sums[p] += _part_sums(xp, nearest(xp, book, small)[0], k, small)
        at = [(p, e) for p in range(parts) for e in range(k) if sums[p][e, 0]]
        if at:
            flat = [[s >> (_SUM_BITS * i) & low if i < n_limbs - 1 else s >> (_SUM_BITS * i) for i in range(n_limbs)]
                    for p, e in at for s in sums[p][e]]
            values = np.array(flat, dtype=np.int64).ravel()
            size = (width + 1) * n_limbs
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(values))],
                names=["part", "entry", "s"])

    size = (width + 1) * n_limbs
    sums = (rows.select("v").mapInArrow(run, "part int, entry int, s array<long>")
            .groupBy("part", "entry").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)]))
    out = [b.copy() for b in books]
    for r in sums.toLocalIterator():          # at most parts * entries rows
        whole = [sum(int(r[f"s{i * n_limbs + j}"]) << (_SUM_BITS * j) for j in range(n_limbs)) for i in range(width + 1)]
        out[r["part"]][r["entry"]] = [s // whole[0] for s in whole[1:]]
    shared.unpersist()
    return out


def vector_codes(vectors: DataFrame, vector_col: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4,
                 scale: float = 1024.0) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes ``vec_id, label, codes array<int>, error`` of all usable rows, and the codebooks, one matrix per part.

    ``error`` is the squared distance between the integer vector and its decoded form."""
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, vector_col, parts, scale), "codes-integers")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    schema = f"vec_id {kinds[0]}, label {kinds[1]}, codes array<int>, error long"
    most = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if most is None:
        return spark.createDataFrame([], schema), []
    dim = most["n"]
    rows = rows.where(F.col("n") == dim)
    largest = rows.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0]
    small = fits_int64(largest, dim) and largest < 1 << 31
    n_limbs = max(2, (int(largest).bit_length() + 40) // _SUM_BITS + 1)     # sums of up to 2**40 rows
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = _whole(np.array([r["v"] for r in first]))
    width = dim // parts
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        books = _new_entries(rows, books, dim, small, n_limbs)
    shared = _shared(spark, books, small)

    def assign(it):
        for b, x in _matrices(it, dim):
            found = [nearest(np.ascontiguousarray(x[:, p * width:(p + 1) * width]), book, small)
                     for p, book in enumerate(shared.value)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.int32)
            error = sum(d for _, d in found)
            error = error if small else [min(LONG_MAX, e) for e in error]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.ravel())),
                 pa.array(error, pa.int64())], names=["vec_id", "label", "codes", "error"])

    return written(rows.select("vec_id", "label", "v").mapInArrow(assign, schema), "codes"), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' components as decimal integers joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the sum of ``error`` over the rows of the same label (nulls are one label).

    Sums are made per label before any shuffle and reach the rows by a join that splits hot labels."""
    keyed = codes.withColumn("__label", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    per_label = written(keyed.groupBy("__label").agg(
        F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"),
        F.count(F.lit(1)).alias("_n")), "codes-labels")
    return attach(keyed, per_label, "__label").drop("__label", "_n")
