"""Exact k-nearest neighbours (Euclidean) over a pivot partition.

1. Equal points are one *vector* (with its ``k + 1`` smallest keys), so a point that a third
   of all rows repeat is searched once.
2. A bounded sample gives pivots (at most :data:`MAX_PIVOTS`); every vector goes to the cell of its nearest
   pivot.  A cell is ordered by distance from its pivot (chunked order, so a dense cell is no
   single task) and cut into *blocks* of ``chunk_rows``: rings around the pivot.  By default blocks grow with the
   vectors (:data:`BLOCKS` of them, up to :data:`MAX_NUMBERS` each), so what the joins move grows as the input does.
3. The triangle inequality bounds the distance of a query ``q`` to a block (pivot ``p``, ring
   ``[lo, hi]``) from below by ``max(d(q, p) - hi, lo - d(q, p), 0)``.
4. Three joins, however many blocks there are: neighbours within the own block; then
   the nearest few blocks, to tighten each query's k-th distance; then all other blocks whose bound does
   not exceed it.  A task joins the queries of a few neighbouring blocks (one, if all points ask) with one block.

The result is exact: a block that is left out holds no vector within the k-th distance, ties
included.  How many pairs are left depends on the data: clustered points visit few, and where
distances concentrate no exact method can prune.  Pivots only decide how much is pruned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ordered import attach, ordered, top_k_per_key

CHUNK = 2048
#: blocks wanted of more than BLOCKS * CHUNK vectors, and numbers (rows x columns) of a block of them at most
BLOCKS, MAX_NUMBERS = 64, 1 << 21
#: query blocks that one task may join at once where few points ask
MAX_GROUP = 16
#: distances that a task holds at once
_TILE = 1 << 22
#: bounds what is broadcast: pivots, and blocks of 24 bytes
MAX_PIVOTS, MAX_BLOCKS = 4096, 1 << 20
#: sampled vectors per pivot
SAMPLE = 16
#: blocks that the tightening round visits at least, if the bound allows
NEAR = 2


def choose_pivots(sample: np.ndarray, m: int, seed: int = 42) -> np.ndarray:
    """``m`` rows of ``sample``, each drawn with probability by its squared distance to those before it."""
    rng = np.random.default_rng(seed)
    at = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < m and gap.max() > 0:
        i = int(np.searchsorted(np.cumsum(gap), rng.random() * gap.sum()))
        i = min(i, len(sample) - 1)
        at.append(i)
        gap = np.minimum(gap, ((sample - sample[i]) ** 2).sum(axis=1))
    return sample[sorted(set(at))]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All Euclidean distances by one matrix product about the mean of ``y`` (rounded; callers add a slack)."""
    mean = y.mean(axis=0)
    a, b = x - mean, y - mean
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than the rounding error of :func:`distances` can be."""
    mean = y.mean(axis=0)
    scale = ((x - mean) ** 2).sum(axis=1).max() + ((y - mean) ** 2).sum(axis=1).max()
    return float(np.sqrt(scale * 1e-12) + 1e-12)


def block_bounds(to_pivot: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances from queries (rows of ``to_pivot``, distances to all pivots) to blocks."""
    d = to_pivot[:, cell]
    return np.maximum(np.maximum(d - hi, lo - d), 0)


def _matrix(column) -> np.ndarray:
    """A column of equally long number lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest_of_pair(k: int, kind: pa.DataType):
    """The k nearest references (role 1) of every query (role 0) of a block pair."""
    schema = pa.schema([("q", kind), ("n", kind), ("dist", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        role = table.column("_role").to_numpy()
        ids, v = table.column("vid").combine_chunks(), _matrix(table.column("v"))
        qa, ra = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(qa) or not len(ra):
            return schema.empty_table()
        xr = v[ra]
        order = np.empty(len(ids), dtype=np.int64)      # ties go by key
        order[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        rank = order[ra]
        same = pa.compute.rank(ids, tiebreaker="min").to_numpy()
        out = [schema.empty_table()]
        step = max(1, _TILE // len(ra))
        for at in range(0, len(qa), step):
            qs = qa[at:at + step]
            xq = v[qs]
            near = distances(xq, xr)
            near[same[qs][:, None] == same[ra][None, :]] = np.inf       # a vector is not its own neighbour
            kk = min(k, near.shape[1])
            kth = np.partition(near, kk - 1, axis=1)[:, kk - 1]
            # the product only chooses (a few more than needed); distances are taken from the differences
            rows, cols = np.nonzero(np.isfinite(near) & (near <= (kth + 2 * slack(xq, xr))[:, None]))
            dist = np.empty(len(rows))
            for i in range(0, len(rows), 65536):
                s = slice(i, i + 65536)
                dist[s] = np.sqrt(((xq[rows[s]] - xr[cols[s]]) ** 2).sum(axis=1))
            by = np.lexsort((rank[cols], dist, rows))
            rows, cols, dist = rows[by], cols[by], dist[by]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < kk
            out.append(pa.table([ids.take(pa.array(qs[rows[keep]])), ids.take(pa.array(ra[cols[keep]])), pa.array(dist[keep])], schema=schema))
        return pa.concat_tables(out)

    return run


def _arrow_type(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[col].dataType)


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy("dist", "n")      # k candidates of each block that the query visited
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vector_neighbours(vectors: DataFrame, k: int, chunk_rows: int | None, visits: dict | None) -> DataFrame:
    """``q, n, dist, rank``: the k nearest other rows of ``vectors(vid, v, _ask)``, whose vectors all differ, for those that ask."""
    spark = vectors.sparkSession
    n, asking, width = vectors.agg(F.count(F.lit(1)), F.count_if("_ask"), F.max(F.size("v"))).first()
    kind = vectors.schema["vid"].dataType.simpleString()
    out_schema = f"q {kind}, n {kind}, dist double"
    if n < 2:
        return spark.createDataFrame([], out_schema + ", rank int")
    chunk_rows = chunk_rows or max(CHUNK, min(-(-n // BLOCKS), MAX_NUMBERS // max(1, width)))
    chunk_rows = max(chunk_rows, -(-n // MAX_BLOCKS))
    together = max(1, min(MAX_GROUP, n // max(1, asking)))
    m = min(MAX_PIVOTS, -(-n // chunk_rows))
    drawn = vectors.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE * m)            # bounded by MAX_PIVOTS
    pivots = spark.sparkContext.broadcast(choose_pivots(np.array([r["v"] for r in drawn.collect()], dtype=float), m))

    def to_cells(it):
        for b in it:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            cell = distances(x, pivots.value).argmin(axis=1)
            r = np.sqrt(((x - pivots.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(r)], names=["vid", "v", "_ask", "_cell", "_r"])

    placed = vectors.select("vid", "v", "_ask").mapInArrow(to_cells, f"vid {kind}, v array<double>, _ask boolean, _cell int, _r double")
    rows = ordered(placed, "_cell", "_r", "vid", chunk_rows=chunk_rows)
    rows = rows.select("vid", "v", "_ask", "_cell", "_r", F.floor((F.col("_pos") - 1) / chunk_rows).cast("long").alias("_ring"))
    rings = stored(rows.groupBy("_cell", "_ring").agg(F.min("_r").alias("lo"), F.max("_r").alias("hi"), F.count(F.lit(1)).alias("size")), "knn-rings")
    table = rings.orderBy("_cell", "_ring").toPandas()                                    # at most MAX_BLOCKS + MAX_PIVOTS rows
    numbered = spark.createDataFrame([(int(c), int(g), i) for i, (c, g) in enumerate(zip(table["_cell"], table["_ring"]))],
                                     "_cell int, _ring long, _b int")
    pts = stored(rows.join(numbered, ["_cell", "_ring"]).select("vid", "v", "_ask", F.col("_b").alias("_a")), "knn-points")
    ask = pts.where("_ask").select("vid", "v", "_a", F.floor(F.col("_a") / together).cast("int").alias("_g"))
    blocks = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("_cell", "lo", "hi", "size")))

    def joined(pairs: DataFrame) -> DataFrame:
        """k nearest per query and pair, for ``pairs(vid, v, _g, _b)`` of queries, in groups, and the blocks they visit."""
        refs = pairs.select("_g", "_b").distinct().join(pts.select(F.col("_a").alias("_b"), "vid", "v"), "_b")
        both = (pairs.select("_g", "_b", "vid", "v", F.lit(0).alias("_role"))
                .unionByName(refs.select("_g", "_b", "vid", "v", F.lit(1).alias("_role"))))
        return both.groupBy("_g", "_b").applyInArrow(_nearest_of_pair(k, _arrow_type(vectors, "vid")), out_schema)

    def visiting(found: DataFrame) -> DataFrame:
        """A row per query and block of ``survivors``."""
        return found.select("vid", "v", "_a", "_g", F.explode("blocks").alias("_b"))

    def survivors(queries: DataFrame, first: bool) -> DataFrame:
        """Queries with the ``blocks`` beyond the own one that may hold neighbours: the nearest few first, then all others.

        A row per query: its vector is stored once, however many blocks it visits."""
        def run(it):
            cell, lo, hi, size = blocks.value
            for b in it:
                for i in range(0, b.num_rows, 1024):
                    s = b.slice(i, 1024)
                    x, own = _matrix(s.column(1)), s.column(2).to_numpy()
                    dk = s.column(4).to_numpy()
                    to_pivot = distances(x, pivots.value)
                    lower = block_bounds(to_pivot, cell, lo, hi)
                    may = lower <= (dk + 2 * slack(x, pivots.value))[:, None]
                    may[np.arange(len(x)), own] = False
                    for q, seen in enumerate(s.column(5).to_pylist()):
                        may[q, seen] = False
                    if first:      # by bound, then by pivot distance, until there are NEAR blocks and k vectors
                        for q in range(len(x)):
                            c = np.flatnonzero(may[q])
                            c = c[np.lexsort((to_pivot[q, cell[c]], lower[q, c]))]
                            enough = np.searchsorted(np.cumsum(size[c]), k) + 1
                            may[q, c[max(NEAR, enough):]] = False
                    goes = np.flatnonzero(may.any(axis=1))
                    ends = np.concatenate([[0], np.cumsum(may[goes].sum(axis=1))])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(may[goes])[1], pa.int32()))
                    take = pa.array(goes)
                    yield pa.RecordBatch.from_arrays([*(s.column(j).take(take) for j in range(4)), lists], names=["vid", "v", "_a", "_g", "blocks"])

        out = queries.select("vid", "v", "_a", "_g", "dk", "seen").mapInArrow(run, f"vid {kind}, v array<double>, _a int, _g int, blocks array<int>")
        return stored(out, "knn-pairs")

    def queries(cand: DataFrame, seen: DataFrame | None) -> DataFrame:
        kth = cand.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("dk")).withColumnRenamed("q", "vid")
        out = ask.join(kth, "vid", "left").withColumn("dk", F.coalesce("dk", F.lit(float("inf"))))
        if seen is None:
            return out.withColumn("seen", F.array().cast("array<int>"))
        been = seen.groupBy("vid").agg(F.flatten(F.collect_list("blocks")).alias("seen"))             # a few blocks per query
        return out.join(been, "vid", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<int>")))

    cand = stored(_best(joined(ask.withColumn("_b", F.col("_a"))), k).drop("rank"), "knn-own")
    near = survivors(queries(cand, None), True)
    cand = stored(_best(cand.unionByName(joined(visiting(near))), k).drop("rank"), "knn-near")
    rest = survivors(queries(cand, near), False)
    if visits is not None:
        pairs = visiting(near).unionByName(visiting(rest)).select("_a", "_b").distinct().count()
        visits.update(blocks=len(table), pairs=pairs + len(table), all_pairs=len(table) ** 2)
    return stored(_best(cand.unionByName(joined(visiting(rest))), k), "knn")


def knn_exact(points: DataFrame, key: str, features: list[str], k: int,
              chunk_rows: int | None = None, visits: dict | None = None, ask: DataFrame | None = None) -> DataFrame:
    """``(q, n, dist, rank)``: the k nearest other points of every point (ties by key), or of those whose keys ``ask`` holds.

    ``visits``, if given, receives how many block pairs were joined and how many there are."""
    p = points.select(F.col(key).alias("vid"), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
    if ask is None:
        p = p.withColumn("_ask", F.lit(True))
    else:
        asked = ask.select(F.col(key).alias("vid")).distinct().withColumn("_ask", F.lit(True))
        p = p.join(asked, "vid", "left").withColumn("_ask", F.coalesce("_ask", F.lit(False)))
    p = stored(p, "knn-input")
    groups = stored(p.groupBy("v").agg(F.min("vid").alias("vid"), F.count(F.lit(1)).alias("_n"), F.max("_ask").alias("_ask")), "knn-vectors")
    between = _vector_neighbours(groups, k, chunk_rows, visits)
    if groups.where("_n > 1").isEmpty():
        return between
    # equal points: each vector's smallest keys stand for it, and its points are neighbours at distance 0
    firsts = (top_k_per_key(p, "v", F.lit(0), F.col("vid"), k + 1).groupBy("v")
              .agg(F.sort_array(F.collect_list("vid")).alias("keys")))                 # k + 1 keys
    heads = stored(groups.join(firsts, "v").select("vid", "_n", "v", "_ask", "keys"), "knn-keys")
    far = (between.join(heads.select(F.col("vid").alias("n"), "keys"), "n")
           .groupBy("q").agg(F.collect_list(F.struct("dist", "keys")).alias("far")))   # k vectors of k + 1 keys
    per = stored(heads.where("_ask").drop("_ask").join(far.withColumnRenamed("q", "vid"), "vid", "left").drop("vid"), "knn-per-vector")
    own = F.transform("keys", lambda x: F.struct(F.lit(0.0).alias("dist"), x.alias("n")))
    others = F.flatten(F.transform(F.coalesce("far", F.array()), lambda g: F.transform(
        g["keys"], lambda x: F.struct(g["dist"].alias("dist"), x.alias("n")))))
    best = F.slice(F.array_sort(F.filter(F.concat(own, others), lambda c: c["n"] != F.col("vid"))), 1, k)
    out = attach(p.where("_ask").drop("_ask"), per, "v", n_col="_n", row_id="vid").select(F.col("vid").alias("q"), F.posexplode(best).alias("at", "c"))
    return out.select("q", "c.n", "c.dist", (F.col("at") + 1).alias("rank"))
