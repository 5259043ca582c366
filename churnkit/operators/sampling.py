"""Splits, folds, class weights, resampling and feature screening (2.15).

Deterministic stratified splits: each row gets a 60-bit number from
``md5(seed || key)``; rows are ranked by it *within their class* and cut by
share.  A class holds a third of all rows, so the within-class rank comes
from the chunked :func:`ordered.ordered` (hash-range chunks), never from a
``Window.partitionBy(class)`` that would put a whole class in one task.
The same hash is available in SQL, so splits are reproducible outside
Spark.

k-NN resampling (SMOTE, ADASYN, SMOTE+ENN) uses the exact distributed
neighbour search of :mod:`operators.knn` (pivot cells cut into rings, pairs of blocks
that the triangle inequality leaves).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered

SEED = 42


def hash_rank_key(key: str, seed: int = SEED) -> F.Column:
    """60-bit unsigned number from md5(seed || key) - identical in DuckDB."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


#: frames of more columns keep them in place while keys are ranked
WIDE_COLUMNS = 32


def rank_within_class(df: DataFrame, label: str, key: str, seed: int = SEED,
                      chunk_rows: int | None = None) -> DataFrame:
    """Adds ``_pos`` (1-based rank by hash within class) and ``_n`` (class size).

    Of a wide frame only the keys are dealt out, stored and ranked; its rows move once, to meet their ranks."""
    if len(df.columns) > WIDE_COLUMNS:
        return _wide_rank_within_class(df, label, key, seed, chunk_rows)
    d = df.withColumn("_h", hash_rank_key(key, seed))
    o = ordered(d, label, "_h", key, chunk_rows=chunk_rows)
    return o.drop("_pos_desc", "_nv", "_t0", "_t1")


def _wide_rank_within_class(df: DataFrame, label: str, key: str, seed: int, chunk_rows: int | None) -> DataFrame:
    per = df.groupBy(label, key).agg(F.count(F.lit(1)).alias("_c")).withColumn("_h", hash_rank_key(key, seed))
    sizes = per.groupBy(label).agg(F.sum("_c").alias("_rows"))
    ranks = ordered(per, label, "_h", key, sums_before={"c": F.col("_c")}, chunk_rows=chunk_rows, stats=sizes).select(
        F.col(label).alias("_label"), F.col(key).alias("_key"), "_h", "_c", F.col("before_c").cast("long").alias("_before"),
        F.col("_rows").alias("_n"))
    # one row per class and key on that side, so no hash table of it holds a hot key
    met = df.join(ranks.hint("shuffle_hash"), (F.col(label) == F.col("_label")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_label", "_key")
    cols = [label, *[c for c in df.columns if c != label], "_h", "_n"]
    out = met.select(*cols, (F.col("_before") + 1).alias("_pos"), "_c")
    if ranks.where("_c > 1").isEmpty():
        return out.drop("_c")
    again = ordered(met.where("_c > 1").drop("_n").withColumnRenamed("_c", "_rows"), [label, "_before"], "_h", "_rows", chunk_rows=chunk_rows, stats=None)
    again = again.join(F.broadcast(sizes.select(F.col(label).alias("_label"), F.col("_rows").alias("_n_rows"))), F.col(label) == F.col("_label"))
    again = again.select(*cols[:-1], F.col("_n_rows").alias("_n"), (F.col("_before") + F.col("_pos")).alias("_pos"))
    return out.where("_c = 1").drop("_c").unionByName(again)


def stratified_split(df: DataFrame, label: str, key: str, shares: dict[str, float], seed: int = SEED,
                     chunk_rows: int | None = None) -> DataFrame:
    """M1 / M2: adds ``split``; ``shares`` in order, e.g. {"test": .1, "val": .1, "train": rest}.

    Per class the first round(n * share) hash-ranked rows go to the first split,
    then the next split takes round(remaining * share / remaining_share) ..."""
    r = rank_within_class(df, label, key, seed, chunk_rows)
    n = F.col("_n").cast("double")
    names = list(shares)
    bounds = []
    taken = F.lit(0).cast("long")
    left_share = 1.0
    expr = None
    for i, name in enumerate(names[:-1]):
        frac = shares[name] / left_share
        cnt_i = F.round((n - taken) * F.lit(frac)).cast("long")
        hi = taken + cnt_i
        bounds.append((name, hi))
        cond = F.col("_pos") <= hi
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        taken = hi
        left_share -= shares[name]
    expr = expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])
    return r.withColumn("split", expr).drop("_h", "_pos", "_n")


def make_splits(df: DataFrame, label: str = "y", key: str = "user_id", val_size: float = 0.10,
                test_size: float = 0.10, seed: int = SEED) -> DataFrame:
    """M1: stratified train / val / test = 80 / 10 / 10."""
    return stratified_split(df, label, key, {"test": test_size, "val": val_size,
                                             "train": 1.0 - val_size - test_size}, seed)


def make_holdout(df: DataFrame, label: str = "y", key: str = "user_id", holdout: float = 0.15,
                 seed: int = SEED) -> DataFrame:
    """M2: stratified 85 / 15 train-val / holdout."""
    return stratified_split(df, label, key, {"holdout": holdout, "trainval": 1.0 - holdout}, seed)


def assign_folds(df: DataFrame, label: str = "y", key: str = "user_id", k: int = 5, seed: int = SEED,
                 chunk_rows: int | None = None) -> DataFrame:
    """M3: stratified fold id = (rank within class - 1) mod k (fold sizes differ by <= 1 per class)."""
    r = rank_within_class(df, label, key, seed, chunk_rows)
    return r.withColumn("fold", F.pmod(F.col("_pos") - 1, F.lit(k)).cast("int")).drop("_h", "_pos", "_n")


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """M4: balanced weights n / (k * n_c) per class (one small row per class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(tot)).select(
        label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "y", col: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(col))
    return df.join(F.broadcast(w), label, "left")  # one row per class


def pos_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """M4: neg / pos for a binary label (one row)."""
    return df.agg((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("pos_weight"))


# ------------------------------------------------------------------- imputing / scaling
def median_impute(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """M8 (first half): NULL -> column median (exact, chunked quantiles)."""
    from .ordered import exact_quantiles
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    tie = key or "_rid"
    base = df if key else df.withColumn("_rid", F.monotonically_increasing_id())
    long = base.select(tie, st.alias("_col", "_v"))
    med = exact_quantiles(long, "_v", [0.5], keys=["_col"], tie=tie)
    row = med.agg(*[F.max(F.when(F.col("_col") == c, F.col("q0"))).alias(f"_med_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(row))  # one row
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
    return out.drop(*[f"_med_{c}" for c in cols])


# ------------------------------------------------------------------- correlation screening
def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson correlation (pyspark.ml.stat); NULLs are filled with 0 first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    va = VectorAssembler(inputCols=cols, outputCol="_f", handleInvalid="keep")
    v = va.transform(df.fillna(0, subset=cols)).select("_f")
    return Correlation.corr(v, "_f").head()[0].toArray()


def correlation_filter(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """M9: drop a column when any earlier column correlates with it above ``threshold``."""
    c = np.abs(correlation_matrix(df, cols))
    drop = {cols[j] for j in range(len(cols)) for i in range(j) if c[i, j] > threshold}
    return [x for x in cols if x not in drop]


def gram_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Uncentred ``X'X`` (NULL as 0): one pass, a task sends one matrix of its rows."""
    import pyarrow as pa
    d = len(cols)

    def run(it):
        total = np.zeros((d, d))
        for b in it:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) if b.num_rows else np.zeros((0, d))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    rows = x.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in rows.toLocalIterator():        # d * d numbers
        out[r["i"], r["j"]] = r["v"]
    return out


def vif_filter(df: DataFrame, cols: list[str], threshold: float = 10.0, tol: float = 1e-10) -> list[str]:
    """Repeatedly drop the column with the largest variance inflation (the first of equals) until none exceeds ``threshold``.

    The uncentred form: a column against all others without intercept, ``[G^-1]_jj G_jj`` of the Gram matrix ``G``.  The
    matrix is built once; a dropped column is swept out of its inverse.  Columns that others span
    exactly have infinite inflation and go first; columns of zeros only are kept, as their inflation is undefined."""
    g = gram_matrix(df, cols)
    scale = np.sqrt(np.diag(g))
    live = [j for j in range(len(cols)) if scale[j] > 0]
    kept = set(range(len(cols)))
    g = g / np.where(scale > 0, scale, 1)[:, None] / np.where(scale > 0, scale, 1)[None, :]
    while len(live) > 1:
        values, vectors = np.linalg.eigh(g[np.ix_(live, live)])
        null = vectors[:, values < tol * len(live)]
        if not null.shape[1]:
            break
        gone = live[int(np.argmax((np.abs(null) > 1e-6).any(axis=1)))]
        live.remove(gone)
        kept.discard(gone)
    inv = np.linalg.inv(g[np.ix_(live, live)]) if live else np.zeros((0, 0))
    while len(live) > 1:
        vif = np.diag(inv)
        j = int(np.argmax(vif))
        if vif[j] <= threshold:
            break
        rest = [i for i in range(len(live)) if i != j]
        inv = inv[np.ix_(rest, rest)] - np.outer(inv[rest, j], inv[j, rest]) / inv[j, j]
        kept.discard(live.pop(j))
    return [c for j, c in enumerate(cols) if j in kept]


# ------------------------------------------------------------------- k-NN resampling
def _counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}   # one row per class


def smote(df: DataFrame, label: str, features: list[str], key: str, k: int = 5, seed: int = SEED,
          minority=None, n_new: int | None = None, chunk_rows: int | None = None, origin: bool = False) -> DataFrame:
    """M5: SMOTE - synthetic minority rows ``x + u * (nn - x)`` with ``nn`` one of the
    k nearest minority neighbours (exact, :func:`knn.knn_exact`).  Features must be
    non-NULL (impute first).  Returns the input plus synthetic rows
    (``synthetic = 1``); by default the synthetic count balances the two classes.
    ``origin`` adds ``base``, ``neighbour`` and ``gap`` (NULL on input rows).

    Synthetic row j starts from the minority row at hash rank ``j mod n_min`` and
    takes neighbour number ``hash(seed, j) mod k`` with gap ``u`` from another
    hash: deterministic, and built with joins only (no driver collect)."""
    from .knn import knn_exact
    counts = _counts(df, label)
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], c), default=None)
    n_min = counts.get(minority, 0)
    n_new = max(counts.values(), default=0) - n_min if n_new is None else n_new
    orig = df.select(F.col(key).cast("string").alias(key), *[F.col(f).cast("double") for f in features],
                     label).withColumn("synthetic", F.lit(0))
    if origin:
        orig = orig.select("*", *[F.lit(None).cast("string").alias(c) for c in ("base", "neighbour")],
                           F.lit(None).cast("double").alias("gap"))
    if n_new <= 0 or n_min < 2:
        return orig
    kk = min(k, n_min - 1)
    mino = orig.where(F.col(label) == minority).select(key, *features)
    nn = knn_exact(mino, key, features, kk, chunk_rows)
    ranked = rank_within_class(mino.withColumn("_one", F.lit(0)), "_one", key, seed).select(key, "_pos")
    spark = df.sparkSession
    syn = spark.range(n_new).select(
        F.col("id").alias("_j"),
        (F.pmod(F.col("id"), F.lit(n_min)) + 1).alias("_pos"),
        (F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(kk)) + 1).cast("int").alias("rank"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(2 ** 31)) / float(2 ** 31)).alias("_u"))
    syn = syn.join(ranked, "_pos").withColumnRenamed(key, "q").join(nn.select("q", "n", "rank"), ["q", "rank"])
    base = mino.select(F.col(key).alias("q"), *[F.col(f).alias(f"_b_{f}") for f in features])
    nb = mino.select(F.col(key).alias("n"), *[F.col(f).alias(f"_n_{f}") for f in features])
    syn = syn.join(base, "q").join(nb, "n")
    syn = syn.select(F.concat(F.lit("syn_"), F.col("_j").cast("string")).alias(key),
                     *[(F.col(f"_b_{f}") + F.col("_u") * (F.col(f"_n_{f}") - F.col(f"_b_{f}"))).alias(f)
                       for f in features],
                     F.lit(minority).alias(label), F.lit(1).alias("synthetic"),
                     *([F.col("q").alias("base"), F.col("n").alias("neighbour"), F.col("_u").alias("gap")] if origin else []))
    return orig.unionByName(syn)


def enn_clean(df: DataFrame, label: str, features: list[str], key: str, k: int = 3,
              chunk_rows: int | None = None) -> DataFrame:
    """M7 (cleaning half): drop rows whose k nearest neighbours (exact) mostly
    disagree with their label."""
    from .knn import knn_exact
    d = df.select(key, label, *features)
    nn = knn_exact(d, key, features, k, chunk_rows)
    lab = d.select(F.col(key).alias("n"), F.col(label).alias("_ln"))
    votes = (nn.join(lab, "n").join(d.select(F.col(key).alias("q"), F.col(label).alias("_lq")), "q")
             .groupBy("q").agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("_ln") == F.col("_lq")).alias("_agree")))
    keep = votes.where(F.col("_agree") * 2 > F.col("_k")).select(F.col("q").alias(key))
    return d.join(keep, key, "left_semi")


def adasyn_counts(df: DataFrame, label: str, features: list[str], key: str, minority, k: int = 5,
                  chunk_rows: int | None = None) -> DataFrame:
    """M6: per minority row, the share of majority rows among its k nearest
    neighbours (exact), normalised into the weight ADASYN uses to spread the
    synthetic rows."""
    r = majority_neighbours(df, label, features, key, minority, k, chunk_rows)
    tot = r.agg(F.sum("majority_neighbours").alias("_t"))
    return r.crossJoin(F.broadcast(tot)).select(key, (F.col("majority_neighbours") / F.col("neighbours")).alias("majority_ratio"),
                                               (F.col("majority_neighbours") / F.col("_t")).alias("weight"))


def majority_neighbours(df: DataFrame, label: str, features: list[str], key: str, minority, k: int = 5,
                        chunk_rows: int | None = None) -> DataFrame:
    """Per minority row its ``neighbours`` (k, or all others of a small table) and how many of them are of another class."""
    from .knn import knn_exact
    d = df.select(key, label, *features)
    nn = knn_exact(d, key, features, k, chunk_rows, ask=d.where(F.col(label) == minority))      # only minority rows ask
    mino = d.where(F.col(label) == minority).select(F.col(key).alias("q"))
    lab = d.select(F.col(key).alias("n"), F.col(label).alias("_ln"))
    return (mino.join(nn, "q", "left").join(lab, "n", "left").groupBy(F.col("q").alias(key))
            .agg(F.count("n").alias("neighbours"), F.count_if(~F.col("_ln").eqNullSafe(F.lit(minority))
                                                             & F.col("n").isNotNull()).alias("majority_neighbours")))


def adasyn_allocation(df: DataFrame, label: str, features: list[str], key: str, minority, n_new: int, k: int = 5,
                      chunk_rows: int | None = None) -> DataFrame:
    """M6: exactly ``n_new`` synthetic rows dealt to the minority rows: ``key, majority_neighbours, n_new``.

    A row's quota is ``n_new * c / C`` with ``c`` of its neighbours and ``C`` of all rows' neighbours
    in another class.  Quotas are cut down and what is missing goes to the largest
    remainders, ties by key; all in whole numbers, so the counts are the same everywhere.
    Ranks by remainder come from the chunked order, as a third of all rows may share a
    remainder.  If no row has a neighbour of another class, all have the same quota."""
    from ..session import stored
    c = stored(majority_neighbours(df, label, features, key, minority, k, chunk_rows), "adasyn-neighbours")
    total, rows = c.agg(F.sum("majority_neighbours"), F.count(F.lit(1))).first()
    weight = F.col("majority_neighbours") if total else F.lit(1).cast("long")
    total = int(total or rows or 1)
    q = (c.select(key, "majority_neighbours", (weight * F.lit(int(n_new)).cast("decimal(20,0)")).alias("_share"))
         .select("*", F.expr(f"_share div {total}").alias("_floor"), F.expr(f"_share % {total}").cast("long").alias("_rem")))
    left = int(n_new) - int(q.agg(F.sum("_floor")).first()[0] or 0)
    o = ordered(q.select(key, "majority_neighbours", "_floor", (-F.col("_rem")).alias("_by"), F.lit(0).alias("_all")), "_all", "_by", key,
                chunk_rows=chunk_rows)
    return o.select(key, "majority_neighbours", (F.col("_floor") + (F.col("_pos") <= left).cast("long")).alias("n_new"))


#: synthetic rows that one task makes of one row at a time
_MADE_AT_ONCE = 10_000


def adasyn(df: DataFrame, label: str, features: list[str], key: str, k: int = 5, seed: int = SEED, minority=None,
           n_new: int | None = None, chunk_rows: int | None = None, origin: bool = False) -> DataFrame:
    """M6: ADASYN - the input plus ``n_new`` synthetic minority rows ``x + u * (nn - x)`` (``synthetic`` = 1).

    Rows with more majority neighbours get more (:func:`adasyn_allocation`); ``nn`` is one of the
    k nearest *minority* neighbours, drawn with ``u`` by seeded hashes of the row and the number of the
    synthetic row.  A row's share is made in pieces of 10,000 by many tasks.  Features must be
    non-NULL.  By default the classes become equal in number; ``origin`` adds
    ``base``, ``neighbour`` and ``gap``."""
    from .knn import knn_exact
    counts = _counts(df, label)
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], c), default=None)
    n_min = counts.get(minority, 0)
    n_new = max(counts.values(), default=0) - n_min if n_new is None else n_new
    orig = df.select(F.col(key).cast("string").alias(key), *[F.col(f).cast("double") for f in features],
                     label).withColumn("synthetic", F.lit(0))
    if origin:
        orig = orig.select("*", *[F.lit(None).cast("string").alias(c) for c in ("base", "neighbour")],
                           F.lit(None).cast("double").alias("gap"))
    if n_new <= 0 or n_min < 2:
        return orig
    kk = min(k, n_min - 1)
    plan = adasyn_allocation(orig, label, features, key, minority, n_new, k, chunk_rows).where("n_new > 0")
    mino = orig.where(F.col(label) == minority).select(key, *features)
    nn = knn_exact(mino, key, features, kk, chunk_rows)
    pieces = plan.select(F.col(key).alias("q"), "n_new", F.explode(F.sequence(
        F.lit(0).cast("long"), F.expr(f"(n_new - 1) div {_MADE_AT_ONCE}"))).alias("_piece"))
    first = F.col("_piece") * _MADE_AT_ONCE
    last = F.least(F.col("n_new"), first + _MADE_AT_ONCE) - 1
    syn = pieces.repartition("q", "_piece").select("q", F.explode(F.sequence(first, last)).alias("_j"))
    syn = syn.select("q", "_j", (F.pmod(F.xxhash64(F.lit(seed), "q", "_j"), F.lit(kk)) + 1).cast("int").alias("rank"),
                     (F.pmod(F.xxhash64(F.lit(seed + 1), "q", "_j"), F.lit(2 ** 31)) / float(2 ** 31)).alias("_u"))
    base = mino.select(F.col(key).alias("q"), *[F.col(f).alias(f"_b_{f}") for f in features])
    nb = mino.select(F.col(key).alias("n"), *[F.col(f).alias(f"_n_{f}") for f in features])
    pairs = nn.select("q", "n", "rank").join(base, "q").join(nb, "n")                  # k rows per minority row
    syn = syn.join(pairs, ["q", "rank"])
    syn = syn.select(F.concat(F.lit("ada_"), "q", F.lit("_"), F.col("_j").cast("string")).alias(key),
                     *[(F.col(f"_b_{f}") + F.col("_u") * (F.col(f"_n_{f}") - F.col(f"_b_{f}"))).alias(f) for f in features],
                     F.lit(minority).alias(label), F.lit(1).alias("synthetic"),
                     *([F.col("q").alias("base"), F.col("n").alias("neighbour"), F.col("_u").alias("gap")] if origin else []))
    return orig.unionByName(syn)


def permutation_importance(model, df: DataFrame, columns: list[str], key: str = "user_id",
                           repeats: int = 5, seed: int = SEED, label: str = "y") -> DataFrame:
    """For each column and repeat, permute the column across rows (values
    re-assigned by a seeded hash rank, via the chunked ranking - no global
    window), rescore, and report the macro-F1 drop from the unpermuted score.

    Each repeat ranks the rows once and pairs every row with its partner's values.  One pass over the pairs
    scores all columns: the tasks hold the parsed trees, a column that is permuted only changes the trees that ask for it, and
    confusion counts per (repeat, column) leave the task.  The plan has the same size for any number of columns."""
    from functools import reduce

    import pyarrow as pa

    from ..plans.models import prepare, tree_table
    from ..session import stored
    from .metrics import macro_f1_of_counts
    feats = [c.removeprefix("_x_") for c in next(s for s in model.stages if s.hasParam("inputCols")).getInputCols()]
    last = model.stages[-1]
    boosted = last.__class__.__name__.startswith("GBT")
    trees = df.sparkSession.sparkContext.broadcast(tree_table(last))
    at = [feats.index(c) for c in columns]
    # stored: an element of an array that the same plan builds makes the optimizer copy the whole array for each of them
    d = stored(prepare(df, feats).select(key, F.col(label).cast("int").alias("y"), F.array(*feats).alias("x")), "permuted-rows")
    one = d.withColumn("_one", F.lit(0))

    def partners(r):
        s = seed + 1000 * r
        a = rank_within_class(one.select(key, "_one"), "_one", key, s).select(key, "_pos")
        b = rank_within_class(one.select(key, "_one", F.array(*[F.col("x")[j] for j in at]).alias("z")), "_one", key, s + 1).select("_pos", "z")
        # both sides have all rows: merged, as one of them as a broadcast would pass the driver whole
        return d.hint("merge").join(a.hint("merge"), key).join(b.hint("merge"), "_pos").select(F.lit(r).alias("repeat"), "y", "x", "z")

    # a job per repeat: the driver plans one of them at a time
    pairs = reduce(lambda a, b: a.unionByName(b), [stored(partners(r), "permuted") for r in range(repeats)])

    def run(it):
        counts: dict[tuple[int, int, int, int], int] = {}
        asks = [set(f for f in t["feat"] if f >= 0) for t in trees.value]

        def leaves(t, x):
            feat, thr, left, right = (np.array(t[k]) for k in ("feat", "thr", "left", "right"))
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feat[node]
                inner = f >= 0
                if not inner.any():
                    return np.asarray(t["value"])[node] * t["w"]
                i = np.flatnonzero(inner)
                v = x[i, f[i]]
                goes = v <= thr[node[i]]
                for n in {n for n in np.unique(node[i]) if t["cats"][n] is not None}:
                    own = node[i] == n
                    goes[own] = np.isin(v[own], list(t["cats"][n]))
                node[i] = np.where(goes, left[node[i]], right[node[i]])

        def classes(total):
            return (total[:, 0] > 0).astype(np.int64) if boosted else total.argmax(axis=1)

        def add(rep, col, y, pred):
            code, n = np.unique(y * 1000 + pred, return_counts=True)
            for c, k in zip(code.tolist(), n.tolist()):
                counts[rep, col, c // 1000, c % 1000] = counts.get((rep, col, c // 1000, c % 1000), 0) + k

        for b in it:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                rep, y = (s.column(j).to_numpy() for j in (0, 1))
                x, z = (s.column(j).flatten().to_numpy().reshape(s.num_rows, -1) for j in (2, 3))
                own = [leaves(t, x) for t in trees.value]
                total = np.sum(own, axis=0)
                for r in np.unique(rep):
                    m = rep == r
                    add(int(r), -1, y[m], classes(total[m]))
                for k, j in enumerate(at):
                    hit = [t for t, a in enumerate(asks) if j in a]
                    changed = total
                    if hit:
                        swapped = x.copy()
                        swapped[:, j] = z[:, k]
                        changed = np.sum([leaves(trees.value[t], swapped) if t in hit else own[t] for t in range(len(own))], axis=0)
                    pred = classes(changed)
                    for r in np.unique(rep):
                        m = rep == r
                        add(int(r), k, y[m], pred[m])
        if counts:
            cols = list(zip(*[(*k, n) for k, n in counts.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.int64()])],
                                             names=["repeat", "column", "y", "pred", "n"])

    cm = pairs.where("y is not null").mapInArrow(run, "repeat int, column int, y int, pred int, n long")
    f1 = stored(macro_f1_of_counts(cm.groupBy("repeat", "column", "y", "pred").agg(F.sum("n").alias("n")), ["repeat", "column"]), "permuted-f1")
    base = f1.where("column < 0").select("repeat", F.col("macro_f1").alias("_base"))
    name = F.array(*[F.lit(c) for c in columns])[F.col("column")]
    return (f1.where("column >= 0").join(base, "repeat").groupBy(name.alias("feature"))
            .agg(F.avg(F.col("_base") - F.col("macro_f1")).alias("importance")).orderBy(F.col("importance").desc(), "feature"))
