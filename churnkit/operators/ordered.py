"""Skew-safe per-key ordered operations.

Per-user windows (``lag``, "last 10 rows", running sums for streaks) are the
one place where a hot user would pin all its rows into a single task: a
plain ``Window.partitionBy("user_id")`` sorts and buffers the whole group
in one task.  Here all rows are dealt out by ranges of
``(key, time NULLS LAST, tie)`` into *chunks* of about equal depth (Spark samples
the split points), so any distribution of times, equal times and NULL times of
one key are spread alike.  The chunked rows are stored once; windows run per
``(key, chunk)``, and a small per-chunk summary table (one row per key and
chunk) stitches the chunk boundaries back together:

* position from the start / from the end of the key's sequence,
* previous row's value (``lag``) across chunk boundaries,
* running sums and maxima over all earlier rows, minima over all later ones,
* per-key attributes (row count, first and last time, and columns of ``stats``),
  which reach the rows through the summary, never by a join on the key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import micros
from ..session import stored


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


#: a key with more than this share of all rows is salted; so at most HOT_KEYS keys are
HOT_KEYS = 1000


def attach(facts: DataFrame, per_key: DataFrame, keys, n_col: str = "_n",
           how: str = "left", hot_rows: int | None = None,
           row_id: str | None = None) -> DataFrame:
    """Join one-row-per-key attributes onto fact rows, splitting hot keys.

    ``per_key`` must be stored and carry ``n_col`` (rows of that key in ``facts``).  Keys with
    more than ``hot_rows`` rows (default: one thousandth of all rows, so at most
    ``HOT_KEYS`` keys are hot and their list is a bounded broadcast) get ``ceil(n / hot_rows)``
    salt values: their fact rows are spread by a hash of ``row_id`` and their per-key
    row is replicated once per salt, so no single join task holds a hot key.
    """
    ks = _keys(keys)
    total = per_key.agg(F.sum(n_col)).first()[0] or 0
    hot_rows = max(1, hot_rows or 0, -(-total // HOT_KEYS))
    hot = (per_key.where(F.col(n_col) > hot_rows)
           .select(*ks, F.ceil(F.col(n_col) / F.lit(hot_rows)).cast("int").alias("_nsalt")))
    hot = F.broadcast(hot)
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    salted = (facts.join(hot, ks, "left")
              .withColumn("_salt", F.pmod(F.xxhash64(rid), F.coalesce(F.col("_nsalt"), F.lit(1))))
              .drop("_nsalt"))
    dim = (per_key.join(hot, ks, "left")
           .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_nsalt"), F.lit(1)) - 1)))
           .drop("_nsalt"))
    return salted.join(dim, ks + ["_salt"], how).drop("_salt")


def _num(df: DataFrame, c: str) -> Column:
    """Numeric projection of the ordering column (epoch micros for times)."""
    t = df.schema[c].dataType.typeName()
    if t in ("timestamp", "timestamp_ntz", "date"):
        return micros(c).cast("double")
    return F.col(c).cast("double")


def with_chunks(df: DataFrame, keys, ts: str, tie: str, chunk_rows: int | None = None) -> DataFrame:
    """Rows with ``_chunk``: numbers that rise with ``(keys, ts NULLS LAST, tie)``.

    The number of chunks is the session's shuffle parallelism (small inputs take
    fewer), or follows ``chunk_rows``, the rows wanted in a chunk."""
    order = [*[F.col(k) for k in _keys(keys)], F.col(ts).isNull(), F.col(ts), F.col(tie)]
    if chunk_rows:
        dealt = df.repartitionByRange(max(1, -(-df.count() // chunk_rows)), *order)
    else:
        dealt = df.repartitionByRange(*order)
    # stored once: the split points are sampled, so the rows must not be dealt out twice
    return stored(dealt.withColumn("_chunk", F.spark_partition_id()), "ordered")


def ordered(df: DataFrame, keys, ts: str, tie: str, *,
            lags: dict[str, Column] | None = None,
            sums_before: dict[str, Column] | None = None,
            maxes_before: dict[str, Column] | None = None,
            mins_after: dict[str, Column] | None = None,
            chunk_rows: int | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Annotate every row with its place in the key's ``(ts NULLS LAST, tie)`` order.

    Adds ``_pos`` (1-based from the start), ``_pos_desc`` (1-based from the
    end), ``lag_<name>`` for each entry of ``lags`` (the previous row's
    value, like ``shift(1)``), ``before_<name>`` for each entry of
    ``sums_before`` (sum over strictly earlier rows) and ``maxbefore_<name>``
    for ``maxes_before`` (max over strictly earlier rows, NULLs skipped), and
    ``minafter_<name>`` for ``mins_after`` (min over strictly later rows).
    The per-key ``_n`` (rows), ``_nv`` (rows with a time), ``_t0``, ``_t1`` (first and
    last time as a number) and the columns of ``stats`` (one row per key) stay on the rows.
    """
    ks = _keys(keys)
    lags = lags or {}
    sums_before = sums_before or {}
    maxes_before = maxes_before or {}
    mins_after = mins_after or {}
    extra = ([c.alias(f"_lv_{n}") for n, c in lags.items()]
             + [c.cast("double").alias(f"_sv_{n}") for n, c in sums_before.items()]
             + [c.alias(f"_mv_{n}") for n, c in maxes_before.items()]
             + [c.alias(f"_nv_{n}") for n, c in mins_after.items()])
    base = df.select("*", *extra) if extra else df
    rows = with_chunks(base, ks, ts, tie, chunk_rows)

    order = [F.col(ts).isNull(), F.col(ts), F.col(tie)]
    w = Window.partitionBy(*ks, "_chunk").orderBy(*order)
    w_before = w.rowsBetween(Window.unboundedPreceding, -1)
    win = [F.row_number().over(w).alias("_rn")]
    win += [F.lag(f"_lv_{n}").over(w).alias(f"_ilag_{n}") for n in lags]
    win += [F.coalesce(F.sum(f"_sv_{n}").over(w_before), F.lit(0.0)).alias(f"_cs_{n}") for n in sums_before]
    win += [F.max(f"_mv_{n}").over(w_before).alias(f"_cm_{n}") for n in maxes_before]
    # as the rows before in the opposite order, which are added up while they pass
    w_down = (Window.partitionBy(*ks, "_chunk").orderBy(F.col(ts).isNull().desc(), F.col(ts).desc(), F.col(tie).desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    win += [F.min(f"_nv_{n}").over(w_down).alias(f"_cn_{n}") for n in mins_after]
    rows = rows.select("*", *win)

    # per-chunk summary: a handful of rows per (key, chunk)
    v = _num(rows, ts)
    summ_aggs = [F.count(F.lit(1)).alias("_ccnt"), F.count(v).alias("_cv"), F.min(v).alias("_c0"), F.max(v).alias("_c1")]
    if lags:
        last_struct = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)],
                               *[F.col(f"_lv_{n}").alias(n) for n in lags])
        summ_aggs.append(F.max(last_struct).alias("_last"))
    summ_aggs += [F.sum(f"_sv_{n}").alias(f"_csum_{n}") for n in sums_before]
    summ_aggs += [F.max(f"_mv_{n}").alias(f"_cmax_{n}") for n in maxes_before]
    summ_aggs += [F.min(f"_nv_{n}").alias(f"_cmin_{n}") for n in mins_after]
    summ = rows.groupBy(*ks, "_chunk").agg(*summ_aggs)
    wc = Window.partitionBy(*ks).orderBy("_chunk")
    prev = wc.rowsBetween(Window.unboundedPreceding, -1)
    nxt = wc.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*ks)
    sel = [*ks, "_chunk", "_ccnt", F.sum("_ccnt").over(whole).alias("_n"), F.sum("_cv").over(whole).alias("_nv"),
           F.min("_c0").over(whole).alias("_t0"), F.max("_c1").over(whole).alias("_t1"),
           F.coalesce(F.sum("_ccnt").over(prev), F.lit(0)).alias("_rows_before"),
           F.coalesce(F.sum("_ccnt").over(nxt), F.lit(0)).alias("_rows_after")]
    sel += [F.lag(F.col("_last").getField(n)).over(wc).alias(f"_plast_{n}") for n in lags]
    sel += [F.coalesce(F.sum(f"_csum_{n}").over(prev), F.lit(0.0)).alias(f"_off_{n}") for n in sums_before]
    sel += [F.max(f"_cmax_{n}").over(prev).alias(f"_moff_{n}") for n in maxes_before]
    sel += [F.min(f"_cmin_{n}").over(nxt).alias(f"_noff_{n}") for n in mins_after]
    summ = summ.select(*sel)
    if stats is not None:
        summ = summ.join(stats, ks, "left")

    out = rows.join(summ, ks + ["_chunk"], "inner")
    drop = {"_rn", "_ccnt", "_rows_before", "_rows_after", "_chunk"}
    for n in lags:
        drop |= {f"_lv_{n}", f"_plast_{n}", f"_ilag_{n}"}
    for n in sums_before:
        drop |= {f"_sv_{n}", f"_cs_{n}", f"_off_{n}"}
    for n in maxes_before:
        drop |= {f"_mv_{n}", f"_cm_{n}", f"_moff_{n}"}
    for n in mins_after:
        drop |= {f"_nv_{n}", f"_cn_{n}", f"_noff_{n}"}
    new_cols = [(F.col("_rows_before") + F.col("_rn")).alias("_pos"),
                (F.col("_rows_after") + F.col("_ccnt") - F.col("_rn") + 1).alias("_pos_desc")]
    new_cols += [F.when(F.col("_rn") == 1, F.col(f"_plast_{n}")).otherwise(F.col(f"_ilag_{n}")).alias(f"lag_{n}")
                 for n in lags]
    new_cols += [(F.col(f"_off_{n}") + F.col(f"_cs_{n}")).alias(f"before_{n}") for n in sums_before]
    new_cols += [F.greatest(F.col(f"_moff_{n}"), F.col(f"_cm_{n}")).alias(f"maxbefore_{n}") for n in maxes_before]
    new_cols += [F.least(F.col(f"_noff_{n}"), F.col(f"_cn_{n}")).alias(f"minafter_{n}") for n in mins_after]
    keep = [c for c in out.columns if c not in drop]
    return out.select(*keep, *new_cols)


def group_median(df: DataFrame, keys, value: str, tie: str, **kw) -> DataFrame:
    """Exact median per key (mean of the two middle values for even counts).

    Ranks come from :func:`ordered`, so a hot key is ranked chunk by chunk;
    no task ever buffers a whole group's values."""
    ks = _keys(keys)
    d = df.where(F.col(value).isNotNull())
    o = ordered(d, ks, value, tie, **kw)
    lo = F.floor((F.col("_n") + 1) / 2)
    hi = F.ceil((F.col("_n") + 1) / 2)
    return (o.where((F.col("_pos") == lo) | (F.col("_pos") == hi))
             .groupBy(*ks).agg(F.avg(F.col(value).cast("double")).alias("median")))


def top_k_per_key(df: DataFrame, keys, score: Column, tie: Column, k: int,
                  salt_buckets: int = 64) -> DataFrame:
    """Top-k rows per key by ``(score desc, tie asc)`` in two rounds.

    Round one keeps the top k per ``(key, hash bucket)``; round two ranks
    at most ``k * salt_buckets`` survivors per key, so a hot key's rows are
    ranked by many tasks."""
    ks = _keys(keys)
    d = df.withColumn("_sc", score).withColumn("_tb", tie)
    d = d.withColumn("_b", F.pmod(F.xxhash64(F.col("_tb")), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*ks, "_b").orderBy(F.col("_sc").desc(), F.col("_tb").asc())
    d = d.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*ks).orderBy(F.col("_sc").desc(), F.col("_tb").asc())
    d = d.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)
    return d.drop("_sc", "_tb", "_b", "_r1")


def exact_quantiles(df: DataFrame, value: str, qs: list[float], keys=None, tie: str | None = None,
                    **kw) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy's default) per key.

    Without ``keys`` the whole column is one group; :func:`ordered` then
    splits it into value-range chunks, so no task ranks more than
    ``chunk_rows`` values.  Returns one row per key with ``q<i>`` columns."""
    ks = _keys(keys) if keys else []
    d = df.where(F.col(value).isNotNull())
    if not ks:
        d = d.withColumn("_all", F.lit(0))
        ks = ["_all"]
    if tie is None:
        d = d.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
        tie = "_tie"
    o = ordered(d, ks, value, tie, **kw)
    n = F.col("_n")
    cols = []
    keep = F.lit(False)
    for i, q in enumerate(qs):
        h = (n - 1).cast("double") * F.lit(float(q))
        lo, hi = F.floor(h) + 1, F.ceil(h) + 1            # 1-based positions
        frac = h - F.floor(h)
        keep = keep | (F.col("_pos") == lo) | (F.col("_pos") == hi)
        v = F.col(value).cast("double")
        cols += [F.max(F.when(F.col("_pos") == lo, v)).alias(f"_lo{i}"),
                 F.max(F.when(F.col("_pos") == hi, v)).alias(f"_hi{i}"),
                 F.max(frac).alias(f"_fr{i}")]
    picked = o.where(keep).groupBy(*ks).agg(*cols)
    out = [*ks] + [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}")).alias(f"q{i}")
                   for i in range(len(qs))]
    res = picked.select(*out)
    return res.drop("_all") if "_all" in ks else res


def column_quantiles(df: DataFrame, columns: dict[str, Column], qs: list[float], margin: float = 1e-3, **kw) -> DataFrame:
    """Exact quantiles as :func:`exact_quantiles` gives them for a few whole columns: ``column, q0, q1, ...``.

    Only the distinct values around each quantile are ranked.  A bounded sketch proposes a range of values that holds it, a
    count of the rows below and within proves that it does; a side that fails the proof is left open.  So the table is
    scanned three times and some ``2 * margin`` of its values per quantile move.  Columns without a value give no row."""
    x = df.select(*[v.cast("double").alias(f"_v{j}") for j, v in enumerate(columns.values())])
    names, spots = list(columns), [(j, i) for j in range(len(columns)) for i in range(len(qs))]
    bounds = [min(1.0, max(0.0, q + side * margin)) for q in qs for side in (-1, 1)]
    row = x.agg(*[F.count(c).alias(f"n{c}") for c in x.columns],
                *[F.percentile_approx(c, bounds, round(4 / margin)).alias(f"b{c}") for c in x.columns]).first()
    n = [row[f"n_v{j}"] for j in range(len(names))]
    near = {(j, i): tuple(row[f"b_v{j}"][2 * i:2 * i + 2]) for j, i in spots if n[j]}
    if not near:
        return df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"q{i} double" for i in range(len(qs))))
    counts = x.agg(*[F.count_if(F.col(f"_v{j}") < lo).alias(f"below_{j}_{i}") for (j, i), (lo, _) in near.items()],
                   *[F.count_if(F.col(f"_v{j}") <= hi).alias(f"upto_{j}_{i}") for (j, i), (_, hi) in near.items()]).first()
    parts, places = [], []
    for (j, i), (lo, hi) in near.items():
        h = (n[j] - 1) * float(qs[i])
        first, last = math.floor(h) + 1, math.ceil(h) + 1            # 1-based positions
        v, here, below = F.col(f"_v{j}"), F.col(f"_v{j}").isNotNull(), 0
        if counts[f"below_{j}_{i}"] < first:
            here, below = here & (v >= lo), counts[f"below_{j}_{i}"]
        if counts[f"upto_{j}_{i}"] >= last:
            here = here & (v <= hi)
        parts.append(F.when(here, F.struct(F.lit(j).alias("_j"), F.lit(i).alias("_i"), v.alias("_v"))))
        places.append((j, i, below, first, last, h - math.floor(h)))
    some = x.select(F.explode(F.array_compact(F.array(*parts))).alias("_p")).select("_p.*")
    values = some.groupBy("_j", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    place = df.sparkSession.createDataFrame(places, "_j int, _i int, _below long, _first long, _last long, _frac double")
    o = ordered(values, ["_j", "_i"], "_v", "_c", sums_before={"c": F.col("_c")}, **kw).join(F.broadcast(place), ["_j", "_i"])
    lower = F.col("_below") + F.col("before_c")

    def at(p):
        return F.max(F.when((lower < F.col(p)) & (F.col(p) <= lower + F.col("_c")), F.col("_v")))

    picked = o.groupBy("_j", "_i").agg(at("_first").alias("_lo"), at("_last").alias("_hi"), F.max("_frac").alias("_fr"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_fr")
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_j") + 1)
    return picked.groupBy(name.alias("column")).agg(*[F.max(F.when(F.col("_i") == i, q)).alias(f"q{i}") for i in range(len(qs))])
