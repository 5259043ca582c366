"""Exact k-NN over pivots and ADASYN against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit.operators import sampling as S
from churnkit.operators.knn import block_bounds, choose_pivots, distances, knn_exact

SF = "/root/testdata/sf0.001"


def brute(x, keys, k):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[keys[i]] = [keys[j] for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], keys[j]))[:k]]
    return out


def found(spark, x, k, chunk, visits=None):
    keys = [f"p{i:04d}" for i in range(len(x))]
    feats = [f"f{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([(keys[i], *map(float, x[i])) for i in range(len(x))], "id string, " + ", ".join(f"{c} double" for c in feats))
    got = {q: [] for q in keys}
    for r in knn_exact(df, "id", feats, k, chunk, visits).collect():
        got[r["q"]].append((r["rank"], r["n"]))
    return {q: [n for _, n in sorted(v)] for q, v in got.items()}, brute(x, keys, k)


def test_clustered_points_of_64_dimensions_visit_few_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(size=(40, 64)) for c in rng.normal(size=(16, 64)) * 20])
    visits = {}
    got, want = found(spark, x, 5, 40, visits)
    assert got == want
    assert visits["blocks"] >= 16 and visits["pairs"] < visits["all_pairs"] / 4


def test_unclustered_equal_and_tied_points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    x[40:100] = x[0]                    # more than a third of all rows are one point
    x[120:124] = x[119]
    for points, k, chunk in ((x, 3, 16), (rng.integers(0, 3, (80, 2)).astype(float), 4, 8), (np.zeros((20, 2)), 3, 5), (x[:3], 5, 10)):
        got, want = found(spark, points, k, chunk)
        assert got == want


def test_bounds_never_exceed_a_distance():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 5)), rng.normal(size=(50, 5)) * 2
    pivots = choose_pivots(x, 6)
    cell = distances(x, pivots).argmin(axis=1)
    r = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
    blocks = [(c, m) for c in range(len(pivots)) for m in ((cell == c) & (r <= 1.5), (cell == c) & (r > 1.5)) if m.any()]
    lower = block_bounds(distances(q, pivots), np.array([c for c, _ in blocks]), np.array([r[m].min() for _, m in blocks]),
                         np.array([r[m].max() for _, m in blocks]))
    true = np.stack([np.sqrt(((q[:, None] - x[m][None]) ** 2).sum(axis=2)).min(axis=1) for _, m in blocks], axis=1)
    assert (lower <= true + 1e-9).all() and (lower > 0).any()


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(20, 3)) + 0.8])
    return x, spark.createDataFrame([(f"r{i:02d}", int(i >= 60), *map(float, x[i])) for i in range(80)], "id string, y int, a double, b double, c double")


def test_adasyn_gives_exactly_the_rows_asked_for(spark, two_classes):
    x, df = two_classes
    feats, keys = ["a", "b", "c"], [f"r{i:02d}" for i in range(80)]
    near = brute(x, keys, 5)
    c = {k: sum(n < "r60" for n in near[k]) for k in keys[60:]}
    for n_new in (0, 7, 40, 1001):
        got = {r["id"]: (r["majority_neighbours"], r["n_new"]) for r in
               S.adasyn_allocation(df, "y", feats, "id", 1, n_new, chunk_rows=16).collect()}
        total = sum(c.values())
        floor = {k: n_new * v // total for k, v in c.items()}
        late = sorted(c, key=lambda k: (-(n_new * c[k] % total), k))[:n_new - sum(floor.values())]
        assert got == {k: (c[k], floor[k] + (k in late)) for k in c}
    weights = {r["id"]: r["weight"] for r in S.adasyn_counts(df, "y", feats, "id", 1).collect()}
    assert weights == pytest.approx({k: v / sum(c.values()) for k, v in c.items()})


def test_adasyn_rows_lie_between_base_and_neighbour(spark, two_classes, monkeypatch):
    x, df = two_classes
    monkeypatch.setattr(S, "_MADE_AT_ONCE", 3)
    keys = [f"r{i:02d}" for i in range(60, 80)]
    near = brute(x[60:], keys, 5)
    at = {f"r{i:02d}": v for i, v in enumerate(x)}
    out = S.adasyn(df, "y", ["a", "b", "c"], "id", origin=True).collect()
    new = [r for r in out if r["synthetic"]]
    assert len(out) == 120 and len(new) == 40 and len({r["id"] for r in out}) == 120 and all(r["y"] == 1 for r in new)
    for r in new:
        assert r["neighbour"] in near[r["base"]] and 0 <= r["gap"] < 1
        assert np.allclose([r["a"], r["b"], r["c"]], at[r["base"]] + r["gap"] * (at[r["neighbour"]] - at[r["base"]]))
    plan = {r["id"]: r["n_new"] for r in S.adasyn_allocation(df, "y", ["a", "b", "c"], "id", 1, 40).collect()}
    made = {k: sum(r["base"] == k for r in new) for k in keys}
    assert made == plan


def test_adasyn_edges(spark):
    far = spark.createDataFrame([(str(i), int(i >= 30), float(i if i < 30 else 1000 + i)) for i in range(40)], "id string, y int, a double")
    # no neighbour of another class: equal quotas
    plan = [r["n_new"] for r in S.adasyn_allocation(far, "y", ["a"], "id", 1, 25, k=3).orderBy("id").collect()]
    assert sorted(plan) == [2] * 5 + [3] * 5
    assert S.adasyn(far, "y", ["a"], "id", k=3).where("y = 1").count() == 30
    one = far.where("id < '3' or id = '39'")
    assert S.adasyn(one, "y", ["a"], "id").count() == one.count()          # a single minority row has no neighbour
    assert S.adasyn(far.limit(0), "y", ["a"], "id").count() == 0


def test_fifth_strategy_trains(spark, two_classes):
    from churnkit.plans import models as MD
    _, df = two_classes
    d = df.withColumnRenamed("id", "user_id")
    out = MD.resample(d.withColumn("yb", F.col("y").cast("double")), "yb", ["a", "b", "c"], "adasyn")
    assert {r["yb"]: r["count"] for r in out.groupBy("yb").count().collect()} == {0.0: 60, 1.0: 60}


def test_few_asking_points_and_bounded_blocks(spark, monkeypatch):
    """Only the keys that ask are searched, with the neighbours they have among all points (equal ones too); blocks
    grow with the points, so their number, and how often the joins move a point, does not."""
    import numpy as np
    from churnkit.operators import knn as K
    monkeypatch.setattr(K, "CHUNK", 8)
    monkeypatch.setattr(K, "BLOCKS", 6)
    x = np.random.default_rng(5).normal(size=(300, 4))
    x[250:] = x[:50]                                        # equal points
    for rows in (x[:250], x):
        df = spark.createDataFrame([(f"k{i:03d}", *map(float, r)) for i, r in enumerate(rows)], "id string, a double, b double, c double, d double")
        ask = df.where("id in ('k003', 'k017', 'k120', 'k249')")
        visits = {}
        every = {tuple(r) for r in K.knn_exact(df, "id", list("abcd"), 3).collect()}
        some = {tuple(r) for r in K.knn_exact(df, "id", list("abcd"), 3, visits=visits, ask=ask).collect()}
        assert some == {r for r in every if r[0] in {"k003", "k017", "k120", "k249"}} and len(some) == 12
        assert visits["blocks"] <= 2 * 6 + 1               # before: 8 points a block, 32 blocks and more
