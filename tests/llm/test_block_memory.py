"""The pairs of a block are compared in strips, so a task holds few numbers a pair."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from churnkit.llm import jaccard_join


class _Task:
    """A DataFrame's one task: its batches go straight to the mapped function."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def _lists(rows):
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows)))


def _block(m, seed=1):
    """(batch of one block pair, token sets, paths) of edited copies of an odd number of sets."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 62, 100) for _ in range(m // 30 | 1)]
    sets, paths = [], []
    for i in range(m):
        t = base[i % len(base)].copy()
        k = rng.integers(0, 9)
        t[:k] = rng.integers(0, 1 << 62, k)
        sets.append(np.unique(t))
        paths.append(np.unique(rng.integers(0, 300, 3)))
    one = lambda v, kind: pa.array(np.full(m, v), kind)
    cols = [one(1 << 41, pa.int64()), one(0, pa.int32()), one(1, pa.int32()), pa.array((np.arange(m) % 2).astype(np.int32)),
            pa.array(np.arange(m) + 10), one(2, pa.int64()), _lists(paths), _lists(sets)]
    return pa.RecordBatch.from_arrays(cols, names="path bi bj b cid rows paths tokens".split()), sets, paths


@pytest.mark.parametrize("room", [1 << 19, 100])
def test_links_of_strips_are_those_of_all_pairs(room, monkeypatch):
    strips = jaccard_join._strips
    monkeypatch.setattr(jaccard_join, "_strips", lambda n: strips(n, room))
    batch, sets, paths = _block(120)
    got = {c: n for out in jaccard_join._links(_Task(batch), 0.8, 1) for c, n in zip(out["cid"].to_pylist(), out["links"].to_pylist())}
    want = {}
    for i in range(120):
        for j in range(120):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (i - j) % 2 and not len(np.intersect1d(paths[i], paths[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-6:
                want[i + 10] = want.get(i + 10, 0) + 2
    assert got == want and want


def test_a_block_pair_holds_few_numbers_a_pair():
    m = 1200
    batch, _, _ = _block(m)
    tracemalloc.start()
    try:
        assert jaccard_join._links(_Task(batch), 0.8, 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * m * m
