"""Self join of documents by Jaccard similarity of word 5-grams: chosen-path join.

Rows with the same set of 5-grams form a *class*; classes are joined, copies are not.

* **Paths.** In each run a set follows a token (a hashed 5-gram) if the token's hash along
  the path is below ``branching / |set|``.  Sets that follow the same tokens meet in a bucket.
  Similar sets share so many chosen tokens that their common paths survive like a branching
  process with mean ``branching * threshold`` or more; dissimilar ones part.
* **Recursion.** Buckets of more than ``leaf`` classes are split again on tokens that are
  sampled anew along the path, up to ``depth`` levels, unless their sets are alike: where two
  members share their minimal token with probability ``dense`` or more, splitting would
  only repeat the bucket.
* **Lone tokens.** Buckets that stay wide lose the classes that cannot have a link in them:
  a partner holds at least ``threshold`` of a set, so a class with more than the rest of its
  tokens in no other class of the wide buckets has none.  One aggregate by token, without a join, tells.
* **Brute force.** Within a leaf bucket all intersections are counted exactly, by products
  of 0/1 matrices over the tokens that occur twice.  A pair belongs to the smallest of the
  paths that both classes took, so each pair is verified in one bucket only, and sets are sent
  only to buckets that own a pair of theirs.  Buckets of any size are handled: they are cut
  into blocks of ``block`` classes, and each pair of blocks is one task.  No pairs are
  emitted: a block gives each class its sum of links and a spanning forest of links.
* **Repeats.** :func:`runs_for` sets the number of runs from the target recall.

Result: one row per document with its component's id and its number of links.

Edge cases: null texts and texts without a word are classes of their own without links;
texts of 1 to 4 words have one token, all their words; repeated rows are documents of the
same class; ``class_id`` is the smallest doc_id of the component (null if all are null); an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, keeping_columns, partitions, text_of, written
from .components import components

_WORDS = re.compile(r"[^\W_]+")
_WORD_HASHES: dict[str, int] = {}
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits (splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _K2
    x = (x ^ (x >> _U(27))) * _K3
    return x ^ (x >> _U(31))


def tokens_of(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams (lower case, letters and digits only)."""
    words = _WORDS.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORD_HASHES) > 200_000:
        _WORD_HASHES.clear()
    h = list(map(_WORD_HASHES.get, words))
    if None in h:
        for w in {w for w, x in zip(words, h) if x is None}:
            _WORD_HASHES[w] = xxhash.xxh3_64_intdigest(w)
        h = list(map(_WORD_HASHES.__getitem__, words))
    h = np.array(h, dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out *= _K2
        out += h[k:k + n]
    return np.unique(mix(out))


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return _signed(d >> 64), _signed(d & (1 << 64) - 1)


def _signed(x: int) -> int:
    return (x ^ (1 << 63)) - (1 << 63)


def chosen(tokens: np.ndarray, path: int, branching: float) -> np.ndarray:
    """Child paths that a set takes below ``path``: a token is followed if its multiply-shift hash
    under the path's own odd factor is small."""
    if not len(tokens):
        return tokens
    factor = mix(np.array([path], dtype=np.int64).view(np.uint64) + _K1) | _U(1)
    x = tokens * factor
    p = branching / len(tokens)
    return mix(x if p >= 1 else x[x < _U(int(p * 2.0 ** 64))])


def runs_for(recall: float, threshold: float, branching: float) -> int:
    """Runs until a pair at the threshold is met with probability ``recall``.

    A pair's common paths are a branching process whose offspring mean is at least
    ``branching * threshold``; ``q`` is the probability that it dies out in a run.
    """
    q = 0.0
    for _ in range(200):
        q = math.exp(-branching * threshold * (1 - q))
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def _sets(docs: DataFrame, width: int, runs: int, branching: float) -> DataFrame:
    """``doc_id, th, c1, c2, n, g, paths`` per row; ``g`` is a minimal token hash."""
    def run(it):
        for b in batches(it):
            rows = []
            for t in b.column(1).to_pylist():
                s = tokens_of(t, width)
                paths = np.unique(np.concatenate([chosen(s, r, branching) for r in range(runs)])).view(np.int64)
                g = int(mix(s ^ _K3).min().view(np.int64)) if len(s) else 0
                rows.append((*class_key(s), len(s), g, paths))
            c1, c2, n, g, paths = zip(*rows) if rows else ([],) * 5
            ends = np.cumsum([0, *map(len, paths)])
            flat = np.concatenate(paths) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *(pa.array(x, pa.int64()) for x in (c1, c2, n, g)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "th", "c1", "c2", "n", "g", "paths"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th long, c1 long, c2 long, n long, g long, paths array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cid, tokens`` of the wanted classes (``doc_id, th, c1, c2, cid``), read from their first row's text."""
    left, right = docs.alias("l"), wanted.alias("r")
    texts = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th"))).select(
        "l.text", "r.c1", "r.c2", "r.cid")

    def run(it):
        for b in batches(it):
            cid, sets = [], []
            for t, c1, c2, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = tokens_of(t, width)
                if class_key(s) == (c1, c2):
                    cid.append(c)
                    sets.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                                             names=["cid", "tokens"])

    # a row that is there twice gives its set twice; the consumers take the first
    return texts.mapInArrow(run, "cid long, tokens array<long>")


def _groups(it, keys: int):
    """Record batches of one key each from batches sorted by their first ``keys`` columns."""
    held = None
    for b in it:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, dtype=bool)
        for k in range(keys):
            c = b.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new)]
        for i, j in zip(at, at[1:]):
            yield b.slice(i, j - i)
        held = b.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, entry) of all entries of a list column."""
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(ends)), column.flatten().to_numpy(zero_copy_only=False)


def _strips(n: int, room: int = 1 << 19) -> Iterator[slice]:
    """Rows of an n x n matrix in strips of about ``room`` numbers, so that what is derived from it stays small."""
    step = max(1, room // max(1, n))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def _common(row: np.ndarray, entry: np.ndarray, n: int, room: int = 1 << 21) -> np.ndarray:
    """n x n counts of common entries, summed over ranges of entries so that no matrix holds more than some ``room`` numbers."""
    _, col, times = np.unique(entry, return_inverse=True, return_counts=True)
    keep = times > 1
    use = keep[col]
    row, col, width = row[use], (np.cumsum(keep) - 1)[col[use]], int(keep.sum())
    total = np.zeros((n, n), dtype=np.float32)
    step = min(4096, max(64, room // max(1, n)))
    for c in range(0, width, step):
        own = (col >= c) & (col < c + step)
        m = np.zeros((n, min(step, width - c)), dtype=np.float32)
        m[row[own], col[own] - c] = 1
        for s in _strips(n):
            total[s] += m[s] @ m.T
    return total


def _apart(pairs: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
    """Leave out the diagonal and, in a task of two blocks, the pairs within a block."""
    np.fill_diagonal(pairs, False)
    if b.column(1)[0].as_py() != b.column(2)[0].as_py():
        block = b.column(3).to_numpy()
        pairs &= block[:, None] != block[None, :]
    return pairs


_MEMBER = "path long, bi int, bj int, b int, cid long, rows long, paths array<long>"


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows of a block pair together in one task, sorted, many of them to a task."""
    return df.repartition(n, "path", "bi", "bj").sortWithinPartitions("path", "bi", "bj", "cid")


def _owners(members: DataFrame, n: int) -> DataFrame:
    """Of all members of block pairs those with a pair that no smaller common path owns."""
    def run(it):
        for b in _groups(it, 3):
            path = b.column(0)[0].as_py()
            row, entry = _lists(b.column(6))
            less = entry < path
            row, entry = row[less], entry[less]
            own = np.flatnonzero(_apart(_common(row, entry, b.num_rows) == 0, b).any(axis=1))
            if len(own):
                keep = np.bincount(row, minlength=b.num_rows)
                ends = np.cumsum([0, *keep])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(entry))
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(6)), lists.take(at)], names=b.schema.names)

    return _dealt(members.select("path", "bi", "bj", "b", "cid", "rows", "paths"), n).mapInArrow(run, _MEMBER)


def _links(owned: DataFrame, threshold: float, n: int) -> DataFrame:
    """``cid, links, root``: per block pair each class's links (rows of linked classes) and its forest root."""
    def run(it):
        for b in _groups(it, 3):
            cid = b.column(4).to_numpy()
            if (cid[1:] == cid[:-1]).any():
                b = b.take(pa.array(np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])))
            m = b.num_rows
            row, entry = _lists(b.column(7))
            size = np.bincount(row, minlength=m)
            both = _common(row, entry, m)
            link = np.empty((m, m), dtype=bool)
            for s in _strips(m):
                link[s] = both[s] >= threshold * (size[s, None] + size[None, :] - both[s]) - 1e-6
            del both
            link = _apart(link, b)
            if link.any():
                link &= _common(*_lists(b.column(6)), m) == 0
            any_ = link.any(axis=1)
            if not any_.any():
                continue
            root = np.arange(m)
            while True:  # smallest label of the neighbours, then of the label's label
                new = np.minimum(np.concatenate([np.where(link[s], root[None, :], m).min(axis=1) for s in _strips(m)]), root)
                new = np.minimum(new, root[new])
                if (new == root).all():
                    break
                root = new
            cid = b.column(4).to_numpy()
            times = b.column(5).to_numpy().astype(np.float64)
            rows = np.concatenate([link[s] @ times for s in _strips(m)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cid[any_]), pa.array(rows[any_]), pa.array(cid[root][any_])],
                                             names=["cid", "links", "root"])

    return (_dealt(owned.select("path", "bi", "bj", "b", "cid", "rows", "paths", "tokens"), n)
            .mapInArrow(run, "cid long, links long, root long"))


def _holders(held: DataFrame, room: int = 1 << 19) -> DataFrame:
    """``t, lo, hi``: tokens with their least and greatest class, met already over some ``room`` tokens of a task, so that
    what alike classes share is sent once and not once a class."""
    def met(cids, tokens):
        cid, t = np.concatenate(cids), np.concatenate(tokens)
        order = np.lexsort((cid, t))
        cid, t = cid[order], t[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(t)][:len(first)] - 1
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t[first], cid[first], cid[last])], names=["t", "lo", "hi"])

    def run(it):
        cids, tokens, n = [], [], 0
        for b in batches(it):
            row, entry = _lists(b.column(1))
            cids.append(b.column(0).to_numpy()[row])
            tokens.append(entry)
            n += len(entry)
            if n >= room:
                yield met(cids, tokens)
                cids, tokens, n = [], [], 0
        if cids:
            yield met(cids, tokens)

    return held.select("cid", "tokens").mapInArrow(run, "t long, lo long, hi long")


def _lone(held: DataFrame, threshold: float) -> DataFrame:
    """``cid`` of the classes of ``held`` (``cid, tokens``) that hold more than the rest of their tokens alone among these."""
    alone = (_holders(held).groupBy("t").agg(F.min("lo").alias("cid"), F.max("hi").alias("last"))
             .where("cid = last").groupBy("cid").agg(F.count(F.lit(1)).alias("alone")))
    return (held.join(alone, "cid").where(F.size("tokens") - F.col("alone") < threshold * F.size("tokens") - 1e-6)
            .select("cid").distinct())


def _without_lone(wide: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``path, cid, size`` of wide buckets without the classes that have no link in any of them.

    A class of ``n`` tokens, ``alone`` of them held by no other class of ``wide``, shares at most ``n - alone`` with
    any, and a link needs ``threshold * n``.  The owner of a token with one holder is its least (and greatest) holder,
    so a token that a third of all rows hold is one row of a partial aggregate.  Classes that go leave further
    tokens alone, so rounds go on while each takes a tenth of the classes."""
    held = written(sets.join(wide.select("cid").distinct(), "cid", "left_semi").select("cid", "tokens"), "join-wide-tokens")
    left = held.select("cid").distinct().count()
    while left:
        held = written(held.join(_lone(held, threshold), "cid", "left_anti"), "join-wide-tokens")
        before, left = left, held.select("cid").distinct().count()
        if before - left < 0.1 * before:
            break
    wide = wide.select("path", "cid").join(held.select("cid").distinct(), "cid", "left_semi")
    sizes = wide.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return wide.join(sizes, "path").select("path", "cid", "size")


def similar_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, branching: float = 4.0, leaf: int = 64,
                    depth: int = 4, dense: float = 0.3, recall: float = 0.99999, block: int = 1024, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): ``doc_id, c1, c2, n`` per row, and per class its ``rep`` row, ``rows``,
    ``links`` to rows of other classes and component ``root`` (a class number ``cid``).
    Rows also have ``th``, a hash of their text; ``rep`` and ``rep_th`` name a class's first row."""
    text = text_of(docs, text_col)
    src = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"))
    runs = runs_for(recall, threshold, branching)
    rows = written(_sets(src, width, runs, branching), "join-sets")
    key = ["c1", "c2"]
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("__r")
    classes = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), rep, F.max("n").alias("n"),
                                             F.first("g").alias("g"), F.first("paths").alias("paths"))
                      .select(*key, "rows", "n", "g", "paths", "__r.doc_id", "__r.th", F.xxhash64(*key).alias("cid")), "join-classes")
    taken = classes.where("n > 0").select("cid", "g", F.explode("paths").alias("path"))

    leaves, level = [], written(taken, "join-level")
    sets = None
    for at in range(depth):
        sizes = written(level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-sizes")
        met = level.join(sizes, "path")
        if sets is None:
            wanted = met.select("cid").distinct().join(classes, "cid").select("doc_id", "th", "c1", "c2", "cid")
            sets = written(_sets_of(src, wanted, width), "join-tokens")
        if at == depth - 1 or sizes.where(F.col("size") > leaf).isEmpty():
            leaves.append(met)
            break
        alike = (met.where(F.col("size") > leaf).groupBy("path", "size", "g").agg(F.count(F.lit(1)).alias("c"))
                 .groupBy("path").agg((F.sum(F.col("c") * F.col("c")) / F.max(F.col("size") * F.col("size"))).alias("alike")))
        wide = written(alike.where(F.col("alike") < dense).select("path"), "join-wide")
        leaves.append(met.join(wide, "path", "left_anti"))
        big = written(met.join(wide, "path", "left_semi").groupBy("cid", "g").agg(F.collect_set("path").alias("paths")), "join-big")
        # a class without a link in the wide buckets has none in their children either
        big = big.join(_lone(sets.join(big.select("cid"), "cid", "left_semi"), threshold), "cid", "left_anti").join(sets, "cid")

        def split(it):
            for b in batches(it):
                cid, child, least = [], [], []
                ends = b.column(3).offsets.to_numpy() - b.column(3).offsets[0].as_py()
                tokens = b.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                for k, (c, g, paths) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
                    t = tokens[ends[k]:ends[k + 1]]
                    for p in paths:
                        x = chosen(t, p, branching)
                        child.append(x.view(np.int64))
                        cid.append(np.full(len(x), c, dtype=np.int64))
                        least.append(np.full(len(x), g, dtype=np.int64))
                if cid:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cid, least, child)],
                                                     names=["cid", "g", "path"])

        level = written(big.select("cid", "g", "paths", "tokens").mapInArrow(split, "cid long, g long, path long").distinct(), "join-level")

    met = leaves[0].select("path", "cid", "size")
    for x in leaves[1:]:
        met = met.unionByName(x.select("path", "cid", "size"))
    wide = written(met.where(F.col("size") > leaf), "join-wide-leaves")
    if not wide.isEmpty():
        met = met.where(F.col("size") <= leaf).unionByName(written(_without_lone(wide, sets, threshold), "join-wide-left"))
    # small buckets with the same members are one bucket
    small = (met.where(F.col("size") <= leaf).groupBy("path").agg(F.sort_array(F.collect_list("cid")).alias("cids"))
             .select("cids").distinct().select(F.xxhash64("cids").alias("path"), F.size("cids").cast("long").alias("size"), F.explode("cids").alias("cid")))
    met = written(small.select("path", "cid", "size").unionByName(met.where(F.col("size") > leaf)), "join-leaves")
    # each class's leaf paths (at most about branching * runs of them, more below wide buckets)
    own = met.groupBy("cid").agg(F.collect_set("path").alias("paths")).join(classes.select("cid", "rows"), "cid")
    n_blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    member = (met.withColumn("nb", n_blocks).withColumn("b", F.pmod(F.xxhash64("cid", "path"), F.col("nb")).cast("int"))
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
              .select("path", "cid", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj")))
    n = 4 * partitions(docs.sparkSession)
    owned = written(_owners(member.join(own, "cid"), n), "join-owned")
    found = written(_links(owned.join(sets, "cid"), threshold, n), "join-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    out = (classes.select(*key, "cid", "doc_id", "th", "rows", "n").join(links, "cid", "left")
           .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
           .select(*key, "cid", F.col("doc_id").alias("rep"), F.col("th").alias("rep_th"), "rows", "n", F.coalesce("links", F.lit(0)).alias("links"),
                   F.coalesce("root", "cid").alias("root")))
    return rows.select("doc_id", "th", *key, "n"), written(out, "join-classes-out")


def ngram_jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, n_links`` per row of ``docs``; see :func:`similar_classes` for the options."""
    rows, classes = similar_classes(docs, **options)
    heads = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    per_class = classes.join(heads, "root").select("c1", "c2", "class_id", "n",
                                                   (F.col("rows") - 1 + F.col("links")).alias("n_links"))
    out = rows.drop("n", "th").join(per_class, ["c1", "c2"])
    empty = F.col("n") == 0
    return out.select("doc_id", F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


@keeping_columns
def one_of_each(docs: DataFrame, text_col: str = "text", broadcast_rows: int = 500_000, **options) -> DataFrame:
    """``docs`` with one row of each component: the first row of the smallest doc_id; of texts without words one of each equal text.

    The rows to leave out are named by doc_id and text hash; up to ``broadcast_rows`` of them
    go to every task, so that no text is shuffled, more are joined by shuffle.
    """
    rows, classes = similar_classes(docs, text_col=text_col, **options)
    first = F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "rep_th")).alias("f")
    keep = classes.where("n > 0").groupBy("root").agg(first).select(F.col("f.rep").alias("doc_id"), F.col("f.rep_th").alias("th"))
    wordless = rows.where("n = 0").groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")).alias("f"))
    keep = keep.unionByName(wordless.select("f.doc_id", "th"))
    per = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("times"))

    def same(a, b, id_col="doc_id", th_col="th"):
        return a["doc_id"].eqNullSafe(b[id_col]) & (a["th"] == b[th_col])

    gone = per.join(keep, same(per, keep), "left_anti")
    twice = per.where("times > 1").join(keep, same(per, keep), "left_semi")
    name = lambda df, what: written(df.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), what)
    gone, twice = name(gone, "join-gone"), name(twice, "join-twice")
    sized = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    out = docs.withColumn("__h", F.xxhash64(text_of(docs, text_col)))
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th"))
    out = out.join(sized(gone), at, "left_anti")
    if not twice.isEmpty():
        again = sized(twice)
        out = out.join(again, at, "left_anti").unionByName(out.join(again, at, "left_semi").dropDuplicates(["doc_id", "__h"]))
    return out.select(*docs.columns)
