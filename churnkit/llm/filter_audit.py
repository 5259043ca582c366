"""Filter interaction audit by min-plus removal ranks.

Every document is judged once by every filter; its verdicts are a bit mask.  Under an order
of the filters a document is removed by the failing filter that comes first, so its
removal step is the smallest position among its failing filters.  With the positions of each
order as one row (the inverse permutation) and the failing filters of each mask as one row,
all steps are a min-plus product of the mask matrix and the position matrix (``+0`` where a
filter fails, ``+inf`` where it holds).  What is kept, removed, redundant or lost at a step are
sums over the masks, weighted by how many documents have each mask.

So the documents are read once: they are reduced to counts per (part, mask), and all orders are
worked out per part from at most ``2**filters`` counts, in tasks.

The identity filter compares whole texts by SHA-256: rows are counted per (digest, doc_id), the
smallest doc_id of each digest is found by a partial aggregate and meets only its own row
again, so a text that a third of all rows share is never gathered.

Edge cases: a null text is empty; a null source is the part ``''``, as an empty one is; a document
without label rows counts as neither good nor toxic, one with several as good if any says so;
rows that repeat a doc_id with the same text are not copies of each other; a row without doc_id
is never a copy and makes no other row one.  A part or label may hold any share of the rows.
Very long texts are judged whole; other columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, text_of, written

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
#: the text filters in bit order; the identity filter takes the next bit
TEXT_FILTERS = "ABCD"
IDENTITY = "E"
#: removal step of a document that no filter removes
NEVER = 1 << 20


def text_mask(text: str) -> int:
    """Bits of the text filters that fail: A short, B repetitive, C upper case, D symbols."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()          # bytes split at exactly the six ASCII white-space characters
    upper = len(data) - len(data.translate(None, _UPPER))
    return ((len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * upper > 2 * len(text)) << 2 | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3)


def document_masks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, part, mask, digest``: the text filters' verdicts and the text's SHA-256 per row."""
    src = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_of(docs, text_col).alias("t"))

    def run(it):
        for b in batches(it):
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text_mask(t) for t in texts], pa.int32()),
                 pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())],
                names=["doc_id", "part", "mask", "digest"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def with_identity(rows: DataFrame, bit: int) -> DataFrame:
    """``doc_id, part, mask, n``: rows counted, with ``bit`` set where a smaller doc_id has the same digest."""
    rows = written(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("__first", F.lit(True))
    copy = F.col("__first").isNull() & F.col("doc_id").isNotNull()
    return (rows.join(first, ["digest", "doc_id"], "left")
            .select("doc_id", "part", "n", (F.col("mask") + F.when(copy, bit).otherwise(0)).alias("mask")))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the flags ``good`` and ``toxic``; rows without doc_id meet no label."""
    def flag(c: str) -> Column:
        return F.max(F.when(F.col(c) == 1, 1).otherwise(0))

    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = rows.where("doc_id is not null").join(marks.where("good + toxic > 0"), "doc_id", "left").fillna(0, ["good", "toxic"])
    return known.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def mask_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """``part, counts``: per part the documents, good and toxic ones of each mask, ``3 * 2**n_filters`` longs in a row."""
    flat = rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "__g", "__t")])
    at = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for c in ("n", "__g", "__t") for m in range(1 << n_filters)]
    return flat.groupBy("part").agg(F.array(*at).alias("counts"))


def removal_steps(n_filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (one row of filter numbers each) and ``steps[mask, order]``, the min-plus product."""
    orders = np.array(list(permutations(range(n_filters))))
    position = np.argsort(orders, axis=1) + 1                      # inverse permutation: step of each filter
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    cost = np.where(fails == 1, 0, NEVER)
    steps = np.full((1 << n_filters, len(orders)), NEVER)
    for f in range(n_filters):                                     # min over filters of cost + position
        steps = np.minimum(steps, cost[:, f, None] + position[None, :, f])
    return orders, steps


def audit_counts(counts: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """All measures per (order, step) of one part; ``counts`` holds documents, good and toxic ones per mask."""
    n_filters = orders.shape[1]
    masks = np.arange(counts.shape[1])
    step = np.arange(1, n_filters + 1)
    here = steps[:, :, None] == step                                # mask, order, step
    fails = (masks[:, None, None] >> orders[None, :, :]) & 1 == 1   # the step's own filter fails
    early = steps[:, :, None] < step
    total = {k: np.tensordot(c, w, axes=(0, 0)) for k, c, w in (
        ("kept", counts[0], steps[:, :, None] > step), ("removed", counts[0], here), ("redundant", counts[0], early & fails),
        ("unique_fails", counts[0], masks[:, None, None] == (1 << orders)[None, :, :]),
        ("good_lost", counts[1], here), ("toxic_lost", counts[2], here))}
    share = np.zeros(n_filters, dtype=np.int64)
    np.add.at(share, orders, total["removed"])                      # scattered to the filter, over all orders
    return total | {"shapley": share[orders]}


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``part, filter_order, step`` and MEASURES: one row per part, order of the five filters and step."""
    names = TEXT_FILTERS + IDENTITY
    rows = with_labels(with_identity(document_masks(docs, text_col), 1 << len(TEXT_FILTERS)), labels)
    weighed = rows.select("part", "mask", "n", (F.col("n") * F.col("good")).alias("__g"), (F.col("n") * F.col("toxic")).alias("__t"))
    orders, steps = removal_steps(len(names))
    labels_of = ["".join(names[f] for f in o) for o in orders]
    n = orders.size

    def run(it):
        for b in it:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = audit_counts(np.array(counts, dtype=np.int64).reshape(3, -1), orders, steps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n), pa.array(np.repeat(labels_of, len(names))),
                     pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders))),
                     *[pa.array(got[m].ravel().astype(np.int64)) for m in MEASURES]],
                    names=["part", "filter_order", "step", *MEASURES])

    return mask_counts(weighed, len(names)).mapInArrow(
        run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
