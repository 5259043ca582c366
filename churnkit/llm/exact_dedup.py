"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is the value of its normalised bytes as a polynomial over two prime
fields.  It composes: ``h(AB) = h(A) * B**len(B) + h(B)``, so the chunks of a huge document
are hashed in parallel tasks and combined by length-shifted arithmetic.  Rows of equal
(fingerprint, length) then undergo a comparison chunk by chunk: per group and chunk the
smallest and largest bytes must be the same.  Texts of a group that holds a large share of
all rows are compared in place: a map task sends one row per chunk of the group.  A group that fails it (a true collision) is split by SHA-256.

Edge cases: null counts as empty and equals texts of white space only; the row with most
code points in the original text stays, then the smallest doc_id (nulls last); repeated rows
are members each, and rows that tie in both share ``keep_id`` (``kept`` is true on each of
them, as they cannot be told apart by doc_id); empty tables give no rows; other columns are
not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, partitions, text_of, written

#: two primes below 2**31 and a base for each (fixed values)
PRIMES = (2147483647, 2147483629)
BASES = (1000003117, 1500450271)
SPACES = b" \t\n\x0b\x0c\r"
#: bytes hashed at once; products of a byte and a residue sum up below 2**64
CHUNK = 1 << 16

_POWERS = {}


def _powers(p: int, base: int) -> np.ndarray:
    """base**0 .. base**(CHUNK-1) modulo p, by doubling."""
    if (p, base) not in _POWERS:
        out = np.ones(1, dtype=np.uint64)
        step = base
        while len(out) < CHUNK:
            out = np.concatenate([out, out * np.uint64(step) % np.uint64(p)])
            step = step * step % p
        _POWERS[p, base] = out
    return _POWERS[p, base]


def normalise(text: str) -> bytes:
    """UTF-8 bytes without the six white-space characters (none of which is part of another character)."""
    return text.encode("utf-8", "surrogatepass").translate(None, SPACES)


def fingerprint_chunk(data: bytes) -> tuple[int, int]:
    """Fingerprints of at most CHUNK bytes."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(b)
    return tuple(int((b * _powers(p, x)[:n][::-1]).sum() % np.uint64(p)) if n else 0
                 for p, x in zip(PRIMES, BASES))


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Fingerprint of a concatenation from those of its parts."""
    return tuple((a * pow(x, right_len, p) + b) % p for a, b, p, x in zip(left, right, PRIMES, BASES))


def fingerprint(data: bytes) -> tuple[int, int]:
    h = (0, 0)
    for i in range(0, len(data), CHUNK):
        part = data[i:i + CHUNK]
        h = combine(h, fingerprint_chunk(part), len(part))
    return h


def _digests(docs: DataFrame, huge: int) -> DataFrame:
    """``doc_id, n_cp, n, text_sha256, f1, f2``; texts over ``huge`` bytes get their fingerprint later."""
    def run(it):
        for b in batches(it):
            cols = {k: [] for k in ("n", "text_sha256", "f1", "f2")}
            for t in b.column(1).to_pylist():
                data = normalise(t)
                f = fingerprint(data) if len(data) <= huge else (None, None)
                for k, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), *f)):
                    cols[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(cols["n"], pa.int64()), pa.array(cols["text_sha256"], pa.string()),
                 pa.array(cols["f1"], pa.int64()), pa.array(cols["f2"], pa.int64())],
                names=["doc_id", "n_cp", "n", "text_sha256", "f1", "f2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.length("text").cast("long")).mapInArrow(
        run, f"doc_id {kind}, n_cp long, n long, text_sha256 string, f1 long, f2 long")


def _huge_fingerprints(docs: DataFrame, huge: int) -> DataFrame:
    """``text_sha256, f1, f2`` of the texts over ``huge`` bytes: chunks are dealt out, hashed and combined."""
    def split(it):
        for b in batches(it, 16):
            for t in b.column(0).to_pylist():
                data = normalise(t)
                if len(data) > huge:
                    sha = hashlib.sha256(data).hexdigest()
                    for i in range(0, len(data), CHUNK):
                        yield pa.RecordBatch.from_pydict({"text_sha256": [sha], "chunk": pa.array([i // CHUNK], pa.int32()),
                                                          "data": pa.array([data[i:i + CHUNK]], pa.binary())})

    def hash_chunks(it):
        for b in it:
            data = b.column(2).to_pylist()
            f = [fingerprint_chunk(d) for d in data]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, data), pa.int64()), pa.array([x[0] for x in f], pa.int64()),
                 pa.array([x[1] for x in f], pa.int64())], names=["text_sha256", "chunk", "len", "f1", "f2"])

    @F.pandas_udf("f1 long, f2 long")
    def fold(parts):
        import pandas as pd
        out = []
        for row in parts:
            h = (0, 0)
            for x in row:
                h = combine(h, (x["f1"], x["f2"]), x["len"])
            out.append(h)
        return pd.DataFrame(out, columns=["f1", "f2"])

    n = partitions(docs.sparkSession)
    chunks = (docs.where(F.octet_length("text") > huge).select("text")
              .mapInArrow(split, "text_sha256 string, chunk int, data binary")
              .repartition(n, "text_sha256", "chunk")
              .mapInArrow(hash_chunks, "text_sha256 string, chunk int, len long, f1 long, f2 long")
              .dropDuplicates(["text_sha256", "chunk"]))
    # one entry of 28 bytes per CHUNK bytes of a text, which itself is one value
    whole = chunks.groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("chunk", "len", "f1", "f2"))).alias("__parts"))
    return whole.select("text_sha256", fold("__parts").alias("__f")).select("text_sha256", "__f.f1", "__f.f2")


def _collided(docs: DataFrame, groups: DataFrame, total: int = 0, chunk: int = 4096, hot_share: int = 1000) -> DataFrame:
    """Keys (f1, f2, n) of groups whose texts differ in some chunk, by comparing all their chunks.

    Texts of groups with more than ``1 / hot_share`` of all rows (at most ``hot_share`` keys, which are
    broadcast) are compared where they lie: a task sends the smallest and largest bytes per group and chunk.  Only texts of
    smaller groups travel to their group's key."""
    def fp(it):
        for b in batches(it):
            data = [normalise(t) for t in b.column(0).to_pylist()]
            f = [fingerprint(d) for d in data]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in f], pa.int64()), pa.array([x[1] for x in f], pa.int64()),
                 pa.array(map(len, data), pa.int64()), pa.array(data, pa.binary())], names=["f1", "f2", "n", "data"])

    keyed = docs.select("text").mapInArrow(fp, "f1 long, f2 long, n long, data binary")
    key = ["f1", "f2", "n"]
    hot = F.col("rows") > max(64, total // hot_share) if "rows" in groups.columns else F.lit(False)
    in_place = keyed.join(F.broadcast(groups.where(hot).select(*key)), key, "left_semi")
    again = in_place.unionByName(keyed.join(groups.where(~hot).select(*key), key, "left_semi"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("n") - 1) / chunk).cast("int"))))
    parts = again.select("f1", "f2", "n", "data", at.alias("c")).select(
        "f1", "f2", "n", "c", F.substring("data", F.col("c") * chunk + 1, F.lit(chunk)).alias("part"))
    return (parts.groupBy("f1", "f2", "n", "c").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
            .where("lo <> hi").select("f1", "f2", "n").distinct())


def exact_dedup(docs: DataFrame, text_col: str = "text", huge: int = 1 << 16, hot_share: int = 1000) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``.

    Groups of more than ``1 / hot_share`` of all rows (at most ``hot_share`` of them, which
    bounds the broadcast) reach their rows by a broadcast join, all others by a shuffle.
    """
    src = docs.select("doc_id", text_of(docs, text_col).alias("text"))
    digests = _digests(src, huge)
    long_ones = _huge_fingerprints(src, huge).select("text_sha256", F.col("f1").alias("__f1"), F.col("f2").alias("__f2"))
    short, tall = digests.where("f1 is not null"), digests.where("f1 is null").drop("f1", "f2")
    tall = tall.join(long_ones, "text_sha256").withColumnsRenamed({"__f1": "f1", "__f2": "f2"}).select(short.columns)
    rows = written(short.unionByName(tall), "dedup-digests")

    total = rows.count()
    by_print = written(rows.groupBy("f1", "f2", "n").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 and n > 0"), "dedup-repeated")
    bad = written(_collided(src, by_print, total).withColumn("__bad", F.lit(True)), "dedup-collisions")
    if not bad.isEmpty():
        rows = (rows.join(bad, ["f1", "f2", "n"], "left")
                .withColumn("__sub", F.when(F.col("__bad"), F.col("text_sha256")).otherwise(F.lit(""))).drop("__bad"))
    else:
        rows = rows.withColumn("__sub", F.lit(""))
    key = ["f1", "f2", "n", "__sub"]
    first = F.min(F.struct((-F.col("n_cp")).alias("m"), F.col("doc_id").isNull().alias("z"), F.col("doc_id")))
    groups = written(rows.groupBy(*key).agg(first.alias("__b"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    hot_size = max(10_000, total // hot_share)
    hot = groups.where(F.col("group_size") > hot_size)
    hot_keys = F.broadcast(hot.withColumnsRenamed({"__b": "__hb", "group_size": "__hg"}))
    tagged = rows.join(hot_keys, key, "left")
    done = tagged.where("__hg is not null").withColumnsRenamed({"__hb": "__b", "__hg": "group_size"})
    rest = tagged.where("__hg is null").drop("__hb", "__hg").join(groups, key)
    out = done.select(*rest.columns).unionByName(rest)
    return out.select("doc_id", F.col("__b.doc_id").alias("keep_id"), "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("__b.doc_id")) & (-F.col("n_cp") == F.col("__b.m"))).alias("kept"),
                      "text_sha256")
