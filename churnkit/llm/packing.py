"""Best-two-fit packing of tokenised documents into sequences of fixed length.

1. One map pass cuts each document's ids into pieces of at most ``capacity`` tokens (only
   longer documents are cut; the first piece may be shorter) and keeps their digests.
2. Lengths are whole numbers from 1 to ``capacity``, so the pieces are summed up exactly by
   a histogram of at most ``capacity`` counts.  :func:`best_two_fit` packs the histogram:
   a bin is filled greedily with the longest piece that fits; then its smallest piece
   gives way to two unpacked pieces that fill the expanded gap more tightly.  Each pattern
   is applied as often as the counts allow, so the work follows ``capacity``, not the rows.
3. Every piece gets its rank among the pieces of its length (salted counts, no window over a
   whole length) and finds its place in the interval table of the patterns by binary search.

Edge cases: null and empty texts are one piece (the closing id alone); repeated rows are
packed each; ties among equal lengths fall by doc_id and piece (any choice is as good); an
empty table gives no rows.  The interval table holds at most a few entries per pattern and
there are at most a few patterns per length, so what is sent to tasks is bounded by
``capacity``.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from .common import batches, partitions, text_of, written

#: characters whose class in the split pattern is the same in every Unicode version
_KNOWN = re.compile("[ \t\n\r!-~¡¿«»–—‘’“”…€£§©®°±×÷À-ÖØ-öø-ÿĀ-ſΑ-ΡΣ-Ωα-ωА-Яа-яЁё]*")


@lru_cache(maxsize=4)
def _state(path: str, ranks_path: str | None):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    ranked = None
    if ranks_path:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tok, ranked, [t.content for t in tok.get_added_tokens_decoder().values()]


def encode_text(text: str, path: str, ranks_path: str | None = None) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers, as the tokenizer file at ``path`` gives them.

    ``ranks_path`` may name the same vocabulary as a rank file, which is several times
    faster; it serves texts of :data:`_KNOWN` characters without special strings only, for
    which both give the same ids.
    """
    tok, ranked, specials = _state(path, ranks_path)
    if ranked and _KNOWN.fullmatch(text) and not any(s in text for s in specials):
        return ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
    return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def cut_pieces(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than ``capacity``
    when there are several."""
    n = len(ids) // 4
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, ranks_path: str | None = None,
                 text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: one row per piece of each document."""
    end = np.array([end_id], dtype="<u4").tobytes()
    src = docs.select("doc_id", text_of(docs, text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType
    schema = ["piece int", "start long", "length long", "ids_crc32 long"]

    def run(it):
        for b in batches(it):
            rows = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = encode_text(text, path, ranks_path) + end
                rows += [(k, j, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                         for j, (s, n) in enumerate(cut_pieces(ids, capacity))]
            k, j, s, n, c = (np.array(x, dtype="int64") for x in zip(*rows)) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(k, pa.int64())), pa.array(j, pa.int64()).cast(pa.int32()),
                 pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, f"doc_id {id_type.simpleString()}, " + ", ".join(schema))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Pack ``counts`` (length -> pieces) into bins; returns (lengths of one bin, times) patterns."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    patterns = []

    def take(n):
        left[n] -= 1
        if not left[n]:
            lengths.remove(n)

    def give(n):
        left[n] = left.get(n, 0) + 1
        if left[n] == 1:
            insort(lengths, n)

    while lengths:
        bin_, gap = [], capacity
        while (i := bisect_right(lengths, gap)):
            n = lengths[i - 1]
            bin_.append(n)
            gap -= n
            take(n)
        while gap and len(bin_) > 1:
            small = bin_[-1]  # filled from the longest on, so the last is the smallest
            room, best = gap + small, None
            for i in range(bisect_right(lengths, room - 1) - 1, -1, -1):
                a = lengths[i]
                if 2 * a < (sum(best) if best else small + 1):
                    break
                j = min(bisect_right(lengths, room - a), i + 1) - 1
                if j == i and left[a] < 2:
                    j -= 1
                if j >= 0 and a + lengths[j] > (sum(best) if best else small):
                    best = (a, lengths[j])
                    if sum(best) == room:
                        break
            if not best:
                break
            bin_.pop()
            give(small)
            for n in best:
                take(n)
                bin_.append(n)
            bin_.sort(reverse=True)
            gap = room - sum(best)
        times = 1 + min(left[n] // bin_.count(n) for n in set(bin_))
        for n in bin_:
            left[n] -= times - 1
            if not left[n] and n in lengths:
                lengths.remove(n)
        patterns.append((bin_, times))
    return patterns


def place_table(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Intervals of ranks per length: ``length, lo, sequence, offset`` (rank r goes to sequence + r - lo)."""
    rows, used, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            lo = used.get(n, 0)
            rows.append((n, lo, sequence, offset))
            used[n] = lo + times
            offset += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "lo", "sequence", "offset"]).sort_values(["length", "lo"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int, rows_per_salt: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``length`` (``pieces`` must be stored)."""
    n_rows = pieces.count()
    salts = max(1, -(-n_rows // rows_per_salt))
    cols = pieces.columns
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    salted = pieces.withColumn("__salt", key)
    per_salt = written(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")), "pack-salts")
    hist = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    places = place_table(best_two_fit(hist, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(places)
    before = (per_salt.withColumn("__before", F.coalesce(F.sum("__n").over(
        Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n"))
    in_salt = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1
    ranked = (salted.repartition(partitions(pieces.sparkSession), "length", "__salt").withColumn("__r", in_salt)
              .join(before, ["length", "__salt"]).withColumn("__rank", F.col("__r") + F.col("__before")))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        big = np.int64(1) << 44
        at = np.searchsorted(t["length"].to_numpy() * big + t["lo"].to_numpy(),
                             length.to_numpy() * big + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"].to_numpy()[at] + rank.to_numpy() - t["lo"].to_numpy()[at],
                             "offset": t["offset"].to_numpy()[at]})

    return (ranked.withColumn("__p", place("length", "__rank"))
            .select(*cols, F.col("__p.sequence_id").alias("sequence_id"), F.col("__p.offset").alias("offset")))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0,
                   ranks_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all rows of ``docs``; one row per piece."""
    return pack(written(token_pieces(docs, path, capacity, end_id, ranks_path, text_col), "pack-pieces"), capacity)
