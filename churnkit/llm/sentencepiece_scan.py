"""SentencePiece BPE encoding and decoding by a max-plus parallel scan.

The BPE segmentation of a text is the one path through the lattice of pieces on which every two
neighbours are *compatible*: encoded together alone, they come out as these two.  (A merge
across a border inside the whole text would also happen in the pair alone, and conversely.)
So it is the best path of a max-plus problem whose states are the pieces that reach over a place,
with weight ``-inf`` for incompatible neighbours and the piece scores otherwise.

* Giant documents are split into chunks at any character.  A chunk's transfer matrix holds, for
  each state over its left border and each over its right border, the best weight of a path
  between them.  Matrices combine associatively in the max-plus semiring, in runs of ``fan``
  chunks first and then over the runs; that fixes each chunk's border states, after which
  every chunk is backtraced independently of the others.
* Between proven cuts (:mod:`churnkit.llm.pieces`) only one state exists, so a chunk's matrix is the
  product of its ragged ends, and what lies between is encoded once per distinct segment.
  A chunk without any cut runs the whole lattice.

Decoding joins the pieces, turns byte tokens into bytes and drops the dummy prefix.

Edge cases: null and empty texts have no ids; characters outside the vocabulary become
byte tokens; a repeated row is encoded again (giant ones once, then multiplied); an empty table
gives no rows; other columns are not touched.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, partitions, text_of, written
from .pieces import MARK, Memo, alone, alone_many, chunks_of, processor, prove, segment_pattern

CUT = (-1, 0)  # the state at a proven cut


class Lattice:
    """Pieces over a text, with the pairs that may stand next to each other."""

    def __init__(self, model_path: str):
        self.sp, self.proof = processor(model_path), prove(model_path)
        sp = self.sp
        self.id = {sp.id_to_piece(i): i for i in range(sp.get_piece_size())
                   if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        # only strings that come out as themselves can be tokens; a single character always can
        self.id = {p: i for p, i in self.id.items() if len(p) == 1 or p.replace(MARK, " ") in self.proof.whole}
        self.piece = {i: p for p, i in self.id.items()}
        self.score = {i: max(sp.get_score(i), -1e6) for i in self.piece}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        self.longest = self.proof.longest
        self.pattern = segment_pattern(self.proof)
        self._pairs: dict = {}

    def fits(self, a: int, b: int) -> bool:
        """Tokens a, b (b after a) are compatible; negative numbers are characters outside the vocabulary."""
        if a < 0 or b < 0:
            return True
        if (a, b) not in self._pairs:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            self._pairs[a, b] = alone(self.sp, self.piece[a] + self.piece[b]) == [a, b]
        return self._pairs[a, b]

    def starting(self, text: str, at: int):
        """(token, length) of the tokens that start at a place; an unknown character is -2 - its code."""
        found = False
        for n in range(1, min(self.longest, len(text) - at) + 1):
            i = self.id.get(text[at:at + n])
            if i is not None:
                found = found or n == 1
                yield i, n
        if not found:
            yield -2 - ord(text[at]), 1

    def weight(self, token: int) -> float:
        return self.score.get(token, -1e6)

    def ids(self, token: int) -> list[int]:
        return [token] if token >= 0 else [self.byte[x] for x in chr(-2 - token).encode("utf-8", "surrogatepass")]

    def cuts(self, text: str) -> list[int]:
        """Places between proven segments."""
        return [m.start() for m in self.pattern.finditer(text)][1:]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """Tokens that cover the character before ``at``, with how far they reach beyond it."""
        out = []
        for s in range(max(0, at - self.longest), at):
            out += [(t, s + n - at) for t, n in self.starting(text, s) if s + n >= at]
        return out

    def walk(self, text: str, entries: list[tuple[int, int]], left: int, right: int):
        """All lattice paths from the entry states over ``left`` to tokens that cover the character before ``right``.

        Returns nodes ``(end, token) -> {entry: (weight, previous node)}``: the columns of the
        transfer matrix, with backpointers.
        """
        nodes: dict = {}
        ends: dict[int, set] = {}
        for k, (t, over) in enumerate(entries):
            nodes.setdefault((left + over, t), {})[k] = (0.0, None)
            ends.setdefault(left + over, set()).add(t)
        for at in range(left, right):
            if at not in ends:
                continue
            for t, n in self.starting(text, at):
                column: dict = {}
                for before in ends[at]:
                    if before == -1 or self.fits(before, t):
                        for k, (w, _) in nodes[at, before].items():
                            if k not in column or w + self.weight(t) > column[k][0]:
                                column[k] = (w + self.weight(t), (at, before))
                if column:
                    nodes[at + n, t] = column
                    ends.setdefault(at + n, set()).add(t)
        return nodes

    @staticmethod
    def trace(nodes: dict, node: tuple[int, int], entry: int) -> list[int]:
        """Tokens of the path that reaches ``node`` from an entry state, the entry's own token left out."""
        out = []
        while nodes[node][entry][1] is not None:
            out.append(node[1])
            node = nodes[node][entry][1]
        return out[::-1]


@lru_cache(maxsize=2)
def lattice(model_path: str) -> Lattice:
    return Lattice(model_path)


_MEMOS: dict[str, Memo] = {}


def _as_bytes(lists: list[list[int]]) -> list[bytes]:
    ends = list(accumulate(map(len, lists), initial=0))
    flat = np.fromiter(chain.from_iterable(lists), dtype="<i4", count=ends[-1]).tobytes()
    return [flat[4 * i:4 * j] for i, j in zip(ends, ends[1:])]


def _memo(model_path: str) -> Memo:
    """Ids of segments as little-endian bytes."""
    if model_path not in _MEMOS:
        lat = lattice(model_path)
        _MEMOS[model_path] = Memo(
            {s: np.array([i], dtype="<i4").tobytes() for s, i in lat.proof.whole.items()},
            lambda c: lat.pattern.findall(" " + c),
            lambda rest: _as_bytes(alone_many(lat.sp, rest)), b"".join, limit=150_000)
    return _MEMOS[model_path]


def _between(model_path: str, text: str) -> bytes:
    """Ids of a stretch between two cuts."""
    lat, memo = lattice(model_path), _memo(model_path)
    parts = lat.pattern.findall(text.replace(MARK, " "))
    return b"".join(memo.known(parts))


class Chunk:
    """A chunk ``text[left:right]`` with enough of its neighbourhood to know the pieces over its borders."""

    def __init__(self, model_path: str, text: str, left: int, right: int, first: bool, last: bool):
        self.path, self.lat = model_path, lattice(model_path)
        self.text, self.left, self.right = text, left, right
        cuts = self.lat.cuts(text)
        self.inner = [c for c in cuts if left <= c <= right]
        self.entries = [CUT] if first or left in self.inner else self.lat.states(text, left)
        self.exits = [CUT] if last or right in self.inner else self.lat.states(text, right)
        self.last = last
        self.a = left if self.entries == [CUT] else next((c for c in self.inner if c > left), None)
        self.b = right if self.exits == [CUT] else next((c for c in reversed(self.inner) if c < right), None)

    def _paths(self, entries, left: int, right: int, exits):
        """{(entry, exit): (weight, tokens)} over a stretch that is not encoded by segments."""
        nodes = self.lat.walk(self.text, [(-1, 0) if e == CUT else e for e in entries], left, right)
        out = {}
        for x in exits:
            for k, e in enumerate(entries):
                if x == CUT:
                    best = max(((col[k][0], node) for node, col in nodes.items() if node[0] == right and k in col), default=None)
                else:
                    node = (right + x[1], x[0])
                    best = (nodes[node][k][0], node) if k in nodes.get(node, {}) else None
                if best is not None:
                    out[e, x] = (best[0], nodes, best[1], k)
        return out

    def matrix(self) -> dict:
        """Transfer matrix ``{(entry state, exit state): weight}``."""
        if self.a is None or self.b is None or self.a > self.b:
            return {k: v[0] for k, v in self._paths(self.entries, self.left, self.right, self.exits).items()}
        head = {CUT: 0.0} if self.a == self.left and self.entries == [CUT] else {
            e: v[0] for (e, _), v in self._paths(self.entries, self.left, self.a, [CUT]).items()}
        tail = {CUT: 0.0} if self.b == self.right and self.exits == [CUT] else {
            x: v[0] for (_, x), v in self._paths([CUT], self.b, self.right, self.exits).items()}
        return {(e, x): v + w for e, v in head.items() for x, w in tail.items()}

    def backtrace(self, entry, exit_) -> bytes:
        """Ids of the tokens that end in this chunk or over its right border."""
        ids = lambda tokens: np.array([i for t in tokens for i in self.lat.ids(t)], dtype="<i4").tobytes()

        def along(e, left, right, x):
            _, nodes, node, k = self._paths([e], left, right, [x])[e, x]
            return ids(Lattice.trace(nodes, node, k))

        if self.a is None or self.b is None or self.a > self.b:
            return along(entry, self.left, self.right, exit_)
        head = b"" if entry == CUT and self.a == self.left else along(entry, self.left, self.a, CUT)
        tail = b"" if exit_ == CUT and self.b == self.right else along(CUT, self.b, self.right, exit_)
        return head + _between(self.path, self.text[self.a:self.b]) + tail


def times(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    by: dict = {}
    for (s, x), w in b.items():
        by.setdefault(s, []).append((x, w))
    out: dict = {}
    for (e, s), v in a.items():
        for x, w in by.get(s, ()):
            if (e, x) not in out or v + w > out[e, x]:
                out[e, x] = v + w
    return out


def dump(m: dict) -> str:
    return json.dumps([[*e, *x, w] for (e, x), w in m.items()])


def load(s: str) -> dict:
    return {((a, b), (c, d)): w for a, b, c, d, w in json.loads(s)}


def borders(matrices: list[dict], entry, exit_) -> list[tuple]:
    """(entry state, exit state) of each matrix on the best path from ``entry`` to ``exit_``."""
    ahead = [{entry: 0.0}]
    for m in matrices:
        v: dict = {}
        for (e, x), w in m.items():
            if e in ahead[-1] and (x not in v or ahead[-1][e] + w > v[x]):
                v[x] = ahead[-1][e] + w
        ahead.append(v)
    out, state = [], exit_
    for k in range(len(matrices) - 1, -1, -1):
        before = max((ahead[k][e] + w, e) for (e, x), w in matrices[k].items() if x == state and e in ahead[k])[1]
        out.append((before, state))
        state = before
    return out[::-1]


def split_text(text: str, size: int, longest: int):
    """(chunk number, chunks, seen text, left, right): chunks of ``size`` characters with their neighbourhood."""
    text = MARK + text.replace(" ", MARK)
    n = -(-len(text) // size)
    for k in range(n):
        lo, hi = max(0, k * size - 2 * longest), min(len(text), (k + 1) * size + 2 * longest)
        yield k, n, text[lo:hi], k * size - lo, min((k + 1) * size, len(text)) - lo


def _giant(docs: DataFrame, model_path: str, size: int, fan: int) -> DataFrame:
    """``doc_id, text_hash, ids, n_chunks`` of the texts of ``size`` characters or more."""
    longest = prove(model_path).longest
    key = ["doc_id", "h1", "h2"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.where(F.length("text") >= size)
    once = text.groupBy("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(3)).alias("h2")).agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))

    def split(it):
        for b in batches(it, 8):
            for i, t in enumerate(b.column(3).to_pylist()):
                rows = list(zip(*split_text(t, size, longest)))
                at = pa.array([i] * len(rows[0]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(at) for c in (0, 1, 2, 4)]
                    + [pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()))],
                    names=[*key, "times", "chunk", "n", "seen", "left", "right"])

    schema = f"doc_id {kind}, h1 long, h2 long, times long, chunk int, n int, seen string, left int, right int"
    chunks = written(once.select(*key, "text", "times").mapInArrow(split, schema)
                     .repartition(partitions(docs.sparkSession), *key, "chunk"), "scan-chunks")

    @F.pandas_udf("string")
    def matrix(seen: pd.Series, left: pd.Series, right: pd.Series, chunk: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([dump(Chunk(model_path, s, a, b, k == 0, k == m - 1).matrix())
                          for s, a, b, k, m in zip(seen, left, right, chunk, n)], dtype=object)

    part = (F.col("chunk") / fan).cast("int").alias("part")
    matrices = written(chunks.select(*key, "chunk", part, matrix("seen", "left", "right", "chunk", "n").alias("m")), "scan-matrices")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        m = load(pdf["m"].iloc[0])
        for x in pdf["m"].iloc[1:]:
            m = times(m, load(x))
        return pdf[[*key, "part"]].head(1).assign(m=dump(m))

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:  # one small matrix per ``fan`` chunks of a text
        pdf = pdf.sort_values("part")
        b = borders([load(x) for x in pdf["m"]], CUT, CUT)
        return pdf[[*key, "part"]].assign(entry=[json.dumps(e) for e, _ in b], leave=[json.dumps(x) for _, x in b])

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        b = borders([load(x) for x in pdf["m"]], tuple(json.loads(pdf["entry"].iloc[0])), tuple(json.loads(pdf["leave"].iloc[0])))
        return pdf[[*key, "chunk"]].assign(entry=[json.dumps(e) for e, _ in b], leave=[json.dumps(x) for _, x in b])

    ids = f"doc_id {kind}, h1 long, h2 long"
    parts = matrices.groupBy(*key, "part").applyInPandas(product, f"{ids}, part int, m string")
    ends = parts.groupBy(*key).applyInPandas(outer, f"{ids}, part int, entry string, leave string")
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    met = matrices.join(ends, same(matrices, ends, [*key, "part"])).select(*(matrices[c] for c in [*key, "chunk", "part", "m"]), "entry", "leave")
    states = met.groupBy(*key, "part").applyInPandas(inner, f"{ids}, chunk int, entry string, leave string")

    @F.pandas_udf("array<int>")
    def back(seen: pd.Series, left: pd.Series, right: pd.Series, chunk: pd.Series, n: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(Chunk(model_path, s, a, b, k == 0, k == m - 1).backtrace(
            tuple(json.loads(e)), tuple(json.loads(x))), dtype="<i4") for s, a, b, k, m, e, x in zip(seen, left, right, chunk, n, entry, leave)])

    traced = chunks.join(states, same(chunks, states, [*key, "chunk"])).select(
        *(chunks[c] for c in [*key, "times", "chunk", "n"]), back("seen", "left", "right", chunks["chunk"], "n", "entry", "leave").alias("ids"))
    whole = traced.groupBy(*key, "times", "n").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return whole.select("doc_id", F.col("h1").alias("text_hash"), F.flatten("parts.ids").alias("ids"), F.col("n").alias("n_chunks"),
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")).drop("copy")


def encode(docs: DataFrame, model_path: str, size: int = 32_768, fan: int = 64, text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, ids array<int>, n_chunks`` per row: the library's ids of the whole text.

    Texts of less than ``size`` characters are one chunk; the others go through the scan.
    """
    src = docs.select("doc_id", text_of(docs, text_col).alias("text"))
    prove(model_path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it):
        for b in batches(it):
            ids = _memo(model_path).texts(b.column(1).to_pylist(), chunks_of)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                                              pa.array(np.ones(len(ids), dtype=np.int32))], names=["doc_id", "text_hash", "ids", "n_chunks"])

    small = src.where(F.length("text") < size).select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        run, f"doc_id {kind}, text_hash long, ids array<int>, n_chunks int")
    return small.unionByName(_giant(src, model_path, size, fan))


class Decoder:
    def __init__(self, model_path: str):
        sp = processor(model_path)
        self.table = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
                      else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]

    def text(self, ids) -> str:
        out = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


@lru_cache(maxsize=2)
def decoder(model_path: str) -> Decoder:
    return Decoder(model_path)


def decode(ids, model_path: str):
    """Column of texts of a column of ids."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        d = decoder(model_path)
        return pd.Series([d.text(x.tolist()) for x in s], dtype=object)

    return run(ids)
