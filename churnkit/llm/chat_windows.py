r"""Chat formatting in budgeted windows.

A conversation becomes windows of formatted turns.  A turn is ``<|im_start|>role\ntext<|im_end|>\n``;
control strings inside texts are escaped reversibly by a backslash behind their ``<`` (one more
where there are some), so only a turn's own marks read as marks.

Windows are aligned to turns.  Prefix sums of the turns' tokens choose the longest span of new
turns that fits the budget beside what is repeated in front: the system turn (the first turn, if its
role is ``system``) and the latest earlier turns of at most ``history`` tokens.  If the next turn would not
fit, history is given up first, oldest turns first; the system turn stays.  A turn that is too long even then gets a window
that exceeds the budget (``over_budget``); nothing is cut or dropped.  The loss mask covers
the texts of new assistant turns only, so each is a target once.

Scale: conversations of up to ``block_tokens`` bytes (tokens never outnumber bytes) are formatted whole, each in
one pass over rows sorted in their partition.  Longer ones may hold any share of all rows: their prefix sums come from
the chunked order of :mod:`churnkit.operators.ordered`, and they are cut into blocks of ``block_tokens`` tokens that
many tasks format; a block also gets the turns that reach into its history, and the system turn.
Windows start anew at a block, which is the only difference.

Edge cases: a null or empty text is an empty turn; a null role is the empty role (other roles than
``assistant`` are never targets); rows go by turn, nulls last, ties by a hash of role and text; repeated
rows are turns each; a null conv_id is one conversation; very long texts are formatted whole; other
columns are not touched; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import attach, ordered
from .common import batches, partitions, written

START, END = "<|im_start|>", "<|im_end|>"
#: control strings; a backslash run behind the first character marks an escaped one
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end|endoftext)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end|endoftext)\|>")
_TURN = re.compile(re.escape(START) + "([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
TARGET, SYSTEM = "assistant", "system"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    """Roles end at the line's end, so theirs are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int]:
    """A turn's formatted form and the place where its text starts."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted window")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


@lru_cache(maxsize=4)
def _encoder(ranks_path: str):
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(formatted: str, ranks_path: str) -> int:
    return len(_encoder(ranks_path).encode_to_numpy(formatted, disallowed_special=()))


def choose_windows(tokens: list[int], first: int, budget: int, history: int, system: int) -> Iterator[tuple[int, int, int]]:
    """``(history from, new from, new to)`` of the windows over turns ``first ..``, by prefix sums.

    Turns before ``first`` serve as history only; ``system`` is the system turn's length where
    it stands before all of ``tokens``, 0 without one."""
    before = np.concatenate([[0], np.cumsum(tokens)])
    i = first
    while i < len(tokens):
        room = budget - system - tokens[i]
        back = min(history, max(room, 0))
        h = int(np.searchsorted(before, before[i] - back, "left"))          # latest turns of at most `back` tokens
        j = int(np.searchsorted(before, before[h] + budget - system, "right")) - 1
        j = max(j, i + 1)
        yield h, i, j
        i = j


def format_block(turns: list[tuple[int, str, str]], first: int, system: tuple[str, str] | None, at: int,
                 ranks_path: str, budget: int, history: int) -> list[dict]:
    """Windows over ``turns[first:]``, each turn ``(place, role, text)``; ``turns[:first]`` may be repeated as history.

    ``system`` is the conversation's system turn if it lies before all of ``turns``."""
    own_system = system is None and bool(turns) and turns[0][0] == 1 and turns[0][1] == SYSTEM
    shown = [render(r, t) for _, r, t in turns]
    if own_system:
        system = turns[0][1:]
    front = render(*system)[0] if system else ""
    front_tokens = n_tokens(front, ranks_path) if system else 0
    tokens = [n_tokens(s, ranks_path) for s, _ in shown]
    skip = 1 if own_system else 0
    out = []
    for h, i, j in choose_windows(tokens[skip:], max(0, first - skip), budget, history, front_tokens):
        h, i, j = h + skip, i + skip, j + skip
        opens = own_system and not out                         # the system turn itself is new in the first window only
        text, loss, total = front, [], front_tokens
        for k in range(h, j):
            body, head = shown[k]
            if k >= i and turns[k][1] == TARGET:
                loss.append({"start": len(text) + head, "end": len(text) + len(body) - len(END) - 1})
            text += body
            total += tokens[k]
        out.append({"window": at + len(out), "first_turn": 1 if opens else turns[i][0], "n_repeated": 0 if opens else (i - h) + bool(system),
                    "n_new": j - i + opens, "n_tokens": total, "over_budget": total > budget, "text": text, "loss": loss})
    if own_system and len(turns) == 1:
        out.append({"window": at, "first_turn": 1, "n_repeated": 0, "n_new": 1, "n_tokens": front_tokens,
                    "over_budget": front_tokens > budget, "text": front, "loss": []})
    return out


WINDOW = ("struct<window:long,first_turn:long,n_repeated:int,n_new:int,n_tokens:long,over_budget:boolean,text:string,"
          "loss:array<struct<start:long,end:long>>>")
_WINDOW = pa.struct([("window", pa.int64()), ("first_turn", pa.int64()), ("n_repeated", pa.int32()), ("n_new", pa.int32()),
                     ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()),
                     ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_OWN, _HISTORY, _SYSTEM = 0, 1, 2
_KEY = ["__null", "__key"]


def _turns(convs: DataFrame) -> DataFrame:
    """Rows with a key that is never null, roles and texts without nulls and a tie-breaking hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    return convs.select(F.col("conv_id").isNull().alias("__null"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("__key"),
                        "conv_id", "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("__tie"))


def _size(role: str = "role", text: str = "text") -> Column:
    """An upper bound of a turn's tokens: the bytes of its formatted form, escapes included."""
    return 2 * (F.octet_length(role) + F.octet_length(text)) + len(START) + len(END) + 2


def _long_blocks(rows: DataFrame, ranks_path: str, history: int, block_tokens: int) -> DataFrame:
    """Rows of long conversations dealt to blocks by prefix sums, with their history and system turns."""
    def count(it):
        for b in batches(it):
            roles, texts = b.column(4).to_pylist(), b.column(5).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([n_tokens(render(r, t)[0], ranks_path) for r, t in zip(roles, texts)], pa.int64())],
                names=[*b.schema.names, "__tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __tokens long"
    o = ordered(rows.mapInArrow(count, schema), _KEY, "turn", "__tie", sums_before={"tokens": F.col("__tokens")})
    before = F.col("before_tokens").cast("long")
    o = o.select(*rows.columns, F.col("_pos").alias("__pos"), before.alias("__before"),
                 F.floor(before / block_tokens).cast("long").alias("__block"))
    last = o.groupBy(*_KEY).agg(F.max("__block").alias("__last"))
    own = o.withColumn("__kind", F.lit(_OWN))
    reach = o.where(F.col("__before") >= (F.col("__block") + 1) * block_tokens - history).withColumns(
        {"__kind": F.lit(_HISTORY), "__block": F.col("__block") + 1})
    system = (o.where((F.col("__pos") == 1) & (F.col("role") == SYSTEM)).join(last, _KEY).where("__last > 0")
              .withColumns({"__kind": F.lit(_SYSTEM), "__block": F.explode(F.sequence(F.lit(1).cast("long"), F.col("__last")))}))
    cols = [*rows.columns, "__pos", "__block", "__kind"]
    return own.select(cols).unionByName(reach.select(cols)).unionByName(system.select(cols)).withColumn("__parts", F.lit(2))


def _format(ranks_path: str, budget: int, history: int):
    """Map over rows sorted by conversation, block and place: one row of windows per block."""
    def run(it):
        key, turns, system, past = None, [], None, []

        def close():
            if not turns:
                return None
            got = format_block(past + turns, len(past), system, key[2] << 32, ranks_path, budget, history)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[3]], kind), pa.array([key[2]], pa.int64()), pa.array([key[4]], pa.int32()),
                 pa.array([got], pa.list_(_WINDOW))], names=["conv_id", "block", "parts", "windows"])

        kind = None
        for b in batches(it, 64):
            kind = b.column(2).type
            for null, k, conv, role, text, pos, block, what, parts in zip(*(c.to_pylist() for c in b.columns)):
                if key is None or key[:3] != (null, k, block):
                    out = close()
                    if out is not None:
                        yield out
                    key, turns, system, past = (null, k, block, conv, parts), [], None, []
                if what == _SYSTEM:
                    system = (role, text)
                elif what == _HISTORY:
                    if not (pos == 1 and role == SYSTEM):
                        past.append((pos, role, text))
                else:
                    turns.append((pos if pos else len(turns) + 1, role, text))
        out = close()
        if out is not None:
            yield out
    return run


def conversation_blocks(convs: DataFrame, ranks_path: str, budget: int = 1024, history: int = 256,
                        block_tokens: int = 1 << 20) -> tuple[DataFrame, bool]:
    """``conv_id, block, parts, windows`` with the windows of a block in order, and whether any conversation has several blocks.

    ``parts`` is 1 where the block is the whole conversation."""
    rows = _turns(convs)
    sizes = rows.groupBy(*_KEY).agg(F.sum(_size()).alias("__size"), F.count(F.lit(1)).alias("_n"))
    long_keys = written(sizes.where(F.col("__size") > block_tokens).select(*_KEY, "_n", F.lit(True).alias("__long")), "chat-long")
    n_long = long_keys.count()
    if n_long:
        marked = attach(rows, long_keys, _KEY).drop("_n")
        short, long = marked.where("__long is null").drop("__long"), marked.where("__long").drop("__long")
    else:
        short, long = rows, None
    cols = [*rows.columns, "__pos", "__block", "__kind"]
    blocks = short.select("*", F.lit(0).cast("long").alias("__pos"), F.lit(0).cast("long").alias("__block"), F.lit(_OWN).alias("__kind"),
                          F.lit(1).alias("__parts"))
    if long is not None:
        blocks = blocks.unionByName(_long_blocks(long, ranks_path, history, block_tokens).select(*cols, "__parts"))
    dealt = (blocks.repartition(partitions(convs.sparkSession), *_KEY, "__block")
             .sortWithinPartitions(*_KEY, "__block", (F.col("__kind") != _SYSTEM).cast("int"), "__pos", F.col("turn").asc_nulls_last(), "__tie"))
    id_kind = convs.schema["conv_id"].dataType.simpleString()
    out = (dealt.select("__null", "__key", "conv_id", "role", "text", "__pos", "__block", "__kind", "__parts")
           .mapInArrow(_format(ranks_path, budget, history), f"conv_id {id_kind}, block long, parts int, windows array<{WINDOW}>"))
    return out, bool(n_long)


def chat_windows(convs: DataFrame, ranks_path: str, budget: int = 1024, history: int = 256, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per window: ``conv_id, window`` (rising in the conversation), ``first_turn`` (place of the first
    new turn), ``n_repeated`` (turns in front that are repeated), ``n_new``, ``n_tokens``, ``over_budget``, ``text`` and ``loss``
    (spans of ``text``, in code points, that are targets)."""
    blocks, _ = conversation_blocks(convs, ranks_path, budget, history, block_tokens)
    return blocks.select("conv_id", F.explode("windows").alias("w")).select("conv_id", "w.*")


class _Reader:
    """What the windows of one conversation say, read back in order with bounded memory."""

    def __init__(self):
        self.n = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, w: dict) -> None:
        turns = read_turns(w["text"])
        for role, text in turns[w["n_repeated"]:]:
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        front = sum(len(render(*t)[0]) for t in turns[:w["n_repeated"]])
        self.chars += len(w["text"]) - front
        for span in w["loss"]:
            text = unescape(w["text"][span["start"]:span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(it):
    """One row per run of rows of the same conversation, its blocks in order."""
    key, reader, kind, done = None, None, None, []

    def row(done):
        cols = list(zip(*done))
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches(it, 64):
        kind = b.column(0).type
        for conv, parts, windows in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if parts == 1 or reader is None or key != (conv, parts):
                if reader is not None:
                    done.append((key[0], *reader.row()))
                key, reader = (conv, parts), _Reader()
            for w in windows:
                reader.take(w)
        if done:
            yield row(done)
            done = []
    if reader is not None:
        yield row([(key[0], *reader.row())])


def read_back(blocks: DataFrame, several: bool) -> DataFrame:
    """Digests per conversation of what :func:`conversation_blocks` formatted, parsed from the output alone.

    ``formatted_chars`` counts every turn's formatted form once, without the repeated ones.  A conversation in one
    block is read where it lies.  Blocks of a longer one meet in order: a SHA-256 can only be
    taken in sequence, but the task that takes it holds one block at a time."""
    schema = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, {_DIGEST}"
    if not several:
        return blocks.mapInArrow(_digests, schema)
    short, long = blocks.where("parts = 1"), blocks.where("parts > 1")
    dealt = long.repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return short.mapInArrow(_digests, schema).unionByName(dealt.mapInArrow(_digests, schema))
