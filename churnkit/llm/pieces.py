"""What a SentencePiece BPE model allows to be decided away from the running text.

A *mark* is the character that stands for a space.  Every merge yields a piece of the
vocabulary, so no merge can cross a place that no piece spans.  :func:`prove` checks three
kinds of places against the whole vocabulary:

* before a mark that follows another character (no piece holds a mark behind another
  character),
* behind a letter that another kind of character follows (no piece holds that), and
* on both sides of a character that occurs in no piece of two or more characters.

Segments between these cuts are encoded independently of each other.  The library's
dummy prefix (one mark before every non-empty text) is part of the first segment.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

MARK = "▁"
#: characters of a text that are looked at together
BLOCK = 1 << 20


class Proof:
    """Result of :func:`prove`; plain data, at most the size of the vocabulary."""

    def __init__(self, whole: dict[str, int], letters: str, others: str, longest: int):
        self.whole = whole          # segment -> id, proven to encode alone as that one token
        self.letters = letters      # letters that occur in pieces of two or more characters
        self.others = others        # other characters that do
        self.longest = longest      # characters of the longest piece


@lru_cache(maxsize=4)
def processor(model_path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def alone(sp, segment: str) -> list[int]:
    """Ids of a segment by itself, behind a line feed, which no piece joins to anything."""
    return sp.encode("\n" + segment.replace(MARK, " "))[2:]


@lru_cache(maxsize=4)
def prove(model_path: str) -> Proof:
    """Check the cuts over the whole vocabulary and list the strings that are one token alone.

    Raises ValueError for a model whose pieces cross the cuts or that normalises text.
    """
    sp = processor(model_path)
    plain = [i for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i) for i in plain}
    if any(re.search(f"[^{MARK}]{MARK}", t) for t in text.values()) or any("\n" in t for t in text.values()):
        raise ValueError("a piece spans a word boundary or a line feed; segments are not independent")
    if sp.decode(sp.encode("  a  b\tﬁ① ")) != "  a  b\tﬁ① ":
        raise ValueError("the model normalises text")
    joinable = {c for t in text.values() if len(t) > 1 for c in t} - {MARK}
    letters = {c for c in joinable if c.isalpha()}
    if any(a in letters and b not in letters for t in text.values() for a, b in zip(t, t[1:])):
        letters = set()
    whole = {}
    for i, t in text.items():
        if alone(sp, t) == [i]:
            whole[t.replace(MARK, " ")] = i
    return Proof(whole, "".join(sorted(letters)), "".join(sorted(joinable - letters)), max(map(len, text.values())))


def segment_pattern(proof: Proof) -> re.Pattern:
    """Matches one independent segment after the other."""
    o, a = f"[{re.escape(proof.others)}]", f"[{re.escape(proof.letters)}]"
    if not proof.letters:
        return re.compile(f"[ {MARK}]+{o}*|{o}+|.", re.DOTALL)
    return re.compile(f"[ {MARK}]+{o}*{a}*|{o}+{a}*|{a}+|.", re.DOTALL)


def chunks_of(text: str):
    """Blocks of a text as lists of chunks: what stands between single spaces (its mark implied),
    or, where marks meet, whole runs of marks with what follows (their first mark implied)."""
    if not text:
        return
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        for block in _spans(text):
            yield block.split(" ")
        return
    runs = re.compile(f"[ {MARK}]+[^ {MARK}]*")
    for block in _spans(" " + text.replace(MARK, " ")):
        yield [c[1:] for c in runs.findall(block if block[0] == " " else " " + block)]


def _spans(text: str, size: int = BLOCK):
    """Parts of about ``size`` characters without the space at which they are cut."""
    cut, pos = re.compile(r"(?<=[^ ]) "), 0
    while len(text) - pos > size:
        m = cut.search(text, pos + size)
        if not m:
            break
        yield text[pos:m.start()]
        pos = m.end()
    yield text[pos:]


class Memo:
    """Values of independent segments, merged by the library once each.

    A text comes as chunks at which it may be cut; a chunk that is not known yet is split
    into segments by ``split``, the unknown segments of all texts go to ``merge`` in one
    call, and ``join`` puts their values together; a single value stands for itself.  Between calls the tables
    start over (the seed of proven segments stays) beyond ``limit`` entries, so memory is bounded.
    """

    def __init__(self, seed: dict, split, merge, join, limit: int = 700_000):
        self.seed, self.split, self.merge, self.join, self.limit = seed, split, merge, join, limit
        self.chunks: dict = {}
        self.segments: dict = dict(seed)

    def known(self, segments: list[str]) -> list:
        """Values of segments; unknown ones are merged in one call."""
        self._learn(set(segments))
        return list(map(self.segments.__getitem__, segments))

    def _learn(self, segments: set[str]) -> None:
        if len(self.segments) > self.limit + len(self.seed):
            self.segments = dict(self.seed)
        rest = [s for s in segments if s not in self.segments]
        if rest:
            self.segments.update(zip(rest, self.merge(rest)))

    def values(self, texts: list[list[str]]) -> list[list]:
        """For each list of chunks the list of their values."""
        if len(self.chunks) > self.limit:
            self.chunks = {}
        got = [list(map(self.chunks.get, chunks)) for chunks in texts]
        open_ = [k for k, values in enumerate(got) if None in values]
        new = {c for k in open_ for c, v in zip(texts[k], got[k]) if v is None}
        if new:
            new = list(new)
            parts = [p if len(p) != 1 else p[0] for p in map(self.split, new)]
            self._learn({s for p in parts for s in ((p,) if isinstance(p, str) else p)})
            value = self.segments.__getitem__
            self.chunks.update(zip(new, [value(p) if isinstance(p, str) else self.join(map(value, p)) for p in parts]))
            for k in open_:
                got[k] = list(map(self.chunks.__getitem__, texts[k]))
        return got

    def texts(self, texts, chunks_of, at_once: int = 1 << 21):
        """Joined values of whole texts; ``chunks_of`` yields lists of chunks for each block of a text."""
        out, held, owner, chars = [], [], [], 0

        def settle():
            for k, values in zip(owner, self.values(held)):
                out[k].append(self.join(values))
            held.clear(), owner.clear()

        for k, text in enumerate(texts):
            out.append([])
            for chunks in chunks_of(text):
                held.append(chunks)
                owner.append(k)
            chars += len(text)
            if chars >= at_once or len(text) > BLOCK:
                settle()
                chars = 0
        settle()
        return [self.join(x) for x in out]


def alone_many(sp, segments: list[str]) -> list[list[int]]:
    return [x[2:] for x in sp.encode(["\n" + s.replace(MARK, " ") for s in segments], num_threads=1)]
