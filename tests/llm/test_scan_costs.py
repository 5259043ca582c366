"""Segments that are whole chunks are not joined, and ids stay the library's."""

import numpy as np
import public_tokenizers

from churnkit.llm import sentencepiece_scan
from churnkit.llm.pieces import Memo, processor
from churnkit.llm.queries import PIECES


def test_a_chunk_of_one_segment_is_not_joined():
    joined = []
    memo = Memo({}, lambda c: c.split("-"), lambda rest: [s.upper() for s in rest], lambda v: joined.append(1) or "".join(v))
    assert memo.values([["ab", "c-d"], ["ab", "e"]]) == [["AB", "CD"], ["AB", "E"]]
    assert len(joined) == 1


def test_scan_ids_as_the_library_gives_them():
    path = public_tokenizers.path(PIECES)
    texts = ["", "one", "one, two-three 4.5", "日本 x퟿ ▁▁ y", "  lead and  gaps ", "a\nb\tc"]
    got = sentencepiece_scan._memo(path).texts(texts, sentencepiece_scan.chunks_of)
    assert [np.frombuffer(x, dtype="<i4").tolist() for x in got] == [processor(path).encode(t) for t in texts]
