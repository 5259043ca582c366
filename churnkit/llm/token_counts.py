"""Token counts with the whole-token shortcut.

Offline, :func:`churnkit.llm.pieces.prove` encodes every string of the vocabulary alone and
keeps those that come out as the single token they are.  A text is cut into independent
segments (pre-tokens); a segment among the proven strings counts one without any merging.
Only the rest is merged by the library, once per distinct segment and task memo.

Edge cases: null and empty texts have 0 bytes and 0 tokens; texts of spaces only count
their marks; rows keep their order-free identity (a repeated row is counted again);
very long texts are read in blocks cut at proven boundaries; an empty table gives an
empty result.  Other columns are not touched, so their names cannot clash.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .pieces import Memo, alone_many, chunks_of, processor, prove, segment_pattern

_MEMOS: dict[str, Memo] = {}


def counter(model_path: str, proof=None) -> Memo:
    """The task's memo of counts, seeded with one token for each proven string."""
    if model_path not in _MEMOS:
        sp, proof = processor(model_path), proof or prove(model_path)
        pattern = segment_pattern(proof)
        _MEMOS[model_path] = Memo(dict.fromkeys(proof.whole, 1), lambda c: pattern.findall(" " + c),
                                  lambda rest: map(len, alone_many(sp, rest)), sum)
    return _MEMOS[model_path]


def token_count(text: Column, model_path: str) -> Column:
    """Column of token counts of the SentencePiece model at ``model_path`` (null: 0)."""
    proof = prove(model_path)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(counter(model_path, proof).texts(s, chunks_of), dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; a map without shuffles."""
    t = text_of(docs, text_col)
    return (docs.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"),
                        token_count(t, model_path).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
