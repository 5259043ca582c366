"""Training-data operators: token counts, SentencePiece scan, PII surrogates, packing,
exact / near / line dedup, quality ranking and rules, language ID.

Nothing else in the library imports this subpackage.
"""
