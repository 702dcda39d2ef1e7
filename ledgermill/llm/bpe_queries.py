"""Ids of ``documents`` under a public byte-level vocabulary."""

from __future__ import annotations

from .byte_bpe import digests, read_ranks
from .registry import query, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op13_byte_bpe")
def op13_byte_bpe(spark, folder, vocabulary: str = VOCABULARY):
    """How many ids every document has, their digest and that of the bytes they decode to."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(vocabulary))
    return digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
