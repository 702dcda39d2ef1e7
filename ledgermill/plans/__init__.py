"""The named queries; importing this package registers them."""

from . import (  # noqa: F401
    answer_queries,
    document_queries,
    evaluation_queries,
    finance_queries,
    retrieval_queries,
    stream_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
