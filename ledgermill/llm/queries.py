"""The named queries of this subpackage; importing this module registers them."""

from . import (  # noqa: F401
    audit_queries,
    bpe_queries,
    decontam_queries,
    dedup_queries,
    html_queries,
    language_queries,
    lm_queries,
    mixing_queries,
    quality_queries,
    repair_queries,
    rule_queries,
    secret_queries,
    shard_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
