"""Registered queries and their SQL counterparts."""

from . import registry
from .registry import ORACLES, QUERIES

for _group in ("features_q", "pit_q", "coverage_q", "decode_q", "validate_q", "rules_q", "ledger_q", "ops_q", "stream_q"):
    registry.load(_group)

__all__ = ["QUERIES", "ORACLES"]
