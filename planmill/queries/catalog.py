"""All registered queries."""

from planmill.queries import augmentation, extraction, long_plans, parsing, records, scoring, token_sequences  # noqa: F401
from planmill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
