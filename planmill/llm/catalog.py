"""All registered text queries."""

from planmill.llm import queries  # noqa: F401
from planmill.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
