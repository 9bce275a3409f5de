"""All queries and their SQL."""

from checks import q_config, q_detect, q_files, q_price, q_series, q_stats, q_summary  # noqa: F401
from checks.oracle import statements
from checks.queries import QUERIES

ORACLES = statements()

__all__ = ["ORACLES", "QUERIES"]
