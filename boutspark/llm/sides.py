"""Sides of joins that may be sent to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one number each up to which a table of names is sent to all tasks (some 16 MB there).
BROADCAST_ROWS = 1_000_000


def few(names: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast if it is counted to be small; else as it is, to be shuffled."""
    return F.broadcast(names) if names.limit(most + 1).count() <= most else names
