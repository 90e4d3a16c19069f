"""Decisions that depend on the size of a scan (from file sizes) or of a counted dimension (which is run once)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.session import stored

# Stored size up to which a dimension is broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024
# Rows of a counted dimension up to which it is broadcast.
BROADCAST_ROWS = 100_000


def scan_bytes(scan: DataFrame) -> int:
    """Size of the files behind a plain scan, as the optimizer knows it; unknown counts as large."""
    if not hasattr(scan, "_jdf"):
        return 2**62
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, scan: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast when the scan it comes from (row by row) is small.

    A larger one is joined by a shuffle, in which adaptive execution splits hot keys.
    """
    return F.broadcast(df) if scan_bytes(scan) <= BROADCAST_BYTES else df


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """Run a narrow dimension once and mark it for broadcast when it counts ``BROADCAST_ROWS`` rows at most.

    The optimizer estimates an aggregate from the scan below it, which can be large where the
    result is not. A larger dimension is joined by a shuffle.
    """
    kept, rows = stored(df)
    return F.broadcast(kept) if rows <= BROADCAST_ROWS else kept
