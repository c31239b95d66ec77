"""Operators over unbounded input.

The operators are pipelined over pipes of rows; here a pipe can be a
streaming DataFrame. Selection and projection run unchanged; sums need an
output mode that rewrites them (complete or update).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import core


def filtered(stream: DataFrame, cnf: str, columns: list[str | int] | None = None) -> DataFrame:
    """Rows of a stream that satisfy a predicate."""
    rows = core.select_pipe(stream, cnf)
    return core.project(rows, columns) if columns else rows


def running_sums(stream: DataFrame, keys: list[str], function: str) -> DataFrame:
    return core.group_by_sum(stream, keys, function)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes all there is now into the in-memory table ``name`` and stops."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
