"""Fitted steps on streams.

The operators split into a fit (an aggregate over a batch) and a projection. The projection needs no
state, so it runs on a streaming table unchanged; there are no streaming operators of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def transform_stream(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply fitted projections to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    for step in steps:
        stream = step(stream)
    return stream
