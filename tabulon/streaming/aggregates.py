"""Worksheet aggregates over event-time windows of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.aggregates import AGGREGATES, criterion


def windowed(stream: DataFrame, ts: str, width: str, lateness: str, keys: Sequence[str], values: dict[str, tuple[str, str]], where: dict[str, str] | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates per window and key, as GROUPBY and SUMIFS would give for the window's rows.

    ``values`` maps a new name to (function, column), ``where`` columns to criteria such as
    ">=10". Rows later than ``lateness`` are dropped by the watermark, which also bounds the
    state. Works the same on a batch table. A timestamp without a zone is taken in the
    session's zone.
    """
    df = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if df.isStreaming:
        df = df.withWatermark(ts, lateness)
    for c, rule in (where or {}).items():
        df = df.filter(criterion(F.col(c), rule))
    made = [AGGREGATES[f.upper()](F.col(c)).value.alias(n) for n, (f, c) in values.items()]
    out = df.groupBy(F.window(ts, width, slide).alias("_window"), *keys).agg(*made)
    return out.select(F.col("_window.start").alias("window_start"), *keys, *values)
