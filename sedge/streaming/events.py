"""The row-local operators and windowed metrics on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.splits import split_name


def split_stream(events: DataFrame, key: str, train: float = 0.8, validation: float = 0.1, seed: int = 17) -> DataFrame:
    """Adds the split of each row's key: without state, the same in batches and streams."""
    return events.withColumn("split", split_name(F.col(key).cast("string"), train, validation, seed))


def windowed_error(events: DataFrame, time: str = "ts", truth: str = "truth", pred: str = "pred", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, n, mae) of each tumbling window, rows later than the watermark left out by the stream."""
    e = F.col(pred) - F.col(truth)
    out = events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"))
    return out.select(F.col("window.start").alias("start"), "n", "mae")
