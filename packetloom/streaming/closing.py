"""Closing a stream of files: a marker row carries the watermark past all that is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_marker(spark: SparkSession, folder: str, rows: DataFrame, ts: str, seconds: int, **values: Column) -> None:
    """Append a row to ``folder`` whose ``ts`` lies ``seconds`` after the last in ``rows``.

    Its other columns are null but for ``values``. Windows and sessions of all real rows are then
    emitted; the marker's own stay open and never are.
    """
    last = rows.agg(F.max(ts).alias(ts))
    beyond = (F.col(ts) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).cast(dict(rows.dtypes)[ts])
    columns = [beyond.alias(c) if c == ts else values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in rows.dtypes]
    last.where(F.col(ts).isNotNull()).select(*columns).write.mode("append").parquet(folder)
