"""Derived tables written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or set on the context).

    Only a local session without one gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-packetloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/packetloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    For small derived tables such as counts and cut points that several steps use. They are
    computed once, outlive their executors, and come back with their true size, so that Spark
    broadcasts them below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a shuffle
    join, whose hot keys adaptive execution splits.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner", null_keys: bool = True) -> DataFrame:
    """Join columns of a keyed ``table`` to the rows of ``df``.

    With ``null_keys`` a null key equals a null key, as in grouping; without, such rows have no
    partner. Columns keep the order of ``df``, then those of ``table``.
    """
    if not null_keys:
        return df.join(table, on, how).select(*df.columns, *[c for c in table.columns if c not in on])
    right = table.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in table.columns])
    condition: Column = F.lit(True)
    for key in on:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return df.join(right, condition, how).drop(*[f"__{key}" for key in on])
