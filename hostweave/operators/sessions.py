"""Gap sessions and range islands by pre-aggregated time slices.

A slice is exactly one gap wide, so all ranges that start in one slice of a key belong together. One
hash aggregation brings every (key, slice) down to a single row; only those rows meet in a per-key
window. A key that holds a third of all rows therefore costs at most one row per gap of elapsed time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


def slice_of(us: Column, gap_us: int) -> Column:
    """Start of the slice that holds ``us``, in whole microseconds (no rounding)."""
    if gap_us <= 0:
        raise ValueError("gap must be positive")
    return us - F.pmod(us, F.lit(gap_us))


def slice_islands(slices: DataFrame, key: Sequence[str], gap_us: int) -> DataFrame:
    """Number the islands of each key over its slice rows (``slice``, ``t0``, ``t1``)."""
    order = W.partitionBy(*key).orderBy("slice")
    reach = F.max("t1").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("t0") - reach > gap_us), 1).otherwise(0)
    return (
        slices.withColumn("_fresh", fresh)
        .withColumn("session_no", F.sum("_fresh").over(order))
        .select(*key, "slice", "session_no")
    )


def range_islands(df: DataFrame, key: Sequence[str], t0: str, t1: str, gap_us: int) -> DataFrame:
    """Add ``session_no``: ranges of a key chained by gaps of at most ``gap_us`` share a number."""
    sliced = df.withColumn("slice", slice_of(F.col(t0), gap_us))
    slices = sliced.groupBy(*key, "slice").agg(F.min(t0).alias("t0"), F.max(t1).alias("t1"))
    numbered = slice_islands(slices, key, gap_us)
    return sliced.join(numbered, [*key, "slice"]).drop("slice")


def members_of_slots(slots: DataFrame, key: Sequence[str], entity: str, gap_us: int) -> DataFrame:
    """Join the slots (key, slice, entity, t0, t1) of a key into sessions, one row per entity."""
    slices = slots.groupBy(*key, "slice").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    numbered = slice_islands(slices, key, gap_us)
    return (
        slots.join(numbered, [*key, "slice"])
        .groupBy(*key, "session_no", entity)
        .agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    )


def gap_session_members(
    df: DataFrame, key: Sequence[str], entity: str, ts: str, gap_seconds: float
) -> DataFrame:
    """One row per (key, session, entity) with its first and last time in microseconds.

    A point at most ``gap_seconds`` after the one before it stays in the session.
    """
    gap_us = int(gap_seconds * 1_000_000)
    slots = (
        df.filter(F.col(ts).isNotNull())
        .select(*key, F.col(entity), micros(ts).alias("_us"))
        .withColumn("slice", slice_of(F.col("_us"), gap_us))
        .groupBy(*key, "slice", entity)
        .agg(F.min("_us").alias("t0"), F.max("_us").alias("t1"))
    )
    return members_of_slots(slots, key, entity, gap_us)


def gap_sessions(df: DataFrame, key: Sequence[str], entity: str, ts: str, gap_seconds: float) -> DataFrame:
    """One row per (key, session): distinct entities and time range, nothing collected."""
    members = gap_session_members(df, key, entity, ts, gap_seconds)
    return members.groupBy(*key, "session_no").agg(
        F.count(F.lit(1)).alias("n_entities"), F.min("t0").alias("t0"), F.max("t1").alias("t1")
    )
