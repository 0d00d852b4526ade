"""State of micro-batch steps, kept as tables.

A step reads the state its predecessor wrote and writes its own. State holds what lies at most ``delay`` behind the newest event time
seen, so a batch reads what the delay covers and never the history. The newest time before a batch, less the delay, is its
watermark; rows below it come out as ``late`` instead of vanishing. Two versions alternate: a batch that is run again still
finds what it read the first time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from hostweave.operators.sessions import range_islands
from hostweave.session import cut

FRESH, REPEAT, LATE, REJECTED, DROPPED = "fresh", "repeat", "late", "rejected", "dropped"


@dataclass(frozen=True)
class StepState:
    """Where a step keeps its state, and how far behind the newest time it reaches."""

    path: str
    delay_us: int

    def _slot(self, name: str, batch_id: int) -> str:
        return f"{self.path.rstrip('/')}/{name}/{batch_id % 2}"

    def read(self, batch: DataFrame, name: str, batch_id: int, schema: StructType) -> DataFrame:
        """What the batch before wrote; nothing before the first one."""
        if batch_id == 0:
            return batch.sparkSession.createDataFrame([], schema)
        return batch.sparkSession.read.schema(schema).parquet(self._slot(name, batch_id - 1))

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._slot(name, batch_id))

    def watermark(self, batch: DataFrame, batch_id: int) -> int | None:
        """Newest time before this batch less the delay, in microseconds."""
        newest = self.read(batch, "newest", batch_id, StructType().add("us", "long")).agg(F.max("us")).first()[0]
        return None if newest is None else newest - self.delay_us

    def advance(self, batch: DataFrame, us: Column, before: int | None, batch_id: int) -> int | None:
        """Write the newest time after this batch; returns its watermark."""
        newest = batch.agg(F.max(us)).first()[0]
        if before is not None:
            newest = max(before + self.delay_us, before + self.delay_us if newest is None else newest)
        self.write(batch.sparkSession.createDataFrame([(newest,)], "us long"), "newest", batch_id)
        return None if newest is None else newest - self.delay_us


def _below(us: Column, mark: int | None) -> Column:
    return F.lit(False) if mark is None else F.coalesce(us < mark, F.lit(False))


def _schema(df: DataFrame, names: Sequence[str], **more: str | DataType) -> StructType:
    out = StructType([StructField(f.name, f.dataType) for f in df.select(*names).schema])
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def _same(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on &= a[k].eqNullSafe(b[k])
    return on


def first_seen_step(
    out: str, state: StepState, key: Sequence[str], ts: str = "ts", judge: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: every row goes to ``out`` with a ``status``, in a folder per batch (safe to repeat).

    Of the rows that share a key the earliest of its first batch is ``fresh``, the others are ``repeat``. Rows below the watermark
    are ``late``. ``judge`` may add ``reason``; rows with one are ``rejected`` and do not count as seen. Rows without a time are
    never late, and their keys are remembered as of the newest time.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = judge(batch) if judge is not None else batch.withColumn("reason", F.lit(None).cast("string"))
        rows = cut(rows.withColumn("_us", F.unix_micros(ts)).withColumn("_row", F.monotonically_increasing_id()))
        mark = state.watermark(batch, batch_id)
        good = F.col("reason").isNull() & ~_below(F.col("_us"), mark)
        heads = rows.filter(good).groupBy(*key).agg(F.min(F.struct("_us", "_row")).alias("h"))
        seen = state.read(batch, "seen", batch_id, _schema(rows, key, _us="long"))
        known = cut(heads.join(seen, _same(heads, seen, key), "left_anti").select(*key, "h._us", "h._row"))
        fresh = rows.join(known.select("_row", F.lit(True).alias("_fresh")), "_row", "left")
        status = F.when(F.col("reason").isNotNull(), REJECTED).when(_below(F.col("_us"), mark), LATE).when(F.col("_fresh"), FRESH).otherwise(REPEAT)
        fresh.withColumn("status", status).select(*batch.columns, "reason", "status").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        after = state.advance(rows.filter("reason IS NULL"), F.col("_us"), mark, batch_id)
        kept = seen.unionByName(known.select(*key, F.coalesce("_us", F.lit((after or 0) + state.delay_us)).alias("_us")))
        state.write(kept.filter(~_below(F.col("_us"), after)), "seen", batch_id)

    return step


def capped_step(out: str, state: StepState, max_per_sec: int, key: Sequence[str] = (), ts: str = "ts", order: Sequence[str] = ("event_id",)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: of each key and second the first ``max_per_sec`` rows are ``fresh``, the others ``dropped``.

    The cap holds over all batches: what came in earlier ones counts first. Rows of seconds below the watermark are ``late``. Every row goes
    to ``out`` with its ``status``. Without a cap (0) all rows are fresh.
    """
    from pyspark.sql import Window as W

    def step(batch: DataFrame, batch_id: int) -> None:
        if max_per_sec <= 0:
            batch.withColumn("status", F.lit(FRESH)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            return
        rows = batch.withColumn("_us", F.unix_micros(F.date_trunc("second", ts))).withColumn("_row", F.monotonically_increasing_id())
        rows = cut(rows)
        mark = state.watermark(batch, batch_id)
        names = [*key, "_us"]
        used = state.read(batch, "seconds", batch_id, _schema(rows, names, _kept="long"))
        # the rank filter is bounded: at most the cap leaves a partition of the window before its shuffle
        rank = F.row_number().over(W.partitionBy(*names).orderBy(ts, *order, "_row"))
        first = rows.filter(~_below(F.col("_us"), mark)).withColumn("_rn", rank).filter(F.col("_rn") <= max_per_sec)
        kept = first.join(used, _same(first, used, names), "left").filter(F.col("_rn") + F.coalesce("_kept", F.lit(0)) <= max_per_sec)
        kept = cut(kept.select(*[first[c] for c in names], "_row"))
        flagged = rows.join(kept.select("_row", F.lit(True).alias("_fresh")), "_row", "left")
        status = F.when(_below(F.col("_us"), mark), LATE).when(F.col("_fresh"), FRESH).otherwise(DROPPED)
        flagged.withColumn("status", status).select(*batch.columns, "status").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        after = state.advance(rows, F.col("_us"), mark, batch_id)
        total = used.unionByName(kept.groupBy(*names).agg(F.count(F.lit(1)).alias("_kept"))).groupBy(*names).agg(F.sum("_kept").alias("_kept"))
        state.write(total.filter(~_below(F.col("_us"), after)), "seconds", batch_id)

    return step


def session_step(out: str, late: str, state: StepState, key: Sequence[str], entity: str, gap_us: int, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: gap sessions per key, each written to ``out`` once the watermark has passed its end by more than the gap.

    Open sessions are state; new points join them as ranges do. Points below the watermark, and points without a time or without
    all of the key, go to ``late``.
    """
    key = list(key)

    def step(batch: DataFrame, batch_id: int) -> None:
        mark = state.watermark(batch, batch_id)
        rows = batch.withColumn("_us", F.unix_micros(ts))
        lost = _below(F.col("_us"), mark)
        for name in ("_us", *key):
            lost |= F.col(name).isNull()
        rows.filter(lost).select(*batch.columns).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        points = rows.filter(~lost).groupBy(*key, F.col("_us").alias("t0")).agg(F.count(F.lit(1)).alias("n_points"), F.collect_set(entity).alias("entities"))
        points = points.withColumn("t1", F.col("t0"))
        opened = state.read(batch, "open", batch_id, _schema(batch, key, t0="long", t1="long", n_points="long", entities=ArrayType(batch.schema[entity].dataType)))
        ranges = opened.unionByName(points.select(opened.columns))
        joined = range_islands(ranges, key, "t0", "t1", gap_us).groupBy(*key, "session_no").agg(
            F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n_points").alias("n_points"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"),
        )
        joined = cut(joined.select(opened.columns))
        after = state.advance(rows, F.col("_us"), mark, batch_id)
        over = _below(F.col("t1") + gap_us, after)
        joined.filter(over).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.write(joined.filter(~over), "open", batch_id)

    return step
