"""Streaming forms: tailing, deduplication, verification, recompute and respond loops.

Steps that need memory keep it as tables (``streaming.state``) and give every row a status, so that none vanishes. Campaigns
depend on the whole history, so they are recomputed in ``foreachBatch`` from the stored events.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostweave.config import FuseConfig
from hostweave.operators.merge import fused_campaigns
from hostweave.operators.reconstruct import isolation_hosts, reconstruct
from hostweave.operators.trust import verify_events
from hostweave.schema import ENVELOPE
from hostweave.sources.sinks import read_campaigns, write_campaigns
from hostweave.sources.tailing import TailedLines
from hostweave.streaming.state import StepState, first_seen_step

RECORD_KEY = ("channel", "EventID", "Computer", "TimeCreated", "RecordId")
FLOW_KEY = ("channel", "EventID", "Computer", "TimeCreated", "dst_ip", "dst_port", "pid", "query", "user")


def tail_folders(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """One stream of raw lines (source, raw) from several folders of growing files; the checkpoint holds each file's offset.

    Lines added to a file are read once, a file that shrank is read again from its start, and the last line of a file
    counts once its line feed is there. Blank lines are left out.
    """
    spark.dataSource.register(TailedLines)
    lines = spark.readStream.format("tailed_lines").option("folders", json.dumps(sources)).load()
    return lines.select("source", F.trim("raw").alias("raw")).filter("raw != ''")


def envelope_stream(lines: DataFrame) -> DataFrame:
    return lines.withColumn("e", F.from_json("raw", ENVELOPE)).select("source", "raw", "e.*").withColumn("ts", F.try_to_timestamp("ts_utc"))


def dedup_step(out: str, state: StepState, key: Sequence[str], ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: records with their ``status``; those whose composite key came before, as far back as the state reaches, are
    ``repeat``, late ones ``late``."""
    return first_seen_step(out, state, key, ts)


def verify_step(out: str, state: StepState, enrollment: DataFrame) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: rows verified against the static enrollment, replays of (producer, nonce) found among those that verify.

    Every row goes to ``out``: ``fresh``, ``repeat`` (a replay), ``late``, or ``rejected`` with its ``reason`` (``bad_shape``: no producer or
    nonce).
    """

    def judge(batch: DataFrame) -> DataFrame:
        whole = F.col("producer_id").isNotNull() & F.col("nonce").isNotNull()
        return verify_events(batch, enrollment).withColumn("reason", F.coalesce("reason", F.when(~whole, "bad_shape")))

    return first_seen_step(out, state, ["producer_id", "nonce"], "ts", judge)


def channel_health(events: DataFrame, expected: DataFrame, degraded_reasons: Sequence[str] = ()) -> DataFrame:
    """ok / hits / reason per expected channel; channels without hits are degraded.

    ``events``: channel, and optionally ``reason`` reported by the collector.
    """
    hits = events.groupBy("channel").agg(
        F.count(F.lit(1)).alias("hits"), *([F.max("reason").alias("reason")] if "reason" in events.columns else [F.lit(None).cast("string").alias("reason")])
    )
    rows = expected.select("channel").distinct().join(hits, "channel", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    bad = F.col("reason").isin(*degraded_reasons) if degraded_reasons else F.lit(False)
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("hits") == 0, "zero_hits")))
    return rows.withColumn("degraded", (F.col("hits") == 0) | F.coalesce(bad, F.lit(False)))


def recompute_step(spark: SparkSession, events_path: str, campaigns_path: str, run_id: str, cfg: FuseConfig = FuseConfig()) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: store the batch, then rebuild the run's campaigns from its whole history.

    A batch overwrites its own folder and the run's campaigns are replaced as a whole, so a repeated
    batch changes nothing. Late and out-of-order events are always included.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
        history = spark.read.parquet(events_path).drop("batch")
        write_campaigns(fused_campaigns(history, cfg), campaigns_path, run_id)

    return step


def respond_step(spark: SparkSession, campaigns_path: str, proposals_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` step: propose (dry run) hosts of the current campaigns that were not proposed yet."""

    def step(_: DataFrame, batch_id: int) -> None:
        hosts = isolation_hosts(reconstruct(read_campaigns(spark, campaigns_path).drop("run_id")))
        seen = _try_read(spark, proposals_path, batch_id)
        fresh = hosts if seen is None else hosts.join(seen, "host_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{proposals_path}/batch={batch_id}")

    return step


def _try_read(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Hosts proposed by earlier batches; None before the first one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("host_id string, batch bigint").parquet(path).filter(F.col("batch") < before).select("host_id").distinct()
    except AnalysisException:
        return None


def start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
