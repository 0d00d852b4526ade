"""Operator-facing feed rows, counters and run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DASH = "—"


def _or(col: Column, alt: str) -> Column:
    return F.coalesce(F.when(col.cast("string") != "", col.cast("string")), F.lit(alt))


def activity_kind() -> Column:
    """AUTH / BLOCKED, EXFIL (small egress), BLOB (large egress), NET, DNS, else the type in capitals."""
    egress, n = F.coalesce("egress", F.lit(False)), F.coalesce("bytes", F.lit(0))
    net = F.col("payload_type") == "net_conn"
    return (
        F.when((F.col("payload_type") == "auth") & F.coalesce(F.col("result").startswith("blocked_by_"), F.lit(False)), "BLOCKED")
        .when(F.col("payload_type") == "auth", "AUTH")
        .when(net & egress & (n > 0) & (n <= 50_000), "EXFIL")
        .when(net & egress & (n > 50_000), "BLOB")
        .when(net, "NET")
        .when(F.col("payload_type") == "dns", "DNS")
        .otherwise(F.upper("payload_type"))
    )


def activity_rows(events: DataFrame) -> DataFrame:
    """Level, kind and one-line detail of each event."""
    rows = events.withColumn("kind", activity_kind())
    level = (
        F.when(F.col("kind").isin("BLOCKED", "BLOB"), "ERROR")
        .when(F.col("kind").isin("EXFIL", "DNS") | ((F.col("kind") == "AUTH") & (F.col("result") == "success")), "WARNING")
        .otherwise("INFO")
    )
    port = F.when(F.col("dst_port") != 0, F.col("dst_port"))
    detail = (
        F.when(
            F.col("payload_type") == "auth",
            F.concat(F.lit("user="), _or(F.col("user"), "?"), F.lit(" result="), _or(F.col("result"), "?"), F.lit(" src="), _or(F.col("src"), "?")),
        )
        .when(
            F.col("payload_type") == "net_conn",
            F.concat(
                F.lit("dst="), _or(F.col("dst_ip"), "?"), F.lit(":"), _or(port, "?"), F.lit(" bytes="), F.coalesce("bytes", F.lit(0)).cast("string"),
                F.lit(" egress="), F.coalesce("egress", F.lit(False)).cast("string"),
            ),
        )
        .when(F.col("payload_type") == "dns", F.concat(F.lit("q="), _or(F.col("query"), "?"), F.lit(" type="), _or(F.col("qtype"), "A")))
        .otherwise(F.substring(F.col("payload"), 1, 160) if "payload" in events.columns else F.lit(""))
    )
    if "technique" in events.columns:
        detail = F.concat(detail, F.when(F.coalesce("technique", F.lit("")) != "", F.concat(F.lit(" · "), "technique")).otherwise(""))
    return rows.select(
        *[c for c in ("ingest_seq",) if c in events.columns], _or(F.col("event_id"), "").alias("id"), F.col("ts_utc").alias("ts"), level.alias("level"),
        "kind", _or(F.col("host_id"), DASH).alias("host"), _or(F.col("producer_id"), "lab").alias("producer"), detail.alias("line"), "payload_type",
    )


def audit_rows(log: DataFrame) -> DataFrame:
    """Feed rows of log entries (entry_hash, kind, campaign_id, hosts, n_stages)."""
    hosts = F.coalesce("hosts", F.array().cast("array<string>"))
    return log.select(
        F.substring("entry_hash", 1, 16).alias("id"),
        F.translate(F.upper("kind"), "_", " ").alias("kind"),
        F.when(F.size(hosts) > 0, F.array_join(F.slice(hosts, 1, 6), ", ")).otherwise(DASH).alias("host"),
        F.concat(
            _or(F.col("campaign_id"), DASH), F.lit(" · hosts="), F.size(hosts).cast("string"), F.lit(" stages="),
            _or(F.when(F.col("n_stages") != 0, F.col("n_stages")), "?"),
        ).alias("line"),
    )


def kpis(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Event and host counts, and counts by feed kind; one row per run."""
    rows = events.withColumn("kind", activity_kind())
    per_host = rows.groupBy(*by, "host_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("AUTH", "EXFIL", "BLOB", "NET", "DNS")]
    )
    return per_host.groupBy(*by).agg(
        F.sum("n").alias("events"), F.count("host_id").alias("hosts"), F.sum("AUTH").alias("auth"),
        (F.sum("EXFIL") + F.sum("BLOB")).alias("exfil"), F.sum("NET").alias("net"), F.sum("DNS").alias("dns"),
    )


def run_status(runs: DataFrame) -> DataFrame:
    """Add ``status``. Columns: loaded, recon_status, n_campaigns, n_events."""
    status = (
        F.when(~F.col("loaded"), "NO_RUN")
        .when(F.col("recon_status") == "insufficient_evidence", "REFUSE")
        .when(F.col("recon_status") == "partial", "PARTIAL")
        .when(F.col("n_campaigns") > 0, "CAMPAIGN")
        .otherwise("EMPTY")
    )
    return runs.withColumn("status", status)


def newest(rows: DataFrame, order: str = "ingest_seq", limit: int = 500) -> DataFrame:
    """Newest rows first: a distributed top-k, never a full sort."""
    return rows.orderBy(F.desc(order)).limit(limit)
