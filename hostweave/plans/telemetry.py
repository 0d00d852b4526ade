"""A telemetry view over a plain ``events`` table, so that every operator can run on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry(events: DataFrame, n_hosts: int = 12) -> DataFrame:
    """Flat host telemetry derived row by row from ``events`` (narrow: no shuffle)."""
    k = F.get_json_object("props", "$.k").cast("int")
    host = F.concat(F.lit("host-"), F.lpad((F.col("user_id") % n_hosts).cast("string"), 2, "0"))
    kind = (
        F.when(F.col("event_type").isin("signup", "error"), "auth")
        .when(F.col("event_type") == "view", "dns")
        .otherwise("net_conn")
    )
    ts = F.col("ts").cast("timestamp")
    base = events.select(
        F.col("event_id").alias("ingest_seq"),
        F.col("event_id").cast("string").alias("event_id"),
        host.alias("host_id"),
        ts.alias("ts"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_utc"),
        kind.alias("payload_type"),
        "event_type",
        "user_id",
        "value",
        k.alias("k"),
    )
    auth, dns, net = (F.col("payload_type") == p for p in ("auth", "dns", "net_conn"))
    src = F.when(
        F.col("k") % 3 == 0,
        F.concat(F.lit("host-"), F.lpad((F.col("k") % n_hosts).cast("string"), 2, "0")),
    ).otherwise("10.1.0.5")
    return base.select(
        "ingest_seq",
        "event_id",
        F.concat(F.lit("prod-"), F.substring("host_id", 6, 10)).alias("producer_id"),
        "host_id",
        "ts",
        "ts_utc",
        F.concat(F.lit("n-"), F.col("event_id")).alias("nonce"),
        "payload_type",
        F.when(auth, F.concat(F.lit("u"), F.col("k") % 40)).alias("user"),
        F.when(auth, F.when(F.col("event_type") == "error", "failure").otherwise("success")).alias("result"),
        F.when(auth, src).alias("src"),
        F.when(net, F.concat(F.lit("203.0.113."), F.col("k"))).alias("dst_ip"),
        F.when(net, F.lit(443)).alias("dst_port"),
        F.when(net, F.floor(F.col("value") * 200)).alias("bytes"),
        F.when(net, F.col("event_type") == "purchase").alias("egress"),
        F.when(
            dns,
            F.concat(F.lit("n"), F.col("user_id"), F.lit(".z"), F.col("k") % 50, F.lit(".example.test")),
        ).alias("query"),
        F.when(dns, F.lit("A")).alias("qtype"),
        "event_type",
        "user_id",
        "value",
        "k",
    )


def load_telemetry(spark: SparkSession, sf_dir: str, n_hosts: int = 12) -> DataFrame:
    return telemetry(read_events(spark, sf_dir), n_hosts)
