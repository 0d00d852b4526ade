"""Query catalogue: each entry is a Spark query over the given tables and, where SQL can state it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def joined(col: str) -> F.Column:
    """Sorted array as text."""
    return F.array_join(F.sort_array(col), ",").alias(col)


def r6(col: str) -> F.Column:
    return F.round(F.col(col).cast("double"), 6).alias(col)


def telemetry_sql(n_hosts: int = 12) -> str:
    return f"""t AS (
  SELECT event_id AS ingest_seq, CAST(event_id AS VARCHAR) AS event_id, host_id, 'prod-' || substr(host_id, 6) AS producer_id,
    'n-' || event_id AS nonce, ts, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_utc, payload_type, event_type, user_id, value, k,
    CASE WHEN payload_type = 'auth' THEN 'u' || (k % 40) END AS usr,
    CASE WHEN payload_type = 'auth' THEN CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END END AS result,
    CASE WHEN payload_type = 'auth' THEN CASE WHEN k % 3 = 0 THEN 'host-' || lpad(CAST(k % {n_hosts} AS VARCHAR), 2, '0') ELSE '10.1.0.5' END END AS src,
    CASE WHEN payload_type = 'net_conn' THEN '203.0.113.' || k END AS dst_ip,
    CASE WHEN payload_type = 'net_conn' THEN 443 END AS dst_port,
    CASE WHEN payload_type = 'net_conn' THEN CAST(floor(value * 200) AS BIGINT) END AS bytes,
    CASE WHEN payload_type = 'net_conn' THEN event_type = 'purchase' END AS egress,
    CASE WHEN payload_type = 'dns' THEN 'n' || user_id || '.z' || (k % 50) || '.example.test' END AS query,
    CASE WHEN payload_type = 'dns' THEN 'z' || (k % 50) || '.example.test' END AS apex
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
          'host-' || lpad(CAST(user_id % {n_hosts} AS VARCHAR), 2, '0') AS host_id,
          CASE WHEN event_type IN ('signup', 'error') THEN 'auth' WHEN event_type = 'view' THEN 'dns' ELSE 'net_conn' END AS payload_type
        FROM events))"""


TEL = telemetry_sql()
