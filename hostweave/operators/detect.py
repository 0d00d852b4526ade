"""Weak-signal detectors: hash aggregations over whole event tables.

The generic forms (:func:`fanout`, :func:`shared_key`) work on any table with an actor/key and an
entity column. ``by`` prefixes every grouping, so many runs or packs are one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions.text import dns_apex

SIGNAL_COLUMNS = ("kind", "host_id", "weight", "user", "dst_ip", "apex", "host_count", "dst_count", "bytes")


def fanout(
    df: DataFrame,
    actor: str,
    target: str,
    min_distinct: int = 5,
    weight_div: float = 10.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Actors that touch at least ``min_distinct`` distinct targets.

    Distinct pairs are built first (spread over actor *and* target), so a hot actor is no hot task.
    """
    pairs = df.filter(F.col(target).isNotNull() & (F.col(target).cast("string") != "")).select(*by, actor, target).distinct()
    return (
        pairs.groupBy(*by, actor)
        .agg(F.count(F.lit(1)).alias("target_count"))
        .filter(F.col("target_count") >= min_distinct)
        .withColumn("weight", F.least(F.lit(1.0), F.col("target_count") / F.lit(float(weight_div))))
    )


def shared_key(
    df: DataFrame,
    key: str,
    entity: str,
    min_entities: int = 2,
    weight_div: float = 3.0,
    by: Sequence[str] = (),
    sums: Sequence[str] = (),
) -> DataFrame:
    """One row per (key, entity) for keys seen on at least ``min_entities`` entities.

    ``sums`` adds per-key totals of those columns. Rows shrink to one per (key, entity) before any
    per-key work.
    """
    pairs = (
        df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(*by, key, entity)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    )
    keys = (
        pairs.groupBy(*by, key)
        .agg(F.count(F.lit(1)).alias("entity_count"), *[F.sum(f"_s_{c}").alias(c) for c in sums])
        .filter(F.col("entity_count") >= min_entities)
    )
    return (
        pairs.select(*by, key, entity)
        .join(keys, [*by, key])
        .withColumn("weight", F.least(F.lit(1.0), F.col("entity_count") / F.lit(float(weight_div))))
    )


def is_small_egress(max_bytes: int = 50_000) -> Column:
    """Outbound connection of 1 to ``max_bytes`` bytes to a named destination."""
    return (
        (F.col("payload_type") == "net_conn")
        & F.coalesce(F.col("egress"), F.lit(False))
        & F.coalesce(F.col("bytes") > 0, F.lit(False))
        & (F.col("bytes") <= max_bytes)
        & (F.coalesce(F.col("dst_ip"), F.lit("")) != "")
    )


def _signal(df: DataFrame, kind: str, by: Sequence[str], **cols: Column) -> DataFrame:
    types = {"host_count": "bigint", "dst_count": "bigint", "bytes": "bigint"}
    out = [*by, F.lit(kind).alias("kind"), F.col("host_id"), F.col("weight")]
    for name in SIGNAL_COLUMNS[3:]:
        out.append(cols.get(name, F.lit(None)).cast(types.get(name, "string")).alias(name))
    return df.select(*out)


def recon_fanout(events: DataFrame, min_distinct: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Hosts with many distinct destinations over all their connections."""
    net = events.filter(F.col("payload_type") == "net_conn")
    hits = fanout(net, "host_id", "dst_ip", min_distinct, 10.0, by)
    return _signal(hits, "recon_fanout", by, dst_count=F.col("target_count"))


def lateral_auth(events: DataFrame, by: Sequence[str] = (), ignore_users: Sequence[str] = ()) -> DataFrame:
    """The same account on two or more hosts, whatever the result of the logon."""
    auth = events.filter(F.col("payload_type") == "auth")
    if ignore_users:
        auth = auth.filter(~F.col("user").isin(*ignore_users))
    hits = shared_key(auth, "user", "host_id", by=by)
    return _signal(hits, "lateral_auth", by, user=F.col("user"), host_count=F.col("entity_count"))


def micro_exfil(events: DataFrame, max_bytes: int = 50_000, by: Sequence[str] = ()) -> DataFrame:
    """Small outbound transfers from two or more hosts to one destination."""
    hits = shared_key(events.filter(is_small_egress(max_bytes)), "dst_ip", "host_id", by=by, sums=["bytes"])
    return _signal(
        hits, "micro_exfil", by, dst_ip=F.col("dst_ip"), host_count=F.col("entity_count"), bytes=F.col("bytes")
    )


def dns_beacon(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same parent zone queried from two or more hosts."""
    dns = events.filter(F.col("payload_type") == "dns").withColumn("apex", dns_apex("query"))
    hits = shared_key(dns, "apex", "host_id", by=by)
    return _signal(hits, "dns_beacon", by, apex=F.col("apex"), host_count=F.col("entity_count"))


def all_signals(
    events: DataFrame, recon_min_distinct: int = 5, max_small_bytes: int = 50_000, by: Sequence[str] = ()
) -> DataFrame:
    parts = [
        recon_fanout(events, recon_min_distinct, by),
        lateral_auth(events, by),
        micro_exfil(events, max_small_bytes, by),
        dns_beacon(events, by),
    ]
    return reduce(DataFrame.unionByName, parts)


def detector_key() -> Column:
    """What a detector-only alert is keyed by: account, destination, or else the host."""
    return (
        F.when(F.col("kind") == "lateral_auth", F.coalesce("user", F.lit("_")))
        .when(F.col("kind") == "micro_exfil", F.coalesce("dst_ip", F.lit("_")))
        .otherwise(F.col("host_id"))
    )


def detector_campaigns(signals: DataFrame, min_hosts: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """One alert row per detector key, with no merging across keys.

    Two keys whose ids collide after cleaning overwrite each other: the greater key stays.
    """
    rows = signals.withColumn("key", detector_key())
    groups = (
        rows.groupBy(*by, "kind", "key")
        .agg(
            F.sort_array(F.collect_set("host_id")).alias("host_ids"),
            F.count_distinct("host_id").alias("n_hosts"),
            F.least(F.lit(1.0), F.avg("weight")).alias("score"),
        )
        .filter((F.col("kind") == "recon_fanout") | (F.col("n_hosts") >= min_hosts))
    )
    cid = F.concat(F.lit("det-"), "kind", F.lit("-"), F.translate("key", ". ", "-_"))
    latest = (
        groups.withColumn("campaign_id", cid)
        .groupBy(*by, "campaign_id")
        .agg(F.max_by(F.struct("kind", "key", "host_ids", "n_hosts", "score"), "key").alias("r"))
        .select(*by, "campaign_id", "r.*")
    )
    return latest.withColumn("stages", F.array(F.struct(F.col("kind").alias("name"), F.col("host_ids").alias("hosts"))))


def _per_host(events: DataFrame, payload_type: str, bar: int, by: Sequence[str]) -> DataFrame:
    return (
        events.filter(F.col("payload_type") == payload_type)
        .groupBy(*by, "host_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .filter(F.col("n_events") >= bar)
    )


def _single_host(df: DataFrame, by: Sequence[str], prefix: str, stage: str, score: float) -> DataFrame:
    hosts = F.array("host_id")
    return df.select(
        *by,
        F.concat(F.lit(prefix), "host_id").alias("campaign_id"),
        hosts.alias("host_ids"),
        F.array(F.struct(F.lit(stage).alias("name"), hosts.alias("hosts"))).alias("stages"),
        F.lit(score).alias("score"),
        "n_events",
    )


def per_host_campaigns(events: DataFrame, min_conns: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Ablation: no cross-host fusion, one row per noisy host."""
    return _single_host(_per_host(events, "net_conn", min_conns, by), by, "host-", "local_noise", 0.3)


def baseline_per_host(events: DataFrame, by: Sequence[str] = (), min_net: int = 8, min_auth: int = 3) -> DataFrame:
    """Baseline B1: per-host thresholds only."""
    net = _single_host(_per_host(events, "net_conn", min_net, by), by, "b1-", "per_host_net_threshold", 0.5)
    auth = _single_host(_per_host(events, "auth", min_auth, by), by, "b1-auth-", "per_host_auth_threshold", 0.4)
    return net.unionByName(auth)


def baseline_joins(
    events: DataFrame, by: Sequence[str] = (), min_dsts: int = 5, max_small_bytes: int = 50_000
) -> DataFrame:
    """Baseline B2: same account or same small-egress destination on two or more hosts.

    Account rows get a leading fan-out stage naming those of their hosts that also fan out.
    """
    net = events.filter(F.col("payload_type") == "net_conn")
    noisy = fanout(net, "host_id", "dst_ip", min_dsts, by=by).select(*by, "host_id", F.lit(True).alias("noisy"))
    users = shared_key(events.filter(F.col("payload_type") == "auth"), "user", "host_id", by=by)
    stage_t = "array<struct<name:string,user:string,dst_ip:string,hosts:array<string>>>"
    by_user = (
        users.join(noisy, [*by, "host_id"], "left")
        .groupBy(*by, "user")
        .agg(
            F.sort_array(F.collect_set("host_id")).alias("host_ids"),
            F.sort_array(F.collect_set(F.when(F.col("noisy"), F.col("host_id")))).alias("recon_hosts"),
        )
    )
    none = F.lit(None).cast("string")
    lateral = F.struct(F.lit("lateral_auth").alias("name"), F.col("user"), none.alias("dst_ip"), F.col("host_ids").alias("hosts"))
    recon = F.struct(F.lit("recon_fanout").alias("name"), none.alias("user"), none.alias("dst_ip"), F.col("recon_hosts").alias("hosts"))
    by_user = by_user.select(
        *by,
        F.concat(F.lit("b2-user-"), "user").alias("campaign_id"),
        "host_ids",
        F.when(F.size("recon_hosts") > 0, F.array(recon, lateral)).otherwise(F.array(lateral)).cast(stage_t).alias("stages"),
        F.lit(0.7).alias("score"),
    )
    dsts = shared_key(events.filter(is_small_egress(max_small_bytes)), "dst_ip", "host_id", by=by)
    by_dst = dsts.groupBy(*by, "dst_ip").agg(F.sort_array(F.collect_set("host_id")).alias("host_ids"))
    exfil = F.struct(F.lit("micro_exfil").alias("name"), none.alias("user"), F.col("dst_ip"), F.col("host_ids").alias("hosts"))
    by_dst = by_dst.select(
        *by,
        F.concat(F.lit("b2-exfil-"), F.translate("dst_ip", ".", "-")).alias("campaign_id"),
        "host_ids",
        F.array(exfil).cast(stage_t).alias("stages"),
        F.lit(0.65).alias("score"),
    )
    return by_user.unionByName(by_dst)
