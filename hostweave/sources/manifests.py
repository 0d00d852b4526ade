"""Scenario manifests: read, reject incomplete ones, expand steps to events and truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hostweave.functions.timestamps import MICROS_Z
from hostweave.operators.normalize import apply_aliases
from hostweave.schema import MANIFEST
from hostweave.session import cut


def parse_manifests(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, rejected) from (source, text); rejected rows name the missing fields.

    The parsed rows are written once: a filter on parsed fields would parse the text again for every field it names, and so would every reader.
    """
    parsed = {"m": F.from_json("text", MANIFEST), "keys": F.from_json("text", "map<string,string>")}
    rows = docs.withColumns(parsed).select("source", "keys", "m.*")
    missing = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.map_contains_key("keys", n), F.lit(False)), n) for n in ("campaign_id", "hosts", "steps")])
    )
    rows = rows.withColumn("missing", F.when(F.col("keys").isNull(), F.array(F.lit("json"))).otherwise(missing))
    rows = cut(rows.withColumn("has_truth_hosts", F.map_contains_key("keys", "truth_hosts")).drop("keys"))
    ok = rows.filter(F.size("missing") == 0).drop("missing")
    return ok, rows.filter(F.size("missing") > 0).select("source", "missing")


def read_manifests(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return parse_manifests(docs)


def default_dsts() -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.concat(F.lit("10.20.30."), j.cast("string")))


def expand_steps(manifests: DataFrame) -> DataFrame:
    """One row per event of every manifest (``pack_id`` = campaign id), aliases not yet applied."""
    steps = manifests.select(
        F.col("campaign_id").alias("pack_id"), "hosts", "producers", "base_time_utc", "host_clock_skew_seconds", "drop_hosts",
        F.posexplode("steps").alias("step_no", "s"),
    )
    kind = F.lower(F.coalesce("s.kind", "s.type", F.lit("")))
    emit = F.coalesce(F.when(F.col("s.emit_host") != "", F.col("s.emit_host")), F.when(F.col("s.host_id_override") != "", F.col("s.host_id_override")), F.col("s.host"))
    steps = steps.withColumns({"kind": kind, "logical": F.col("s.host"), "host_id": emit})
    gone = F.coalesce(F.array_contains("drop_hosts", F.col("logical")) | F.array_contains("drop_hosts", F.col("host_id")), F.lit(False))
    is_recon = F.col("kind").isin("recon", "recon_fanout")
    dsts = F.when(F.size(F.coalesce("s.dst_ips", F.array().cast("array<string>"))) > 0, F.col("s.dst_ips")).otherwise(default_dsts())
    steps = steps.withColumn("dsts", F.when(is_recon, dsts).otherwise(F.array(F.lit(None).cast("string"))))
    steps = steps.withColumn("n_out", F.when(gone, 0).otherwise(F.size("dsts")))
    # Steps of one manifest are a short authored list; the running count is per manifest.
    before = F.coalesce(F.sum("n_out").over(W.partitionBy("pack_id").orderBy("step_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("before", before).filter("n_out > 0")
    offset = F.coalesce("s.offset_seconds", F.col("before") * 20.0)
    skew = F.coalesce(F.col("host_clock_skew_seconds")[F.col("logical")], F.lit(0.0)) + F.coalesce("s.clock_skew_seconds", F.lit(0.0))
    rows = steps.select("*", F.posexplode("dsts").alias("j", "scan_dst")).withColumn("seq", F.col("before") + F.col("j") + 1)
    step_gap = F.when(is_recon, F.col("j") * F.coalesce("s.dst_step", F.lit(5.0))).otherwise(F.lit(0.0))
    base = F.coalesce(F.try_to_timestamp("base_time_utc"), F.lit("2026-06-01T14:00:00Z").cast("timestamp"))
    ts = F.timestamp_micros(F.unix_micros(base) + F.round((offset + step_gap + skew) * 1_000_000).cast("bigint"))
    is_exfil = F.col("kind").isin("egress", "exfil", "micro_exfil")
    is_auth, is_dns = F.col("kind") == "auth", F.col("kind") == "dns"
    is_net = is_exfil | is_recon
    label = F.when(is_auth, "auth").when(is_exfil, "exfil").when(is_recon, "recon").when(is_dns, "dns")
    event_id = F.concat_ws("-", "pack_id", label, F.lpad(F.col("seq").cast("string"), 4, "0"))
    place = F.array_position("hosts", F.col("logical"))
    letter = F.when(place <= 26, F.concat(F.lit("prod-"), F.chr(F.lit(96) + place))).otherwise(F.concat(F.lit("prod-"), (place - 1).cast("string")))
    producer = F.coalesce(F.col("producers")[F.col("host_id")], F.col("producers")[F.col("logical")], F.when(place > 0, letter))
    nz = lambda c, d: F.coalesce(F.when(c != 0, c), d)
    txt = lambda c, d: F.coalesce(F.when(c != "", c), d)
    return rows.select(
        "pack_id", "step_no", F.col("seq").cast("bigint").alias("ingest_seq"), event_id.alias("event_id"), event_id.alias("nonce"),
        producer.alias("producer_id"), "logical", "host_id", ts.alias("ts"), F.date_format(ts, MICROS_Z).alias("ts_utc"),
        F.when(is_auth, "auth").when(is_net, "net_conn").when(is_dns, "dns").alias("payload_type"),
        F.when(is_auth, txt(F.col("s.user"), F.lit("attacker"))).alias("user"),
        F.when(is_auth, F.lit("success")).alias("result"),
        F.when(is_auth, txt(F.col("s.src"), F.lit("10.1.0.5"))).alias("src"),
        F.when(is_recon, F.col("scan_dst")).when(is_exfil, txt(F.col("s.dst_ip"), F.lit("203.0.113.50"))).alias("dst_ip"),
        F.when(is_net, nz(F.col("s.dst_port"), F.when(is_recon, 445).otherwise(443))).cast("int").alias("dst_port"),
        F.when(is_net, nz(F.col("s.bytes"), F.when(is_recon, 60).otherwise(12_000))).cast("bigint").alias("bytes"),
        F.when(is_net, is_exfil).alias("egress"),
        F.when(is_dns, txt(F.col("s.query"), F.concat(F.lit("c2-"), F.col("seq").cast("string"), F.lit(".example.com")))).alias("query"),
        F.when(is_dns, txt(F.col("s.qtype"), F.lit("A"))).alias("qtype"),
        F.col("s.technique").alias("technique"),
        F.when(is_auth, "lateral_auth").when(is_exfil, "micro_exfil").when(is_recon, "recon_fanout").alias("stage"),
    )


def manifest_events(manifests: DataFrame) -> DataFrame:
    """Events of every manifest, with aliases brought to their persistent names."""
    aliases = manifests.select(F.col("campaign_id").alias("pack_id"), F.explode("host_aliases").alias("alias", "asset"))
    return apply_aliases(expand_steps(manifests), aliases, ["pack_id"])


def manifest_truth(manifests: DataFrame) -> DataFrame:
    """Ground truth per manifest; stage hosts are the names that were emitted, before aliasing.

    Absent ``truth_hosts`` means all hosts, an explicit empty list stays empty.
    """
    stages = (
        expand_steps(manifests).filter("stage is not null").groupBy("pack_id", "stage")
        .agg(F.sort_array(F.collect_set("host_id")).alias("hosts"), F.min("step_no").alias("first_step"))
        .groupBy("pack_id")
        .agg(F.sort_array(F.collect_list(F.struct("first_step", F.col("stage").alias("name"), "hosts"))).alias("st"))
        .select("pack_id", F.transform("st", lambda s: F.struct(s["name"].alias("name"), s["hosts"].alias("hosts"))).alias("stages"))
    )
    none = F.array().cast("array<string>")
    base = manifests.select(
        F.col("campaign_id").alias("pack_id"), "campaign_id",
        F.when(F.col("has_truth_hosts"), F.coalesce("truth_hosts", none)).otherwise(F.col("hosts")).alias("host_ids"),
        F.coalesce("family", F.lit("attack_repo")).alias("family"), F.coalesce("ood", F.lit(False)).alias("ood"),
    )
    empty = F.array().cast("array<struct<name:string,hosts:array<string>>>")
    return base.join(stages, "pack_id", "left").withColumn("stages", F.coalesce("stages", empty))
