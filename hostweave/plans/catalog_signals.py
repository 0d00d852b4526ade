"""Detectors, baselines, feed, sessions, clusters, merge rules and campaigns over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hostweave.config import FuseConfig
from hostweave.functions.sets import quiet_gap, ranges_near
from hostweave.functions.text import dns_apex
from hostweave.operators import detect, feed, fuse, merge
from hostweave.operators.sessions import gap_sessions
from hostweave.plans.catalog_base import TEL, joined, query, r6
from hostweave.plans.correlate import campaigns
from hostweave.plans.telemetry import load_telemetry, read_events
from hostweave.session import cut

CFG = FuseConfig(window_seconds=3600, resume_window_seconds=7200, recon_min_distinct=98)
WUS = CFG.window_us
SMALL = "payload_type = 'net_conn' AND egress AND bytes > 0 AND bytes <= 50000"


# --- detectors -----------------------------------------------------------------------------------

D01 = "SELECT host_id, count(DISTINCT dst_ip) AS n FROM t WHERE payload_type = 'net_conn' GROUP BY 1 HAVING count(DISTINCT dst_ip) >= 5"


@query("d01_recon_fanout", f"WITH {TEL} SELECT host_id, n AS dst_count, round(least(1.0, n / 10.0), 6) AS weight FROM ({D01})")
def _(spark, d):
    return detect.recon_fanout(load_telemetry(spark, d)).select("host_id", "dst_count", r6("weight"))


@query(
    "d01_fanout_suppliers",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS target_count, round(least(1.0, count(DISTINCT l_partkey) / 100.0), 6) AS weight "
    "FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 50",
)
def _(spark, d):
    rows = detect.fanout(spark.read.parquet(f"{d}/lineitem.parquet"), "l_suppkey", "l_partkey", 50, 100.0)
    return rows.select("l_suppkey", "target_count", r6("weight"))


def shared_sql(key: str, where: str, extra: str = "", out: str = "") -> str:
    return (
        f"WITH {TEL}, p AS (SELECT {key} AS key, host_id{extra} FROM t WHERE {where}), "
        f"c AS (SELECT key, count(DISTINCT host_id) AS n{', sum(bytes) AS b' if extra else ''} FROM p GROUP BY 1 HAVING count(DISTINCT host_id) >= 2) "
        f"SELECT DISTINCT p.host_id, p.key, c.n AS host_count, round(least(1.0, c.n / 3.0), 6) AS weight{out} FROM p JOIN c USING (key)"
    )


@query("d02_lateral_auth", shared_sql("usr", "payload_type = 'auth'"))
def _(spark, d):
    return detect.lateral_auth(load_telemetry(spark, d)).select("host_id", F.col("user").alias("key"), "host_count", r6("weight"))


@query("d03_micro_exfil", shared_sql("dst_ip", SMALL, ", bytes", ", CAST(c.b AS BIGINT) AS bytes"))
def _(spark, d):
    return detect.micro_exfil(load_telemetry(spark, d)).select("host_id", F.col("dst_ip").alias("key"), "host_count", r6("weight"), "bytes")


@query("d04_dns_beacon", shared_sql("apex", "payload_type = 'dns'"))
def _(spark, d):
    return detect.dns_beacon(load_telemetry(spark, d)).select("host_id", F.col("apex").alias("key"), "host_count", r6("weight"))


@query(
    "d02_shared_key_parts",
    "WITH p AS (SELECT DISTINCT l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "c AS (SELECT l_partkey, count(*) AS entity_count FROM p GROUP BY 1 HAVING count(*) >= 20) "
    "SELECT p.l_partkey, p.o_custkey, c.entity_count FROM p JOIN c USING (l_partkey)",
)
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return detect.shared_key(li.join(o, "l_orderkey"), "l_partkey", "o_custkey", 20).select("l_partkey", "o_custkey", "entity_count")


SIGNALS_SQL = f"""sig AS (
  SELECT 'recon_fanout' AS kind, host_id, least(1.0, n / 10.0) AS weight, host_id AS key FROM ({D01})
  UNION ALL SELECT 'lateral_auth', p.host_id, least(1.0, n / 3.0), p.key FROM (SELECT DISTINCT usr AS key, host_id FROM t WHERE payload_type = 'auth') p
    JOIN (SELECT usr AS key, count(DISTINCT host_id) AS n FROM t WHERE payload_type = 'auth' GROUP BY 1) c USING (key) WHERE n >= 2
  UNION ALL SELECT 'micro_exfil', p.host_id, least(1.0, n / 3.0), p.key FROM (SELECT DISTINCT dst_ip AS key, host_id FROM t WHERE {SMALL}) p
    JOIN (SELECT dst_ip AS key, count(DISTINCT host_id) AS n FROM t WHERE {SMALL} GROUP BY 1) c USING (key) WHERE n >= 2
  UNION ALL SELECT 'dns_beacon', p.host_id, least(1.0, n / 3.0), p.key FROM (SELECT DISTINCT apex AS key, host_id FROM t WHERE payload_type = 'dns') p
    JOIN (SELECT apex AS key, count(DISTINCT host_id) AS n FROM t WHERE payload_type = 'dns' GROUP BY 1) c USING (key) WHERE n >= 2)"""


@query("d05_all_signals", f"WITH {TEL}, {SIGNALS_SQL} SELECT kind, host_id, key, round(weight, 6) AS weight FROM sig")
def _(spark, d):
    rows = detect.all_signals(load_telemetry(spark, d))
    return rows.select("kind", "host_id", F.coalesce("user", "dst_ip", "apex", "host_id").alias("key"), r6("weight"))


DET_SQL = """det AS (
  SELECT 'det-' || kind || '-' || replace(replace(key, '.', '-'), ' ', '_') AS campaign_id, kind, key, list_sort(list(DISTINCT host_id)) AS hosts, least(1.0, avg(weight)) AS score
  FROM (SELECT kind, CASE WHEN kind IN ('lateral_auth', 'micro_exfil') THEN key ELSE host_id END AS key, host_id, weight FROM sig)
  GROUP BY kind, key HAVING kind = 'recon_fanout' OR count(DISTINCT host_id) >= 2)"""


@query("d06_detector_campaigns", f"WITH {TEL}, {SIGNALS_SQL}, {DET_SQL} SELECT campaign_id, kind, array_to_string(hosts, ',') AS host_ids, round(score, 6) AS score FROM det")
def _(spark, d):
    rows = detect.detector_campaigns(detect.all_signals(load_telemetry(spark, d)))
    return rows.select("campaign_id", "kind", joined("host_ids"), r6("score"))


def per_host_sql(kind: str, bar: int, prefix: str, score: float) -> str:
    return f"SELECT '{prefix}' || host_id AS campaign_id, host_id AS host_ids, count(*) AS n_events, {score} AS score FROM t WHERE payload_type = '{kind}' GROUP BY host_id HAVING count(*) >= {bar}"


@query("d07_per_host_ablation", f"WITH {TEL} " + per_host_sql("net_conn", 5, "host-", 0.3).replace("0.3 AS", "CAST(0.3 AS DOUBLE) AS"))
def _(spark, d):
    return detect.per_host_campaigns(load_telemetry(spark, d)).select("campaign_id", joined("host_ids"), "n_events", "score")


@query(
    "d08_baseline_per_host",
    f"WITH {TEL} SELECT campaign_id, host_ids, n_events, CAST(score AS DOUBLE) AS score FROM ("
    + per_host_sql("net_conn", 8, "b1-", 0.5) + " UNION ALL " + per_host_sql("auth", 3, "b1-auth-", 0.4) + ")",
)
def _(spark, d):
    return detect.baseline_per_host(load_telemetry(spark, d)).select("campaign_id", joined("host_ids"), "n_events", "score")


@query(
    "d09_baseline_joins",
    f"""WITH {TEL}, noisy AS ({D01}),
    u AS (SELECT DISTINCT usr, host_id FROM t WHERE payload_type = 'auth'),
    x AS (SELECT DISTINCT dst_ip, host_id FROM t WHERE {SMALL})
    SELECT 'b2-user-' || usr AS campaign_id, array_to_string(list_sort(list(u.host_id)), ',') AS host_ids, CAST(0.7 AS DOUBLE) AS score,
      CASE WHEN count(n.host_id) > 0 THEN 'recon_fanout:' || array_to_string(list_sort(list(n.host_id) FILTER (WHERE n.host_id IS NOT NULL)), ',') || ';' ELSE '' END
        || 'lateral_auth:' || array_to_string(list_sort(list(u.host_id)), ',') AS stages
    FROM u LEFT JOIN noisy n USING (host_id) GROUP BY usr HAVING count(*) >= 2
    UNION ALL SELECT 'b2-exfil-' || replace(dst_ip, '.', '-'), array_to_string(list_sort(list(host_id)), ','), 0.65,
      'micro_exfil:' || array_to_string(list_sort(list(host_id)), ',') FROM x GROUP BY dst_ip HAVING count(*) >= 2""",
)
def _(spark, d):
    rows = detect.baseline_joins(load_telemetry(spark, d))
    stages = F.array_join(F.transform("stages", lambda s: F.concat(s["name"], F.lit(":"), F.array_join(s["hosts"], ","))), ";")
    return rows.select("campaign_id", joined("host_ids"), "score", stages.alias("stages"))


KIND = (
    "CASE WHEN payload_type = 'auth' THEN 'AUTH' WHEN payload_type = 'dns' THEN 'DNS' WHEN egress AND bytes > 0 AND bytes <= 50000 THEN 'EXFIL' "
    "WHEN egress AND bytes > 50000 THEN 'BLOB' ELSE 'NET' END"
)


@query(
    "d10_kpis",
    f"WITH {TEL} SELECT count(*) AS events, count(DISTINCT host_id) AS hosts, count(*) FILTER (WHERE kd = 'AUTH') AS auth, "
    f"count(*) FILTER (WHERE kd IN ('EXFIL', 'BLOB')) AS exfil, count(*) FILTER (WHERE kd = 'NET') AS net, count(*) FILTER (WHERE kd = 'DNS') AS dns FROM (SELECT *, {KIND} AS kd FROM t)",
)
def _(spark, d):
    return feed.kpis(load_telemetry(spark, d))


@query(
    "d11_run_status",
    f"""WITH {TEL} SELECT user_id, CASE WHEN n < 60 THEN 'NO_RUN' WHEN fails > n * 0.3 THEN 'REFUSE' WHEN fails > n * 0.2 THEN 'PARTIAL' WHEN nb > 0 THEN 'CAMPAIGN' ELSE 'EMPTY' END AS status
    FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE result = 'failure') AS fails, count(*) FILTER (WHERE bytes > 50000) AS nb FROM t GROUP BY 1)""",
)
def _(spark, d):
    c = F.col
    runs = load_telemetry(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(c("result") == "failure").alias("fails"), F.count_if(c("bytes") > 50000).alias("n_campaigns")
    )
    runs = runs.withColumns(
        {
            "loaded": c("n_events") >= 60,
            "recon_status": F.when(c("fails") > c("n_events") * 0.3, "insufficient_evidence").when(c("fails") > c("n_events") * 0.2, "partial"),
        }
    )
    return feed.run_status(runs).select("user_id", "status")


@query("d12_newest_activity", f"WITH {TEL} SELECT ingest_seq, ts_utc AS ts, {KIND} AS kind, host_id AS host FROM t ORDER BY ingest_seq DESC LIMIT 500")
def _(spark, d):
    return feed.activity_rows(feed.newest(load_telemetry(spark, d))).select("ingest_seq", "ts", "kind", "host")


@query(
    "n30_activity_rows",
    f"""WITH {TEL} SELECT ingest_seq, {KIND} AS kind,
      CASE WHEN payload_type = 'auth' THEN CASE WHEN result = 'success' THEN 'WARNING' ELSE 'INFO' END WHEN payload_type = 'dns' THEN 'WARNING'
        WHEN egress AND bytes > 50000 THEN 'ERROR' WHEN egress AND bytes > 0 THEN 'WARNING' ELSE 'INFO' END AS level,
      CASE WHEN payload_type = 'auth' THEN 'user=' || usr || ' result=' || result || ' src=' || src WHEN payload_type = 'dns' THEN 'q=' || query || ' type=A'
        ELSE 'dst=' || dst_ip || ':443 bytes=' || bytes || ' egress=' || CASE WHEN egress THEN 'true' ELSE 'false' END END AS line FROM t""",
)
def _(spark, d):
    return feed.activity_rows(load_telemetry(spark, d)).select("ingest_seq", "kind", "level", "line")


@query("n29_dns_apex", f"WITH {TEL} SELECT apex, count(*) AS n FROM t WHERE payload_type = 'dns' GROUP BY 1")
def _(spark, d):
    ev = load_telemetry(spark, d).filter("payload_type = 'dns'")
    return ev.groupBy(dns_apex(F.concat(F.lit(" "), F.upper("query"), F.lit(". "))).alias("apex")).agg(F.count(F.lit(1)).alias("n"))


# --- facts, sessions, clusters -------------------------------------------------------------------

FLEET_SQL = (
    "fleet AS (SELECT host_id AS h FROM t UNION SELECT src FROM t WHERE payload_type = 'auth' AND src LIKE 'host-%' AND src <> host_id), "
    "facts AS (SELECT count(*) AS fleet_n, greatest(4, count(*) - 1) AS fanout_bar, greatest(2, count(*) // 2) AS hub_bar FROM fleet)"
)
HOPS_SQL = (
    "hop AS (SELECT DISTINCT usr, host_id AS host, src AS peer FROM t WHERE payload_type = 'auth' AND src LIKE 'host-%' AND src <> host_id "
    "UNION SELECT DISTINCT usr, src, host_id FROM t WHERE payload_type = 'auth' AND src LIKE 'host-%' AND src <> host_id)"
)
POINTS_SQL = f"""pts AS (
  SELECT 'lateral' AS kind, usr AS key, host_id AS host, us, ts_utc, ingest_seq, false AS is_src FROM t WHERE payload_type = 'auth'
  UNION ALL SELECT 'lateral', usr, src, us, ts_utc, ingest_seq, true FROM t WHERE payload_type = 'auth' AND src LIKE 'host-%' AND src <> host_id
  UNION ALL SELECT 'exfil', dst_ip, host_id, us, ts_utc, ingest_seq, false FROM t WHERE {SMALL}
  UNION ALL SELECT 'dns', apex, host_id, us, ts_utc, ingest_seq, false FROM t WHERE payload_type = 'dns')"""


def mem_sql(window_us: int = WUS) -> str:
    return f"""{POINTS_SQL},
  brk AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY kind, key ORDER BY us, ingest_seq, is_src) <= {window_us} THEN 0 ELSE 1 END AS nw FROM pts),
  ses AS (SELECT *, sum(nw) OVER (PARTITION BY kind, key ORDER BY us, ingest_seq, is_src ROWS UNBOUNDED PRECEDING) AS sno FROM brk),
  mem0 AS (SELECT kind, key, sno, host, min(us) AS t0, max(us) AS t1 FROM ses GROUP BY ALL),
  multi AS (SELECT kind, key FROM mem0 GROUP BY 1, 2 HAVING count(DISTINCT host) >= 2),
  mem AS (SELECT m.* FROM mem0 m JOIN multi USING (kind, key)),
  siz AS (SELECT kind, key, sno, count(*) AS n_hosts, min(t0) AS t0, max(t1) AS t1 FROM mem GROUP BY ALL)"""


def acc_sql(window_us: int = WUS, bar: str = "(SELECT fanout_bar FROM facts)") -> str:
    return f"""{FLEET_SQL}, {HOPS_SQL}, {mem_sql(window_us)},
  bad AS (SELECT key FROM siz WHERE kind = 'exfil' GROUP BY key HAVING max(n_hosts) >= {bar}),
  lat AS (SELECT m.* FROM mem m JOIN siz s USING (kind, key, sno) WHERE m.kind = 'lateral' AND s.n_hosts >= 2
          AND (s.n_hosts < {bar} OR EXISTS (SELECT 1 FROM hop h WHERE h.usr = m.key AND h.host = m.host))),
  acc AS (SELECT * FROM lat WHERE (key, sno) IN (SELECT (key, sno) FROM lat GROUP BY key, sno HAVING count(*) >= 2)
    UNION ALL SELECT m.* FROM mem m JOIN siz s USING (kind, key, sno) WHERE m.kind = 'exfil' AND s.n_hosts >= 2 AND m.key NOT IN (SELECT key FROM bad)
    UNION ALL SELECT m.* FROM mem m JOIN siz s USING (kind, key, sno) WHERE m.kind = 'dns' AND s.n_hosts >= 2)"""


CLU_SQL = f"""{acc_sql()},
  seen AS (SELECT kind, key, min((ts_utc, ingest_seq)) AS fs FROM pts WHERE NOT is_src GROUP BY ALL),
  clu AS (SELECT *, row_number() OVER (ORDER BY kn, fs, sno) AS part FROM (
    SELECT a.kind, a.key, a.sno, CASE a.kind WHEN 'lateral' THEN 1 WHEN 'exfil' THEN 2 ELSE 3 END AS kn, s.fs, count(*) AS n_hosts,
      min(t0) AS t0, max(t1) AS t1, list_sort(list(host)) AS hosts FROM acc a JOIN seen s USING (kind, key) GROUP BY ALL)),
  cid AS (SELECT *, 'camp-' || kind || '-' || CASE WHEN kind = 'lateral' THEN key ELSE replace(key, '.', '-') END || '-' || part AS campaign_id FROM clu)"""


def _stages(spark, d, cfg=CFG):
    ev = load_telemetry(spark, d)
    points = fuse.key_points(ev, cfg)
    members = fuse.slot_members(fuse.key_slots(points, cfg), cfg)
    return ev, points, members, fuse.fleet_facts(ev, cfg)


@query("f01_fleet_facts", f"WITH {TEL}, {FLEET_SQL} SELECT * FROM facts")
def _(spark, d):
    return fuse.fleet_facts(load_telemetry(spark, d), CFG)


@query("f02_auth_points", f"WITH {TEL}, {POINTS_SQL} SELECT key AS usr, host, us, ingest_seq FROM pts WHERE kind = 'lateral'")
def _(spark, d):
    return fuse.key_points(load_telemetry(spark, d), CFG).filter("kind = 'lateral'").select(F.col("key").alias("usr"), "host", "us", "ingest_seq")


@query("f03_hop_degree", f"WITH {TEL}, {HOPS_SQL} SELECT host, count(DISTINCT peer) AS degree FROM hop GROUP BY 1")
def _(spark, d):
    return fuse.hop_degree(fuse.hop_edges(fuse.key_points(load_telemetry(spark, d), CFG)))


@query("f04_hop_hosts", f"WITH {TEL}, {HOPS_SQL} SELECT DISTINCT usr, host FROM hop")
def _(spark, d):
    return fuse.hop_hosts(fuse.hop_edges(fuse.key_points(load_telemetry(spark, d), CFG))).select(F.col("user").alias("usr"), "host")


@query("f05_gap_sessions", f"WITH {TEL}, {mem_sql()} SELECT kind, key, CAST(sno AS BIGINT) AS session_no, n_hosts, t0, t1 FROM siz")
def _(spark, d):
    _, _, members, _ = _stages(spark, d)
    return members.groupBy("kind", "key", "session_no").agg(F.count(F.lit(1)).alias("n_hosts"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


@query(
    "f05_order_sessions",
    """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us FROM orders),
    b AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) <= 2592000000000 THEN 0 ELSE 1 END AS nw FROM o),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey ROWS UNBOUNDED PRECEDING) AS sno FROM b)
    SELECT o_custkey, CAST(sno AS BIGINT) AS session_no, count(*) AS n_entities, min(us) AS t0, max(us) AS t1 FROM s GROUP BY 1, 2""",
)
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return gap_sessions(o, ["o_custkey"], "o_orderkey", "ts", 30 * 86400)


def _cluster_rows(members):
    return members.groupBy("key", "session_no").agg(
        joined_set("host").alias("hosts"), F.min("t0").alias("t0"), F.max("t1").alias("t1")
    )


def joined_set(col):
    return F.array_join(F.sort_array(F.collect_set(col)), ",")


def cluster_sql(kind: str, **kw) -> str:
    return (
        f"WITH {TEL}, {acc_sql(**kw)} SELECT key, CAST(sno AS BIGINT) AS session_no, array_to_string(list_sort(list(host)), ',') AS hosts, "
        f"min(t0) AS t0, max(t1) AS t1 FROM acc WHERE kind = '{kind}' GROUP BY key, sno"
    )


@query("f06_lateral_clusters", cluster_sql("lateral", bar="3"))
def _(spark, d):
    _, points, members, facts = _stages(spark, d)
    return _cluster_rows(fuse.lateral_members(members, fuse.hop_edges(points), facts.withColumn("fanout_bar", F.lit(3)), CFG))


@query("f07_poisoned_destinations", f"WITH {TEL}, {mem_sql()} SELECT key, max(n_hosts) AS widest FROM siz WHERE kind = 'exfil' GROUP BY 1 HAVING max(n_hosts) >= 3")
def _(spark, d):
    _, _, members, facts = _stages(spark, d)
    return fuse.poisoned_destinations(members, facts.withColumn("fanout_bar", F.lit(3)), CFG).select("key", "widest")


@query("f08_exfil_clusters", cluster_sql("exfil", bar="3"))
def _(spark, d):
    _, _, members, facts = _stages(spark, d)
    return _cluster_rows(fuse.exfil_members(members, facts.withColumn("fanout_bar", F.lit(3)), CFG))


@query("f09_dns_clusters", cluster_sql("dns"))
def _(spark, d):
    _, _, members, _ = _stages(spark, d)
    return _cluster_rows(fuse.dns_members(members, CFG))


@query("f10_numbered_clusters", f"WITH {TEL}, {CLU_SQL} SELECT campaign_id, part, n_hosts, t0, t1 FROM cid")
def _(spark, d):
    clusters, _ = fuse.numbered_clusters(load_telemetry(spark, d), CFG)
    return clusters.select("campaign_id", "part", "n_hosts", "t0", "t1")


RECON_SQL = f"recon AS (SELECT host_id AS host FROM t WHERE payload_type = 'net_conn' GROUP BY 1 HAVING count(DISTINCT dst_ip) >= {CFG.recon_min_distinct})"


@query(
    "f11_recon_attach",
    f"""WITH {TEL}, {CLU_SQL}, {RECON_SQL}, r AS (SELECT list_sort(list(host)) AS rh FROM recon)
    SELECT campaign_id, len(list_intersect(hosts, rh)) > 0 AS absorbs_recon, array_to_string(list_sort(CASE WHEN len(list_intersect(hosts, rh)) > 0
      THEN list_distinct(list_concat(hosts, rh)) ELSE hosts END), ',') AS host_ids FROM cid, r""",
)
def _(spark, d):
    ev = load_telemetry(spark, d)
    clusters, members = fuse.numbered_clusters(ev, CFG)
    recon = cut(fuse.recon_hosts(ev, CFG))
    clusters, flagged = fuse.attach_recon(clusters, members, recon)
    own = flagged.groupBy("part").agg(F.collect_set(F.when(~F.col("is_recon"), F.col("host"))).alias("plain"))
    rows = clusters.join(own, "part").select("campaign_id", "plain", "absorbs_recon")
    hosts = merge.campaign_hosts(rows, recon).groupBy("campaign_id").agg(joined_set("host_id").alias("host_ids"))
    return rows.select("campaign_id", "absorbs_recon").join(hosts, "campaign_id")


@query(
    "f12_recon_cluster",
    f"WITH {TEL}, {RECON_SQL} SELECT 'camp-recon-multi' AS campaign_id, array_to_string(list_sort(list(host)), ',') AS host_ids, count(*) AS n_hosts FROM recon HAVING count(*) >= 2",
)
def _(spark, d):
    recon = fuse.recon_hosts(load_telemetry(spark, d), CFG)
    rows = recon.groupBy().agg(joined_set("host").alias("host_ids"), F.count(F.lit(1)).alias("n_hosts")).filter(F.col("n_hosts") >= CFG.min_hosts)
    return rows.select(F.lit("camp-recon-multi").alias("campaign_id"), "host_ids", "n_hosts")


@query(
    "f13_f14_range_gaps",
    f"""WITH {TEL}, {mem_sql()}, g AS (SELECT kind, key, sno, t0 - lag(t1) OVER (PARTITION BY kind, key ORDER BY sno) AS gap FROM siz)
    SELECT kind, key, CAST(sno AS BIGINT) AS session_no, coalesce(greatest(0, gap), 0) AS quiet_us, coalesce(gap <= {2 * WUS}, true) AS near FROM g""",
)
def _(spark, d):
    _, _, members, _ = _stages(spark, d)
    rows = members.groupBy("kind", "key", "session_no").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    w = W.partitionBy("kind", "key").orderBy("session_no")
    rows = rows.withColumns({"p0": F.lag("t0").over(w), "p1": F.lag("t1").over(w)})
    c = F.col
    return rows.select(
        "kind", "key", "session_no", quiet_gap(c("p0"), c("p1"), c("t0"), c("t1")).alias("quiet_us"),
        ranges_near(c("p0"), c("p1"), c("t0"), c("t1"), 2 * WUS).alias("near"),
    )


PAIR_CFG = FuseConfig(window_seconds=3600, resume_window_seconds=7200, recon_min_distinct=101)
PAIRS_SQL = f"""{CLU_SQL},
  deg AS (SELECT host FROM hop GROUP BY 1 HAVING count(DISTINCT peer) >= (SELECT hub_bar FROM facts)),
  hubs AS (SELECT list(host) AS hl FROM deg),
  pr AS (SELECT a.campaign_id AS a_id, b.campaign_id AS b_id, a.kind AS ak, b.kind AS bk, a.key AS akey, b.key AS bkey, a.hosts AS ah, b.hosts AS bh,
      list_intersect(a.hosts, b.hosts) AS sh, greatest(0, b.t0 - a.t1, a.t0 - b.t1) AS gap
    FROM cid a JOIN cid b ON a.part < b.part AND b.t0 - a.t1 <= {WUS} AND a.t0 - b.t1 <= {WUS}),
  fl AS (SELECT *, len(sh) AS n_shared, ak = 'lateral' AND bk <> 'lateral' OR bk = 'lateral' AND ak <> 'lateral' AS crossk FROM pr),
  ru AS (SELECT a_id, b_id, n_shared, (n_shared >= 2 OR (n_shared = 1 AND crossk)) AS bridge_ok,
      gap >= {WUS} AND ak <> bk AS refuse_shape_gap,
      (len(list_intersect(sh, coalesce((SELECT hl FROM hubs), []))) > 0 AND (ak = 'lateral' OR bk = 'lateral') AND NOT (ak = bk AND akey = bkey)
        AND n_shared < len(ah) AND n_shared < len(bh) AND NOT (crossk AND (ak = 'exfil' OR bk = 'exfil'))) AS refuse_hub,
      (ak = 'lateral' AND bk = 'lateral' AND akey <> bkey) AS refuse_users
    FROM fl WHERE n_shared >= 2 OR (n_shared = 1 AND crossk))"""


def _rule_rows(spark, d):
    items, _ = fuse.cluster_items(load_telemetry(spark, d), PAIR_CFG)
    states = items.withColumns({"gid": F.lpad(F.col("ord").cast("string"), 14, "0"), "n_items": F.lit(1)})
    states = cut(merge._profile(states.withColumn("sid", F.col("gid"))))
    pairs = merge.candidate_pairs(states, [], WUS)
    fields = ("campaign_id", "t0", "t1", "hosts", "hubs", "lateral_hosts", "egress_hosts", "exfil_hosts", "names", "user", "dsts")
    side = lambda n: states.select(F.col("sid").alias(f"{n}_sid"), F.struct(*fields).alias(n))
    rule = fuse.pair_rules("a", "b", PAIR_CFG, WUS)
    names = ("n_shared", "bridge_ok", "refuse_shape_gap", "refuse_hub", "refuse_users")
    rows = pairs.join(side("a"), "a_sid").join(side("b"), "b_sid")
    return rows.select(F.col("a.campaign_id").alias("a_id"), F.col("b.campaign_id").alias("b_id"), *[rule[n].alias(n) for n in names]).filter("bridge_ok")


@query("f15_f16_f17_f18_pair_rules", f"WITH {TEL}, {PAIRS_SQL} SELECT * FROM ru")
def _(spark, d):
    return _rule_rows(spark, d)


@query("f19_merge_pairs", f"WITH {TEL}, {PAIRS_SQL} SELECT a_id, b_id, n_shared FROM ru WHERE bridge_ok AND NOT refuse_shape_gap AND NOT refuse_hub AND NOT refuse_users")
def _(spark, d):
    ok = ~F.col("refuse_shape_gap") & ~F.col("refuse_hub") & ~F.col("refuse_users")
    return _rule_rows(spark, d).filter(ok).select("a_id", "b_id", "n_shared")


@query("f20_f21_merged_clusters")
def _(spark, d):
    ev = load_telemetry(spark, d)
    items, recon = fuse.cluster_items(ev, CFG)
    merged = merge.merge_clusters(items, cut(recon), cut(fuse.recon_hosts(ev, CFG)), CFG)
    return merged.select("campaign_id", "ord", joined("plain"), "absorbs_recon", F.size("stages").alias("n_stages"), "t0", "t1")


@query("f22_fused_campaigns")
def _(spark, d):
    rows = merge.fused_campaigns(load_telemetry(spark, d), CFG)
    return rows.select("campaign_id", joined("host_ids"), F.size("stages").alias("n_stages"), F.size("evidence").alias("n_evidence"), r6("score"))


@query("f23_modes")
def _(spark, d):
    ev = load_telemetry(spark, d)
    out = None
    for mode in ("fused", "detector_only", "ablation"):
        part = campaigns(ev, mode, CFG).select(F.lit(mode).alias("mode"), "campaign_id", joined("host_ids"), r6("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f22_campaign_evidence_long", f"WITH {TEL}, {SIGNALS_SQL}, {DET_SQL} SELECT d.campaign_id, s.kind, count(*) AS n FROM (SELECT campaign_id, unnest(hosts) AS host_id FROM det) d JOIN sig s USING (host_id) GROUP BY ALL")
def _(spark, d):
    sig = detect.all_signals(load_telemetry(spark, d))
    hosts = detect.detector_campaigns(sig).select("campaign_id", F.explode("host_ids").alias("host_id"))
    return merge.campaign_evidence(hosts, sig).groupBy("campaign_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f20_component_labels",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1),
    ed AS (SELECT DISTINCT a.s AS u, b.s AS v FROM e a JOIN e b USING (p) WHERE a.s <> b.s),
    r(u, v) AS (SELECT u, v FROM ed UNION SELECT r.u, ed.v FROM r JOIN ed ON r.v = ed.u)
    SELECT u AS node, count(*) FILTER (WHERE v <> u) + 1 AS component_size FROM r GROUP BY 1""",
)
def _(spark, d):
    from hostweave.operators.components import component_labels

    li = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity = 50 AND l_discount = 0.1")
    e = li.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    low = e.groupBy("p").agg(F.min("s").alias("low"))
    edges = e.join(low, "p").filter("s <> low").select(F.col("low").alias("u"), F.col("s").alias("v")).distinct()
    labels = component_labels(edges)
    return labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("component_size")), "label").select("node", "component_size")
