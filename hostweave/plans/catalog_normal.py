"""Sources, normalisation and trust, over raw text that Spark derives from the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostweave.functions.signing import payload_digest
from hostweave.functions.text import safe_id
from hostweave.operators import feed, normalize, reconstruct, trust
from hostweave.plans.catalog_base import TEL, joined, query
from hostweave.plans.telemetry import load_telemetry
from hostweave.session import cut, shared_folder
from hostweave.sources import dimensions, exports, manifests, sinks, text_logs

INGEST = "2030-01-01T00:00:00.000000Z"
S = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
c = F.col


# --- raw Windows records out of events -----------------------------------------------------------


def windows_raw(ev):
    """Raw records in the shapes exporters write: channel fields, id forms, time forms, EventData forms."""
    k, et = c("k"), c("event_type")
    ch = F.when(et.isin("signup", "error"), "security").when((et == "view") & (k % 4 == 0), "powershell").when(et.isin("view", "click"), "sysmon").otherwise("firewall")
    eid = (
        F.when(et == "signup", F.when(k % 7 == 0, "4624.0").otherwise("4624")).when(et == "error", F.when(k % 5 == 0, "4688").otherwise("4625"))
        .when(ch == "powershell", "4104").when(et == "view", "22").when(et == "click", F.when(k % 3 == 0, "1").otherwise("3"))
        .otherwise(F.when(k % 2 == 1, "5157").otherwise("5156"))
    )
    time = (
        F.when(k % 5 == 0, S('"', c("ts_utc"), '"'))
        .when(k % 5 == 1, S('"', F.date_format(c("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '+02:00"'))
        .when(k % 5 == 2, S('"', F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), '"'))
        .when(k % 5 == 3, F.unix_seconds("ts").cast("string"))
        .when(k == 94, '"not a time"')
        .otherwise(S('"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"'))
    )
    pair = (
        F.when(ch == "security", F.array(F.lit("TargetUserName"), c("user")))
        .when(ch == "powershell", F.array(F.lit("ScriptBlockText"), S("Get-Thing\\n", c("query"))))
        .when(et == "view", F.array(F.lit("QueryName"), c("query")))
        .when((et == "click") & (k % 3 == 0), F.array(F.lit("Image"), S("tool-", k.cast("string"))))
        .when(et == "click", F.array(F.lit("DestinationIp"), c("dst_ip")))
        .otherwise(F.array(F.lit("DestAddress"), c("dst_ip")))
    )
    plain = S('{"', pair[0], '":"', pair[1], '"', F.when((et == "purchase") & (k % 10 == 0), ',"Action":"Block"').otherwise(""), "}")
    listed = S('{"Data":[{"Name":"', pair[0], '","Value":"', pair[1], '"}]}')
    ed = F.when((k % 2 == 1) & (et != "purchase"), listed).otherwise(plain)
    chan = (
        F.when(ch == "security", '"Channel":"Security"').when(ch == "sysmon", '"channel":"Microsoft-Windows-Sysmon/Operational"')
        .when(ch == "firewall", '"LogName":"firewall"').otherwise('"System":{"Channel":"Windows PowerShell"}')
    )
    host = F.when(k % 11 == 0, S('"Hostname":"', F.upper("host_id"), '"')).otherwise(S('"Computer":"', F.upper("host_id"), '.lab.local"'))
    who = F.when((ch == "security") & (k % 6 != 0), S('"TargetUserName":"', c("user"), '",')).otherwise('"TargetUserName":"-",')
    addr = F.when(ch == "security", F.when(k % 8 == 0, '"IpAddress":"127.0.0.1",').otherwise(S('"IpAddress":"', c("src"), '",'))).otherwise("")
    raw = S("{", chan, ',"EventID":', F.when(eid == "4624.0", '"4624.0"').otherwise(eid), ",", host, ',"TimeCreated":', time, ",", who, addr, '"EventData":', ed, "}")
    return ev.select(S("part-", (c("user_id") % 4).cast("string")).alias("source"), c("ingest_seq").alias("pos"), raw.alias("raw"))


def windows_records(spark, d):
    return exports.with_record(windows_raw(load_telemetry(spark, d)))


def windows_allow(spark):
    return dimensions.allowlist_frame(spark, dimensions.WINDOWS_ALLOWLIST)


def mapped_windows(spark, d):
    return normalize.map_windows(windows_records(spark, d), windows_allow(spark), INGEST)


W = f"""{TEL}, w AS (SELECT *, 'part-' || (user_id % 4) AS source, ingest_seq AS pos,
  CASE WHEN event_type IN ('signup', 'error') THEN 'security' WHEN event_type = 'view' AND k % 4 = 0 THEN 'powershell' WHEN event_type IN ('view', 'click') THEN 'sysmon' ELSE 'firewall' END AS channel,
  CASE WHEN event_type = 'signup' THEN '4624' WHEN event_type = 'error' THEN CASE WHEN k % 5 = 0 THEN '4688' ELSE '4625' END WHEN event_type = 'view' AND k % 4 = 0 THEN '4104'
    WHEN event_type = 'view' THEN '22' WHEN event_type = 'click' THEN CASE WHEN k % 3 = 0 THEN '1' ELSE '3' END WHEN k % 2 = 1 THEN '5157' ELSE '5156' END AS event_kind,
  CASE WHEN k % 5 < 3 THEN ts_utc WHEN k = 94 THEN '{INGEST}' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.000000Z') END AS wts,
  CASE WHEN k % 8 = 0 THEN '0.0.0.0' ELSE src END AS wsrc FROM t)"""


@query("n02_timestamps", f"WITH {W} SELECT pos, wts AS ts_utc FROM w")
def _(spark, d):
    return normalize.parse_windows(windows_records(spark, d), INGEST).select("pos", "ts_utc")


@query("n03_n04_ids_and_channels", f"WITH {W} SELECT pos, channel, event_kind FROM w")
def _(spark, d):
    return normalize.parse_windows(windows_records(spark, d), INGEST).select("pos", "channel", "event_kind")


HOST_MAP_SQL = "hm AS (SELECT DISTINCT host_id AS raw, 'asset-' || substr(host_id, 6) AS asset FROM t WHERE CAST(substr(host_id, 6) AS INT) < 6)"


def host_map(ev, upper=False):
    rows = ev.filter(F.substring("host_id", 6, 2).cast("int") < 6).select("host_id").distinct()
    name = F.upper("host_id") if upper else c("host_id")
    return rows.select(name.alias("raw_host"), S("asset-", F.substring("host_id", 6, 10)).alias("host_id"))


@query("n05_hosts_mapped", f"WITH {W}, {HOST_MAP_SQL} SELECT pos, coalesce(asset, host_id) AS host_id FROM w LEFT JOIN hm ON raw = host_id")
def _(spark, d):
    ev = load_telemetry(spark, d)
    rows = normalize.parse_windows(exports.with_record(windows_raw(ev)), INGEST)
    return dimensions.map_hosts(rows, "host_id", host_map(ev)).select("pos", "host_id")


@query("n06_n07_users_and_sources", f"WITH {W} SELECT pos, coalesce(usr, 'unknown') AS usr, coalesce(wsrc, '0.0.0.0') AS src FROM w")
def _(spark, d):
    rows = normalize.with_event_data(windows_records(spark, d), "ed")
    return rows.select("pos", normalize.windows_user(c("rec"), c("ed")).alias("usr"), normalize.windows_source(c("rec"), c("ed")).alias("src"))


@query(
    "n08_event_data",
    f"WITH {W} SELECT pos, CASE WHEN event_type IN ('signup', 'error') THEN 'TargetUserName=' || usr WHEN channel = 'powershell' THEN 'ScriptBlockText=Get-Thing' || chr(10) || query "
    "WHEN event_type = 'view' THEN 'QueryName=' || query WHEN event_type = 'click' AND k % 3 = 0 THEN 'Image=tool-' || k WHEN event_type = 'click' THEN 'DestinationIp=' || dst_ip "
    "ELSE CASE WHEN k % 10 = 0 THEN 'Action=Block,' ELSE '' END || 'DestAddress=' || dst_ip END AS data FROM w",
)
def _(spark, d):
    rows = normalize.with_event_data(windows_records(spark, d), "ed")
    pairs = F.transform(F.map_entries("ed"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("pos", F.array_join(F.sort_array(pairs), ",").alias("data"))


@query("n09_allowed", f"WITH {W} SELECT pos, event_kind <> '4688' AND channel IN ('security', 'sysmon') AS allowed FROM w")
def _(spark, d):
    rows = normalize.parse_windows(windows_records(spark, d), INGEST)
    return normalize.allowed(rows, windows_allow(spark), ["security", "sysmon"]).select("pos", "allowed")


@query("n10_security", f"WITH {W} SELECT pos, host_id, usr AS \"user\", result, wsrc AS src FROM w WHERE channel = 'security' AND event_kind <> '4688'")
def _(spark, d):
    return mapped_windows(spark, d).filter("adapted and channel = 'security'").select("pos", "host_id", "user", "result", "src")


@query(
    "n11_sysmon",
    f"""WITH {W} SELECT pos, CASE event_kind WHEN '1' THEN 'process' WHEN '3' THEN 'net_conn' ELSE 'dns' END AS payload_type, CASE WHEN event_kind = '1' THEN 'tool-' || k END AS image,
    CASE WHEN event_kind = '3' THEN dst_ip END AS dst_ip, CASE WHEN event_kind = '3' THEN 1200 END AS bytes, CASE WHEN event_kind = '22' THEN query END AS query FROM w WHERE channel = 'sysmon'""",
)
def _(spark, d):
    return mapped_windows(spark, d).filter("adapted and channel = 'sysmon'").select("pos", "payload_type", "image", "dst_ip", "bytes", "query")


@query("n12_firewall", f"WITH {W} SELECT pos, dst_ip, 800 AS bytes, egress, (event_kind = '5157' OR k % 10 = 0) AS blocked FROM w WHERE channel = 'firewall'")
def _(spark, d):
    return mapped_windows(spark, d).filter("adapted and channel = 'firewall'").select("pos", "dst_ip", "bytes", "egress", "blocked")


@query(
    "n13_powershell",
    f"""WITH {W} SELECT pos, substr(sha256('Get-Thing' || chr(10) || query), 1, 16) AS script_sha256_16,
    'script_sha256=' || substr(sha256('Get-Thing' || chr(10) || query), 1, 16) || ' prefix=' || replace(substr('Get-Thing' || chr(10) || query, 1, 80), chr(10), ' ') AS command_line
    FROM w WHERE channel = 'powershell'""",
)
def _(spark, d):
    return mapped_windows(spark, d).filter("adapted and channel = 'powershell'").select("pos", "script_sha256_16", "command_line")


@query(
    "n14_windows_auth",
    f"""WITH {W} SELECT 'win-' || 'auth-' || host_id || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(4, length(CAST(rn AS VARCHAR))) AS INT), '0') AS event_id, wts AS ts_utc, usr AS "user", wsrc AS src
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM w WHERE event_kind = '4624')""",
)
def _(spark, d):
    return normalize.adapt_windows_auth(windows_records(spark, d), INGEST).select("event_id", "ts_utc", "user", "src")


@query(
    "n18_payload_json",
    f"""WITH {W} SELECT pos, CAST(json_object('user', usr, 'result', result, 'src', wsrc, 'event_kind', event_kind, 'channel', 'security') AS VARCHAR) AS payload FROM w WHERE channel = 'security' AND event_kind <> '4688'""",
)
def _(spark, d):
    return normalize.payload_json(mapped_windows(spark, d).filter("adapted and channel = 'security'")).select("pos", "payload")


@query(
    "n21_event_numbers",
    f"""WITH {W} SELECT pos, 'osw-' || channel || '-' || host_id || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(5, length(CAST(rn AS VARCHAR))) AS INT), '0') AS event_id
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rn FROM w WHERE event_kind <> '4688')""",
)
def _(spark, d):
    events, _ = normalize.adapt_windows(windows_records(spark, d), windows_allow(spark), INGEST)
    return events.select("pos", "event_id")


@query("n22_adapt_stats", f"WITH {W} SELECT channel, count(*) FILTER (WHERE event_kind <> '4688') AS adapted, count(*) FILTER (WHERE event_kind = '4688') AS skipped FROM w GROUP BY 1")
def _(spark, d):
    return normalize.adapt_stats(mapped_windows(spark, d))


@query(
    "n19_s05_captured",
    f"""WITH {TEL} SELECT ingest_seq AS pos, CASE WHEN event_type = 'purchase' THEN 'firewall' WHEN payload_type = 'auth' THEN 'security' ELSE 'sysmon' END AS channel, host_id,
    usr AS "user", dst_ip, query, ts_utc FROM t""",
)
def _(spark, d):
    ev = load_telemetry(spark, d)
    et = c("event_type")
    body = (
        F.when(et == "purchase", S('"Channel":"Security","EventID":5156,"DestAddress":"', c("dst_ip"), '"'))
        .when(et == "signup", S('"Channel":"Security","EventID":4624,"TargetUserName":"', c("user"), '"'))
        .when(et == "error", S('"Channel":"Security","EventID":4625,"TargetUserName":"', c("user"), '"'))
        .when(et == "view", S('"channel":"Microsoft-Windows-Sysmon/Operational","EventID":22,"QueryName":"', c("query"), '"'))
        .otherwise(S('"channel":"Microsoft-Windows-Sysmon/Operational","EventID":3,"DestinationIp":"', c("dst_ip"), '"'))
    )
    raw = S("{", body, ',"Hostname":"', F.upper("host_id"), '.shire.local","@timestamp":"', c("ts_utc"), '"}')
    rows = exports.with_record(ev.select(F.lit("cap").alias("source"), c("ingest_seq").alias("pos"), raw.alias("raw")))
    mapped = normalize.map_windows(normalize.normalize_captured(rows), windows_allow(spark), INGEST)
    return mapped.filter("adapted").select("pos", "channel", "host_id", "user", "dst_ip", "query", "ts_utc")


# --- macOS ---------------------------------------------------------------------------------------


def macos_records(spark, d):
    ev = load_telemetry(spark, d)
    et, k = c("event_type"), c("k")
    body = (
        F.when(et.isin("signup", "error"), S('"channel":"auth","EventID":"', F.when(et == "error", "ssh_fail").otherwise("SSH_Accept"), '","user":"', c("user"), '","src":"', c("src"), '"'))
        .when((et == "view") & (k % 4 == 0), S('"channel":"proc","EventID":"exec","comm":"tool","args":"', c("query"), '","script":"s', k.cast("string"), '"'))
        .when(et == "view", S('"channel":"dns","EventID":"query","query":" ', c("query"), ' "'))
        .when(et == "click", S('"channel":"network","EventID":"', F.when(k % 9 == 0, "udp_noise").otherwise("tcp_established"), '","dst_ip":"', F.when(k % 10 == 0, "0.0.0.0").otherwise(c("dst_ip")), '","dst_port":"x","bytes":', c("bytes").cast("string")))
        .otherwise(S('"channel":"firewall","EventID":"pass","dst_ip":"', c("dst_ip"), '","bytes":"bad"', F.when(k % 2 == 0, ',"action":"Block"').otherwise("")))
    )
    raw = S("{", body, ',"Computer":"', c("host_id"), '.local","TimeCreated":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 13 == 0, "").otherwise("Z"), '"}')
    return ev, exports.with_record(ev.select(F.lit("mac").alias("source"), c("ingest_seq").alias("pos"), raw.alias("raw")))


def mapped_macos(spark, d):
    ev, rows = macos_records(spark, d)
    return normalize.map_macos(rows, dimensions.allowlist_frame(spark, dimensions.MACOS_ALLOWLIST), INGEST, host_map(ev))


M = f"""{TEL}, {HOST_MAP_SQL}, m AS (SELECT *, CASE WHEN k % 13 = 0 THEN '{INGEST}' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS mts, coalesce(asset, host_id || '.local') AS mh,
  CASE WHEN event_type IN ('signup', 'error') THEN 'auth' WHEN event_type = 'view' AND k % 4 = 0 THEN 'process' WHEN event_type = 'view' THEN 'dns' WHEN event_type = 'click' THEN 'net' ELSE 'pf' END AS channel
  FROM t LEFT JOIN hm ON raw = host_id WHERE NOT (event_type = 'click' AND (k % 9 = 0 OR k % 10 = 0)))"""


@query("n15_macos_auth", f"WITH {M} SELECT ingest_seq AS pos, mh AS host_id, mts AS ts_utc, usr AS \"user\", result, src FROM m WHERE channel = 'auth'")
def _(spark, d):
    return mapped_macos(spark, d).filter("adapted and channel = 'auth'").select("pos", "host_id", "ts_utc", "user", "result", "src")


@query("n16_macos_net", f"WITH {M} SELECT ingest_seq AS pos, mh AS host_id, dst_ip, 0 AS dst_port, CASE WHEN bytes = 0 THEN 1200 ELSE bytes END AS bytes, true AS egress FROM m WHERE channel = 'net'")
def _(spark, d):
    return mapped_macos(spark, d).filter("adapted and channel = 'net'").select("pos", "host_id", "dst_ip", "dst_port", "bytes", "egress")


@query(
    "n17_macos_dns_process_pf",
    f"""WITH {M} SELECT ingest_seq AS pos, channel, CASE WHEN channel = 'dns' THEN query END AS query, CASE WHEN channel = 'process' THEN query END AS command_line,
    CASE WHEN channel = 'process' THEN substr(sha256('s' || k), 1, 16) END AS script_sha256_16, CASE WHEN channel = 'pf' THEN 1200 END AS bytes, CASE WHEN channel = 'pf' THEN k % 2 = 0 END AS blocked
    FROM m WHERE channel IN ('dns', 'process', 'pf')""",
)
def _(spark, d):
    rows = mapped_macos(spark, d).filter("adapted and channel in ('dns', 'process', 'pf')")
    return rows.select("pos", "channel", "query", "command_line", "script_sha256_16", "bytes", "blocked")


# --- flat rows, names, clocks --------------------------------------------------------------------


def flat_records(ev):
    k, et = c("k"), c("event_type")
    signed = S('{"type":"event","schema_ver":"1","event_id":"', c("event_id"), '","producer_id":"', c("producer_id"), '","host_id":"', c("host_id"), '","ts_utc":"', c("ts_utc"), '","nonce":"', c("nonce"),
               '","payload_type":"', c("payload_type"), '","payload":{"k":', k.cast("string"), "}", F.when(k % 10 == 1, "}").otherwise(',"hmac":"00"}'))
    flat = S('{"kind":"', F.when(et == "view", "dns").otherwise(c("payload_type")), '","host_id":"', c("host_id"), '","ts_utc":"', c("ts_utc"), '","user":"', F.coalesce("user", F.lit("")), '","bytes":', F.coalesce("bytes", F.lit(0)).cast("string"), "}")
    raw = F.when(k % 5 == 1, signed).when(k % 5 == 2, '{"other":1}').otherwise(flat)
    return exports.with_record(ev.select(F.lit("lab").alias("source"), c("ingest_seq").alias("pos"), raw.alias("raw")))


@query(
    "n01_n20_row_status",
    f"""WITH {TEL} SELECT ingest_seq AS pos, CASE WHEN k % 5 = 1 THEN CASE WHEN k % 10 = 1 THEN 'bad_shape' ELSE 'ok' END WHEN k % 5 = 2 OR event_type = 'view' OR host_id = 'host-00' THEN 'flat_skip' ELSE 'adapted' END AS status,
    CASE WHEN k % 5 NOT IN (1, 2) AND payload_type = 'auth' AND host_id <> 'host-00' THEN usr END AS "user", CASE WHEN k % 5 NOT IN (1, 2) AND payload_type = 'net_conn' AND host_id <> 'host-00' THEN bytes END AS bytes FROM t""",
)
def _(spark, d):
    ev = load_telemetry(spark, d)
    producers = ev.filter("host_id <> 'host-00'").select("host_id", "producer_id").distinct()
    return normalize.adapt_flat(flat_records(ev), producers).select("pos", "status", "user", "bytes")


@query("n23_aliases", f"WITH {TEL}, {HOST_MAP_SQL} SELECT ingest_seq, coalesce(a.asset, host_id) AS host_id, coalesce(b.asset, src) AS src FROM t LEFT JOIN hm a ON a.raw = host_id LEFT JOIN hm b ON b.raw = src")
def _(spark, d):
    ev = load_telemetry(spark, d)
    al = host_map(ev).select(c("raw_host").alias("alias"), c("host_id").alias("asset"))
    return normalize.apply_aliases(ev, al).select("ingest_seq", "host_id", "src")


@query("n24_clock_skew", f"WITH {TEL} SELECT ingest_seq, strftime(ts + to_microseconds(CASE WHEN CAST(substr(host_id, 6) AS INT) < 6 THEN 47500000 ELSE 0 END), '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_utc FROM t")
def _(spark, d):
    ev = load_telemetry(spark, d)
    skew = host_map(ev).select(c("raw_host").alias("host_id"), F.lit(47.5).alias("skew_seconds"))
    return normalize.shift_clocks(ev, skew).select("ingest_seq", "ts_utc")


@query("n25_dropped_hosts", f"WITH {TEL} SELECT host_id, count(*) AS n FROM t WHERE CAST(substr(host_id, 6) AS INT) >= 6 GROUP BY 1")
def _(spark, d):
    ev = load_telemetry(spark, d)
    return normalize.drop_hosts(ev, host_map(ev).select(c("raw_host").alias("host_id"))).groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))


def manifest_docs(ev):
    """One scenario document per (user, day): its events become steps; every seventh lacks its steps."""
    rows = ev.withColumns({"day": F.to_date("ts"), "name": S("s-", c("user_id").cast("string"), "-", F.date_format("ts", "yyyyMMdd"))})
    kind = F.when(c("payload_type") == "auth", "auth").when(c("payload_type") == "dns", "dns").when(c("event_type") == "purchase", "exfil").otherwise("recon")
    host = S("host-", (c("k") % 6).cast("string"))
    emit = F.when(c("k") % 10 == 3, S("dhcp-", (c("k") % 6).cast("string")))
    step = F.struct(
        c("ingest_seq").alias("o"),
        F.struct(
            kind.alias("kind"), host.alias("host"), emit.alias("emit_host"), (F.unix_seconds("ts") - F.unix_seconds(c("day").cast("timestamp"))).cast("double").alias("offset_seconds"),
            c("user"), c("src"), F.when(c("event_type") == "purchase", c("dst_ip")).alias("dst_ip"), c("bytes"), c("query"),
        ).alias("s"),
    )
    docs = rows.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["s"]).alias("steps"), F.min("day").alias("day"), F.min("user_id").alias("u"))
    hosts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("host-"), i.cast("string")))
    aliases = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("dhcp-"), i.cast("string"))), hosts)
    body = F.struct(
        c("name").alias("campaign_id"), hosts.alias("hosts"), F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("base_time_utc"), aliases.alias("host_aliases"),
        F.array(F.lit("host-5")).alias("drop_hosts"), F.when(c("u") % 7 != 0, c("steps")).alias("steps"),
        F.when(c("u") % 3 == 0, F.array(F.lit("host-0"), F.lit("host-1"))).alias("truth_hosts"),
    )
    return docs.select(c("name").alias("source"), F.to_json(body).alias("text"))


MAN = f"""{TEL}, st AS (SELECT *, 's-' || user_id || '-' || strftime(ts, '%Y%m%d') AS pack_id, k % 6 AS h,
  CASE WHEN payload_type = 'auth' THEN 'lateral_auth' WHEN event_type = 'purchase' THEN 'micro_exfil' WHEN event_type = 'click' THEN 'recon_fanout' END AS stage FROM t),
  live AS (SELECT *, CASE WHEN stage = 'recon_fanout' THEN 8 ELSE 1 END AS n_out FROM st WHERE user_id % 7 <> 0 AND h <> 5)"""


@query("s06_manifests", f"WITH {MAN} SELECT pack_id AS source, user_id % 7 <> 0 AS complete FROM st GROUP BY ALL")
def _(spark, d):
    ok, bad = manifests.parse_manifests(manifest_docs(load_telemetry(spark, d)))
    return ok.select("source", F.lit(True).alias("complete")).union(bad.select("source", F.lit(False)))


@query(
    "n26_manifest_events",
    f"""WITH {MAN}, x AS (SELECT *, unnest(range(n_out)) AS j, coalesce(sum(n_out) OVER (PARTITION BY pack_id ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM live)
    SELECT pack_id || '-' || CASE WHEN stage = 'lateral_auth' THEN 'auth' WHEN stage = 'micro_exfil' THEN 'exfil' WHEN stage = 'recon_fanout' THEN 'recon' ELSE 'dns' END || '-' || lpad(CAST(before + j + 1 AS VARCHAR), 4, '0') AS event_id,
      'host-' || h AS host_id, strftime(date_trunc('second', ts) + to_seconds(CAST(CASE WHEN stage = 'recon_fanout' THEN 5 * j ELSE 0 END AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000000Z') AS ts_utc,
      CASE WHEN stage = 'recon_fanout' THEN '10.20.30.' || (j + 1) WHEN stage = 'micro_exfil' THEN dst_ip END AS dst_ip,
      CASE WHEN stage = 'recon_fanout' THEN CASE WHEN bytes = 0 THEN 60 ELSE bytes END WHEN stage = 'micro_exfil' THEN CASE WHEN bytes = 0 THEN 12000 ELSE bytes END END AS bytes, query FROM x""",
)
def _(spark, d):
    ok, _ = manifests.parse_manifests(manifest_docs(load_telemetry(spark, d)))
    return manifests.manifest_events(ok).select("event_id", "host_id", "ts_utc", "dst_ip", "bytes", "query")


@query(
    "n27_manifest_truth",
    f"""WITH {MAN}, s AS (SELECT pack_id, stage, min(ingest_seq) AS f, array_to_string(list_sort(list(DISTINCT CASE WHEN k % 10 = 3 THEN 'dhcp-' ELSE 'host-' END || h)), ',') AS hs
      FROM live WHERE stage IS NOT NULL GROUP BY 1, 2), g AS (SELECT pack_id, string_agg(stage || ':' || hs, ';' ORDER BY f) AS stages FROM s GROUP BY 1)
    SELECT p.pack_id, CASE WHEN u % 3 = 0 THEN 'host-0,host-1' ELSE 'host-0,host-1,host-2,host-3,host-4,host-5' END AS host_ids, coalesce(stages, '') AS stages
    FROM (SELECT DISTINCT pack_id, user_id AS u FROM st WHERE user_id % 7 <> 0) p LEFT JOIN g USING (pack_id)""",
)
def _(spark, d):
    ok, _ = manifests.parse_manifests(manifest_docs(load_telemetry(spark, d)))
    stages = F.array_join(F.transform("stages", lambda s: F.concat(s["name"], F.lit(":"), F.array_join(s["hosts"], ","))), ";")
    return manifests.manifest_truth(ok).select("pack_id", joined("host_ids"), stages.alias("stages"))


@query("n28_corpus_names", f"WITH {TEL} SELECT ingest_seq, 'host-' || substr(host_id, 6) AS host_id, src, 'prod-' || host_id AS producer_id FROM t")
def _(spark, d):
    ev = load_telemetry(spark, d).withColumns({"host_id": S(F.upper("host_id"), ".Corp.Example"), "src": F.when(c("src").startswith("host-"), F.upper("src")).otherwise(c("src"))})
    return normalize.canonical_corpus(ev).select("ingest_seq", "host_id", "src", "producer_id")


@query(
    "n31_audit_rows",
    f"WITH {TEL} SELECT substr(sha256(event_id), 1, 16) AS id, 'CAMPAIGN UPSERT' AS kind, host_id AS host, 'c' || k || ' · hosts=1 stages=' || CASE WHEN k % 4 = 0 THEN '?' ELSE CAST(k % 4 AS VARCHAR) END AS line FROM t",
)
def _(spark, d):
    ev = load_telemetry(spark, d)
    log = ev.select(F.sha2(c("event_id").cast("binary"), 256).alias("entry_hash"), F.lit("campaign_upsert").alias("kind"), S("c", c("k").cast("string")).alias("campaign_id"), F.array("host_id").alias("hosts"), (c("k") % 4).alias("n_stages"))
    return feed.audit_rows(log)


@query("n32_techniques", f"WITH {TEL} SELECT payload_type, CASE payload_type WHEN 'auth' THEN 'T1078' ELSE '' END AS techniques, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    rows = load_telemetry(spark, d).select("payload_type", F.array_join(reconstruct.techniques_of(c("payload_type")), ",").alias("techniques"))
    return rows.groupBy("payload_type", "techniques").agg(F.count(F.lit(1)).alias("n"))


# --- sources and sinks ---------------------------------------------------------------------------


def envelope_lines(ev):
    body = F.to_json(F.struct(F.lit("event").alias("type"), F.lit("1").alias("schema_ver"), "event_id", "producer_id", "host_id", "ts_utc", "nonce", "payload_type", F.struct("user", "result", "src", "dst_ip", "bytes", "egress", "query").alias("payload"), F.lit("00").alias("hmac")))
    return ev.select(S("/x/pack-", (c("user_id") % 5).cast("string"), ".jsonl").alias("source"), c("ingest_seq").alias("pos"), body.alias("raw"))


@query("s01_envelopes", f"WITH {TEL} SELECT event_id, host_id, payload_type, usr AS \"user\", dst_ip, bytes, query, us FROM t")
def _(spark, d):
    rows = exports.flatten_payload(exports.parse_envelopes(envelope_lines(load_telemetry(spark, d))))
    return rows.select("event_id", "host_id", "payload_type", "user", "dst_ip", "bytes", "query", F.unix_micros("ts").alias("us"))


@query("s02_packs", f"WITH {TEL} SELECT 'pack-' || (user_id % 5) || '.jsonl' AS pack_id, count(*) AS n_events, array_to_string(list_sort(list(DISTINCT host_id)), ',') AS truth_hosts FROM t GROUP BY 1")
def _(spark, d):
    lines = envelope_lines(load_telemetry(spark, d))
    hosts = load_telemetry(spark, d).withColumn("source", S("/x/pack-", (c("user_id") % 5).cast("string"), ".jsonl")).groupBy("source").agg(F.sort_array(F.collect_set("host_id")).alias("host_ids"))
    truth = hosts.select("source", F.lit(-1).cast("bigint").alias("pos"), F.to_json(F.struct(F.lit("ground_truth").alias("type"), c("source").alias("campaign_id"), "host_ids")).alias("raw"))
    events, truths = exports.split_packs(lines.union(truth))
    n = events.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_events"))
    return n.join(truths.select("pack_id", F.array_join("host_ids", ",").alias("truth_hosts")), "pack_id")


@query("s03_s04_document_layouts", f"WITH {W} SELECT pos, channel, event_kind FROM w")
def _(spark, d):
    """Records grouped into small documents of every layout, then taken apart again."""
    raw = windows_raw(load_telemetry(spark, d)).withColumn("doc", F.expr("pos div 25"))
    docs = raw.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda x: F.concat(F.regexp_replace(x["raw"], r"\}$", ""), F.lit(',"n":'), x["pos"].cast("string"), F.lit("}"))).alias("r"))
    body = F.array_join("r", ",")
    text = F.when(c("doc") % 4 == 0, S("[", body, "]")).when(c("doc") % 4 == 1, S('{"Events":[', body, "]}")).when(c("doc") % 4 == 2, S('{"events":[', body, "]}")).otherwise(F.array_join("r", "\n"))
    rows = exports.with_record(exports.split_documents(docs.select(c("doc").cast("string").alias("source"), text.alias("text"))))
    rows = rows.withColumn("pos", c("rec")["n"].cast("bigint"))
    return normalize.parse_windows(rows, INGEST).select("pos", "channel", "event_kind")


@query("s07_connection_log", f"WITH {TEL} SELECT ingest_seq, 'tool' AS image, k AS pid, host_id AS \"user\", CASE WHEN k % 5 = 0 THEN 'fe80::' || k ELSE dst_ip END AS dst_ip, 443 AS dst_port FROM t WHERE payload_type = 'net_conn' AND k % 7 <> 0")
def _(spark, d):
    ev = load_telemetry(spark, d).filter("payload_type = 'net_conn'")
    dst = F.when(c("k") % 7 == 0, "127.0.0.1:443").when(c("k") % 5 == 0, S("[fe80::", c("k").cast("string"), "]:443")).otherwise(S(c("dst_ip"), ":443"))
    line = S("tool  ", c("k").cast("string"), " ", c("host_id"), " 12u IPv4 0x1 0t0 TCP 10.0.0.1:5000->", dst, F.when(c("k") % 2 == 0, " (ESTABLISHED)").otherwise(""))
    head = ev.limit(1).select("ingest_seq", F.lit("COMMAND PID USER FD TYPE DEVICE SIZE NODE NAME->").alias("value"))
    return text_logs.parse_connection_log(ev.select("ingest_seq", line.alias("value")).union(head)).select("ingest_seq", "image", "pid", "user", "dst_ip", "dst_port")


@query(
    "s08_auth_log",
    f"""WITH {TEL} SELECT ingest_seq, CASE WHEN event_type = 'error' THEN 'ssh_fail' WHEN k % 2 = 0 THEN 'ssh_accept' ELSE 'login_success' END AS event_kind, result FROM t WHERE payload_type = 'auth'
    UNION ALL SELECT doc_id, CASE WHEN l LIKE '%accepted%' OR l LIKE '%logged in%' THEN CASE WHEN l LIKE '%ssh%' OR l LIKE '%accepted%' THEN 'ssh_accept' ELSE 'login_success' END ELSE 'ssh_fail' END,
      CASE WHEN l LIKE '%accepted%' OR l LIKE '%logged in%' THEN 'success' ELSE 'failure' END FROM (SELECT doc_id, lower(text) AS l FROM documents) WHERE l LIKE '%accepted%' OR l LIKE '%logged in%' OR l LIKE '%failed%' OR l LIKE '%invalid%'""",
)
def _(spark, d):
    ev = load_telemetry(spark, d)
    line = F.when(c("event_type") == "error", S("sshd: Failed password for ", c("user"))).when(c("payload_type") != "auth", "noise").when(c("k") % 2 == 0, S("sshd: Accepted key ", c("user"))).otherwise(S("User ", c("user"), " Logged In"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").alias("ingest_seq"), c("text").alias("value"))
    return text_logs.parse_auth_log(ev.select("ingest_seq", line.alias("value")).union(docs)).select("ingest_seq", "event_kind", "result")


@query("s09_dns_log", "SELECT page_id, rtrim(q, '.') AS query FROM (SELECT page_id, regexp_extract(url, '([A-Za-z0-9_.-]+\\.[A-Za-z]{2,})', 1) AS q FROM pages) WHERE rtrim(q, '.') <> ''")
def _(spark, d):
    return text_logs.parse_dns_log(spark.read.parquet(f"{d}/pages.parquet").select("page_id", c("url").alias("value"))).select("page_id", "query")


@query("s10_process_list", f"WITH {TEL} SELECT ingest_seq, host_id AS \"user\", CASE WHEN k % 4 <> 1 THEN k END AS pid, 'tool' AS image, CASE WHEN k % 3 = 0 THEN 'tool' ELSE substr('-x ' || repeat('y', 300), 1, 240) END AS command_line FROM t WHERE k % 4 <> 0")
def _(spark, d):
    k = c("k")
    line = F.when(k % 4 == 0, "short line").otherwise(S("  ", c("host_id"), "   ", F.when(k % 4 == 1, "n/a").otherwise(k.cast("string")), " tool", F.when(k % 3 == 0, "").otherwise(S("  -x ", F.repeat(F.lit("y"), 300)))))
    return text_logs.parse_process_list(load_telemetry(spark, d).select("ingest_seq", line.alias("value"))).select("ingest_seq", "user", "pid", "image", "command_line")


@query("s11_allowlist", f"WITH {TEL} SELECT 'sysmon' AS channel, CAST(k AS VARCHAR) AS event_kind FROM t GROUP BY k UNION ALL SELECT * FROM (VALUES ('security','4624'),('security','4625'),('security','4648'),('firewall','2004'),('firewall','2005'),('firewall','2006'),('firewall','5156'),('firewall','5157'),('powershell','4103'),('powershell','4104'))")
def _(spark, d):
    ids = load_telemetry(spark, d).select("k").distinct()
    docs = ids.groupBy().agg(F.to_json(F.struct(F.struct(F.collect_list("k").alias("Microsoft-Windows-Sysmon/Operational")).alias("allowlist"))).alias("value"))
    return dimensions.parse_allowlist(docs, windows_allow(spark), dimensions.WINDOWS_ALIASES)


@query("s12_host_map", f"WITH {TEL}, {HOST_MAP_SQL} SELECT upper(raw) AS raw_host, asset AS host_id FROM hm UNION ALL SELECT raw, asset FROM hm")
def _(spark, d):
    rows = host_map(load_telemetry(spark, d), upper=True)
    docs = rows.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("raw_host", "host_id")))).alias("value"))
    return dimensions.parse_host_map(docs)


@query("s13_fused_sources", f"WITH {TEL} SELECT payload_type AS source, count(*) AS n, count(usr) AS n_users, count(dst_ip) AS n_dst FROM t GROUP BY 1")
def _(spark, d):
    ev = load_telemetry(spark, d)
    parts = {
        "auth": ev.filter("payload_type = 'auth'").select("event_id", "user"), "dns": ev.filter("payload_type = 'dns'").select("event_id", "query"),
        "net_conn": ev.filter("payload_type = 'net_conn'").select("event_id", "dst_ip"),
    }
    return exports.fuse_sources(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("user").alias("n_users"), F.count("dst_ip").alias("n_dst"))


@query("s14_written_events", f"WITH {TEL} SELECT payload_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM t GROUP BY 1")
def _(spark, d):
    import uuid

    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    sinks.write_events(load_telemetry(spark, d), path)
    return spark.read.parquet(path).groupBy("payload_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_date").alias("n_days"))


@query("s15_latest_campaigns", f"WITH {TEL} SELECT 'c' || k AS campaign_id, max(ingest_seq) AS seq, arg_max(host_id, ingest_seq) AS host_id FROM t GROUP BY k")
def _(spark, d):
    return sinks.latest_campaigns(load_telemetry(spark, d).select(S("c", c("k").cast("string")).alias("campaign_id"), c("ingest_seq").alias("seq"), "host_id"))


@query(
    "s15_replaced_run",
    f"""WITH {TEL}, c AS (SELECT 'c' || k AS campaign_id, k, max(ingest_seq) AS seq FROM t GROUP BY k)
    SELECT 'before' AS state, campaign_id, seq FROM c UNION ALL SELECT 'after', campaign_id, seq FROM c WHERE k >= 50 UNION ALL SELECT 'other', campaign_id, seq FROM c WHERE k % 2 = 0""",
)
def _(spark, d):
    """A reader that began before a run was replaced still has the whole old set; the other run is untouched."""
    rows = cut(load_telemetry(spark, d).groupBy("k").agg(F.max("ingest_seq").alias("seq")).withColumn("campaign_id", S("c", c("k").cast("string"))))
    path = f"{shared_folder(spark)}/campaigns-{uuid.uuid4().hex}"
    sinks.write_campaigns(rows, path, "run/1")
    sinks.write_campaigns(rows.filter("k % 2 = 0"), path, "2")
    before = sinks.read_campaigns(spark, path, "run/1")
    sinks.write_campaigns(rows.filter("k >= 50"), path, "run/1")
    parts = {"before": before, "after": sinks.read_campaigns(spark, path, "run/1"), "other": sinks.read_campaigns(spark, path).filter("run_id = '2'")}
    out = None
    for state, part in parts.items():
        part = part.select(F.lit(state).alias("state"), "campaign_id", "seq")
        out = part if out is None else out.unionByName(part)
    return out


@query("s16_prevention_log", f"WITH {TEL} SELECT ingest_seq AS seq, 'c' || k AS campaign_id, host_id AS hosts FROM t WHERE k % 10 <> 3 ORDER BY ingest_seq DESC LIMIT 200")
def _(spark, d):
    ev = load_telemetry(spark, d)
    raw = F.when(c("k") % 10 == 3, "{broken").otherwise(F.to_json(F.struct(S("c", c("k").cast("string")).alias("campaign_id"), F.array("host_id").alias("hosts"))))
    return sinks.prevention_log(ev.select(c("ingest_seq").alias("seq"), raw.alias("raw"))).select("seq", "campaign_id", joined("hosts"))


@query("s17_imported_outcomes", f"WITH {TEL}, o AS (SELECT 'c' || k AS campaign_id, list_sort(list(DISTINCT host_id)) AS hs FROM t GROUP BY k) SELECT campaign_id, len(hs) * 2 AS n_actions FROM o WHERE campaign_id NOT IN (SELECT 'c' || k FROM t WHERE event_type = 'purchase' AND value > 150)")
def _(spark, d):
    ev = load_telemetry(spark, d).withColumn("campaign_id", S("c", c("k").cast("string")))
    out = ev.groupBy("campaign_id").agg(F.sort_array(F.collect_set("host_id")).alias("hosts"))
    return sinks.import_prevention(ev.filter("event_type = 'purchase' and value > 150"), out).select("campaign_id", F.size("actions").alias("n_actions"))


@query("s18_safe_ids", "SELECT url, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_id FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("url", safe_id("url").alias("safe_id"))


def enrollment(ev):
    """(producer_id, host_id, secret): one host per producer."""
    rows = ev.select("producer_id", "host_id").distinct()
    return rows.withColumn("secret", S("signing-key-for-", c("producer_id")).cast("binary"))


@query(
    "s19_enrollment_issues",
    f"""WITH {TEL}, e AS (SELECT DISTINCT 'p' || (user_id % 40) AS p, host_id FROM t), g AS (SELECT p, count(*) AS n FROM e GROUP BY 1)
    SELECT p AS producer_id, 'multihost_producer' AS issue FROM g WHERE n > 1 UNION ALL SELECT p, 'forbidden_secret' FROM g WHERE CAST(substr(p, 2) AS INT) % 10 = 1
    UNION ALL SELECT p, 'short_secret' FROM g WHERE CAST(substr(p, 2) AS INT) % 10 IN (1, 2)""",
)
def _(spark, d):
    rows = load_telemetry(spark, d).select(S("p", (c("user_id") % 40).cast("string")).alias("producer_id"), "host_id", (c("user_id") % 40 % 10).alias("m")).distinct()
    secret = F.when(c("m") == 1, "ChangeMe").when(c("m") == 2, "tooshort").otherwise("a-long-enough-secret")
    return trust.enrollment_issues(rows.withColumn("secret", secret.cast("binary")))


@query("s20_split_producers", f"WITH {TEL}, e AS (SELECT DISTINCT 'p' || (user_id % 40) AS producer_id, host_id FROM t) SELECT *, CASE WHEN host_id = min(host_id) OVER (PARTITION BY producer_id) THEN producer_id ELSE producer_id || '__' || host_id END AS new_producer_id FROM e")
def _(spark, d):
    return trust.split_multihost_producers(load_telemetry(spark, d).select(S("p", (c("user_id") % 40).cast("string")).alias("producer_id"), "host_id"))


# --- trust ---------------------------------------------------------------------------------------


def payloads(ev):
    """Signed-event input whose payload text has unordered keys, blanks and a non-ASCII value."""
    text = S('{"src": "é', c("k").cast("string"), '", "bytes":', c("k").cast("string"), ', "dst_ip": "x"}')
    return ev.select("ingest_seq", "event_id", "producer_id", "host_id", "ts_utc", "ts", "nonce", "payload_type", "k", F.lit("1").alias("schema_ver"), text.alias("payload"))


CANON = "'{\"bytes\":' || k || ',\"dst_ip\":\"x\",\"src\":\"' || chr(92) || 'u00e9' || k || '\"}'"


def pad_sql(mask: int) -> str:
    return f"unhex(array_to_string(list_transform(range(1, 65), lambda i: printf('%02x', xor(CASE WHEN i <= length(s) THEN ascii(substr(s, i, 1)) ELSE 0 END, {mask}))), ''))"


MAC = f"""{TEL}, keys AS (SELECT p, {pad_sql(0x36)} AS ip, {pad_sql(0x5c)} AS op FROM (SELECT DISTINCT producer_id AS p, 'signing-key-for-' || producer_id AS s FROM t)),
  sg AS (SELECT t.*, sha256(op || unhex(sha256(ip || encode(concat_ws('||', '1', producer_id, host_id, event_id, ts_utc, nonce, payload_type, sha256({CANON})))))) AS mac FROM t JOIN keys ON p = producer_id)"""


@query("a01_payload_digest", f"WITH {TEL} SELECT ingest_seq, sha256({CANON}) AS digest FROM t")
def _(spark, d):
    return payloads(load_telemetry(spark, d)).select("ingest_seq", payload_digest(c("payload")).alias("digest"))


@query("a02_signed", f"WITH {MAC} SELECT ingest_seq, mac AS hmac FROM sg")
def _(spark, d):
    ev = load_telemetry(spark, d)
    return trust.sign_events(payloads(ev), enrollment(ev)).select("ingest_seq", "hmac")


def tampered(ev):
    """Signed rows of which some are changed after signing, and some come from an unknown producer."""
    rows = trust.sign_events(payloads(ev), enrollment(ev))
    return rows.withColumns(
        {"ts_utc": F.when(c("k") % 10 == 4, "2020-01-01T00:00:00Z").otherwise(c("ts_utc")), "producer_id": F.when(c("k") % 10 == 5, "stranger").otherwise(c("producer_id"))}
    )


@query("a03_a04_a05_verified", f"WITH {TEL} SELECT ingest_seq, CASE WHEN k % 10 = 5 THEN 'not_enrolled' WHEN k % 10 = 4 THEN 'bad_hmac' END AS reason FROM t")
def _(spark, d):
    ev = load_telemetry(spark, d)
    return trust.verify_events(tampered(ev), enrollment(ev)).select("ingest_seq", "reason")


@query("a04_enrolled", f"WITH {TEL} SELECT ingest_seq, k % 10 <> 5 AS enrolled FROM t")
def _(spark, d):
    ev = load_telemetry(spark, d)
    rows = ev.withColumn("producer_id", F.when(c("k") % 10 == 5, "stranger").otherwise(c("producer_id")))
    return trust.enrollment_check(rows, enrollment(ev)).select("ingest_seq", "enrolled")


@query("a06_dedup", f"WITH {TEL} SELECT 'e' || (ingest_seq // 3) AS event_id, min(ingest_seq) AS ingest_seq, arg_min(host_id, ingest_seq) AS host_id FROM t GROUP BY 1")
def _(spark, d):
    rows = load_telemetry(spark, d).withColumn("event_id", S("e", F.expr("ingest_seq div 3").cast("string")))
    return trust.dedup_events(rows).select("event_id", "ingest_seq", "host_id")


@query("a07_replays", f"WITH {TEL} SELECT ingest_seq, row_number() OVER (PARTITION BY producer_id, k ORDER BY ingest_seq) > 1 AS replay FROM t")
def _(spark, d):
    return trust.mark_replays(load_telemetry(spark, d).withColumn("nonce", c("k").cast("string"))).select("ingest_seq", "replay")


@query("a08_restamped", f"WITH {TEL} SELECT ingest_seq, CASE WHEN k % 10 = 4 THEN 'locally_stamped' END AS provenance, true AS valid FROM t WHERE k % 10 <> 5")
def _(spark, d):
    ev = load_telemetry(spark, d)
    rows = trust.verify_events(trust.restamp(tampered(ev), enrollment(ev)), enrollment(ev))
    return rows.select("ingest_seq", F.get_json_object("payload", "$.provenance").alias("provenance"), c("reason").isNull().alias("valid"))


@query(
    "a09_ingest_counts",
    f"""WITH {TEL} SELECT count(*) FILTER (WHERE st IN ('ok', 'adapted') AND k % 4 <> 3) AS events, count(*) FILTER (WHERE st = 'adapted') AS adapted, count(*) FILTER (WHERE st NOT IN ('ok', 'adapted')) AS skipped,
    count(*) FILTER (WHERE st IN ('ok', 'adapted') AND k % 4 = 3) AS hmac_rejected FROM (SELECT *, CASE k % 5 WHEN 0 THEN 'flat_skip' WHEN 1 THEN 'bad_shape' WHEN 2 THEN 'adapted' ELSE 'ok' END AS st FROM t)""",
)
def _(spark, d):
    k = c("k")
    status = F.when(k % 5 == 0, "flat_skip").when(k % 5 == 1, "bad_shape").when(k % 5 == 2, "adapted").otherwise("ok")
    return trust.ingest_counts(load_telemetry(spark, d).withColumns({"status": status, "reason": F.when(k % 4 == 3, "bad_hmac")}))


@query(
    "a10_chain",
    f"""WITH {TEL}, b AS (SELECT user_id % 50 AS run_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ingest_seq) AS seq, k, host_id FROM t)
    SELECT run_id, seq, (seq < 3) AS valid FROM b""",
)
def _(spark, d):
    """Entries of every run are chained; then the third one is changed, which breaks it and all after it by one link."""
    from hostweave.session import with_place_rank

    ev = load_telemetry(spark, d).withColumn("run_id", c("user_id") % 50)
    rows = with_place_rank(ev, "ingest_seq", "seq", ["run_id"]).select("run_id", "seq", F.lit("campaign_upsert").alias("kind"), F.to_json(F.struct("host_id", "k")).alias("payload"))
    log = trust.append_chain(rows).withColumn("entry_hash", F.when(c("seq") >= 3, F.sha2(F.concat("entry_hash", F.lit("x")).cast("binary"), 256)).otherwise(c("entry_hash")))
    return trust.verify_chain(log, ["run_id"]).select("run_id", "seq", "valid")
