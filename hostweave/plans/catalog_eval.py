"""Reconstruction, proposals, evaluation and streaming, over campaigns and truths derived from the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostweave.config import FuseConfig
from hostweave.functions.sets import jaccard
from hostweave.operators import evaluate as ev
from hostweave.operators import fleet_eval as fl
from hostweave.operators import reconstruct as rc
from hostweave.operators.trust import sign_events
from hostweave.plans.catalog_base import TEL, joined, query, r6
from hostweave.plans.catalog_normal import enrollment, payloads
from hostweave.plans.telemetry import load_telemetry, telemetry
from hostweave.session import cut, shared_folder
from hostweave.sources.sinks import read_campaigns
from hostweave.streaming import live
from hostweave.streaming.state import StepState, capped_step, session_step

c = F.col
S = lambda *p: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in p])
NOW = "2026-01-01T00:00:00Z"

# Campaign-like groups: two kinds (by value) per (user, k % 4), hosts h0..h6, stages from event types.
STAGE_SQL = "CASE event_type WHEN 'signup' THEN 'lateral_auth' WHEN 'purchase' THEN 'micro_exfil' WHEN 'view' THEN 'dns_beacon' WHEN 'error' THEN 'recon_fanout' ELSE CASE WHEN k < 20 THEN 'odd' ELSE 'dns_beacon' END END"


def _stage():
    et = c("event_type")
    return F.when(et == "signup", "lateral_auth").when(et == "purchase", "micro_exfil").when(et == "view", "dns_beacon").when(et == "error", "recon_fanout").when(c("k") < 20, "odd").otherwise("dns_beacon")


def groups(spark, d):
    t = load_telemetry(spark, d).withColumns(
        {"stage": _stage(), "h": S("h", (F.expr("k div 4") % 7).cast("string")), "pack_id": S("p", c("user_id").cast("string")), "idx": (c("k") % 4 + F.when(c("value") > 90, 0).otherwise(4)).cast("int")}
    )
    return t


def campaign_rows(spark, d):
    """(pack_id, idx, campaign_id, host_ids, stages, score, evidence)"""
    g = groups(spark, d)
    st = g.groupBy("pack_id", "idx", "stage").agg(F.sort_array(F.collect_set("h")).alias("hosts"))
    st = st.groupBy("pack_id", "idx").agg(F.sort_array(F.collect_list(F.struct(c("stage").alias("name"), "hosts"))).alias("stages"))
    base = g.groupBy("pack_id", "idx").agg(
        F.sort_array(F.collect_set("h")).alias("host_ids"), F.when(F.max("value") > 150, 1.0).otherwise(0.8).alias("score"),
        F.sort_array(F.collect_set(F.struct(c("stage").alias("kind"), c("h").alias("host_id")))).alias("evidence"),
    )
    return base.join(st, ["pack_id", "idx"]).withColumn("campaign_id", S(c("pack_id"), "-c", c("idx").cast("string")))


G = f"""{TEL}, g AS (SELECT *, 'p' || user_id AS pack_id, k % 4 + CASE WHEN value > 90 THEN 0 ELSE 4 END AS idx, {STAGE_SQL} AS stage, 'h' || ((k // 4) % 7) AS h FROM t),
  cs AS (SELECT pack_id, idx, stage, list_sort(list(DISTINCT h)) AS hosts FROM g GROUP BY ALL),
  ca AS (SELECT pack_id, idx, pack_id || '-c' || idx AS campaign_id, list_sort(list(DISTINCT h)) AS host_ids, CASE WHEN max(value) > 150 THEN 1.0 ELSE 0.8 END::DOUBLE AS score,
    list_sort(list(DISTINCT stage)) AS names, count(DISTINCT stage) AS n_steps FROM g GROUP BY 1, 2),
  tr AS (SELECT 'p' || user_id AS pack_id, coalesce(list_sort(list(DISTINCT 'h' || ((k // 4) % 7)) FILTER (WHERE value BETWEEN 50 AND 120 AND event_type <> 'click')), []) AS truth_hosts,
    coalesce(list_sort(list(DISTINCT {STAGE_SQL}) FILTER (WHERE value BETWEEN 50 AND 120 AND event_type <> 'click')), []) AS truth_stages,
    CASE WHEN user_id % 5 = 0 THEN 'benign' WHEN user_id % 2 = 0 THEN 'lateral' ELSE 'exfil' END AS family FROM t GROUP BY user_id)"""
TECH_SQL = "CASE stage WHEN 'lateral_auth' THEN 'T1078,T1021' WHEN 'micro_exfil' THEN 'T1041' WHEN 'dns_beacon' THEN 'T1071.004' WHEN 'recon_fanout' THEN 'T1046' ELSE '' END"
JAC = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


def truth_rows(spark, d):
    """(pack_id, truth_idx, truth_id, truth_hosts, truth_stages, family), one per pack."""
    hit = F.expr("value between 50 and 120 and event_type <> 'click'")
    u = c("user_id")
    rows = load_telemetry(spark, d).groupBy("user_id").agg(
        F.sort_array(F.collect_set(F.when(hit, S("h", (F.expr("k div 4") % 7).cast("string"))))).alias("truth_hosts"), F.sort_array(F.collect_set(F.when(hit, _stage()))).alias("truth_stages")
    )
    family = F.when(u % 5 == 0, "benign").when(u % 2 == 0, "lateral").otherwise("exfil")
    return rows.select(S("p", u.cast("string")).alias("pack_id"), F.lit(0).alias("truth_idx"), S("t", u.cast("string")).alias("truth_id"), "truth_hosts", "truth_stages", family.alias("family"))


def pred_rows(spark, d):
    names = F.transform("stages", lambda s: s["name"])
    return campaign_rows(spark, d).select("pack_id", "idx", "campaign_id", "host_ids", names.alias("stage_names"), "score")


# --- reconstruction ------------------------------------------------------------------------------


@query(
    "r01_steps",
    f"""WITH {G} SELECT campaign_id, CAST(row_number() OVER (PARTITION BY campaign_id ORDER BY stage) AS INT) AS step, stage AS name, array_to_string(hosts, ',') AS hosts, {TECH_SQL} AS techniques,
    round(least(1.0, 0.35 + 0.25 * score + 0.2), 3) AS confidence, true AS verified FROM cs JOIN ca USING (pack_id, idx)""",
)
def _(spark, d):
    rows = rc.reconstruct(campaign_rows(spark, d)).select("campaign_id", F.explode("steps").alias("s"))
    return rows.select("campaign_id", "s.step", "s.name", F.array_join("s.hosts", ",").alias("hosts"), F.array_join("s.techniques", ",").alias("techniques"), "s.confidence", "s.verified")


@query(
    "r02_evidence_steps",
    f"""WITH {G} SELECT campaign_id, stage AS name, array_to_string(hosts, ',') AS hosts, round(least(0.55, 0.3 + 0.2 * score), 3) AS confidence, 'partial' AS status FROM cs JOIN ca USING (pack_id, idx)""",
)
def _(spark, d):
    rows = rc.reconstruct(campaign_rows(spark, d).withColumn("stages", F.filter("stages", lambda s: F.lit(False))))
    rows = rows.select("campaign_id", "status", F.explode("steps").alias("s"))
    return rows.select("campaign_id", "s.name", F.array_join("s.hosts", ",").alias("hosts"), "s.confidence", "status")


RSQL = f"""{G}, rj AS (SELECT ca.*, truth_hosts, truth_stages, {JAC.format(a='host_ids', b='truth_hosts')} AS hj, {JAC.format(a='names', b='truth_stages')} AS sj FROM ca LEFT JOIN tr USING (pack_id)),
  rg AS (SELECT *, (hj >= 0.99 AND sj >= 0.99) AS fm, (CASE WHEN list_contains(names, 'odd') THEN 1 ELSE 0 END + CASE WHEN len(host_ids) < 2 THEN 1 ELSE 0 END
    + CASE WHEN len(list_filter(truth_hosts, lambda x: NOT list_contains(host_ids, x))) > 0 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(host_ids, lambda x: NOT list_contains(truth_hosts, x))) > 0 THEN 1 ELSE 0 END
    + CASE WHEN NOT (hj >= 0.99 AND sj >= 0.99) THEN 1 ELSE 0 END) AS n_gaps FROM rj),
  rs AS (SELECT *, CASE WHEN n_gaps > 0 THEN 'partial' ELSE 'complete' END AS status,
    (list_has_any(names, ['micro_exfil', 'dns_beacon']) OR (list_contains(names, 'recon_fanout') AND list_contains(names, 'lateral_auth'))) AS contain FROM rg)"""


def rebuilt(spark, d):
    return rc.reconstruct(campaign_rows(spark, d), truth_rows(spark, d), ["pack_id"])


@query("r03_gaps", f"WITH {RSQL} SELECT campaign_id, n_gaps FROM rs")
def _(spark, d):
    return rebuilt(spark, d).select("campaign_id", F.size("gaps").alias("n_gaps"))


@query("r04_truth_comparison", f"WITH {RSQL} SELECT campaign_id, round(hj, 4) AS host_jaccard, round(sj, 4) AS stage_jaccard, array_to_string(list_sort(list_filter(truth_hosts, lambda x: NOT list_contains(host_ids, x))), ',') AS missing_hosts, fm AS full_match FROM rs")
def _(spark, d):
    return rebuilt(spark, d).select("campaign_id", "host_jaccard", "stage_jaccard", F.array_join("missing_hosts", ",").alias("missing_hosts"), "full_match")


@query(
    "r05_status",
    f"WITH {RSQL} SELECT campaign_id, status, round(CASE WHEN status = 'partial' THEN least(0.75, 0.25 + 0.15 * n_steps + 0.1 * len(host_ids)) ELSE least(0.95, 0.55 + 0.1 * n_steps + 0.05 * len(host_ids)) END, 3) AS confidence FROM rs",
)
def _(spark, d):
    return rebuilt(spark, d).select("campaign_id", "status", "confidence")


@query("r06_containment", f"WITH {RSQL} SELECT campaign_id, contain FROM rs")
def _(spark, d):
    return rebuilt(spark, d).select("campaign_id", (~c("plan_refused")).alias("contain"))


@query(
    "r07_quarantine",
    f"""WITH {RSQL}, w AS (SELECT pack_id, idx, arg_min(hosts[2], stage) AS c1 FROM cs WHERE len(hosts) >= 2 GROUP BY 1, 2)
    SELECT campaign_id, CASE WHEN contain THEN array_to_string(host_ids, ',') ELSE '' END AS quarantine_hosts, CASE WHEN contain AND len(host_ids) >= 2 THEN coalesce(c1, host_ids[2]) END AS cut_point
    FROM rs LEFT JOIN w USING (pack_id, idx)""",
)
def _(spark, d):
    return rebuilt(spark, d).select("campaign_id", F.array_join("quarantine_hosts", ",").alias("quarantine_hosts"), "cut_point")


@query("r08_run_summary", f"WITH {RSQL} SELECT pack_id, count(*) AS n_campaigns, count(*) FILTER (WHERE status = 'complete') AS n_complete, CASE WHEN count(*) FILTER (WHERE status <> 'complete') = 0 THEN 'complete' ELSE 'partial' END AS aggregate_status FROM rs GROUP BY 1")
def _(spark, d):
    return rc.run_summary(rebuilt(spark, d), ["pack_id"]).select("pack_id", "n_campaigns", "n_complete", "aggregate_status")


@query(
    "r09_manifest_rows",
    f"""WITH {G} SELECT campaign_id, CASE stage WHEN 'lateral_auth' THEN 'auth' WHEN 'micro_exfil' THEN 'exfil' WHEN 'recon_fanout' THEN 'recon' ELSE 'unknown' END AS kind, unnest(hosts) AS host,
    nullif(split_part({TECH_SQL}, ',', 1), '') AS technique FROM cs JOIN ca USING (pack_id, idx)""",
)
def _(spark, d):
    return rc.manifest_rows(rebuilt(spark, d)).select("campaign_id", "kind", "host", "technique")


@query("r09_truth_rows", f"WITH {G} SELECT campaign_id, array_to_string(host_ids, ',') AS host_ids, n_steps AS n_stages FROM ca")
def _(spark, d):
    return rc.truth_rows(rebuilt(spark, d)).select("campaign_id", F.array_join("host_ids", ",").alias("host_ids"), F.size("stages").cast("bigint").alias("n_stages"))


@query(
    "r10_proposals",
    f"""WITH {RSQL}, h AS (SELECT DISTINCT unnest(host_ids) AS host_id FROM rs WHERE contain)
    SELECT host_id, substr(sha256('IsolateHost|{{"host_id": "' || host_id || '"}}|campaign evidence|{NOW}'), 1, 32) AS idempotency_key, '2026-01-01T00:05:00Z' AS expiry, true AS dry_run FROM h""",
)
def _(spark, d):
    rows = rc.proposals(rc.isolation_hosts(rebuilt(spark, d)), NOW, F.lit("campaign evidence"))
    return rows.select("host_id", "idempotency_key", "expiry", "dry_run")


@query(
    "r11_validated",
    f"""WITH {TEL}, b AS (SELECT ingest_seq AS seq, k, 'key-' || (ingest_seq // 2) AS ik, CASE WHEN k % 10 = 0 THEN 'unknown_verb' WHEN k % 10 = 1 THEN 'dry_run' WHEN k % 10 = 2 THEN 'bad_expiry' WHEN k % 10 = 3 THEN 'expired'
      WHEN k % 10 = 4 THEN 'authz' WHEN k % 10 = 5 THEN 'no_host' END AS r FROM t)
    SELECT seq, coalesce(r, CASE WHEN seq > min(CASE WHEN r IS NULL THEN seq END) OVER (PARTITION BY ik) THEN 'replay' END) AS reason FROM b""",
)
def _(spark, d):
    m = c("k") % 10
    rows = load_telemetry(spark, d).select(
        c("ingest_seq").alias("seq"), S("key-", F.expr("ingest_seq div 2").cast("string")).alias("idempotency_key"), F.when(m == 0, "Reboot").otherwise("IsolateHost").alias("verb"), (m == 1).alias("dry_run"),
        F.when(m == 2, "soon").when(m == 3, "2020-01-01T00:00:00Z").otherwise("2027-01-01T00:00:00Z").alias("expiry"), F.when(m == 4, "wrong").otherwise("token").alias("authz"),
        F.when(m == 5, "").otherwise(c("host_id")).alias("host_id"),
    )
    return rc.validate_proposals(rows, NOW, "token").select("seq", "reason")


@query("r12_isolation_hosts", f"WITH {RSQL} SELECT DISTINCT pack_id, unnest(host_ids) AS host_id FROM rs WHERE contain")
def _(spark, d):
    return rc.isolation_hosts(rebuilt(spark, d), ["pack_id"])


# --- evaluation ----------------------------------------------------------------------------------

PAIR_SQL = f"""{G}, pj AS (SELECT ca.pack_id, ca.idx, ca.campaign_id, score, {JAC.format(a='host_ids', b='truth_hosts')} AS j, list_has_any(names, truth_stages) AS so, family FROM ca JOIN tr USING (pack_id)),
  mp AS (SELECT * FROM pj WHERE j >= 0.5 AND so AND family <> 'benign')"""


@query("e01_jaccard", f"WITH {PAIR_SQL} SELECT campaign_id, round(j, 6) AS j FROM pj")
def _(spark, d):
    rows = pred_rows(spark, d).join(truth_rows(spark, d).select("pack_id", "truth_hosts"), "pack_id")
    return rows.select("campaign_id", F.round(jaccard("host_ids", "truth_hosts"), 6).alias("j"))


@query("e02_match_pairs", f"WITH {PAIR_SQL} SELECT campaign_id, round(j, 6) AS jaccard FROM mp")
def _(spark, d):
    return ev.match_pairs(pred_rows(spark, d), truth_rows(spark, d)).select("campaign_id", r6("jaccard"))


@query("e02_greedy_matches", f"WITH {PAIR_SQL} SELECT pack_id, arg_max(campaign_id, (j, idx)) AS campaign_id FROM mp GROUP BY 1")
def _(spark, d):
    return ev.greedy_matches(cut(ev.match_pairs(pred_rows(spark, d), truth_rows(spark, d)))).select("pack_id", "campaign_id")


def many_truths(spark, d):
    """Up to five truths per pack, so that matching and assignment have real choices."""
    place = F.when(F.expr("value < 40 and event_type in ('purchase', 'view', 'error')"), c("k") % 3).otherwise(3 + c("k") % 2)
    rows = load_telemetry(spark, d).groupBy("user_id", place.cast("int").alias("truth_idx")).agg(
        F.sort_array(F.collect_set(S("h", (F.expr("k div 4") % 7).cast("string")))).alias("truth_hosts"), F.sort_array(F.collect_set(_stage())).alias("truth_stages")
    )
    pack = S("p", c("user_id").cast("string"))
    return rows.select(pack.alias("pack_id"), "truth_idx", S(pack, "-t", c("truth_idx").cast("string")).alias("truth_id"), "truth_hosts", "truth_stages", F.lit("attack").alias("family"))


MANY_SQL = f"""{G}, mt2 AS (SELECT 'p' || user_id AS pack_id, CASE WHEN value < 40 AND event_type IN ('purchase', 'view', 'error') THEN k % 3 ELSE 3 + k % 2 END AS ti,
    list_sort(list(DISTINCT 'h' || ((k // 4) % 7))) AS th, list_sort(list(DISTINCT {STAGE_SQL})) AS ts FROM t GROUP BY 1, 2)"""
# The greedy pass: the best pair of every pack, then what shares neither end with it, again.
GREEDY_SQL = f"""{MANY_SQL}, pm AS (SELECT pack_id, idx, ti, campaign_id, {JAC.format(a='host_ids', b='th')} AS j FROM ca JOIN mt2 USING (pack_id) WHERE list_has_any(names, ts)),
  s0 AS (SELECT pack_id, list({{'i': idx, 't': ti, 'c': campaign_id, 'j': j}} ORDER BY j DESC, idx DESC, ti DESC) AS l FROM pm WHERE j >= 0.5 GROUP BY 1),
  gr(pack_id, l, m) AS (SELECT pack_id, l, l[len(l) + 1] FROM s0 UNION ALL SELECT pack_id, list_filter(l, lambda q: q.i <> l[1].i AND q.t <> l[1].t), l[1] FROM gr WHERE len(l) > 0)"""
# Truths in order, each taking the best campaign left (the earliest on ties).
ASSIGN_SQL = f"""{MANY_SQL}, tl AS (SELECT pack_id, list({{'ti': ti, 'th': th}} ORDER BY ti) AS tl, count(DISTINCT th) < count(*) AS reuse FROM mt2 GROUP BY 1),
  pl AS (SELECT pack_id, list({{'i': idx, 'c': campaign_id, 'h': host_ids}} ORDER BY idx) AS pl FROM ca GROUP BY 1),
  ar(pack_id, n, used, ti, w) AS (SELECT pack_id, 0, []::BIGINT[], NULL::INTEGER, NULL::STRUCT(j DOUBLE, i BIGINT, c VARCHAR) FROM tl
    UNION ALL SELECT pack_id, n + 1, CASE WHEN w IS NULL THEN used ELSE list_append(used, w.i) END, tr.ti, w FROM (
      SELECT pack_id, n, used, tr, list_sort(list_transform(list_filter(pl, lambda q: reuse OR NOT list_contains(used, q.i)),
        lambda q: {{'j': -({JAC.format(a='q.h', b='tr.th')}), 'i': q.i, 'c': q.c}}))[1]::STRUCT(j DOUBLE, i BIGINT, c VARCHAR) AS w
      FROM (SELECT ar.pack_id, n, used, tl[n + 1] AS tr, reuse, pl FROM ar JOIN tl USING (pack_id) LEFT JOIN pl USING (pack_id) WHERE n < len(tl)))),
  asg AS (SELECT pack_id, ti, w.c AS campaign_id, coalesce(-w.j, 0.0) AS j FROM ar WHERE ti IS NOT NULL)"""


@query("e02_greedy_matches_many", f"WITH RECURSIVE {GREEDY_SQL} SELECT pack_id, m.c AS campaign_id, pack_id || '-t' || m.t AS truth_id, round(m.j, 6) AS jaccard FROM gr WHERE m IS NOT NULL")
def _(spark, d):
    return ev.greedy_matches(cut(ev.match_pairs(pred_rows(spark, d), many_truths(spark, d)))).select("pack_id", "campaign_id", "truth_id", r6("jaccard"))


@query("e04_precision_at_1", f"WITH {PAIR_SQL}, top AS (SELECT pack_id, arg_max(idx, (score, -idx)) AS idx FROM ca GROUP BY 1) SELECT pack_id, CASE WHEN mp.idx IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS precision_at_1 FROM top LEFT JOIN mp USING (pack_id, idx)")
def _(spark, d):
    return ev.precision_at_1(pred_rows(spark, d), truth_rows(spark, d))


ISO = f"""{G}, ph AS (SELECT DISTINCT pack_id, unnest(host_ids) AS h FROM ca), th AS (SELECT pack_id, unnest(truth_hosts) AS h FROM tr WHERE family <> 'benign'),
  io AS (SELECT tr.pack_id, family, (SELECT count(*) FROM ph WHERE ph.pack_id = tr.pack_id) AS np, (SELECT count(*) FROM ph JOIN th USING (pack_id, h) WHERE ph.pack_id = tr.pack_id) AS ok,
    (SELECT count(*) FROM th WHERE th.pack_id = tr.pack_id) AS nt FROM tr)"""


@query(
    "e06_isolation_metrics",
    f"""WITH {ISO} SELECT pack_id, np AS hosts_proposed, ok AS hosts_correct, np - ok AS false_isolates, nt - ok AS missed_hosts, round(CASE WHEN np > 0 THEN (np - ok) / np ELSE 0 END, 6) AS false_isolate_rate,
    round(CASE WHEN family = 'benign' THEN CASE WHEN np > 0 THEN 0 ELSE 1 END WHEN np > 0 THEN ok / np ELSE 0 END, 6) AS isolate_precision, round(CASE WHEN family = 'benign' THEN 1 ELSE ok / nt END, 6) AS isolate_recall FROM io""",
)
def _(spark, d):
    rows = ev.isolation_metrics(pred_rows(spark, d), truth_rows(spark, d))
    return rows.select("pack_id", "hosts_proposed", "hosts_correct", "false_isolates", "missed_hosts", r6("false_isolate_rate"), r6("isolate_precision"), r6("isolate_recall"))


SC = f"""{PAIR_SQL}, np AS (SELECT pack_id, count(*) AS n FROM ca GROUP BY 1), top AS (SELECT pack_id, arg_max(idx, (score, -idx)) AS idx FROM ca GROUP BY 1),
  sc0 AS (SELECT pack_id, family, family = 'benign' AS b, coalesce(n, 0) AS n, CASE WHEN pack_id IN (SELECT pack_id FROM mp) THEN 1 ELSE 0 END AS hit,
    CASE WHEN pack_id IN (SELECT pack_id FROM top JOIN mp USING (pack_id, idx)) THEN 1.0 ELSE 0.0 END AS p1 FROM tr LEFT JOIN np USING (pack_id)),
  sc AS (SELECT pack_id, family, b AS benign, CASE WHEN b THEN 0 ELSE hit END AS tp, CASE WHEN b THEN n ELSE n - hit END AS fp, CASE WHEN b THEN 0 ELSE 1 - hit END AS fn,
    CASE WHEN b THEN CASE WHEN n = 0 THEN 1 ELSE 0 END WHEN n > 0 THEN hit / n ELSE 0 END AS prec, CASE WHEN b THEN CASE WHEN n = 0 THEN 1 ELSE 0 END ELSE hit END AS rec,
    CASE WHEN b THEN CASE WHEN n = 0 THEN 1 ELSE 0 END WHEN hit = 1 THEN 2.0 * (hit / n) / (hit / n + 1) ELSE 0 END AS f1, CASE WHEN b THEN CASE WHEN n = 0 THEN 1 ELSE 0 END ELSE p1 END AS p1,
    CASE WHEN b AND n > 0 THEN 1.0 ELSE 0.0 END AS fcr FROM sc0)"""


@query(
    "e03_e05_e07_pack_scores",
    f"WITH {SC} SELECT pack_id, family, tp, fp, fn, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS campaign_f1, round(p1, 6) AS precision_at_1, round(fcr, 6) AS false_campaign_rate FROM sc",
)
def _(spark, d):
    rows = ev.score_packs(cut(pred_rows(spark, d)), cut(truth_rows(spark, d)))
    return rows.select("pack_id", "family", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("campaign_f1"), r6("precision_at_1"), r6("false_campaign_rate"))


def agg_sql(by: str = "") -> str:
    g = f"{by}, " if by else ""
    return (
        f"WITH {SC}, a AS (SELECT {g}count(*) FILTER (WHERE NOT benign) AS na, avg(f1) FILTER (WHERE NOT benign) AS f1, avg(p1) FILTER (WHERE NOT benign) AS p1, coalesce(sum(tp) FILTER (WHERE NOT benign), 0) AS tp, "
        f"coalesce(sum(fp) FILTER (WHERE NOT benign), 0) AS fp, coalesce(sum(fn) FILTER (WHERE NOT benign), 0) AS fn, coalesce(avg(fcr) FILTER (WHERE benign), 0) AS fcr FROM sc {'GROUP BY 1' if by else ''}) "
        f"SELECT {g}round(CASE WHEN na > 0 THEN f1 ELSE 1 - fcr END, 6) AS campaign_f1, round(CASE WHEN na > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END ELSE 1 - fcr END, 6) AS precision, "
        f"round(CASE WHEN na > 0 THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END WHEN fcr = 0 THEN 1 ELSE 0 END, 6) AS recall, round(CASE WHEN na > 0 THEN p1 ELSE 1 - fcr END, 6) AS precision_at_1, round(fcr, 6) AS false_campaign_rate FROM a"
    )


def _scores(spark, d):
    return cut(ev.score_packs(cut(pred_rows(spark, d)), cut(truth_rows(spark, d))))


AGG = ("campaign_f1", "precision", "recall", "precision_at_1", "false_campaign_rate")


@query("e08_aggregate", agg_sql())
def _(spark, d):
    return ev.aggregate_scores(_scores(spark, d)).select(*[r6(x) for x in AGG])


@query("e09_by_family", agg_sql("family"))
def _(spark, d):
    return ev.aggregate_scores(_scores(spark, d), ["family"]).select("family", *[r6(x) for x in AGG])


@query("e10_pooled_isolation", f"WITH {ISO} SELECT sum(np)::BIGINT AS hosts_proposed, sum(ok)::BIGINT AS hosts_correct, round(sum(np - ok) / sum(np), 6) AS false_isolate_rate, round(sum(ok) / sum(nt), 6) AS isolate_recall FROM io")
def _(spark, d):
    rows = ev.pooled_isolation(ev.isolation_metrics(pred_rows(spark, d), truth_rows(spark, d)))
    return rows.select("hosts_proposed", "hosts_correct", r6("false_isolate_rate"), r6("isolate_recall"))


@query(
    "e11_lift",
    agg_sql("family").replace("SELECT family, round(CASE", "SELECT family, round(CASE WHEN na > 0 THEN f1 ELSE 1 - fcr END - 0.25, 6) AS f1_lift, round(CASE", 1).replace(" FROM a", " FROM a"),
)
def _(spark, d):
    ours = cut(ev.aggregate_scores(_scores(spark, d), ["family"]))
    base = ours.select("family", F.lit(0.25).alias("campaign_f1"), *[x for x in ev.METRICS if x != "campaign_f1"])
    rows = ev.lift(ours, base, ["family"]).join(ours.select("family", "precision_at_1"), "family")
    return rows.select("family", r6("f1_lift"), *[r6(x) for x in AGG])


@query(
    "e12_pass_bars",
    f"""WITH {SC} SELECT pack_id, concat_ws(',', CASE WHEN f1 < 0.7 THEN 'f1_below_bar' END, CASE WHEN f1 < 0.5 THEN 'f1_below_b2' END, CASE WHEN prec < 0.8 THEN 'precision' END, CASE WHEN rec < 0.7 THEN 'recall' END,
    CASE WHEN p1 < 0.8 THEN 'precision_at_1' END, CASE WHEN fcr > 0.1 THEN 'false_campaign_rate' END, CASE WHEN NOT (f1 >= 0.6 - 0.05 OR f1 >= 0.5) THEN 'ablation' END) AS reasons FROM sc""",
)
def _(spark, d):
    rows = _scores(spark, d).withColumns({"b2_f1": F.lit(0.5), "detector_f1": F.lit(0.6)})
    return ev.pass_reasons(rows).select("pack_id", F.array_join("reasons", ",").alias("reasons"))


BRK = f"""{PAIR_SQL}, dt AS (SELECT pack_id, idx, h FROM g), dj0 AS (SELECT pack_id, idx, stage, list_sort(list(DISTINCT h)) AS dh FROM g GROUP BY ALL),
  dj AS (SELECT dj0.pack_id, max({JAC.format(a='dh', b='truth_hosts')}) AS dbest, count(*) AS nd FROM dj0 JOIN tr USING (pack_id) GROUP BY 1),
  fj AS (SELECT pack_id, max(j) AS fbest, arg_max(campaign_id, (j, -idx)) AS bc FROM pj GROUP BY 1), fu AS (SELECT pack_id, list(DISTINCT h) AS fh FROM g GROUP BY 1),
  br AS (SELECT tr.pack_id, coalesce(fbest, 0) AS fbest, coalesce(dbest, 0) AS dbest, coalesce(nd, 0) AS nd, truth_hosts, coalesce(fh, []) AS fh, coalesce(b.host_ids, []) AS bh
    FROM tr LEFT JOIN fj USING (pack_id) LEFT JOIN dj USING (pack_id) LEFT JOIN fu USING (pack_id) LEFT JOIN ca b ON b.campaign_id = bc)"""


def _diff(a: str, b: str) -> str:
    return f"array_to_string(list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x))), ',')"


def stage_preds(spark, d):
    """Detector-like predictions: one per (pack, group, stage)."""
    g = groups(spark, d).groupBy("pack_id", "idx", "stage").agg(F.sort_array(F.collect_set("h")).alias("host_ids"))
    place = F.hash("stage", "idx").cast("bigint")
    return g.select("pack_id", place.alias("idx"), S(c("pack_id"), "-", c("stage")).alias("campaign_id"), "host_ids", F.lit(0.5).alias("score"))


def breaks(spark, d):
    return ev.break_points(truth_rows(spark, d), pred_rows(spark, d), stage_preds(spark, d))


@query(
    "e13_break_points",
    f"""WITH {BRK} SELECT pack_id, round(fbest, 4) AS best_jaccard, fbest >= 0.5 AS matched, {_diff('truth_hosts', 'fh')} AS missed_hosts, {_diff('bh', 'truth_hosts')} AS over_merged_hosts,
    {_diff('list_filter(fh, lambda y: NOT list_contains(bh, y))', 'truth_hosts')} AS secondary_hosts, fbest >= 0.5 AND dbest < 0.5 AS fusion_lift, fbest < 0.5 AND dbest < 0.5 AS both_missed, nd >= 2 AND dbest < 0.5 AS detector_fragmented FROM br""",
)
def _(spark, d):
    txt = lambda n: F.array_join(n, ",").alias(n)
    return breaks(spark, d).select("pack_id", "best_jaccard", "matched", txt("missed_hosts"), txt("over_merged_hosts"), txt("secondary_hosts"), "fusion_lift", "both_missed", "detector_fragmented")


@query("e14_thin_alerts", f"WITH {PAIR_SQL} SELECT campaign_id, round(j, 4) AS jaccard FROM pj WHERE j < 0.5")
def _(spark, d):
    return ev.thin_alerts(pred_rows(spark, d), truth_rows(spark, d)).select("campaign_id", "jaccard")


@query("e14_ranked_campaigns", f"WITH {PAIR_SQL} SELECT campaign_id, row_number() OVER (PARTITION BY pack_id ORDER BY round(j, 4) DESC, score DESC, idx) AS place FROM pj")
def _(spark, d):
    return ev.ranked_campaigns(pred_rows(spark, d), truth_rows(spark, d)).select("campaign_id", "place")


@query("e14_score_margin", f"WITH {G}, r AS (SELECT pack_id, score, row_number() OVER (PARTITION BY pack_id ORDER BY score DESC) AS p FROM ca) SELECT pack_id, round(max(score) FILTER (WHERE p = 1) - coalesce(max(score) FILTER (WHERE p = 2), 0), 4) AS score_margin FROM r GROUP BY 1")
def _(spark, d):
    return ev.score_margin(pred_rows(spark, d))


@query(
    "e15_break_summary",
    f"WITH {BRK} SELECT count(*) AS n_packs, count(*) FILTER (WHERE fbest >= 0.5 AND dbest < 0.5) AS fusion_lift_count, count(*) FILTER (WHERE fbest < 0.5 AND dbest < 0.5) AS both_missed_count, count(*) FILTER (WHERE {_diff('truth_hosts', 'fh')} <> '') AS n_missed FROM br",
)
def _(spark, d):
    return ev.break_summary(breaks(spark, d)).select("n_packs", "fusion_lift_count", "both_missed_count", F.size("packs_with_missed_hosts").cast("bigint").alias("n_missed"))


@query(
    "e16_rebuild_regression",
    f"""WITH {RSQL}, b AS (SELECT pack_id, arg_max(status, (hj, -idx)) AS st, max(hj) AS hj FROM rs GROUP BY 1)
    SELECT pack_id, family, CASE WHEN family = 'benign' THEN b.pack_id IS NULL ELSE coalesce(hj >= 0.5, false) END AS ok, CASE WHEN family = 'benign' THEN CASE WHEN b.pack_id IS NULL THEN 'empty' ELSE 'false_campaign' END
    ELSE coalesce(st, 'insufficient_evidence') END AS status FROM tr LEFT JOIN b USING (pack_id)""",
)
def _(spark, d):
    return ev.rebuild_regression(campaign_rows(spark, d), truth_rows(spark, d)).select("pack_id", "family", "ok", "status")


@query("e17_host_hours", f"WITH {TEL} SELECT host_id, round((max(us) - min(us)) / 3.6e9, 6) AS host_hours FROM t GROUP BY 1")
def _(spark, d):
    return fl.host_hours(load_telemetry(spark, d))


WIDE_SQL = f"""{TEL}, s AS (SELECT host_id AS h, CASE WHEN k % 5 = 4 THEN 'peer' || (k % 9) ELSE src END AS p FROM t WHERE payload_type = 'auth'), o AS (SELECT * FROM s WHERE p <> h AND (p LIKE 'host-%' OR p NOT LIKE '%.%')),
  dg AS (SELECT h AS host, count(DISTINCT p) AS degree FROM (SELECT h, p FROM o UNION SELECT p, h FROM o) GROUP BY 1)"""


def wide_events(spark, d):
    return load_telemetry(spark, d).withColumn("src", F.when(c("k") % 5 == 4, S("peer", (c("k") % 9).cast("string"))).otherwise(c("src")))


@query("e18_wide_hop_degree", f"WITH {WIDE_SQL} SELECT * FROM dg")
def _(spark, d):
    return fl.hop_degree_wide(wide_events(spark, d))


@query("e19_hub_coverage", f"WITH {WIDE_SQL} SELECT 12 AS hub_bar, array_to_string(list_sort(list(host) FILTER (WHERE degree >= 12)), ',') AS hubs, CASE WHEN count(*) FILTER (WHERE degree >= 12) > 0 THEN 'OK' ELSE 'GAP' END AS coverage FROM dg")
def _(spark, d):
    return fl.hub_coverage(fl.hop_degree_wide(wide_events(spark, d)), 24).select("hub_bar", F.array_join("hubs", ",").alias("hubs"), "coverage")


@query("e20_false_campaigns", f"WITH {G} SELECT campaign_id FROM ca WHERE len(list_filter(host_ids, lambda x: x NOT IN ('h0', 'h1', 'h2', 'h3'))) > 0")
def _(spark, d):
    bad = groups(spark, d).select(c("h").alias("host_id")).distinct().filter("host_id < 'h4'")
    return fl.false_campaigns(campaign_rows(spark, d), bad).select("campaign_id")


@query(
    "e21_benign_gate",
    f"""WITH {TEL}, b AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'mixed' ELSE 'pure_benign' END AS kd, (max(us) - min(us)) / 3.6e9 AS hh, count(DISTINCT k % 4) AS nh, count(*) FILTER (WHERE value > 250) AS fi, count(*) FILTER (WHERE value < 0.5) AS fs FROM t GROUP BY 1)
    SELECT user_id, CASE WHEN kd = 'mixed' OR hh < 72 OR nh < 3 THEN 'INCOMPLETE' WHEN fi / hh > 0.001 OR fs / hh > 0.01 THEN 'FAIL' ELSE 'PASS' END AS gate FROM b""",
)
def _(spark, d):
    rows = load_telemetry(spark, d).groupBy("user_id").agg(
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 3.6e9).alias("host_hours"), F.count_distinct(c("k") % 4).alias("n_hosts"),
        F.count_if(c("value") > 250).alias("fp_iso"), F.count_if(c("value") < 0.5).alias("fp_seal"),
    )
    return fl.benign_gate(rows.withColumn("corpus_kind", F.when(c("user_id") % 3 == 0, "mixed").otherwise("pure_benign"))).select("user_id", "gate")


@query("e22_truth_assignment", f"WITH RECURSIVE {ASSIGN_SQL} SELECT pack_id, pack_id || '-t' || ti AS truth_id, campaign_id, round(j, 6) AS jaccard FROM asg")
def _(spark, d):
    return fl.assign_truths(cut(pred_rows(spark, d)), cut(many_truths(spark, d))).select("pack_id", "truth_id", "campaign_id", r6("jaccard"))


MT = f"""{G}, mt AS (SELECT 'p' || user_id AS pack_id, CASE WHEN value < 40 AND event_type IN ('purchase', 'view', 'error') THEN k % 3 ELSE 3 + k % 2 END AS ti, list_sort(list(DISTINCT 'h' || ((k // 4) % 7))) AS th FROM t GROUP BY ALL),
  ru AS (SELECT pack_id FROM mt GROUP BY 1 HAVING count(DISTINCT th) = count(*)),
  cp AS (SELECT a.pack_id, a.ti AS ta, b.ti AS tb, arg_min(campaign_id, idx) AS campaign_id FROM mt a JOIN mt b ON a.pack_id = b.pack_id AND a.ti < b.ti JOIN ru ON ru.pack_id = a.pack_id JOIN ca ON ca.pack_id = a.pack_id
    WHERE len(list_intersect(host_ids, a.th)) / len(a.th) >= 0.5 AND len(list_intersect(host_ids, b.th)) / len(b.th) >= 0.5
      AND {JAC.format(a='host_ids', b='list_distinct(list_concat(a.th, b.th))')} >= 0.75
      AND {JAC.format(a='host_ids', b='list_distinct(list_concat(a.th, b.th))')} > greatest({JAC.format(a='host_ids', b='a.th')}, {JAC.format(a='host_ids', b='b.th')}) + 0.05 GROUP BY 1, 2, 3)"""


@query("e23_collapsed_pairs", f"WITH {MT} SELECT pack_id || '-t' || ta AS truth_a, pack_id || '-t' || tb AS truth_b, campaign_id FROM cp")
def _(spark, d):
    return fl.collapsed_pairs(cut(pred_rows(spark, d)), cut(many_truths(spark, d))).select("truth_a", "truth_b", "campaign_id")


@query(
    "e24_ambiguity_margin",
    f"""WITH RECURSIVE {ASSIGN_SQL}, {MT[len(G) + 2:]}, pr AS (SELECT pack_id, min(j) AS mj, count(*) AS n, count(DISTINCT campaign_id) FILTER (WHERE j >= 0.9) AS ids FROM asg GROUP BY 1),
    sc AS (SELECT ca.pack_id, min(score) FILTER (WHERE m.campaign_id IS NOT NULL) AS low, max(score) FILTER (WHERE m.campaign_id IS NULL) AS high
      FROM ca LEFT JOIN (SELECT DISTINCT campaign_id FROM asg WHERE j >= 0.9) m USING (campaign_id) GROUP BY 1)
    SELECT pack_id, CASE WHEN pack_id NOT IN (SELECT pack_id FROM cp) AND mj >= 0.9 AND ids >= n THEN round(low - coalesce(high, 0.0), 4) END AS ambiguity_margin FROM pr LEFT JOIN sc USING (pack_id)""",
)
def _(spark, d):
    preds, truths = cut(pred_rows(spark, d)), cut(many_truths(spark, d))
    return fl.ambiguity_margin(preds, fl.assign_truths(preds, truths), fl.collapsed_pairs(preds, truths)).select("pack_id", "ambiguity_margin")


VER = f"""{TEL}, v AS (SELECT user_id, count(*) FILTER (WHERE value > 170) AS nf, count(*) FILTER (WHERE value > 220) AS nb, count(*) FILTER (WHERE value < 1) AS nm, count(*) FILTER (WHERE value BETWEEN 1 AND 2) AS nov,
  round(0.3 + (sum(k) % 71) / 100.0, 2) AS j, round((sum(k) % 40) / 100.0, 2) AS mg, user_id % 6 AS m6, user_id % 4 AS m4 FROM t GROUP BY 1)"""


def verdict_rows(spark, d):
    n = lambda cond: F.count_if(F.expr(cond))
    rows = load_telemetry(spark, d).groupBy("user_id").agg(
        n("value > 170").alias("n_false"), n("value > 220").alias("n_false_in_best"), n("value < 1").alias("n_missed"), n("value between 1 and 2").alias("n_over_merged"),
        F.round(0.3 + (F.sum("k") % 71) / 100.0, 2).alias("jaccard"), F.round((F.sum("k") % 40) / 100.0, 2).alias("margin"),
    )
    u = c("user_id")
    return rows.withColumns(
        {
            "empty_truth": u % 6 == 0, "has_multi": u % 6 == 1, "collapsed": (u % 6 == 1) & (u % 4 == 3), "min_jaccard": c("jaccard"), "mean_jaccard": c("jaccard"),
            "identical_host_truths": u % 4 == 1, "n_campaigns": u % 3, "reference_jaccard": F.when(u % 6 == 2, F.lit(0.8)), "recovered": u % 4 == 0, "ambiguous_false": (u % 6 == 3) & (u % 4 == 1),
        }
    ).withColumn("verdict", fl.limits_verdict())


VERDICT_SQL = """CASE WHEN m6 = 0 THEN CASE WHEN nf > 0 THEN 'BROKE' ELSE 'HELD' END
  WHEN m6 = 1 THEN CASE WHEN m4 = 3 OR j < 0.5 THEN 'BROKE' WHEN j < 0.9 THEN 'PARTIAL' WHEN m4 = 1 THEN CASE WHEN user_id % 3 < 2 THEN 'BROKE' ELSE 'HELD' END WHEN nb > 0 THEN 'BROKE' ELSE 'HELD' END
  WHEN m6 = 3 AND m4 = 1 THEN 'BROKE' WHEN m6 = 2 AND j + 1e-9 < 0.8 AND j < 0.5 THEN 'BROKE' WHEN m6 = 2 AND j + 1e-9 < 0.8 THEN 'PARTIAL' WHEN nb > 0 THEN 'BROKE' WHEN j < 0.5 OR (nm > 0 AND m4 <> 0) THEN 'BROKE'
  WHEN j < 0.9 OR nov > 0 OR nm > 0 THEN 'PARTIAL' ELSE 'HELD' END"""
FRAGILE_SQL = "vd = 'HELD' AND CASE WHEN m4 = 2 THEN nf > 0 ELSE mg < 0.2 END"


@query("e26_limits_verdict", f"WITH {VER} SELECT user_id, {VERDICT_SQL} AS verdict FROM v")
def _(spark, d):
    return verdict_rows(spark, d).select("user_id", "verdict")


def fragile_rows(spark, d):
    margin = F.when(c("user_id") % 4 != 2, c("margin"))
    return verdict_rows(spark, d).withColumn("fragile", fl.is_fragile(c("verdict"), margin, c("n_false")))


@query("e25_fragile", f"WITH {VER} SELECT user_id, {FRAGILE_SQL} AS fragile FROM (SELECT *, {VERDICT_SQL} AS vd FROM v)")
def _(spark, d):
    return fragile_rows(spark, d).select("user_id", "fragile")


@query("e27_fleet_verdict", f"WITH {VER} SELECT user_id, CASE WHEN m6 = 0 OR j <= 0 THEN 'BROKE' WHEN nm > 0 OR nov > 0 OR j < 0.99 THEN 'PARTIAL' ELSE 'HELD' END AS verdict FROM v")
def _(spark, d):
    rows = verdict_rows(spark, d).withColumn("both_missed", c("user_id") % 6 == 0)
    return rows.select("user_id", fl.fleet_verdict().alias("verdict"))


HO = f"""{G}, hs AS (SELECT DISTINCT 'p' || user_id AS pack_id, 'h' || ((k // 4) % 7) AS host FROM t), tt AS (SELECT DISTINCT pack_id, unnest(truth_hosts) AS host FROM tr), ff AS (SELECT DISTINCT pack_id, h AS host FROM g WHERE idx < 4),
  pp AS (SELECT DISTINCT pack_id, h AS host FROM g WHERE idx < 4 AND stage = 'micro_exfil'), oc AS (SELECT hs.*, (pack_id, host) IN (SELECT (pack_id, host) FROM tt) AS co, (pack_id, host) IN (SELECT (pack_id, host) FROM ff) AS fg, (pack_id, host) IN (SELECT (pack_id, host) FROM pp) AS pr FROM hs)"""


def outcome_rows(spark, d):
    hosts = load_telemetry(spark, d).select(S("p", c("user_id").cast("string")).alias("pack_id"), S("h", (F.expr("k div 4") % 7).cast("string")).alias("host"))
    g = groups(spark, d).filter("idx < 4").select("pack_id", c("h").alias("host"), "stage")  # the campaigns of one kind
    truth = truth_rows(spark, d).select("pack_id", F.explode("truth_hosts").alias("host"))
    return fl.host_outcomes(hosts, truth, g, g.filter("stage = 'micro_exfil'"))


@query("e28_e31_host_outcomes", f"WITH {HO} SELECT pack_id, host, co AS compromised, fg AS flagged, co AND NOT fg AS missed, pr AS proposed, NOT co AND NOT pr AS saved, co AND pr AS contained, NOT co AND pr AS false_proposal FROM oc")
def _(spark, d):
    return outcome_rows(spark, d).select("pack_id", "host", "compromised", "flagged", "missed", "proposed", "saved", "contained", "false_proposal")


@query("e28_recovered", f"WITH {HO} SELECT pack_id, host, (pack_id, host) IN (SELECT ('p' || user_id, CASE WHEN value > 60 THEN 'h' ELSE 'quiet-' END || ((k // 4) % 7)) FROM t) AS recovered FROM oc WHERE co AND NOT fg")
def _(spark, d):
    seen = load_telemetry(spark, d).select(S("p", c("user_id").cast("string")).alias("pack_id"), S(F.when(c("value") > 60, "h").otherwise("quiet-"), (F.expr("k div 4") % 7).cast("string")).alias("host"))
    return fl.recovered_on_replay(outcome_rows(spark, d).filter("missed").select("pack_id", "host"), seen)


BW = "CASE WHEN m4 = 0 THEN nb < nf ELSE (nb < nf AND nm >= nov) OR (nb = nf AND nm > nov) END"


def baseline_rows(rows):
    rows = rows.withColumns({"n_truth": c("user_id") % 4, "b1_false": c("n_false_in_best"), "b1_covered": c("n_missed"), "covered": c("n_over_merged")})
    return rows.withColumn("baseline_wins", fl.baseline_wins())


@query("e29_baseline_wins", f"WITH {VER} SELECT user_id, {BW} AS baseline_wins FROM v")
def _(spark, d):
    return baseline_rows(verdict_rows(spark, d)).select("user_id", "baseline_wins")


@query(
    "e30_suite_summary",
    f"""WITH {VER}, q AS (SELECT *, {VERDICT_SQL} AS vd, {BW} AS bw FROM v) SELECT count(*) FILTER (WHERE vd = 'HELD') AS held, count(*) FILTER (WHERE vd = 'PARTIAL') AS partial, count(*) FILTER (WHERE vd = 'BROKE') AS broke,
    count(*) FILTER (WHERE {FRAGILE_SQL}) AS fragile, round(count(*) FILTER (WHERE {FRAGILE_SQL}) / count(*) FILTER (WHERE vd = 'HELD'), 4) AS fragile_rate, count(*) FILTER (WHERE bw) AS baseline_wins, true AS perf_gate FROM q""",
)
def _(spark, d):
    return fl.suite_summary(baseline_rows(fragile_rows(spark, d)), 50.0, 100.0, 0.5).drop("fragile_gate")


STEPS = f"""{TEL}, st AS (SELECT 'p' || user_id AS pack_id, ingest_seq AS step_no, CASE payload_type WHEN 'auth' THEN 'auth' ELSE 'exfil' END AS kind, 'h' || (k % 5) AS host, k AS off,
  CASE WHEN k % 9 = 0 THEN 'FIRST_COMPROMISE method=phish x' WHEN k % 9 = 1 THEN 'uses method=m' || (k % 4) || ' tail' WHEN k % 9 = 2 THEN 'plain note' END AS note FROM t)"""


def attack_steps(spark, d):
    k = c("k")
    note = F.when(k % 9 == 0, "FIRST_COMPROMISE method=phish x").when(k % 9 == 1, S("uses method=m", (k % 4).cast("string"), " tail")).when(k % 9 == 2, "plain note")
    return load_telemetry(spark, d).select(
        S("p", c("user_id").cast("string")).alias("pack_id"), c("ingest_seq").alias("step_no"), F.when(c("payload_type") == "auth", "auth").otherwise("exfil").alias("kind"), S("h", (k % 5).cast("string")).alias("host"),
        k.cast("double").alias("offset_seconds"), "user", F.lit(None).cast("string").alias("technique"), note.alias("note"),
    )


@query(
    "e32_first_compromise",
    f"""WITH {STEPS}, p AS (SELECT *, CASE WHEN note LIKE 'FIRST_COMPROMISE%' THEN 0 WHEN kind = 'auth' AND host IN ('h1', 'h2') THEN 1 END AS p FROM st)
    SELECT pack_id, arg_min(host, (p, step_no)) AS host, CAST(arg_min(off, (p, step_no)) AS DOUBLE) AS offset_seconds, arg_min(coalesce(note, 'first_auth'), (p, step_no)) AS method FROM p WHERE p IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    steps = attack_steps(spark, d)
    truth = steps.filter("host in ('h1', 'h2')").select("pack_id", "host").distinct()
    return fl.first_compromise(steps, truth).select("pack_id", "host", "offset_seconds", "method")


@query(
    "e33_methods_by_host",
    f"""WITH {STEPS}, m AS (SELECT pack_id, host, step_no, CASE WHEN note LIKE '%method=%' THEN regexp_extract(note, 'method=\\s*(\\S*)', 1) ELSE coalesce(note, kind) END AS m FROM st), f AS (SELECT pack_id, host, m, min(step_no) AS a FROM m GROUP BY ALL)
    SELECT pack_id, host, string_agg(m, ',' ORDER BY a) AS methods FROM f GROUP BY 1, 2""",
)
def _(spark, d):
    return fl.methods_by_host(attack_steps(spark, d)).select("pack_id", "host", F.array_join("methods", ",").alias("methods"))


@query("e34_retry_summary", f"WITH {VER} SELECT round(count(*) FILTER (WHERE j >= 0.5) / count(*), 3) AS match_rate, round(avg(j), 4) AS mean_jaccard FROM v")
def _(spark, d):
    return fl.retry_summary(verdict_rows(spark, d).withColumn("matched", c("jaccard") >= 0.5))


@query("e34_stable_residuals", f"WITH {TEL}, r AS (SELECT DISTINCT user_id % 8 AS attempt, CASE WHEN value > 150 THEN 'h' ELSE 'low' END || (k % 50) AS host FROM t) SELECT host, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 4")
def _(spark, d):
    rows = load_telemetry(spark, d).select((c("user_id") % 8).alias("attempt"), S(F.when(c("value") > 150, "h").otherwise("low"), (c("k") % 50).cast("string")).alias("host")).distinct()
    return fl.stable_residuals(rows, 8)


@query("e35_metric_gates", f"WITH {VER} SELECT user_id, nf >= 5 AND j <= 0.1 + 0.4 AS benign_gate, mg >= 0.05 AS lift_gate FROM v")
def _(spark, d):
    rows = verdict_rows(spark, d).select("user_id", c("n_false").alias("n_benign"), c("jaccard").alias("false_campaign_rate"), c("margin").alias("f1_lift"))
    return fl.metric_gates(rows, max_fcr=0.5).select("user_id", "benign_gate", "lift_gate")


@query("e36_missing_channels", f"WITH {TEL} SELECT DISTINCT 'ch' || (k % 20) AS channel FROM t WHERE k % 20 >= 15")
def _(spark, d):
    rows = load_telemetry(spark, d).withColumn("channel", S("ch", (c("k") % 20).cast("string")))
    stats = rows.groupBy("channel").agg(F.count_if(c("k") % 20 < 15).alias("adapted"))
    return fl.missing_channels(stats, rows)


# --- streaming -----------------------------------------------------------------------------------


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return telemetry(raw)


def run_stream(spark, stream, name: str, step=None):
    """Drive a stream to its end through ``foreachBatch`` into a table folder, and read that back."""
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = live.start(stream, step or write, f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch") if step is None else None


@query("t01_tailed_sources", f"WITH {TEL} SELECT CASE WHEN payload_type = 'auth' THEN 'auth' ELSE 'other' END AS source, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM t GROUP BY 1")
def _(spark, d):
    """Logs are written, read, then half of the files get more lines and the others are replaced by shorter ones, and are read again."""
    base = f"{shared_folder(spark)}/tail-{uuid.uuid4().hex}"
    rows = load_telemetry(spark, d).withColumn("src_name", F.when(c("payload_type") == "auth", "auth").otherwise("other"))
    lines = rows.select("k", "src_name", S(c("src_name"), "/", F.pmod(c("ingest_seq"), F.lit(4)).cast("string"), ".log").alias("file"),
                        F.to_json(F.struct("event_id", "host_id", "ts_utc", "payload_type")).alias("value"))
    folders = {"auth": f"{base}/auth", "other": f"{base}/other"}
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"

    def read():
        stream = live.envelope_stream(live.tail_folders(spark, folders)).select("source", "event_id")
        live.start(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), checkpoint).awaitTermination()

    _write_logs(lines.filter("k < 70"), base, append=False)
    read()
    _write_logs(lines.filter("k >= 70 AND src_name = 'auth'"), base, append=True)
    _write_logs(lines.filter("k >= 70 AND src_name = 'other'"), base, append=False)
    read()
    return spark.read.parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))


def _write_logs(lines, base: str, append: bool) -> None:
    """Write lines (file, value) to the files under ``base``, one task a file."""

    def write(batches):
        import posixpath

        import pyarrow as pa
        import pyarrow.compute as pc

        from hostweave.sources.tailing import open_folder

        fs, root = open_folder(base)
        begun = set()
        for b in batches:
            for name in pc.unique(b.column("file")).to_pylist():
                path = f"{root}/{name}"
                fs.create_dir(posixpath.dirname(path), recursive=True)
                text = "".join(v + "\n" for v in b.filter(pc.equal(b.column("file"), name)).column("value").to_pylist())
                opened = fs.open_append_stream if append or path in begun else fs.open_output_stream
                with opened(path) as f:
                    f.write(text.encode())
                begun.add(path)
        yield pa.RecordBatch.from_arrays([pa.array([len(begun)])], ["n"])

    lines.select("file", "value").repartition("file").mapInArrow(write, "n long").agg(F.sum("n")).collect()


DAY_US = 86_400_000_000


def in_batches(spark, rows, name: str, make):
    """Drive a stream over the rows in three micro-batches: the earlier and the later half of the time, then stragglers (k % 10 = 3).

    ``make(base)`` gives the step; returns the folder the step works in.
    """
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    us = F.unix_micros("_event_time")
    middle = rows.agg(F.expr("(min(unix_micros(_event_time)) + max(unix_micros(_event_time))) div 2")).first()[0]
    rows = rows.withColumn("_batch", F.when(c("k") % 10 == 3, 2).when(us < middle, 0).otherwise(1)).drop("_event_time")
    schema, step = rows.drop("_batch").schema, make(base)
    for i in range(3):
        rows.filter(c("_batch") == i).drop("_batch").write.parquet(f"{base}/in/part{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in")
        live.start(stream, step, f"{base}/checkpoint").awaitTermination()
    return base


BATCH_SQL = """mid AS (SELECT (min(us) + max(us)) // 2 AS m FROM t),
  tb AS (SELECT t.*, CASE WHEN k % 10 = 3 THEN 2 WHEN us < m THEN 0 ELSE 1 END AS b FROM t, mid)"""


def seen_sql(key: str, good: str, delay: int) -> str:
    """Status counts of the rows ``tb`` by first appearance of ``key`` over three batches, with a state that reaches back ``delay``."""
    return f"""ok AS (SELECT *, {key} AS sk FROM tb WHERE {good}),
  w1 AS (SELECT max(us) - {delay} AS w FROM ok WHERE b = 0), w2 AS (SELECT max(us) - {delay} AS w FROM ok WHERE b <= 1),
  lv AS (SELECT * FROM ok WHERE b = 0 OR b = 1 AND us >= (SELECT w FROM w1) OR b = 2 AND us >= (SELECT w FROM w2)),
  f0 AS (SELECT sk, min(us) AS us FROM lv WHERE b = 0 GROUP BY 1), s1 AS (SELECT * FROM f0 WHERE us >= (SELECT w FROM w1)),
  f1 AS (SELECT sk, min(us) AS us FROM lv WHERE b = 1 AND sk NOT IN (SELECT sk FROM s1) GROUP BY 1),
  s2 AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM f1) WHERE us >= (SELECT w FROM w2)),
  f2 AS (SELECT sk, min(us) AS us FROM lv WHERE b = 2 AND sk NOT IN (SELECT sk FROM s2) GROUP BY 1),
  fr AS (SELECT (SELECT count(*) FROM f0) + (SELECT count(*) FROM f1) + (SELECT count(*) FROM f2) AS n),
  st AS (SELECT 'fresh' AS status, n FROM fr UNION ALL SELECT 'repeat', (SELECT count(*) FROM lv) - n FROM fr
    UNION ALL SELECT 'late', (SELECT count(*) FROM ok) - (SELECT count(*) FROM lv) UNION ALL SELECT 'rejected', (SELECT count(*) FROM tb) - (SELECT count(*) FROM ok))"""


def status_counts(spark, out: str):
    return spark.read.parquet(out).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("t02_deduplicated", f"WITH {TEL}, {BATCH_SQL}, {seen_sql('(host_id, payload_type, k)', 'true', 10 * DAY_US)} SELECT status, CAST(n AS BIGINT) AS n FROM st WHERE n > 0")
def _(spark, d):
    rows = load_telemetry(spark, d).withColumn("_event_time", c("ts"))
    key = ["host_id", "payload_type", "k"]
    base = in_batches(spark, rows, "dedup", lambda b: live.dedup_step(f"{b}/out", StepState(f"{b}/state", 10 * DAY_US), key))
    return status_counts(spark, f"{base}/out")


HOUR = "us // 3600000000"


@query(
    "t03_rate_cap",
    f"""WITH {TEL}, {BATCH_SQL}, s AS (SELECT ingest_seq, event_id, host_id, b, ts, {HOUR} AS sec FROM tb),
    w AS (SELECT *, CASE b WHEN 1 THEN (SELECT max(sec) FROM s WHERE b = 0) WHEN 2 THEN (SELECT max(sec) FROM s WHERE b <= 1) END - 240 AS mark FROM s),
    r AS (SELECT ingest_seq, row_number() OVER (PARTITION BY host_id, sec ORDER BY b, ts, event_id) AS p FROM w WHERE mark IS NULL OR sec >= mark)
    SELECT s.ingest_seq, CASE WHEN p IS NULL THEN 'late' WHEN p <= 1 THEN 'fresh' ELSE 'dropped' END AS status FROM s LEFT JOIN r USING (ingest_seq)""",
)
def _(spark, d):
    """The cap is per event-time second; hours are shrunk to seconds so that the sparse sample reaches it."""
    hour = F.timestamp_seconds(F.floor(F.unix_micros("ts") / 3_600_000_000) + (F.unix_micros("ts") % 3_600_000_000) / 3_600_000_001)
    rows = load_telemetry(spark, d).withColumn("_event_time", c("ts")).withColumn("ts", hour)
    base = in_batches(spark, rows, "cap", lambda b: capped_step(f"{b}/out", StepState(f"{b}/state", 240_000_000), 1, ["host_id"]))
    return spark.read.parquet(f"{base}/out").select("ingest_seq", "status")


@query("t04_verified_stream", f"WITH {TEL}, {BATCH_SQL}, {seen_sql('ingest_seq // 2', 'k % 10 <> 4', 10 * DAY_US)} SELECT status, CAST(n AS BIGINT) AS n FROM st WHERE n > 0")
def _(spark, d):
    """Two events share a producer and a nonce; some are altered after they were signed."""
    pair = F.expr("ingest_seq div 2")
    part = F.lpad((pair % 12).cast("string"), 2, "0")
    rows = load_telemetry(spark, d).withColumns({"nonce": S("n", pair.cast("string")), "producer_id": S("prod-", part), "host_id": S("host-", part)})
    keys = cut(enrollment(rows))
    signed = sign_events(payloads(rows), keys).withColumn("_event_time", c("ts"))
    signed = signed.withColumn("ts_utc", F.when(c("k") % 10 == 4, "2020-01-01T00:00:00Z").otherwise(c("ts_utc")))
    base = in_batches(spark, signed, "verified", lambda b: live.verify_step(f"{b}/out", StepState(f"{b}/state", 10 * DAY_US), keys))
    return status_counts(spark, f"{base}/out")


@query(
    "t05_stream_sessions",
    f"""WITH {TEL}, mid AS (SELECT (min(us) + max(us)) // 2 AS m FROM t WHERE payload_type = 'auth'),
    a AS (SELECT usr, host_id, us, CASE WHEN k % 10 = 3 THEN 2 WHEN us < m THEN 0 ELSE 1 END AS b FROM t, mid WHERE payload_type = 'auth'),
    l AS (SELECT *, CASE b WHEN 1 THEN (SELECT max(us) FROM a WHERE b = 0) WHEN 2 THEN (SELECT max(us) FROM a WHERE b <= 1) END - {10 * DAY_US} AS mark FROM a),
    ok AS (SELECT * FROM l WHERE mark IS NULL OR us >= mark),
    n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY usr ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS nw FROM ok),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY usr ORDER BY us ROWS UNBOUNDED PRECEDING) AS sno FROM n)
    SELECT usr, min(us) AS t0, max(us) AS t1, CAST(count(*) AS BIGINT) AS n_points, array_to_string(list_sort(list(DISTINCT host_id)), ',') AS entities FROM s GROUP BY usr, sno
    HAVING max(us) + 3600000000 < (SELECT max(us) FROM a) - {10 * DAY_US}
    UNION ALL SELECT 'late', NULL, NULL, CAST((SELECT count(*) FROM a) - (SELECT count(*) FROM ok) AS BIGINT), NULL""",
)
def _(spark, d):
    rows = load_telemetry(spark, d)
    points = rows.filter("payload_type = 'auth'").select(c("user").alias("usr"), "host_id", "ts", "k", c("ts").alias("_event_time"))
    base = in_batches(spark, points, "sessions", lambda b: session_step(f"{b}/out", f"{b}/late", StepState(f"{b}/state", 10 * DAY_US), ["usr"], "host_id", 3_600_000_000))
    closed = spark.read.parquet(f"{base}/out").select("usr", "t0", "t1", "n_points", F.array_join("entities", ",").alias("entities"))
    none = F.lit(None)
    late = spark.read.parquet(f"{base}/late").agg(F.count(F.lit(1)).alias("n_points"))
    late = late.select(F.lit("late").alias("usr"), none.cast("long").alias("t0"), none.cast("long").alias("t1"), "n_points", none.cast("string").alias("entities"))
    return closed.unionByName(late)


STREAM_CFG = FuseConfig(window_seconds=3600, resume_window_seconds=7200, recon_min_distinct=98)


def _recomputed(spark, d):
    base = f"{shared_folder(spark)}/recompute-{uuid.uuid4().hex}"
    run_stream(spark, event_stream(spark, d), "recompute", live.recompute_step(spark, f"{base}/events", f"{base}/campaigns", "run", STREAM_CFG))
    return base


@query("t06_recomputed_campaigns")
def _(spark, d):
    return read_campaigns(spark, f"{_recomputed(spark, d)}/campaigns").select("campaign_id", joined("host_ids"), F.size("stages").alias("n_stages"), r6("score"))


@query("t07_respond_loop")
def _(spark, d):
    base = _recomputed(spark, d)
    run_stream(spark, event_stream(spark, d), "respond", live.respond_step(spark, f"{base}/campaigns", f"{base}/proposals"))
    return spark.read.parquet(f"{base}/proposals").select("host_id")


@query("t08_channel_health", f"WITH {TEL} SELECT 'ch' || m AS channel, coalesce(n, 0) AS hits, n IS NULL AS degraded FROM (SELECT DISTINCT k % 20 AS m FROM t) LEFT JOIN (SELECT k % 20 AS m, count(*) AS n FROM t WHERE k % 20 < 15 GROUP BY 1) USING (m)")
def _(spark, d):
    rows = load_telemetry(spark, d).withColumn("channel", S("ch", (c("k") % 20).cast("string")))
    return live.channel_health(rows.filter(c("k") % 20 < 15), rows.select("channel")).select("channel", "hits", "degraded")
