"""Benign-corpus gates and the verdicts of multi-scenario fleet suites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions.sets import jaccard
from hostweave.session import cut

# Bars of the benign gate and of the suites.
MIN_HOST_HOURS = 72.0
MIN_HOSTS = 3
MAX_ISOLATIONS_PER_HOST_HOUR = 1.0 / 1000.0
MAX_CAMPAIGNS_PER_HOST_HOUR = 1.0 / 100.0
PURE_KINDS = ("pure_benign", "home_lab_capture")
CLEAN_JACCARD = 0.9
FRAGILE_MARGIN = 0.2


def host_hours(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hours between the first and last event of each host."""
    rows = events.filter((F.coalesce("host_id", F.lit("")) != "") & F.col("ts").isNotNull())
    span = F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))
    return rows.groupBy(*by, "host_id").agg(F.round(span / F.lit(3.6e9), 6).alias("host_hours"))


def hop_degree_wide(events: DataFrame, prefix: str = "host-", by: Sequence[str] = ()) -> DataFrame:
    """Hop degree that also accepts short source names without dots (and without colons) as peers."""
    src, host = F.col("src"), F.col("host_id")
    named = src.startswith(prefix) | (~F.contains(src, F.lit(".")) & ~F.contains(src, F.lit(":")))
    hop = (F.col("payload_type") == "auth") & (host != "") & (F.coalesce(src, F.lit("")) != "") & (src != host) & named
    ends = events.filter(hop).select(
        *by, F.explode(F.array(F.struct(host.alias("host"), src.alias("peer")), F.struct(src.alias("host"), host.alias("peer")))).alias("e")
    )
    return ends.select(*by, "e.host", "e.peer").distinct().groupBy(*by, "host").agg(F.count(F.lit(1)).alias("degree"))


def hub_coverage(degrees: DataFrame, n_hosts: int, bar: int | None = None) -> DataFrame:
    """Hosts at or above the hub bar, OK when there is one, else GAP."""
    level = int(bar) if bar is not None else max(2, n_hosts // 2)
    return degrees.groupBy().agg(
        F.lit(level).cast("bigint").alias("hub_bar"),
        F.array_sort(F.collect_list(F.when(F.col("degree") >= level, F.col("host")))).alias("hubs"),
    ).withColumn("coverage", F.when(F.size("hubs") > 0, "OK").otherwise("GAP"))


def false_campaigns(campaigns: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Campaigns that are not wholly inside the excluded attack hosts (host_id)."""
    if excluded is None:
        return campaigns
    hosts = campaigns.select("campaign_id", F.explode("host_ids").alias("host_id"))
    outside = hosts.join(excluded.select("host_id").distinct(), "host_id", "left_anti").select("campaign_id").distinct()
    empty = campaigns.filter(F.size("host_ids") == 0).select("campaign_id")
    return campaigns.join(outside.union(empty), "campaign_id", "left_semi")


def benign_gate(rows: DataFrame) -> DataFrame:
    """Add rates, ``reasons`` and ``gate``. Columns: corpus_kind, host_hours, n_hosts, fp_iso, fp_seal."""
    hours = F.col("host_hours")
    pure = F.col("corpus_kind").isin(*PURE_KINDS)
    big = (hours >= MIN_HOST_HOURS) & (F.col("n_hosts") >= MIN_HOSTS)
    rate = lambda c: F.when(hours > 0, F.round(F.col(c) / hours, 8))
    over = lambda c, bar: F.when(hours > 0, F.col(c) / hours > bar).otherwise(F.col(c) > 0)
    iso, seal = over("fp_iso", MAX_ISOLATIONS_PER_HOST_HOUR), over("fp_seal", MAX_CAMPAIGNS_PER_HOST_HOUR)
    ready = pure & big
    reasons = F.array_compact(
        F.array(
            F.when(~pure, "kind_not_eligible"), F.when(~big, "below_minimum_size"), F.when(ready & iso, "isolation_rate"),
            F.when(ready & seal, "campaign_rate"), F.when(ready & ~iso & ~seal, "bars_met"),
        )
    )
    gate = F.when(~ready, "INCOMPLETE").when(iso | seal, "FAIL").otherwise("PASS")
    return rows.withColumns(
        {"iso_rate": rate("fp_iso"), "campaign_rate": rate("fp_seal"), "eligible": ready, "reasons": reasons, "gate": gate}
    )


# --- several truths per pack ---------------------------------------------------------------------


def assign_truths(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Truths in their order take the best campaign left (the earliest on ties).

    When two truths of a pack name the same hosts, campaigns may be used again. One round per place in
    the truth lists (a handful of authored incidents), each over all packs at once.
    """
    same = truths.groupBy("pack_id").agg((F.count_distinct(F.array_sort("truth_hosts")) < F.count(F.lit(1))).alias("reuse"))
    p = preds.select("pack_id", "idx", F.size("host_ids").alias("np"), F.explode("host_ids").alias("h"))
    t = truths.select("pack_id", "truth_idx", F.size("truth_hosts").alias("nt"), F.explode("truth_hosts").alias("h"))
    pairs = p.join(t, ["pack_id", "h"]).groupBy("pack_id", "idx", "truth_idx", "np", "nt").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs.select("pack_id", "idx", "truth_idx", (F.col("n") / (F.col("np") + F.col("nt") - F.col("n"))).alias("j")))
    order = cut(truths.join(same, "pack_id").select("pack_id", "truth_idx", "truth_id", "reuse"))
    used, out = None, None
    for place in range(int(order.agg(F.max("truth_idx")).first()[0] or 0) + 1):
        now = order.filter(F.col("truth_idx") == place)
        free = preds.select("pack_id", "idx", "campaign_id")
        cand = pairs.filter(F.col("truth_idx") == place).select("pack_id", "idx", "j")
        if used is not None:
            free = free.join(used, ["pack_id", "idx"], "left_anti")
        rows = free.join(cand, ["pack_id", "idx"], "left").withColumn("j", F.coalesce("j", F.lit(0.0)))
        best = rows.groupBy("pack_id").agg(F.max_by(F.struct("idx", "campaign_id", "j"), F.struct("j", -F.col("idx"))).alias("b"))
        won = cut(now.join(best, "pack_id", "left").select("pack_id", "truth_idx", "truth_id", "reuse", "b.idx", "b.campaign_id", F.coalesce("b.j", F.lit(0.0)).alias("jaccard")))
        out = won if out is None else out.unionByName(won)
        taken = won.filter(~F.col("reuse") & F.col("idx").isNotNull()).select("pack_id", "idx")
        used = taken if used is None else used.union(taken)
    return out


def assignment_summary(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("pack_id").agg(
        F.round(F.avg("jaccard"), 4).alias("mean_jaccard"), F.round(F.min("jaccard"), 4).alias("min_jaccard"),
        F.max("reuse").alias("identical_host_truths"), F.count(F.lit(1)).alias("n_truths"),
    )


def collapsed_pairs(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Campaigns that look like the union of two truths: (pack_id, truth_a, truth_b, campaign_id).

    Both truths must be at least half covered, so they are found through shared hosts; a pack whose
    truths repeat a host set has no collapse.
    """
    same = truths.groupBy("pack_id").agg((F.count_distinct(F.array_sort("truth_hosts")) < F.count(F.lit(1))).alias("reuse"))
    p = preds.select("pack_id", "idx", "campaign_id", F.explode("host_ids").alias("h"))
    t = truths.select("pack_id", "truth_idx", F.size("truth_hosts").alias("nt"), F.explode("truth_hosts").alias("h"))
    covered = p.join(t, ["pack_id", "h"]).groupBy("pack_id", "idx", "truth_idx", "nt").agg(F.count(F.lit(1)).alias("n")).filter("n / nt >= 0.5")
    a = covered.select("pack_id", "idx", F.col("truth_idx").alias("ta"))
    b = covered.select("pack_id", "idx", F.col("truth_idx").alias("tb"))
    side = lambda n: truths.select("pack_id", F.col("truth_idx").alias(f"t{n}"), F.col("truth_id").alias(f"truth_{n}"), F.col("truth_hosts").alias(f"h{n}"))
    rows = (
        a.join(b, ["pack_id", "idx"]).filter("ta < tb").join(same.filter("not reuse").select("pack_id"), "pack_id")
        .join(side("a"), ["pack_id", "ta"]).join(side("b"), ["pack_id", "tb"]).join(preds.select("pack_id", "idx", "campaign_id", "host_ids"), ["pack_id", "idx"])
    )
    union = jaccard("host_ids", F.array_union("ha", "hb"))
    hit = (union >= 0.75) & (union > F.greatest(jaccard("host_ids", "ha"), jaccard("host_ids", "hb")) + 0.05)
    first = rows.filter(hit).groupBy("pack_id", "truth_a", "truth_b").agg(F.min_by("campaign_id", "idx").alias("campaign_id"))
    return first


def ambiguity_margin(preds: DataFrame, assigned: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Least score of the matched campaigns minus the greatest of the others, per cleanly resolved pack.

    NULL when the pack is collapsed, a match is not clean, or one campaign serves two truths.
    """
    per = assigned.groupBy("pack_id").agg(
        F.min("jaccard").alias("min_j"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("jaccard") >= CLEAN_JACCARD, F.col("campaign_id"))).alias("n_ids")
    )
    bad = collapsed.select("pack_id", F.lit(True).alias("bad")).distinct()
    matched = assigned.filter(F.col("jaccard") >= CLEAN_JACCARD).select("pack_id", "campaign_id", F.lit(True).alias("m")).distinct()
    scores = preds.join(matched, ["pack_id", "campaign_id"], "left").groupBy("pack_id").agg(
        F.min(F.when(F.col("m"), F.col("score"))).alias("low"), F.max(F.when(F.col("m").isNull(), F.col("score"))).alias("high")
    )
    rows = per.join(scores, "pack_id", "left").join(bad, "pack_id", "left")
    clean = F.col("bad").isNull() & (F.col("min_j") >= CLEAN_JACCARD) & (F.col("n_ids") >= F.col("n"))
    return rows.select("pack_id", F.when(clean, F.round(F.col("low") - F.coalesce("high", F.lit(0.0)), 4)).alias("ambiguity_margin"))


def is_fragile(verdict: Column, margin: Column, n_false: Column) -> Column:
    return (verdict == "HELD") & F.when(margin.isNull(), n_false > 0).otherwise(margin < FRAGILE_MARGIN)


def limits_verdict() -> Column:
    """HELD / PARTIAL / BROKE of one scenario, rules in order.

    Columns: empty_truth, n_false (false proposals), has_multi, collapsed, min_jaccard, mean_jaccard,
    identical_host_truths, n_campaigns, n_false_in_best, jaccard, reference_jaccard, n_missed,
    recovered, n_over_merged, ambiguous_false (a named innocent of the dual-lateral case is proposed).
    """
    c = F.col
    multi = (
        F.when(c("collapsed") | (c("min_jaccard") < 0.5), "BROKE")
        .when((c("mean_jaccard") < 0.9) | (c("min_jaccard") < 0.9), "PARTIAL")
        .when(c("identical_host_truths"), F.when(c("n_campaigns") < 2, "BROKE").otherwise("HELD"))
        .when(c("n_false_in_best") > 0, "BROKE")
        .otherwise("HELD")
    )
    below = c("reference_jaccard").isNotNull() & (c("jaccard") + 1e-9 < c("reference_jaccard"))
    lost = (c("n_missed") > 0) & ~c("recovered")
    return (
        F.when(c("empty_truth"), F.when(c("n_false") > 0, "BROKE").otherwise("HELD"))
        .when(c("has_multi"), multi)
        .when(c("ambiguous_false"), "BROKE")
        .when(below & (c("jaccard") < 0.5), "BROKE")
        .when(below & (c("jaccard") < 0.9), "PARTIAL")
        .when(c("n_false_in_best") > 0, "BROKE")
        .when((c("jaccard") < 0.5) | lost, "BROKE")
        .when((c("jaccard") < 0.9) | (c("n_over_merged") > 0) | (c("n_missed") > 0), "PARTIAL")
        .otherwise("HELD")
    )


def fleet_verdict() -> Column:
    """Columns: both_missed, jaccard, n_missed, n_over_merged."""
    return (
        F.when(F.col("both_missed") | (F.col("jaccard") <= 0), "BROKE")
        .when((F.col("n_missed") > 0) | (F.col("n_over_merged") > 0) | (F.col("jaccard") < 0.99), "PARTIAL")
        .otherwise("HELD")
    )


def host_outcomes(hosts: DataFrame, truth: DataFrame, flagged: DataFrame, proposed: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Per (pack_id, host): compromised, flagged, over_merged, missed, proposed, saved, contained, false_proposal."""
    mark = lambda df, n: df.select("pack_id", "host", F.lit(True).alias(n)).distinct()
    rows = hosts.select("pack_id", "host").distinct()
    parts = {"compromised": truth, "flagged": flagged, "proposed": proposed}
    if over is not None:
        parts["over_merged"] = over
    for name, df in parts.items():
        rows = rows.join(mark(df, name), ["pack_id", "host"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    if over is None:
        rows = rows.withColumn("over_merged", F.lit(False))
    c = F.col
    return rows.withColumns(
        {
            "missed": c("compromised") & ~c("flagged"), "saved": ~c("compromised") & ~c("proposed"),
            "contained": c("compromised") & c("proposed"), "false_proposal": ~c("compromised") & c("proposed"),
        }
    )


def recovered_on_replay(missed: DataFrame, rebuilt_hosts: DataFrame) -> DataFrame:
    """Missed (pack_id, host) rows with ``recovered``: the replay's reconstruction names the host."""
    seen = rebuilt_hosts.select("pack_id", "host", F.lit(True).alias("recovered")).distinct()
    return missed.join(seen, ["pack_id", "host"], "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))


def baseline_wins() -> Column:
    """Columns: n_truth, b1_false, false, b1_covered, covered."""
    c = F.col
    fewer, equal = c("b1_false") < c("n_false"), c("b1_false") == c("n_false")
    return F.when(c("n_truth") == 0, fewer).otherwise((fewer & (c("b1_covered") >= c("covered"))) | (equal & (c("b1_covered") > c("covered"))))


def suite_summary(rows: DataFrame, wall_seconds: float, rss_mb: float | None, t0_fragile_rate: float | None, decoys: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Verdict counts, fragile rate and the two gates. Columns: verdict, fragile, baseline_wins."""
    held = F.count_if(F.col("verdict") == "HELD")
    frag = F.count_if((F.col("verdict") == "HELD") & F.col("fragile"))
    perf = wall_seconds < 120.0 and (rss_mb is None or rss_mb < 500.0)
    out = rows.groupBy(*by).agg(
        held.alias("held"), F.count_if(F.col("verdict") == "PARTIAL").alias("partial"), F.count_if(F.col("verdict") == "BROKE").alias("broke"),
        frag.alias("fragile"), F.round(F.try_divide(frag, held), 4).alias("fragile_rate"), F.count_if("baseline_wins").alias("baseline_wins"),
    ).withColumn("perf_gate", F.lit(perf))
    gate = F.lit(None).cast("boolean") if t0_fragile_rate is None or decoys else F.col("fragile_rate") <= t0_fragile_rate + 0.10
    return out.withColumn("fragile_gate", gate)


# --- attack steps --------------------------------------------------------------------------------


def first_compromise(steps: DataFrame, truth: DataFrame) -> DataFrame:
    """First step noted as the first compromise, else the first log-on on a truth host, per pack.

    ``steps``: pack_id, step_no, kind, host, offset_seconds, user, technique, note.
    """
    note = F.coalesce("note", F.lit(""))
    told = F.contains(note, F.lit("FIRST_COMPROMISE")) | F.lower(note).startswith("first")
    on_truth = truth.select("pack_id", "host", F.lit(True).alias("_t")).distinct()
    rows = steps.join(on_truth, ["pack_id", "host"], "left").withColumn(
        "p", F.when(told, 0).when((F.lower("kind") == "auth") & F.col("_t"), 1)
    ).filter("p is not null")
    method = F.when(F.col("p") == 0, note).otherwise(F.coalesce(F.when(note != "", note), F.lit("first_auth")))
    pick = F.struct("host", "offset_seconds", "user", "technique", method.alias("method"))
    return rows.groupBy("pack_id").agg(F.min_by(pick, F.struct("p", "step_no")).alias("r")).select("pack_id", "r.*")


def methods_by_host(steps: DataFrame) -> DataFrame:
    """Distinct methods of each host in order of first use: the ``method=`` token, else 60 characters."""
    txt = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("note", "technique", "kind")], F.lit(""))
    method = F.when(F.contains(txt, F.lit("method=")), F.regexp_extract(txt, r"method=\s*(\S*)", 1)).otherwise(F.substring(txt, 1, 60))
    first = steps.withColumn("method", method).groupBy("pack_id", "host", "method").agg(F.min("step_no").alias("at"))
    return first.groupBy("pack_id", "host").agg(F.sort_array(F.collect_list(F.struct("at", "method"))).alias("m")).select(
        "pack_id", "host", F.transform("m", lambda x: x["method"]).alias("methods")
    )


def retry_summary(attempts: DataFrame) -> DataFrame:
    """Match rate and mean overlap. Columns: matched, jaccard."""
    return attempts.groupBy().agg(
        F.round(F.coalesce(F.try_divide(F.count_if("matched"), F.count(F.lit(1))), F.lit(0.0)), 3).alias("match_rate"),
        F.round(F.avg("jaccard"), 4).alias("mean_jaccard"),
    )


def stable_residuals(residuals: DataFrame, n_attempts: int) -> DataFrame:
    """Hosts (attempt, host) seen in at least half of the attempts, rounded up."""
    bar = n_attempts // 2 + n_attempts % 2
    return residuals.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= bar)


def metric_gates(rows: DataFrame, min_benign: int = 5, max_fcr: float = 0.10, min_lift: float = 0.05) -> DataFrame:
    """Columns: n_benign, false_campaign_rate, f1_lift."""
    return rows.withColumns(
        {
            "benign_gate": (F.col("n_benign") >= min_benign) & (F.col("false_campaign_rate") <= max_fcr),
            "lift_gate": F.col("f1_lift") >= min_lift,
        }
    )


def missing_channels(stats: DataFrame, required: DataFrame) -> DataFrame:
    """Required channels without an adapted event."""
    live = stats.filter("adapted >= 1").select("channel")
    return required.select("channel").distinct().join(live, "channel", "left_anti")
