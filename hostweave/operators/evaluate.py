"""Scoring of predicted campaigns against labelled truth, all packs in one job.

Tables: ``preds`` (pack_id, idx, campaign_id, host_ids, stage_names, score) and ``truths`` (pack_id,
truth_idx, truth_id, truth_hosts, truth_stages, family). Pairs come from an equi-join on hosts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.functions.sets import jaccard
from hostweave.session import cut, with_rank

# The bars of the pass decision.
PASS_BARS = {
    "min_f1": 0.70, "min_precision": 0.80, "min_recall": 0.70, "min_precision_at_1": 0.80,
    "max_false_campaign_rate": 0.10, "max_seconds": 2.0, "max_false_isolate_rate": 0.10,
}


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def is_benign() -> Column:
    return (F.col("family") == "benign") | (F.size("truth_hosts") == 0)


def match_pairs(preds: DataFrame, truths: DataFrame, min_jaccard: float = 0.5) -> DataFrame:
    """Pairs with enough host overlap and a shared stage name (or a truth without stages)."""
    p = preds.select("pack_id", "idx", "stage_names", F.size("host_ids").alias("np"), F.explode("host_ids").alias("host"))
    t = truths.filter(~is_benign()).select(
        "pack_id", "truth_idx", "truth_stages", F.size("truth_hosts").alias("nt"), F.explode("truth_hosts").alias("host")
    )
    shared = p.drop("stage_names").join(t.drop("truth_stages"), ["pack_id", "host"]).groupBy("pack_id", "idx", "truth_idx").agg(
        F.count(F.lit(1)).alias("n"), F.max("np").alias("np"), F.max("nt").alias("nt")
    )
    pairs = shared.withColumn("jaccard", F.col("n") / (F.col("np") + F.col("nt") - F.col("n"))).filter(F.col("jaccard") >= min_jaccard)
    named = pairs.join(preds.select("pack_id", "idx", "campaign_id", "stage_names"), ["pack_id", "idx"]).join(
        truths.select("pack_id", "truth_idx", "truth_id", "truth_stages"), ["pack_id", "truth_idx"]
    )
    ok = F.arrays_overlap("stage_names", "truth_stages") | (F.size("truth_stages") == 0)
    return named.filter(ok).select("pack_id", "idx", "truth_idx", "campaign_id", "truth_id", "jaccard")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """One-to-one matches taken in descending (jaccard, idx, truth_idx) order.

    A pair that is the best one left for both its ends is taken by the ordered greedy pass too, so all
    such pairs are taken at once and the rest goes round again. No pack is held by one task.
    """
    left, taken = pairs, None
    while True:
        rank = F.struct("jaccard", "idx", "truth_idx")
        by_p = left.groupBy("pack_id", "idx").agg(F.max(rank).alias("bp"))
        by_t = left.groupBy("pack_id", "truth_idx").agg(F.max(rank).alias("bt"))
        best = left.join(by_p, ["pack_id", "idx"]).join(by_t, ["pack_id", "truth_idx"])
        won = cut(best.filter((F.col("bp") == rank) & (F.col("bt") == rank)).select(*pairs.columns))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(
            left.join(won.select("pack_id", "idx"), ["pack_id", "idx"], "left_anti").join(
                won.select("pack_id", "truth_idx"), ["pack_id", "truth_idx"], "left_anti"
            ).select(*pairs.columns)
        )
        if left.isEmpty():
            return taken


def top_prediction(preds: DataFrame) -> DataFrame:
    """Highest score of each pack, the earlier one on ties."""
    others = [c for c in preds.columns if c != "pack_id"]
    return preds.groupBy("pack_id").agg(F.max_by(F.struct(*others), F.struct("score", -F.col("idx"))).alias("_r")).select("pack_id", "_r.*")


def precision_at_1(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """(pack_id, precision_at_1) for every pack with a prediction."""
    top = top_prediction(preds)
    hit = match_pairs(top, truths).select("pack_id").distinct().withColumn("hit", F.lit(1.0))
    return top.select("pack_id").join(hit, "pack_id", "left").select("pack_id", F.coalesce("hit", F.lit(0.0)).alias("precision_at_1"))


def isolation_metrics(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Per pack: hosts that would be isolated, right, wrong and missed. ``truths`` has one row per pack."""
    p = preds.select("pack_id", F.explode("host_ids").alias("host")).distinct().withColumn("in_p", F.lit(1))
    t = truths.filter(~is_benign()).select("pack_id", F.explode("truth_hosts").alias("host")).distinct().withColumn("in_t", F.lit(1))
    both = p.join(t, ["pack_id", "host"], "full").groupBy("pack_id").agg(
        F.count("in_p").alias("np"), F.count_if(F.col("in_p").isNotNull() & F.col("in_t").isNotNull()).alias("ok"), F.count("in_t").alias("nt")
    )
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    rows = truths.select("pack_id", is_benign().alias("benign")).join(both, "pack_id", "left").select(
        "pack_id", "benign", z("np").alias("hosts_proposed"), z("ok").alias("hosts_correct"),
        (z("np") - z("ok")).alias("false_isolates"), (z("nt") - z("ok")).alias("missed_hosts"),
    )
    n, ok = F.col("hosts_proposed"), F.col("hosts_correct")
    return rows.withColumns(
        {
            "false_isolate_rate": ratio(F.col("false_isolates"), n),
            "isolate_precision": F.when(F.col("benign"), F.when(n > 0, 0.0).otherwise(1.0)).otherwise(ratio(ok, n)),
            "isolate_recall": F.when(F.col("benign"), F.lit(1.0)).otherwise(ratio(ok, ok + F.col("missed_hosts"))),
        }
    ).drop("benign")


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "campaign_f1": F.when(tp == 0, F.lit(0.0)).otherwise(ratio(2 * p * r, p + r))}


def score_packs(preds: DataFrame, truths: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """One score row per pack. A benign pack scores 1 without any prediction, else 0."""
    n_pred = preds.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_pred"))
    tp = greedy_matches(match_pairs(preds, truths)).groupBy("pack_id").agg(F.count(F.lit(1)).alias("tp"))
    rows = truths.groupBy("pack_id").agg(
        F.first("family").alias("family"), F.count_if(~is_benign()).alias("n_truth"), F.max(F.col("family") == "benign").alias("benign")
    )
    rows = rows.join(n_pred, "pack_id", "left").join(tp, "pack_id", "left").join(precision_at_1(preds, truths), "pack_id", "left")
    rows = rows.na.fill(0, ["n_pred", "tp"]).na.fill(0.0, ["precision_at_1"])
    rows = rows.withColumn("seconds", F.lit(0.0)) if seconds is None else rows.join(seconds, "pack_id", "left").na.fill(0.0, ["seconds"])
    b, clean = F.col("benign"), (F.col("n_pred") == 0).cast("double")
    hit, miss = F.col("tp"), F.col("n_truth") - F.col("tp")
    m = prf(hit, F.col("n_pred") - hit, miss)
    pick = lambda c: F.when(b, clean).otherwise(c)
    return rows.select(
        "pack_id", F.coalesce(F.when(F.col("family") != "", F.col("family")), F.lit("unknown")).alias("family"), "benign",
        F.when(b, 0).otherwise(hit).cast("bigint").alias("tp"),
        F.when(b, F.col("n_pred")).otherwise(F.col("n_pred") - hit).cast("bigint").alias("fp"),
        F.when(b, 0).otherwise(miss).cast("bigint").alias("fn"),
        *[pick(m[k]).alias(k) for k in ("precision", "recall", "campaign_f1")],
        pick(F.col("precision_at_1")).alias("precision_at_1"),
        F.when(b & (F.col("n_pred") > 0), 1.0).otherwise(0.0).alias("false_campaign_rate"),
        "seconds",
    )


def aggregate_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 and P@1, micro precision and recall over attack packs; false-campaign rate over benign ones."""
    attack = ~F.col("benign")
    on = lambda c: F.when(attack, F.col(c))
    agg = scores.groupBy(*by).agg(
        F.count_if(attack).alias("n_attack"), F.avg(on("campaign_f1")).alias("f1"), F.avg(on("precision_at_1")).alias("p1"),
        *[F.coalesce(F.sum(on(c)), F.lit(0)).cast("double").alias(c) for c in ("tp", "fp", "fn")],
        F.coalesce(F.avg(F.when(~attack, F.col("false_campaign_rate"))), F.lit(0.0)).alias("false_campaign_rate"),
        F.coalesce(F.max("seconds"), F.lit(0.0)).alias("seconds"), F.count(F.lit(1)).alias("n_packs"),
    )
    m = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    some, fcr = F.col("n_attack") > 0, F.col("false_campaign_rate")
    alone = F.when(F.col("n_packs") == 0, F.lit(0.0)).otherwise(1.0 - fcr)
    return agg.select(
        *by, F.when(some, F.col("f1")).otherwise(alone).alias("campaign_f1"), F.when(some, m["precision"]).otherwise(alone).alias("precision"),
        F.when(some, m["recall"]).otherwise(F.when((fcr == 0) & (F.col("n_packs") > 0), 1.0).otherwise(0.0)).alias("recall"),
        F.when(some, F.col("p1")).otherwise(alone).alias("precision_at_1"), "false_campaign_rate", "seconds", "tp", "fp", "fn",
    )


def pooled_isolation(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cols = ("hosts_proposed", "hosts_correct", "false_isolates", "missed_hosts")
    agg = metrics.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
    ok = F.col("hosts_correct")
    return agg.withColumns(
        {
            "false_isolate_rate": ratio(F.col("false_isolates"), F.col("hosts_proposed")),
            "isolate_precision": ratio(ok, F.col("hosts_proposed")),
            "isolate_recall": ratio(ok, ok + F.col("missed_hosts")),
        }
    )


METRICS = ("campaign_f1", "precision", "recall", "precision_at_1", "false_campaign_rate", "seconds")


def lift(ours: DataFrame, baseline: DataFrame, by: Sequence[str]) -> DataFrame:
    """Difference to a baseline's metric row, joined on ``by``."""
    base = baseline.select(*by, *[F.col(c).alias(f"baseline_{c}") for c in METRICS])
    return ours.join(base, list(by)).select(
        *by, "campaign_f1", "baseline_campaign_f1", (F.col("campaign_f1") - F.col("baseline_campaign_f1")).alias("f1_lift"),
        "recall", "baseline_recall", (F.col("recall") - F.col("baseline_recall")).alias("recall_lift"),
        "precision", "baseline_precision", "false_campaign_rate", "baseline_false_campaign_rate",
    )


def pass_reasons(rows: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``passed``. Columns: METRICS, b2_f1, detector_f1, and optionally
    false_isolate_rate and train (the baseline floor of 0.40 applies to training packs)."""
    b = PASS_BARS
    f1, b2 = F.col("campaign_f1"), F.col("b2_f1")
    need = F.greatest(F.lit(b["min_f1"]), b2)
    checks = [
        F.when(f1 < need, "f1_below_bar"),
        F.when(f1 < b2, "f1_below_b2"),
        F.when(F.col("precision") < b["min_precision"], "precision"),
        F.when(F.col("recall") < b["min_recall"], "recall"),
        F.when(F.col("precision_at_1") < b["min_precision_at_1"], "precision_at_1"),
        F.when(F.col("false_campaign_rate") > b["max_false_campaign_rate"], "false_campaign_rate"),
        F.when(F.col("seconds") > b["max_seconds"], "seconds"),
        F.when(~((f1 >= F.col("detector_f1") - 0.05) | (f1 >= b2)), "ablation"),
    ]
    if "false_isolate_rate" in rows.columns:
        checks.append(F.when(F.col("false_isolate_rate") > b["max_false_isolate_rate"], "false_isolate_rate"))
    if "train" in rows.columns:
        checks.append(F.when(F.col("train") & (b2 < 0.40), "b2_train_floor"))
    return rows.withColumn("reasons", F.array_compact(F.array(*checks))).withColumn("passed", F.size("reasons") == 0)


# --- where fusion helps and where it fails -------------------------------------------------------


def _host_union(preds: DataFrame, name: str) -> DataFrame:
    return preds.select("pack_id", F.explode("host_ids").alias("h")).distinct().groupBy("pack_id").agg(F.sort_array(F.collect_list("h")).alias(name))


def best_by_hosts(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Per pack: best host overlap, its campaign (earliest on ties), number of campaigns, all their hosts."""
    rows = preds.join(truths.select("pack_id", "truth_hosts"), "pack_id").withColumn("j", jaccard("host_ids", "truth_hosts"))
    best = rows.groupBy("pack_id").agg(
        F.max("j").alias("best_jaccard"), F.count(F.lit(1)).alias("n_campaigns"),
        F.max_by(F.struct("campaign_id", "host_ids"), F.struct("j", -F.col("idx"))).alias("b"),
    )
    return best.join(_host_union(preds, "hosts_union"), "pack_id", "left").select(
        "pack_id", "best_jaccard", "n_campaigns", F.col("b.campaign_id").alias("best_campaign"), F.col("b.host_ids").alias("best_hosts"),
        "hosts_union",
    )


def break_points(truths: DataFrame, fused: DataFrame, detectors: DataFrame) -> DataFrame:
    """Missed, over-merged and secondary hosts per pack, and whether fusion beat the detectors."""
    none = F.array().cast("array<string>")
    pick = lambda df, n: best_by_hosts(df, truths).select(
        "pack_id", *[F.col(c).alias(f"{n}_{c}") for c in ("best_jaccard", "n_campaigns", "best_hosts", "hosts_union")]
    )
    rows = truths.join(pick(fused, "f"), "pack_id", "left").join(pick(detectors, "d"), "pack_id", "left")
    rows = rows.na.fill(0.0, ["f_best_jaccard", "d_best_jaccard"]).na.fill(0, ["f_n_campaigns", "d_n_campaigns"])
    arr = lambda c: F.coalesce(c, none)
    f_ok, d_ok = F.col("f_best_jaccard") >= 0.5, F.col("d_best_jaccard") >= 0.5
    fb, fu, du, t = arr("f_best_hosts"), arr("f_hosts_union"), arr("d_hosts_union"), F.col("truth_hosts")
    diff = lambda a, b: F.array_sort(F.array_except(a, b))
    return rows.select(
        "pack_id", F.round("f_best_jaccard", 4).alias("best_jaccard"), f_ok.alias("matched"), F.round("d_best_jaccard", 4).alias("detector_jaccard"),
        diff(t, fu).alias("missed_hosts"), diff(fb, t).alias("over_merged_hosts"), diff(F.array_except(fu, fb), t).alias("secondary_hosts"),
        diff(t, du).alias("never_in_detector"), (f_ok & ~d_ok).alias("fusion_lift"), (~f_ok & ~d_ok).alias("both_missed"),
        ((F.col("d_n_campaigns") >= 2) & ~d_ok).alias("detector_fragmented"),
    )


def thin_alerts(preds: DataFrame, truths: DataFrame) -> DataFrame:
    rows = preds.join(truths.select("pack_id", "truth_hosts"), "pack_id").withColumn("j", jaccard("host_ids", "truth_hosts"))
    return rows.filter("j < 0.5").select("pack_id", "campaign_id", F.array_sort("host_ids").alias("hosts"), F.round("j", 4).alias("jaccard"))


def ranked_campaigns(preds: DataFrame, truths: DataFrame) -> DataFrame:
    """Place of each campaign by (overlap, score), earlier ones first on ties."""
    rows = preds.join(truths.select("pack_id", "truth_hosts"), "pack_id").withColumn("jaccard", F.round(jaccard("host_ids", "truth_hosts"), 4))
    rows = rows.select("pack_id", "campaign_id", "jaccard", "score", "idx", (-F.col("jaccard")).alias("_j"), (-F.col("score")).alias("_s"))
    return with_rank(rows, ["_j", "_s", "idx"], "place", ["pack_id"]).drop("_j", "_s")


def score_margin(preds: DataFrame) -> DataFrame:
    """Top score minus the second (the top itself when alone): two values per pack, found by hash aggregation."""
    top = preds.groupBy("pack_id").agg(F.max(F.struct("score", -F.col("idx"))).alias("t"), F.count(F.lit(1)).alias("n"))
    rest = preds.join(top, "pack_id").filter(F.col("idx") != -F.col("t.col2"))
    second = rest.groupBy("pack_id").agg(F.max("score").alias("s2"))
    rows = top.join(second, "pack_id", "left")
    return rows.select("pack_id", F.round(F.col("t.score") - F.coalesce("s2", F.lit(0.0)), 4).alias("score_margin"))


def break_summary(breaks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    lifted = F.count_if("fusion_lift")
    return breaks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_packs"), lifted.alias("fusion_lift_count"), F.count_if("both_missed").alias("both_missed_count"),
        F.sort_array(F.collect_list(F.when(F.size("missed_hosts") > 0, F.col("pack_id")))).alias("packs_with_missed_hosts"),
        F.coalesce(F.try_divide(lifted, F.count(F.lit(1))), F.lit(0.0)).alias("fusion_lift_rate"),
    )


def rebuild_regression(campaigns: DataFrame, truths: DataFrame) -> DataFrame:
    """Per pack: rebuild the campaign closest to the truth and decide whether that is good enough."""
    from hostweave.operators.reconstruct import reconstruct

    rows = campaigns.join(truths.select("pack_id", "truth_hosts"), "pack_id").withColumn("_j", jaccard("host_ids", "truth_hosts"))
    keep = [c for c in campaigns.columns if c != "pack_id"]
    best = rows.groupBy("pack_id").agg(F.max_by(F.struct(*keep), F.struct("_j", -F.col("idx"))).alias("b"), F.count(F.lit(1)).alias("n"))
    best = best.select("pack_id", "n", "b.*")
    built = reconstruct(best, truths, ["pack_id"]).select("pack_id", "n", "campaign_id", "status", "confidence", "host_jaccard", "gaps")
    out = truths.select("pack_id", "family").join(built, "pack_id", "left")
    benign, found = F.col("family") == "benign", F.col("n").isNotNull()
    good = F.coalesce(F.col("status").isin("complete", "partial") & (F.col("host_jaccard") >= 0.5), F.lit(False))
    return out.select(
        "pack_id", "family", F.when(benign, ~found).otherwise(good).alias("ok"),
        F.when(benign, F.when(found, "false_campaign").otherwise("empty")).when(~found, "insufficient_evidence").otherwise(F.col("status")).alias("status"),
        F.when(benign, F.when(found, 0.0).otherwise(1.0)).otherwise(F.coalesce("host_jaccard", F.lit(0.0))).alias("host_jaccard"),
    )


def regression_totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    benign = F.col("family") == "benign"
    n_ok = F.count_if("ok")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_packs"), n_ok.alias("n_ok"), ((n_ok == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)).alias("passed"),
        F.count_if(F.col("ok") & ~benign).alias("attack_ok"), F.count_if(~benign).alias("attack_n"),
        F.count_if(F.col("ok") & benign).alias("benign_ok"), F.count_if(benign).alias("benign_n"),
    )
