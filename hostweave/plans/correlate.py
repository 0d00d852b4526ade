"""Fixed pipelines over the operators: modes, replay of signed events, and pack evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.config import FuseConfig
from hostweave.operators.detect import all_signals, baseline_joins, baseline_per_host, detector_campaigns, per_host_campaigns
from hostweave.operators.evaluate import aggregate_scores, isolation_metrics, lift, pass_reasons, pooled_isolation, score_packs
from hostweave.operators.merge import fused_campaigns
from hostweave.operators.reconstruct import reconstruct
from hostweave.operators.trust import dedup_events, drop_replays, verify_events
from hostweave.session import cut
from hostweave.sources.exports import flatten_payload

MODES = ("fused", "detector_only", "ablation", "b1", "b2")


def campaigns(events: DataFrame, mode: str = "fused", cfg: FuseConfig = FuseConfig(), by: Sequence[str] = ()) -> DataFrame:
    """Campaign rows of one mode, all with the columns (by, campaign_id, host_ids, stages, score)."""
    if mode == "fused":
        rows = fused_campaigns(events, cfg, by, with_evidence=False)
    elif mode == "detector_only":
        rows = detector_campaigns(all_signals(events, cfg.recon_min_distinct, cfg.max_small_bytes, by), cfg.min_hosts, by)
    elif mode == "ablation":
        rows = per_host_campaigns(events, by=by)
    elif mode == "b1":
        rows = baseline_per_host(events, by)
    elif mode == "b2":
        rows = baseline_joins(events, by)
    else:
        raise ValueError(f"mode must be one of {MODES}")
    stages = F.transform("stages", lambda s: F.struct(s["name"].alias("name"), s["hosts"].alias("hosts")))
    place = F.col("ord") if mode == "fused" else F.lit(None).cast("bigint")
    return rows.select(*by, "campaign_id", "host_ids", stages.alias("stages"), "score", place.alias("ord"))


def replay(signed: DataFrame, enrollment: DataFrame, cfg: FuseConfig = FuseConfig()) -> dict[str, DataFrame]:
    """Verify, drop replays among what verified, deduplicate, correlate and rebuild one run of signed events.

    ``signed`` has the envelope columns and ``ingest_seq``.
    """
    verified = verify_events(signed, enrollment)
    fresh, replays = drop_replays(verified.filter("reason IS NULL").drop("reason"))
    accepted, rejected = dedup_events(fresh), verified.filter("reason IS NOT NULL")
    events = cut(flatten_payload(accepted))
    found = cut(fused_campaigns(events, cfg))
    return {
        "events": events, "rejected": rejected.unionByName(replays, allowMissingColumns=True), "campaigns": found, "reconstruction": reconstruct(found),
    }


def as_predictions(rows: DataFrame) -> DataFrame:
    """Campaigns of many packs as scoring input; ``idx`` is their order within the pack."""
    from hostweave.session import with_rank

    order = F.coalesce(F.col("ord"), F.lit(0))
    ranked = with_rank(rows.withColumn("_o", order), ["_o", "campaign_id"], "idx", ["pack_id"]).drop("_o", "ord")
    names = F.array_distinct(F.transform("stages", lambda s: s["name"]))
    return ranked.withColumn("stage_names", names)


def as_truths(truth: DataFrame) -> DataFrame:
    """One truth row per pack as scoring input."""
    return truth.select(
        "pack_id", F.lit(0).alias("truth_idx"), F.col("campaign_id").alias("truth_id"), F.col("host_ids").alias("truth_hosts"),
        F.array_distinct(F.transform("stages", lambda s: s["name"])).alias("truth_stages"), "family",
    )


def evaluate(events: DataFrame, truth: DataFrame, cfg: FuseConfig = FuseConfig(), train: bool = False) -> dict[str, DataFrame]:
    """Score every mode on all packs in one job and decide the gate. Events carry ``pack_id``."""
    truths = cut(as_truths(truth))
    scores, totals, fused = {}, {}, None
    for mode in ("fused", "b1", "b2", "detector_only"):
        preds = cut(as_predictions(campaigns(events, mode, cfg, ["pack_id"])))
        fused = preds if mode == "fused" else fused
        scores[mode] = cut(score_packs(preds, truths))
        totals[mode] = aggregate_scores(scores[mode]).withColumn("split", F.lit("all"))
    iso = cut(isolation_metrics(fused, truths))
    pooled = pooled_isolation(iso).select(F.lit("all").alias("split"), "false_isolate_rate")
    f1 = lambda m, n: totals[m].select("split", F.col("campaign_f1").alias(n))
    gate_in = totals["fused"].join(f1("b2", "b2_f1"), "split").join(f1("detector_only", "detector_f1"), "split").join(pooled, "split")
    return {
        "scores": scores["fused"], "by_mode": _modes(totals), "isolation": iso,
        "by_family": aggregate_scores(scores["fused"], ["family"]), "lift_b1": lift(totals["fused"], totals["b1"], ["split"]),
        "gate": pass_reasons(gate_in.withColumn("train", F.lit(train))), "predictions": fused, "truths": truths,
    }


def _modes(totals: dict[str, DataFrame]) -> DataFrame:
    out = None
    for mode, df in totals.items():
        part = df.withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out
