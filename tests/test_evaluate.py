import random

from hostweave.operators import evaluate as ev
from hostweave.operators import fleet_eval as fl
from hostweave.operators.reconstruct import reconstruct, run_summary

P = "pack_id string, idx int, campaign_id string, host_ids array<string>, stage_names array<string>, score double"
T = "pack_id string, truth_idx int, truth_id string, truth_hosts array<string>, truth_stages array<string>, family string"


def jac(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def random_packs(rng, n):
    preds, truths = [], []
    hosts = [f"h{i}" for i in range(6)]
    pick = lambda: sorted(rng.sample(hosts, rng.randint(1, 5)))
    for p in range(n):
        preds += [(f"p{p}", i, f"p{p}c{i}", pick(), rng.sample(["a", "b", "c"], 2), rng.choice([0.5, 0.8, 1.0])) for i in range(rng.randint(0, 5))]
        truths += [(f"p{p}", j, f"p{p}t{j}", pick(), rng.choice([["a"], ["b", "c"], []]), "attack") for j in range(rng.randint(1, 4))]
    return preds, truths


def test_greedy_matching_is_the_ordered_one(spark):
    preds, truths = random_packs(random.Random(3), 40)
    want = set()
    for pack in {t[0] for t in truths}:
        pairs = []
        for p in (x for x in preds if x[0] == pack):
            for t in (x for x in truths if x[0] == pack):
                j = jac(p[3], t[3])
                if j >= 0.5 and (set(p[4]) & set(t[4]) or not t[4]):
                    pairs.append((j, p[1], t[1], p[2], t[2]))
        up, ut = set(), set()
        for _, i, j, c, t in sorted(pairs, reverse=True):
            if i not in up and j not in ut:
                up.add(i), ut.add(j), want.add((c, t))
    got = ev.greedy_matches(ev.match_pairs(spark.createDataFrame(preds, P), spark.createDataFrame(truths, T)))
    assert {(r["campaign_id"], r["truth_id"]) for r in got.collect()} == want and len(want) > 20


def test_assignment_is_the_sequential_one(spark):
    preds, truths = random_packs(random.Random(5), 40)
    want = {}
    for pack in {t[0] for t in truths}:
        ps, ts = [x for x in preds if x[0] == pack], sorted(x for x in truths if x[0] == pack)
        reuse = len({frozenset(t[3]) for t in ts}) < len(ts)
        used = set()
        for t in ts:
            best = max(((jac(p[3], t[3]), -p[1]) for p in ps if reuse or p[1] not in used), default=None)
            want[t[2]] = (None, 0.0) if best is None else (f"{pack}c{-best[1]}", round(best[0], 6))
            if best is not None:
                used.add(-best[1])
    got = fl.assign_truths(spark.createDataFrame(preds, P), spark.createDataFrame(truths, T)).collect()
    assert {r["truth_id"]: (r["campaign_id"], round(r["jaccard"], 6)) for r in got} == want


def test_pack_scores_and_totals(spark):
    preds = [("a", 0, "c0", ["h1", "h2"], ["s"], 0.9), ("a", 1, "c1", ["h7"], ["s"], 0.5), ("ben", 0, "c2", ["h1"], ["s"], 0.5)]
    truths = [("a", 0, "t", ["h1", "h2", "h3"], ["s"], "lateral"), ("ben", 0, "t", [], [], "benign"), ("clean", 0, "t", [], [], "benign")]
    p, t = spark.createDataFrame(preds, P), spark.createDataFrame(truths, T)
    rows = {r["pack_id"]: r for r in ev.score_packs(p, t).collect()}
    assert (rows["a"]["tp"], rows["a"]["fp"], rows["a"]["fn"]) == (1, 1, 0) and rows["a"]["precision_at_1"] == 1.0
    assert rows["ben"]["false_campaign_rate"] == 1.0 and rows["clean"]["campaign_f1"] == 1.0
    total = ev.aggregate_scores(ev.score_packs(p, t)).first()
    assert total["precision"] == 0.5 and total["recall"] == 1.0 and total["false_campaign_rate"] == 0.5
    iso = {r["pack_id"]: r for r in ev.isolation_metrics(p, t).collect()}
    assert (iso["a"]["hosts_correct"], iso["a"]["false_isolates"], iso["a"]["missed_hosts"]) == (2, 1, 1)
    assert iso["ben"]["isolate_precision"] == 0.0 and iso["clean"]["isolate_precision"] == 1.0


def test_ambiguity_margin(spark):
    truths = [("x", 0, "t0", ["a", "b"], [], "k"), ("x", 1, "t1", ["c", "d"], [], "k")]
    t = spark.createDataFrame(truths, T)

    def margin(preds):
        p = spark.createDataFrame([("x", i, f"c{i}", h, ["s"], s) for i, (h, s) in enumerate(preds)], P)
        return fl.ambiguity_margin(p, fl.assign_truths(p, t), fl.collapsed_pairs(p, t)).first()["ambiguity_margin"]

    assert margin([(["a", "b"], 1.0), (["c", "d"], 1.0)]) == 1.0
    assert margin([(["a", "b"], 1.0), (["c", "d"], 1.0), (["z"], 0.95)]) == 0.05
    assert margin([(["a", "b", "c", "d"], 1.0)]) is None


C = "campaign_id string, host_ids array<string>, stages array<struct<name:string,hosts:array<string>>>, score double, evidence array<struct<kind:string,host_id:string>>"


def rebuild(spark, hosts, stages, evidence=(), score=1.0, truth=None):
    df = spark.createDataFrame([("c", hosts, stages, score, list(evidence))], C)
    t = None if truth is None else spark.createDataFrame([truth], "truth_hosts array<string>, truth_stages array<string>")
    return reconstruct(df, t).first()


def test_reconstruction_statuses(spark):
    both = [("lateral_auth", ["a", "b"])]
    assert rebuild(spark, [], [])["status"] == "empty"
    assert rebuild(spark, ["a"], [])["status"] == "insufficient_evidence"
    r = rebuild(spark, ["a", "b"], both, [("lateral_auth", "a")])
    assert (r["status"], r["confidence"], r["plan_refused"]) == ("complete", 0.75, True)
    assert rebuild(spark, ["a"], both)["status"] == "partial"
    r = rebuild(spark, ["a", "b"], [("recon_fanout", ["a"]), ("lateral_auth", ["a", "b"])])
    assert r["quarantine_hosts"] == ["a", "b"] and r["cut_point"] == "b"
    r = rebuild(spark, ["a", "b"], [], [("micro_exfil", "b")])
    assert r["status"] == "partial" and [s["name"] for s in r["steps"]] == ["micro_exfil"] and not r["plan_refused"]
    r = rebuild(spark, ["a", "b"], both, truth=(["a", "c"], ["lateral_auth"]))
    assert r["status"] == "partial" and r["missing_hosts"] == ["c"] and r["extra_hosts"] == ["b"] and not r["full_match"]
    assert rebuild(spark, ["a", "b"], both, truth=(["a", "b"], ["lateral_auth"]))["status"] == "complete"
    empty = spark.createDataFrame([], C)
    assert run_summary(reconstruct(empty)).first()["aggregate_status"] == "empty"


def test_gates(spark):
    rows = spark.createDataFrame([("pure_benign", 100.0, 4, 0, 0), ("pure_benign", 100.0, 4, 1, 0), ("mixed", 100.0, 4, 0, 0), ("pure_benign", 10.0, 4, 0, 0)], "corpus_kind string, host_hours double, n_hosts int, fp_iso int, fp_seal int")
    assert [r["gate"] for r in fl.benign_gate(rows).collect()] == ["PASS", "FAIL", "INCOMPLETE", "INCOMPLETE"]
