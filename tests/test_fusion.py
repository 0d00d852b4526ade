import random
from functools import reduce

import duckdb
from pyspark.sql import DataFrame

from hostweave.config import FuseConfig
from hostweave.operators import fuse, merge
from hostweave.operators.merge import fused_campaigns
from hostweave.plans import catalog_signals as signals
from hostweave.plans.telemetry import load_telemetry
from hostweave.session import cut
from tests.fold_sql import fold_sql
from tests.model import auth, campaigns, dns, exfil, frame, leak, walk


def key_of(row):
    stages = tuple((s["name"], s["user"], s["dst_ip"], s["apex"], tuple(s["hosts"])) for s in row["stages"])
    return (row["campaign_id"], tuple(row["host_ids"]), stages, round(row["score"], 9))


def fuse_packs(spark, packs, **cfg):
    """Campaign keys per pack, from one job over all packs."""
    events = reduce(DataFrame.union, [frame(spark, specs, name) for name, specs in packs.items()])
    out = {name: set() for name in packs}
    for r in fused_campaigns(events, FuseConfig(**cfg), ["pack_id"], with_evidence=False).collect():
        out[r["pack_id"]].add(key_of(r))
    return out


H = [f"host-{i:02d}" for i in range(11, 18)]
BEACONS = [dns(h, f"q{i}.tick.example.net", 11 * i) for i, h in enumerate(H[:4])]

CASES = {
    "same_walk_days_later": walk("kiosk", H[:3], 0) + walk("kiosk", H[:3], 250_000),
    "uploads_only": leak(H[:6], "192.0.2.201", 6_100, 5),
    "relay_of_two_accounts": walk("backup7", H[:3], 0, 21) + walk("desk4", H[2:4], 200, 21),
    "walk_then_leak": walk("deploy9", H[:5], 3) + leak(H[3:5], "192.0.2.15", 17_500, 70),
    "crossing_accounts": walk("ada", H[:3], 0, 17) + walk("bo", H[1:4], 6, 17) + leak(H[1:3], "192.0.2.44", 9_300, 90),
    "beacons": BEACONS,
    "beacons_then_walk": BEACONS + walk("late1", H[:3], 655) + leak(H[2:3], "192.0.2.61", 12_900, 690),
    "pause_within_resume": walk("drowsy", H[:2], 0) + leak(H[1:2], "192.0.2.90", 8_800, 33) + walk("drowsy", H[1:3], 1_500) + leak(H[2:3], "192.0.2.91", 8_900, 1_560),
    "pause_beyond_resume": walk("drowsy", H[:2], 0) + leak(H[1:2], "192.0.2.90", 8_800, 33) + walk("drowsy", H[1:3], 6_500) + leak(H[2:3], "192.0.2.91", 8_900, 6_560),
    "three_walks_through_one_host": [
        x for i, u in enumerate(("ann", "ben", "cyd")) for x in walk(u, H[i : i + 3], 7 * i, 12) + leak([H[i + 2]], f"192.0.2.{30 + i}", 20_100 + i, 60 + 5 * i)
    ],
}


def test_cases_match_model(spark):
    assert fuse_packs(spark, CASES) == {n: set(campaigns(c)) for n, c in CASES.items()}


def test_one_run_without_packs(spark):
    specs = CASES["three_walks_through_one_host"]
    rows = fused_campaigns(frame(spark, specs), FuseConfig(), with_evidence=True).collect()
    assert {key_of(r) for r in rows} == set(campaigns(specs))
    for r in rows:
        assert {e["host_id"] for e in r["evidence"]} <= set(r["host_ids"])
        assert any(e["kind"] == "lateral_auth" for e in r["evidence"])


def host_sets(name):
    return {frozenset(c[1]) for c in campaigns(CASES[name])}


def test_model_gives_the_outcomes_the_rules_ask_for():
    assert [set(c[1]) for c in campaigns(CASES["same_walk_days_later"])] == [set(H[:3])] * 2
    assert host_sets("beacons") == {frozenset(H[:4])}
    assert any(s >= set(H[:5]) for s in host_sets("walk_then_leak"))
    assert len(campaigns(CASES["pause_within_resume"])) < len(campaigns(CASES["pause_beyond_resume"]))


def random_specs(rng, n, hosts, span):
    hs = [f"host-{i:02d}" for i in range(hosts)]
    out = []
    for _ in range(n):
        h, at = rng.choice(hs), rng.randrange(span)
        kind = rng.random()
        if kind < 0.45:
            src = rng.choice([None, "10.0.0.1", rng.choice(hs)])
            out.append(auth(h, f"u{rng.randrange(6)}", at, src))
        elif kind < 0.75:
            out.append(exfil(h, f"203.0.113.{rng.randrange(6)}", rng.choice([500, 9000, 60_000]), at))
        else:
            out.append(dns(h, f"x{rng.randrange(9)}.z{rng.randrange(3)}.test", at))
    return out


def test_random_events_match_model(spark):
    """Every random pack gives the brute-force result."""
    recon, window = 4, 600
    rng = random.Random(recon)
    packs = {
        f"p{i}": random_specs(rng, rng.choice([60, 120, 200]), rng.choice([5, 8, 14]), rng.choice([3000, 20_000, 60_000]))
        for i in range(10)
    }
    want = {n: set(campaigns(s, window=window, recon_min=recon)) for n, s in packs.items()}
    assert fuse_packs(spark, packs, recon_min_distinct=recon, window_seconds=window) == want


def test_merge_equals_sql_over_the_given_events(spark):
    """The whole event table of the smallest scale, fan-out hosts included, against the recursive SQL."""
    sf = "/root/testdata/sf0.001"
    cfg = FuseConfig(window_seconds=3600, resume_window_seconds=7200, recon_min_distinct=28)
    events = load_telemetry(spark, sf)
    items, facts = fuse.cluster_items(events, cfg)
    recon = fuse.recon_hosts(events, cfg)
    merged = merge.merge_clusters(items, cut(facts), cut(recon), cfg)
    everyone = {r["host"] for r in recon.collect()}
    got = {(r["campaign_id"], r["ord"], r["t0"], r["t1"], len(r["stages"]), tuple(sorted(set(r["plain"]) | (everyone if r["absorbs_recon"] else set())))) for r in merged.collect()}
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    wide = "recon AS (SELECT host_id AS host FROM t WHERE payload_type = 'net_conn' GROUP BY 1 HAVING count(DISTINCT dst_ip) >= 28)"
    rows = con.execute(
        f"WITH RECURSIVE {signals.TEL}, {signals.CLU_SQL}, {wide}, {fold_sql(cfg.window_us, cfg.resume_us, cfg.min_hosts)} SELECT x.cid, x.ord, x.t0, x.t1, len(x.st), x.h FROM folded"
    ).fetchall()
    assert got == {(c, o, a, z, n, tuple(h)) for c, o, a, z, n, h in rows}
    assert len(everyone) >= 2 and any(n > 1 for _, _, _, _, n, _ in rows)
