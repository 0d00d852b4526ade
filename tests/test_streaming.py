from pyspark.sql import functions as F

from hostweave.config import FuseConfig
from hostweave.operators.merge import fused_campaigns
from hostweave.operators.sessions import gap_sessions
from hostweave.sources.sinks import read_campaigns
from hostweave.streaming import live
from hostweave.streaming.state import StepState, capped_step, session_step
from tests.model import SCHEMA, auth, campaigns, frame, leak, walk

HOSTS = ["host-31", "host-32", "host-33"]
CHAIN = walk("patch2", HOSTS, 4, 15) + leak(HOSTS[:0:-1], "192.0.2.118", 14_600, 61)


def put(spark, df, folder, n):
    df.coalesce(1).write.parquet(f"{folder}/part{n}")


def test_recompute_and_respond_loops(spark, tmp_path):
    """Two batches, the earlier events arriving last, give what one batch over everything gives."""
    src, events, camps, props = (str(tmp_path / n) for n in ("src", "events", "camps", "props"))
    step = live.recompute_step(spark, events, camps, "run")
    respond = live.respond_step(spark, camps, props)

    def both(batch, batch_id):
        step(batch, batch_id)
        respond(batch, batch_id)

    whole = frame(spark, CHAIN)
    for n, keep in enumerate(["ingest_seq >= 2", "ingest_seq < 2"]):
        put(spark, whole.filter(keep), src, n)
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        live.start(stream, both, str(tmp_path / "ckpt")).awaitTermination()
    got = {(r["campaign_id"], tuple(r["host_ids"])) for r in read_campaigns(spark, camps).collect()}
    assert got == {(c[0], c[1]) for c in campaigns(CHAIN)}
    assert got == {(r["campaign_id"], tuple(r["host_ids"])) for r in fused_campaigns(whole, FuseConfig(), with_evidence=False).collect()}
    proposed = [r["host_id"] for r in spark.read.parquet(props).collect()]
    assert sorted(proposed) == HOSTS


def in_batches(spark, whole, parts, step, folder):
    for n, keep in enumerate(parts):
        put(spark, whole.filter(keep), f"{folder}/src", n)
        stream = spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/src")
        live.start(stream, step, f"{folder}/ckpt").awaitTermination()


def statuses(spark, path, name="event_id"):
    return sorted((r[name], r["status"]) for r in spark.read.parquet(path).collect())


def test_stream_sessions_equal_batch_and_late_points_are_kept(spark, tmp_path):
    """Points come out of order over three batches; what the last watermark closes equals the batch operator."""
    base = str(tmp_path)
    points = frame(spark, [
        auth("host-a", "u", 0), auth("host-b", "u", 600), auth("host-a", "u", 1300), auth("host-a", "v", 50), auth("host-c", "v", 700), auth("host-a", "z", 90_000), auth("host-d", "u", 5),
    ])
    step = session_step(f"{base}/out", f"{base}/late", StepState(f"{base}/state", 1000 * 1_000_000), ["user"], "host_id", 600 * 1_000_000)
    in_batches(spark, points, ["ingest_seq in (0, 2, 4)", "ingest_seq in (1, 3, 5)", "ingest_seq = 6"], step, base)
    # 1300 closes nothing below 300 for the first batch: host-b at 600 joins, 'v' at 50 and the last point are late
    late = sorted(r["host_id"] for r in spark.read.parquet(f"{base}/late").collect())
    assert late == ["host-a", "host-d"]
    got = {(r["user"], r["n_points"], tuple(r["entities"])) for r in spark.read.parquet(f"{base}/out").collect()}
    used = points.filter("ingest_seq not in (3, 6) and user <> 'z'")
    want = {(r["user"], r["n_entities"]) for r in gap_sessions(used, ["user"], "host_id", "ts", 600).collect()}
    assert {(u, len(e)) for u, _, e in got} == want
    assert got == {("u", 2, ("host-a", "host-b")), ("u", 1, ("host-a",)), ("v", 1, ("host-c",))}


def test_first_seen_forgets_only_below_the_watermark(spark, tmp_path):
    base = str(tmp_path)
    rows = [(0, "a", 0), (1, "a", 1), (2, None, 5), (3, "b", 100), (4, "a", 60), (5, "b", 101), (6, "c", 20), (7, None, 130), (8, "a", 95), (9, "d", None)]
    whole = spark.createDataFrame(rows, "event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    step = live.dedup_step(f"{base}/out", StepState(f"{base}/state", 50 * 1_000_000), ["key"])
    in_batches(spark, whole, ["event_id < 4", "event_id in (4, 5, 6, 9)", "event_id in (7, 8)"], step, base)
    want = [(0, "fresh"), (1, "repeat"), (2, "fresh"), (3, "fresh"), (4, "fresh"), (5, "repeat"), (6, "late"), (7, "fresh"), (8, "repeat"), (9, "fresh")]
    assert statuses(spark, f"{base}/out") == want
    step(whole.filter("event_id in (7, 8)"), 2)  # a batch that is run again changes nothing
    assert statuses(spark, f"{base}/out") == want


def test_health(spark):
    hits = spark.createDataFrame([("dns", None), ("net", "permission_denied")], "channel string, reason string")
    want = spark.createDataFrame([("dns",), ("net",), ("pf",)], "channel string")
    rows = {r["channel"]: r for r in live.channel_health(hits, want, ["permission_denied"]).collect()}
    assert [rows[k]["degraded"] for k in ("dns", "net", "pf")] == [False, True, True] and rows["pf"]["reason"] == "zero_hits"


def test_rate_cap_holds_over_batches_and_every_row_has_a_status(spark, tmp_path):
    base = str(tmp_path)
    rows = [("a", i, f"2024-01-01 00:00:00.{i}") for i in range(4)] + [("b", 4, "2024-01-01 00:00:00.5"), (None, 5, "2024-01-01 00:00:00.5"), ("a", 6, "2024-01-01 00:00:30"), ("a", 7, "2024-01-01 00:00:00.9")]
    whole = spark.createDataFrame(rows, "host_id string, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    step = capped_step(f"{base}/out", StepState(f"{base}/state", 10 * 1_000_000), 3, ["host_id"])
    in_batches(spark, whole, ["event_id in (2, 3, 4)", "event_id in (0, 1, 5, 6)", "event_id = 7"], step, base)
    want = [(0, "fresh"), (1, "dropped"), (2, "fresh"), (3, "fresh"), (4, "fresh"), (5, "fresh"), (6, "fresh"), (7, "late")]
    assert statuses(spark, f"{base}/out") == want
    step(whole.filter("event_id = 7"), 2)
    assert statuses(spark, f"{base}/out") == want
    capped_step(f"{base}/all", StepState(f"{base}/none", 0), 0)(whole, 0)
    assert {s for _, s in statuses(spark, f"{base}/all")} == {"fresh"}
