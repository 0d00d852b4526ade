import hashlib
import hmac
import json
import time

from pyspark.sql import functions as F

from hostweave.operators import trust
from hostweave.plans.correlate import replay

SECRET = {"prod-a": b"k" * 32, "prod-b": b"q" * 80}
FIELDS = ["schema_ver", "producer_id", "host_id", "event_id", "ts_utc", "nonce", "payload_type"]


def enrolled(spark):
    return spark.createDataFrame([("prod-a", "host-a", bytearray(SECRET["prod-a"])), ("prod-b", "host-b", bytearray(SECRET["prod-b"]))], "producer_id string, host_id string, secret binary")


def signed(i, producer, host, payload, ptype="auth", at="2026-01-15T12:00:00.000000Z"):
    e = {"schema_ver": "1", "event_id": f"e{i}", "producer_id": producer, "host_id": host, "ts_utc": at, "nonce": f"n{i}", "payload_type": ptype}
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    msg = "||".join([e[f] for f in FIELDS] + [digest]).encode()
    mac = hmac.new(SECRET.get(producer, b"other-key-other-key"), msg, hashlib.sha256).hexdigest()
    return {**e, "payload": json.dumps(payload), "hmac": mac, "ingest_seq": i}


def frame(spark, rows):
    cols = ["ingest_seq", *FIELDS, "payload", "hmac"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], "ingest_seq bigint, " + ", ".join(f"{c} string" for c in cols[1:]))


def test_signatures_match_the_standard_library(spark):
    rows = [signed(1, "prod-a", "host-a", {"b": 1, "a": "é\n\"x"}), signed(2, "prod-b", "host-b", {"n": 12000.0, "z": None, "l": [1, {"y": 1, "x": 2}]})]
    got = {r["ingest_seq"]: r["hmac"] for r in trust.sign_events(frame(spark, rows), enrolled(spark)).collect()}
    assert got == {r["ingest_seq"]: r["hmac"] for r in rows}


def test_reasons_and_dedup(spark):
    bad = {**signed(3, "prod-a", "host-a", {"user": "u"}), "payload": json.dumps({"user": "v"})}
    rows = [signed(1, "prod-a", "host-a", {"user": "u"}), signed(2, "prod-a", "host-b", {"user": "u"}), bad, {**signed(1, "prod-a", "host-a", {"user": "u"}), "ingest_seq": 9}]
    ok, rejected = trust.ingest(frame(spark, rows), enrolled(spark))
    assert [(r["event_id"], r["ingest_seq"]) for r in ok.collect()] == [("e1", 1)]
    assert {r["event_id"]: r["reason"] for r in rejected.collect()} == {"e2": "not_enrolled", "e3": "bad_hmac"}
    assert {r["reason"] for r in trust.verify_events(frame(spark, rows), None).collect()} == {"enrollment_required"}
    assert trust.ingest(frame(spark, rows), None, allow_unverified=True)[0].count() == 3


def test_restamp(spark):
    bad = {**signed(3, "prod-a", "host-a", {"user": "u"}), "hmac": "00"}
    rows = frame(spark, [signed(1, "prod-a", "host-a", {"user": "u"}), bad])
    again = trust.restamp(rows, enrolled(spark))
    assert trust.verify_events(again, enrolled(spark)).filter("reason is not null").count() == 0
    assert {r["event_id"]: json.loads(r["payload"]).get("provenance") for r in again.collect()} == {"e1": None, "e3": "locally_stamped"}
    assert trust.restamp(rows, enrolled(spark), allow_stamp=False).count() == 1


def test_chain_detects_changes(spark):
    rows = spark.createDataFrame([("r", i, "k", json.dumps({"i": i}, separators=(",", ":"))) for i in range(1, 6)], "run_id string, seq bigint, kind string, payload string")
    log = trust.append_chain(rows)
    first = log.filter("seq = 1").first()
    body = json.dumps({"prev": "0" * 64, "kind": "k", "payload": {"i": 1}}, sort_keys=True, separators=(",", ":"))
    assert first["entry_hash"] == hashlib.sha256(body.encode()).hexdigest()
    assert trust.verify_chain(log, ["run_id"]).filter("not valid").count() == 0
    forged = log.withColumn("payload", F.when(F.col("seq") == 3, '{"i":99}').otherwise(F.col("payload")))
    assert [r["seq"] for r in trust.verify_chain(forged, ["run_id"]).filter("not valid").collect()] == [3]
    cut_out = log.filter("seq <> 2")
    assert [r["seq"] for r in trust.verify_chain(cut_out, ["run_id"]).filter("not valid").collect()] == [3]


def test_long_chains(spark):
    """30,000 entries of one run beside short runs, an unnamed run, and an entry without payload: linear in the entries."""
    rows = [("long", i, "k", str(i)) for i in range(30_000)] + [(r, i, "k", str(i)) for r in ("a", None) for i in (2, 1)]
    rows += [("gap", 1, "k", "1"), ("gap", 2, "k", None), ("gap", 3, "k", "3")]
    begun = time.monotonic()
    log = trust.append_chain(spark.createDataFrame(rows, "run_id string, seq int, kind string, payload string").repartition(4))
    assert log.dtypes == [("run_id", "string"), ("seq", "bigint"), ("prev", "string"), ("kind", "string"), ("payload", "string"), ("entry_hash", "string")]
    found = {(r["run_id"], r["seq"]): (r["prev"], r["entry_hash"]) for r in log.collect()}
    assert time.monotonic() - begun < 60
    assert len(found) == len(rows)
    last = {}
    for run, seq, _, payload in sorted(rows, key=lambda r: r[1]):
        prev = last.get(run, "0" * 64)
        text = None if prev is None or payload is None else '{"kind":"k","payload":' + payload + ',"prev":"' + prev + '"}'
        last[run] = None if text is None else hashlib.sha256(text.encode()).hexdigest()
        assert found[run, seq] == (prev, last[run])


def test_replay_pipeline(spark):
    rows = [signed(i, p, h, {"user": "svc", "result": "success"}, at=f"2026-01-15T12:00:{10 + i}.000000Z") for i, (p, h) in enumerate([("prod-a", "host-a"), ("prod-b", "host-b")])]
    rows.append({**rows[0], "ingest_seq": 7})
    out = replay(frame(spark, rows), enrolled(spark))
    camp = out["campaigns"].first()
    assert camp["campaign_id"] == "camp-lateral-svc-1" and camp["host_ids"] == ["host-a", "host-b"]
    assert [r["reason"] for r in out["rejected"].collect()] == ["replay"]
    built = out["reconstruction"].first()
    assert built["status"] == "complete" and built["plan_refused"] and built["quarantine_hosts"] == []


def test_forged_rows_do_not_take_nonces_and_no_row_is_lost(spark):
    from hostweave.plans.correlate import verify_events

    def row(i, event_id, nonce, payload):
        return {**signed(i, "prod-a", "host-a", {}), "event_id": event_id, "nonce": nonce, "payload": payload}

    good = [row(1, "e1", "n1", '{"a":1}'), row(2, "e2", None, '{"a":2}'), row(3, "e3", "n1", '{"a":3}'), row(4, "e4", "n4", "{broken")]
    good = trust.sign_events(frame(spark, good), enrolled(spark))
    forged = frame(spark, [row(0, "f1", "n1", '{"a":9}')])
    checked = verify_events(forged.unionByName(good, allowMissingColumns=True), enrolled(spark))
    fresh, replays = trust.drop_replays(checked.filter("reason IS NULL").drop("reason"))
    reasons = {r.event_id: r.reason for r in checked.filter("reason IS NOT NULL").unionByName(replays).collect()}
    assert [r.event_id for r in fresh.collect()] == ["e1"]
    assert reasons == {"f1": "bad_hmac", "e2": "bad_shape", "e3": "replay", "e4": "bad_payload"}
