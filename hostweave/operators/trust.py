"""Authentication, integrity and deduplication of signed event envelopes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from hostweave.functions.signing import canonical_json, hmac_hex, key_pads, payload_digest, signed_message

# Secrets that may never be used. A caller adds product or site defaults.
FORBIDDEN_SECRETS = ("changeme", "shared", "default", "test-shared-hmac", "lab-dual-control-token")


def enrollment_issues(
    enrollment: DataFrame, allow_multihost: bool = False, forbidden: Sequence[str] = FORBIDDEN_SECRETS
) -> DataFrame:
    """(producer_id, issue) rows: several hosts under one producer, forbidden or short secrets."""
    per = enrollment.groupBy("producer_id").agg(
        F.count_distinct("host_id").alias("n_hosts"),
        F.max(F.lower(F.col("secret").cast("string")).isin(*forbidden)).alias("is_forbidden"),
        F.min(F.octet_length("secret")).alias("secret_len"),
    )
    checks = F.array(
        F.when((F.col("n_hosts") > 1) & F.lit(not allow_multihost), "multihost_producer"),
        F.when(F.col("is_forbidden"), "forbidden_secret"),
        F.when(F.col("secret_len") < 16, "short_secret"),
    )
    return per.select("producer_id", F.explode(F.array_compact(checks)).alias("issue"))


def split_multihost_producers(enrollment: DataFrame) -> DataFrame:
    """(producer_id, host_id, new_producer_id): the first host keeps the id, others get ``producer__host``.

    A new id that is already taken gets ``_x`` appended. Secrets are not made here.
    """
    pairs = enrollment.select("producer_id", "host_id").distinct()
    first = pairs.groupBy("producer_id").agg(F.min("host_id").alias("_first"))
    moved = pairs.join(first, "producer_id").withColumn(
        "new_producer_id",
        F.when(F.col("host_id") == F.col("_first"), F.col("producer_id")).otherwise(F.concat("producer_id", F.lit("__"), "host_id")),
    )
    taken = pairs.select(F.col("producer_id").alias("new_producer_id"), F.lit(True).alias("_taken")).distinct()
    out = moved.join(taken, "new_producer_id", "left")
    clash = F.coalesce("_taken", F.lit(False)) & (F.col("host_id") != F.col("_first"))
    return out.select(
        "producer_id", "host_id",
        F.when(clash, F.concat("new_producer_id", F.lit("_x"))).otherwise(F.col("new_producer_id")).alias("new_producer_id"),
    )


def with_digest(events: DataFrame, payload: str = "payload") -> DataFrame:
    return events.withColumn("payload_digest", payload_digest(F.col(payload)))


def _with_pads(events: DataFrame, enrollment: DataFrame) -> DataFrame:
    return events.join(key_pads(enrollment), ["producer_id", "host_id"], "left")


def sign_events(events: DataFrame, enrollment: DataFrame) -> DataFrame:
    """Set ``hmac`` on every row whose (producer, host) is enrolled; NULL on the others."""
    rows = _with_pads(events.drop("hmac"), enrollment)
    digest = payload_digest(F.col("payload"))
    mac = F.when(digest.isNotNull(), hmac_hex(signed_message(digest), F.col("inner"), F.col("outer")))
    return rows.withColumn("hmac", mac).drop("inner", "outer")


def enrollment_check(events: DataFrame, enrollment: DataFrame) -> DataFrame:
    pairs = enrollment.select("producer_id", "host_id", F.lit(True).alias("enrolled")).distinct()
    return events.join(pairs, ["producer_id", "host_id"], "left").withColumn("enrolled", F.coalesce("enrolled", F.lit(False)))


def verify_events(events: DataFrame, enrollment: DataFrame | None, allow_unverified: bool = False) -> DataFrame:
    """Add ``reason``: NULL when accepted, else not_enrolled / bad_payload / bad_hmac / enrollment_required."""
    if enrollment is None:
        return events.withColumn("reason", F.lit(None if allow_unverified else "enrollment_required").cast("string"))
    rows = _with_pads(events, enrollment)
    digest = payload_digest(F.col("payload"))
    mac = hmac_hex(signed_message(digest), F.col("inner"), F.col("outer"))
    reason = F.when(F.col("inner").isNull(), "not_enrolled").when(digest.isNull(), "bad_payload").when(F.coalesce(mac != F.col("hmac"), F.lit(True)), "bad_hmac")
    return rows.withColumn("reason", reason).drop("inner", "outer")


def _first_by(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """First row per key by ``order``, as a hash aggregation (a hot key is combined before the shuffle)."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(*key, "_r.*").select(*df.columns)


def dedup_events(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keep the first arrival of every event id; run it after verification. Rows without an id are all kept."""
    return _first_by(events.filter("event_id IS NOT NULL"), [*by, "event_id"], "ingest_seq").unionByName(events.filter("event_id IS NULL"))


def mark_replays(events: DataFrame) -> DataFrame:
    """Add ``replay``: every later use of a producer's nonce. Nothing is forgotten.

    Run it on verified rows, or a forged row takes the nonce of a genuine one. A row without a nonce or producer
    cannot be checked: its ``replay`` is NULL.
    """
    first = events.groupBy("producer_id", "nonce").agg(F.min("ingest_seq").alias("_first"))
    rows = events.join(first, ["producer_id", "nonce"], "left").withColumn("replay", F.col("ingest_seq") > F.col("_first"))
    return rows.drop("_first").select(*events.columns, "replay")


def drop_replays(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, rejected) of verified rows: replays and rows that cannot be checked leave with a reason."""
    marked = mark_replays(accepted)
    reason = F.when(F.col("replay").isNull(), "bad_shape").otherwise("replay")
    return marked.filter("NOT replay").drop("replay"), marked.filter("replay IS NULL OR replay").withColumn("reason", reason).drop("replay")


def ingest(
    events: DataFrame, enrollment: DataFrame | None, allow_unverified: bool = False, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): verify, then deduplicate what was accepted."""
    checked = verify_events(events, enrollment, allow_unverified)
    accepted = dedup_events(checked.filter(F.col("reason").isNull()).drop("reason"), by)
    return accepted, checked.filter(F.col("reason").isNotNull())


def restamp(events: DataFrame, enrollment: DataFrame, allow_stamp: bool = True, tag: str = "provenance") -> DataFrame:
    """Keep rows that verify; tag and sign the others again, or drop them when stamping is off."""
    checked = verify_events(events, enrollment)
    if not allow_stamp:
        return checked.filter(F.col("reason").isNull()).drop("reason")
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    again = checked.filter(F.col("reason") == "bad_hmac").drop("reason").withColumn("payload", _tagged("payload", tag))
    return good.unionByName(sign_events(again, enrollment))


def _tagged(payload: str, tag: str) -> Column:
    """Payload text with one more field; the canonical form drops an earlier one of that name."""
    body = canonical_json(F.col(payload))
    extra = F.lit(f'"{tag}":"locally_stamped"}}')
    return F.when(body == "{}", F.concat(F.lit("{"), extra)).otherwise(
        F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(","), extra)
    )


def ingest_counts(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events kept, adapted, skipped and rejected; rows carry ``status`` and ``reason``."""
    ok = F.col("status").isin("ok", "adapted")
    return rows.groupBy(*by).agg(
        F.count_if(ok & F.col("reason").isNull()).alias("events"),
        F.count_if(F.col("status") == "adapted").alias("adapted"),
        F.count_if(~ok).alias("skipped"),
        F.count_if(ok & F.col("reason").isNotNull()).alias("hmac_rejected"),
    )


# --- hash-chained log ----------------------------------------------------------------------------

GENESIS = "0" * 64


def entry_head(kind: Column, payload: Column) -> Column:
    """Canonical JSON of a log entry up to the digest of the previous one."""
    return F.concat(F.lit('{"kind":"'), kind, F.lit('","payload":'), payload, F.lit(',"prev":"'))


def entry_text(prev: Column, kind: Column, payload: Column) -> Column:
    """Canonical JSON of a log entry; ``payload`` is canonical JSON text already."""
    return F.concat(entry_head(kind, payload), prev, F.lit('"}'))


def verify_chain(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``valid`` to log rows (seq, prev, kind, payload, entry_hash), all rows in parallel.

    Each row's predecessor is found by an equi-join on its number, so no row waits for another.
    """
    before = log.select(*by, (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_before"))
    rows = log.join(before, [*by, "seq"], "left")
    expected = F.sha2(entry_text(F.col("prev"), F.col("kind"), F.col("payload")).cast("binary"), 256)
    linked = F.col("prev") == F.coalesce("_before", F.lit(GENESIS))
    return rows.withColumn("valid", linked & (expected == F.col("entry_hash"))).drop("_before")


def _chained(tip: str):
    """Chain sorted entries: ``_new`` marks the first one of a run, ``_head`` is its text up to the previous digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = tip
        for b in batches:
            before, made = [], []
            for new, head in zip(b.column("_new").to_pylist(), b.column("_head").to_pylist(), strict=True):
                if new:
                    last = tip
                before.append(last)
                # an entry without text has no digest, and so have those that follow it
                last = None if head is None or last is None else sha256(head + last.encode() + b'"}').hexdigest()
                made.append(last)
            rest = b.drop_columns(["_new", "_head"])
            yield rest.append_column("prev", pa.array(before, pa.string())).append_column("entry_hash", pa.array(made, pa.string()))

    return run


def append_chain(entries: DataFrame, tip: str = GENESIS, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Chain the new entries (seq, kind, payload) of each run onto ``tip``.

    A hash chain is sequential by nature: a run's entries are sorted and pass through one task, which holds only the last digest.
    """
    order = ["seq", "kind", "payload"]
    w = W.partitionBy(*by).orderBy(*order)
    rows = entries.select(*by, *order).withColumn("_new", F.row_number().over(w) == 1)
    rows = rows.withColumn("seq", F.col("seq").cast("bigint")).withColumn("_head", entry_head(F.col("kind"), F.col("payload")).cast("binary"))
    kept = rows.select(*by, *order).schema
    schema = StructType([*kept.fields, StructField("prev", StringType()), StructField("entry_hash", StringType())])
    return rows.mapInArrow(_chained(tip), schema).select(*by, "seq", "prev", "kind", "payload", "entry_hash")


def cap_per_second(events: DataFrame, key: Sequence[str], max_per_sec: int, ts: str = "ts") -> DataFrame:
    """Keep the first ``max_per_sec`` events of each key in every event-time second.

    The bound is part of the filter, so each task sends at most that many rows of a second onwards: a
    hot second is cut down before the shuffle.
    """
    if max_per_sec <= 0:
        return events
    w = W.partitionBy(*key, "_sec").orderBy(ts, "event_id")
    rows = events.withColumn("_sec", F.date_trunc("second", ts)).withColumn("_rn", F.row_number().over(w))
    return rows.filter(F.col("_rn") <= max_per_sec).drop("_rn", "_sec")


def dropped_by_cap(events: DataFrame, key: Sequence[str], max_per_sec: int, ts: str = "ts") -> DataFrame:
    """(key, second, dropped) of the seconds that exceed the cap."""
    per = events.groupBy(*key, F.date_trunc("second", ts).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return per.filter(F.col("n") > max_per_sec).select(*key, "second", (F.col("n") - max_per_sec).alias("dropped"))
