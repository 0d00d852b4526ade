"""Payload digests and HMAC-SHA256, computed in the JVM but for the canonical JSON text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNED_FIELDS = ("schema_ver", "producer_id", "host_id", "event_id", "ts_utc", "nonce", "payload_type")


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no blanks, ASCII escapes: neither order nor escapes are Spark's ``to_json``. NULL if it is no JSON."""

    def canonical(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return text.map(canonical)


def payload_digest(payload: Column) -> Column:
    return F.sha2(canonical_json(payload).cast("binary"), 256)


@F.pandas_udf(T.StructType().add("inner", T.BinaryType()).add("outer", T.BinaryType()))
def _pads(secret: pd.Series) -> pd.DataFrame:
    """The two 64-byte HMAC key blocks of each secret."""
    import hashlib

    def block(key: bytes, mask: int) -> bytes:
        key = hashlib.sha256(key).digest() if len(key) > 64 else key
        return bytes(b ^ mask for b in key.ljust(64, b"\0"))

    return pd.DataFrame(
        {"inner": [block(bytes(k), 0x36) for k in secret], "outer": [block(bytes(k), 0x5C) for k in secret]}
    )


def key_pads(enrollment: DataFrame) -> DataFrame:
    """(producer_id, host_id, inner, outer): the secret itself goes no further."""
    return enrollment.withColumn("_p", _pads("secret")).select(
        "producer_id", "host_id", F.col("_p.inner").alias("inner"), F.col("_p.outer").alias("outer")
    )


def hmac_hex(message: Column, inner: Column, outer: Column) -> Column:
    first = F.sha2(F.concat(inner, message.cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def signed_message(digest: Column) -> Column:
    return F.concat_ws("||", *[F.col(c) for c in SIGNED_FIELDS], digest)
