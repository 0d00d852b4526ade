"""Readers for event exports, labelled packs and signed envelopes.

Files of one record per line are read line by line, so they split over tasks. ``documents`` reads
whole files, for exports that are one JSON array, one wrapper object or one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.schema import ENVELOPE, TRUTH

Paths = str | Sequence[str]


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(source, pos, raw): one row per non-blank line; ``pos`` grows with the line inside a file."""
    lines = spark.read.text(_paths(paths)).select(
        F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("raw")
    )
    return lines.filter("raw != ''")


def split_documents(docs: DataFrame) -> DataFrame:
    """(source, pos, raw) from (source, text): array, ``Events``/``events`` wrapper, one record, or lines."""
    text = F.trim("text")
    lines = F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    # A record per line is told from one record over many lines by its first line being complete.
    by_line = (F.size(lines) > 1) & F.try_parse_json(F.get(lines, 0)).isNotNull()
    obj = F.from_json(text, "map<string,string>")
    listed = F.from_json(F.coalesce(obj["Events"], obj["events"]), "array<string>")
    records = (
        F.when(text.startswith("["), F.from_json(text, "array<string>"))
        .when(text.startswith("{") & ~by_line, F.when(listed.isNotNull(), listed).otherwise(F.array(text)))
        .otherwise(lines)
    )
    rows = docs.select("source", F.posexplode(records).alias("pos", "raw"))
    return rows.filter(F.col("raw").startswith("{")).select("source", F.col("pos").cast("bigint").alias("pos"), "raw")


def read_documents(spark: SparkSession, paths: Paths) -> DataFrame:
    docs = spark.read.text(_paths(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")
    )
    return split_documents(docs)


def read_records(spark: SparkSession, paths: Paths, layout: str = "lines") -> DataFrame:
    """Raw records with ``rec``, a map of field text; nested objects stay JSON text."""
    raw = read_documents(spark, paths) if layout == "documents" else read_lines(spark, paths)
    return with_record(raw)


def with_record(raw: DataFrame) -> DataFrame:
    return raw.withColumn("rec", F.from_json("raw", "map<string,string>"))


def parse_envelopes(lines: DataFrame) -> DataFrame:
    """Envelope columns from raw lines; the payload stays JSON text and the raw line is kept."""
    return lines.withColumn("e", F.from_json("raw", ENVELOPE)).select("source", "pos", "raw", "e.*")


def read_envelopes(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_envelopes(read_lines(spark, paths))


def split_packs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, truth) of labelled packs, keyed by ``pack_id`` (the file name)."""
    rows = lines.withColumn("pack_id", F.element_at(F.split("source", "/"), -1)).withColumn(
        "type", F.get_json_object("raw", "$.type")
    )
    events = parse_envelopes(rows.filter("type = 'event'")).withColumn("pack_id", F.element_at(F.split("source", "/"), -1))
    truth = rows.filter("type = 'ground_truth'").select("pack_id", F.from_json("raw", TRUTH).alias("t")).select("pack_id", "t.*")
    return events, truth


def read_packs(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    return split_packs(read_lines(spark, paths))


def flatten_payload(events: DataFrame) -> DataFrame:
    """Signed events as the flat telemetry columns that detectors and fusion read."""
    p = F.from_json("payload", "map<string,string>")
    seq = F.col("ingest_seq") if "ingest_seq" in events.columns else F.col("pos")
    return (
        events.withColumn("_p", p)
        .withColumn("ingest_seq", seq.cast("bigint"))
        .withColumn("ts", F.try_to_timestamp("ts_utc"))
        .withColumns(
            {
                **{c: F.col("_p")[c] for c in ("user", "result", "src", "dst_ip", "query", "qtype", "image", "technique")},
                "dst_port": F.col("_p")["dst_port"].try_cast("double").try_cast("int"),
                "bytes": F.coalesce(F.col("_p")["bytes"].try_cast("bigint"), F.col("_p")["bytes"].try_cast("double").try_cast("bigint")),
                "egress": F.col("_p")["egress"].try_cast("boolean"),
            }
        )
        .drop("_p")
    )


def fuse_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """One event table from several named ones; missing columns become NULL."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
