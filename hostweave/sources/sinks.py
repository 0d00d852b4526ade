"""Tables the pipeline writes: events, campaigns, prevention log, reconstructions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.functions.text import safe_id
from hostweave.operators.feed import newest


def write_events(df: DataFrame, path: str) -> None:
    """Append events, laid out by day and type so that readers prune what they do not need.

    Each folder's rows meet before they are written, for few files; a folder too large for one task is dealt to several.
    """
    out = df.withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date", "payload_type")
    out.write.mode("append").partitionBy("event_date", "payload_type").parquet(path)


def write_pack(events: DataFrame, truth: DataFrame, path: str) -> None:
    """Labelled pack as JSON lines per pack: truth rows and event rows told apart by ``type``."""
    t = truth.select("pack_id", F.to_json(F.struct(F.lit("ground_truth").alias("type"), *[c for c in truth.columns if c != "pack_id"])).alias("value"))
    e = events.select("pack_id", F.to_json(F.struct(F.lit("event").alias("type"), *[c for c in events.columns if c != "pack_id"])).alias("value"))
    t.unionByName(e).write.mode("overwrite").partitionBy("pack_id").text(path)


def latest_campaigns(rows: DataFrame) -> DataFrame:
    """Last written row of each campaign id (``seq`` grows with every write)."""
    others = [c for c in rows.columns if c != "campaign_id"]
    return rows.groupBy("campaign_id").agg(F.max_by(F.struct(*others), "seq").alias("_r")).select("campaign_id", "_r.*").select(*rows.columns)


CURRENT = "run_key string, version long"


def _run_key(run_id: str) -> str:
    return f"r{run_id.encode().hex()}"  # safe as a folder name, and never read as a number


def _current(spark: SparkSession, path: str) -> DataFrame | None:
    """(run_key, version): the version of each run that readers take; None before the first write."""
    try:
        return spark.read.schema(CURRENT).parquet(f"{path}/current").groupBy("run_key").agg(F.max("version").alias("version"))
    except AnalysisException:
        return None


def write_campaigns(campaigns: DataFrame, path: str, run_id: str) -> None:
    """Replace a run's whole set of campaigns, also by none; other runs stay.

    The set is written as a new version, and only then becomes the current one by a record of one row. So a reader sees
    the old set or the new one, whole, also while a replacement runs or after one that failed. One writer per run at a time.
    """
    spark, key = campaigns.sparkSession, _run_key(run_id)
    now = _current(spark, path)
    last = None if now is None else now.filter(F.col("run_key") == key).agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    rows = campaigns.drop("run_id").withColumn("run_id", F.lit(run_id))
    rows.write.mode("overwrite").parquet(f"{path}/data/run_key={key}/version={version}")
    spark.createDataFrame([(key, version)], CURRENT).coalesce(1).write.mode("append").parquet(f"{path}/current")


def read_campaigns(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The current campaigns of all runs or one, with ``run_id``."""
    now = _current(spark, path)
    if now is None:
        raise FileNotFoundError(f"{path}: no campaigns were written")
    rows = spark.read.parquet(f"{path}/data").withColumn("version", F.col("version").cast("long"))
    if run_id is not None:
        # one run: its version is read now, so the scan is pruned to one folder
        version = now.filter(F.col("run_key") == _run_key(run_id)).agg(F.max("version")).first()[0]
        rows = rows.filter((F.col("run_key") == _run_key(run_id)) & (F.col("version") == F.lit(version)))
        return rows.drop("run_key", "version")
    return rows.join(now, ["run_key", "version"], "left_semi").drop("run_key", "version")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the versions of each run before its last ``keep`` ones (readers may still hold those); returns how many went."""
    from pyarrow.fs import FileSelector, FileType

    from hostweave.sources.tailing import open_folder

    now = _current(spark, path)
    fs, root = open_folder(f"{path}/data")
    gone = 0
    for key, version in [] if now is None else now.toLocalIterator():
        for found in fs.get_file_info(FileSelector(f"{root}/run_key={key}", allow_not_found=True)):
            if found.type == FileType.Directory and int(found.base_name.removeprefix("version=")) <= version - keep:
                fs.delete_dir(found.path)
                gone += 1
    return gone


PREVENTION = (
    "id string, ts string, status string, attack_type string, attack_name string, campaign_id string, source string, "
    "identity string, hosts array<string>, actions array<string>, summary string"
)


def prevention_log(lines: DataFrame, limit: int = 200) -> DataFrame:
    """Newest records of the log lines (seq, raw); lines that are not JSON are skipped."""
    rows = lines.filter(F.try_parse_json("raw").isNotNull()).withColumn("r", F.from_json("raw", PREVENTION))
    return newest(rows.select("seq", "r.*"), "seq", limit)


def import_prevention(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome rows whose campaign is not in the log yet, as log records."""
    known = log.select("campaign_id").distinct()
    fresh = outcomes.join(known, "campaign_id", "left_anti")
    acts = F.concat(
        F.transform("hosts", lambda h: F.concat(F.lit("IsolateHost "), h)), F.transform("hosts", lambda h: F.concat(F.lit("Blocked retry on "), h))
    )
    return fresh.withColumns({"actions": acts, "status": F.lit("prevented")})


def append_prevention(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.mode("append").text(path)


def write_reconstruction(rebuilt: DataFrame, path: str) -> None:
    """One report row per campaign, and one folder of regression rows per campaign id."""
    from hostweave.operators.reconstruct import manifest_rows

    rebuilt.write.mode("overwrite").json(f"{path}/report")
    rows = manifest_rows(rebuilt).withColumn("safe_id", safe_id(F.coalesce("campaign_id", F.lit("unknown"))))
    rows.write.mode("overwrite").partitionBy("safe_id").json(f"{path}/manifests")
