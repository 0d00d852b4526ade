import re
from pathlib import Path

from pyspark.sql import functions as F

from hostweave.plans import catalog
from hostweave.session import shared_folder
from hostweave.sources.sinks import drop_old_versions, read_campaigns, write_campaigns


def test_a_run_is_replaced_by_nothing_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "campaigns")
    df = spark.createDataFrame([("c1", 1.0)], "campaign_id string, score double")
    write_campaigns(df, path, "run/a")
    write_campaigns(df, path, "run-b")
    write_campaigns(df.limit(0), path, "run/a")
    assert read_campaigns(spark, path, "run/a").count() == 0
    assert [r.run_id for r in read_campaigns(spark, path).collect()] == ["run-b"]


def test_readers_keep_the_set_they_began_with(spark, tmp_path):
    path = str(tmp_path / "campaigns")

    def rows(*ids):
        return spark.createDataFrame([(i, 1.0) for i in ids], "campaign_id string, score double")

    write_campaigns(rows("a", "b"), path, "1/é")
    write_campaigns(rows("x"), path, "01")
    before, before_all = read_campaigns(spark, path, "1/é"), read_campaigns(spark, path)
    # a replacement that fails half way leaves the current set as it was
    rows("z").write.parquet(f"{path}/data/run_key=r{'1/é'.encode().hex()}/version=1")
    assert sorted(r.campaign_id for r in read_campaigns(spark, path, "1/é").collect()) == ["a", "b"]
    write_campaigns(rows("c"), path, "1/é")
    assert sorted(r.campaign_id for r in before.collect()) == ["a", "b"]
    assert sorted((r.run_id, r.campaign_id) for r in before_all.collect()) == [("01", "x"), ("1/é", "a"), ("1/é", "b")]
    assert sorted((r.run_id, r.campaign_id) for r in read_campaigns(spark, path).collect()) == [("01", "x"), ("1/é", "c")]
    write_campaigns(rows("d"), path, "1/é")
    assert drop_old_versions(spark, path) == 1
    assert [r.campaign_id for r in read_campaigns(spark, path, "1/é").collect()] == ["d"]


def test_events_of_one_type_are_written_by_several_tasks(spark, tmp_path):
    ev = spark.range(4000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 200).alias("ts"), (F.col("id") % 50).alias("user_id"),
        F.lit("view").alias("event_type"), F.rand(1).alias("value"), F.format_string('{"k": %d}', F.col("id") % 97).alias("props"),
    )
    ev.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    known, size = set(folder.glob("events-*")), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        found = catalog.QUERIES["s14_written_events"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(size)
    assert [(r["payload_type"], r["n"], r["n_days"]) for r in found] == [("dns", 4000, ev.select(F.to_date("ts")).distinct().count())]
    (made,) = set(folder.glob("events-*")) - known
    assert len({re.match(r"part-(\d+)-", f.name)[1] for f in made.rglob("*.parquet")}) > 1
