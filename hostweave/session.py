"""Session set-up and the small plan helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def build_session(app: str = "hostweave", cores: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; a cluster passes its own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of the session, wherever it was started."""
    context = spark.sparkContext
    if not any(f.endswith("hostweave.zip") for f in context._python_includes):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="hostweave-")) / "hostweave.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted((root / "hostweave").rglob("*.py")):
                out.write(f, f.relative_to(root))
        context.addPyFile(str(archive))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hostweave-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` and survives lost executors. The table also brings its
    real size: a checkpoint keeps the multiplied size guesses of its plan, which grow every round and
    hide that a side is small enough to broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach_facts(df: DataFrame, facts: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add per-run facts as columns: a scalar subquery for one run, an equi-join for many."""
    if by:
        return df.join(facts.select(*by, *names), list(by))
    one = facts.select(F.struct(*names).alias("_facts")).scalar()
    return df.withColumn("_facts", one).select(
        *df.columns, *[F.col("_facts").getField(n).alias(n) for n in names]
    )


def with_rank(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based dense position of each row in ``order`` (per ``by``), without a one-task window.

    A range-partitioned sort places the rows; each row's position is its place inside its partition
    plus the rows in the partitions before it. Only one count per partition is ever brought together.
    """
    keys = [*by, *order]
    placed = cut(df.sort(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    before = counts.select(
        "_part",
        (F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_before"),
    )
    # One row per sort partition: bounded by spark.sql.shuffle.partitions.
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    low = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranked.withColumn(name, low + F.coalesce("_before", F.lit(0)) + 1).drop("_mid", "_part", "_before")
    if not by:
        return ranked
    first = ranked.groupBy(*by).agg(F.min(name).alias("_first"))
    return ranked.join(first, list(by)).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def with_place_rank(df: DataFrame, place: str, name: str, by: Sequence[str] = (), chunk: int = 1 << 16) -> DataFrame:
    """1-based number of each row in the order of the whole number ``place`` within ``by``, from prefix offsets.

    Rows are cut into chunks of places. A row's number is its place among the rows of its chunk plus the rows of the chunks before it:
    one shuffle by chunk and no global sort; only one count per chunk is brought together. ``by`` must not be null.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(place) / chunk))
    part = [*by, "_chunk"]
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    order = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*part, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    ranked = rows.withColumn(name, F.row_number().over(W.partitionBy(*part).orderBy(place)))
    return ranked.join(before, part).withColumn(name, F.col(name) + F.col("_before")).drop("_chunk", "_before")


def not_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != "", c)
