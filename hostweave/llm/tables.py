"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hostweave.session import cut

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts the lineage, and the shuffle files that led
    to it are dropped at once. A lost executor takes nothing of it away."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return cut(df)
    finally:
        conf.set(CLEANUP, before)
