"""What the trained operators share: which labelled rows may be learnt from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a classifier is fitted on. They are those with the least md5 of the id.
SAMPLE_ROWS = 20_000


def held_out(id_col: str, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether a row is kept for testing: crc32 of the id as text, modulo ``modulus``. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_text, _y) of at most ``rows`` labelled documents that are not held out. The ids are few enough to broadcast. Of rows
    that repeat an id, the one with the least text counts."""
    y = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    y = y.groupBy(id_col).agg(F.max(label).cast("double").alias("_y"))
    few = y.orderBy(F.md5(F.col(id_col).cast("string"))).limit(rows).select(F.col(id_col).alias("_i"), "_y")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = base.join(F.broadcast(few), base["_id"] == F.col("_i"))
    return found.groupBy("_i").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y")).select("_text", "_y")
