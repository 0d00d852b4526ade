"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source is a queue of its documents in a fixed shuffled order (md5 of the id), repeated up to ``most`` times.
A copy's virtual finish time is the source's words up to and including it, divided by the source's target. Copies
are served in the order of their finish times until the total budget is used up, so all sources reach their
targets together.

A hot source costs nothing extra: running sums come from a range sort over (source, shuffled order), one sum for
each sort partition and source, and a window inside each partition. The same gives the global order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hostweave.llm.tables import stored
from hostweave.session import with_rank

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows up to each one in ``order`` (per ``by``); no task gets a whole group."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed.withColumn("_tie", F.monotonically_increasing_id()))
    # rows: sort partitions plus groups, as each partition is a stretch of the order
    sums = placed.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy("_part", *by).orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.sum(value).over(inside))
    on = local["_part"] == sums["_part"]
    for c in by:
        on &= local[c].eqNullSafe(sums[c])
    return local.join(sums, on).select(*[local[c] for c in df.columns], (F.col("_local") + F.col("_before")).alias(name))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size): sources by code point, null last, get the
    weights in turn; what a source may not take (``most`` times its size) is shared by weight among the others."""
    n = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    keyed = sizes.withColumn("_null", F.col("source").isNull())
    t = stored(with_rank(keyed, ["_null", "source"], "place").withColumn("weight", n).drop("_null"))
    total, open_weight = t.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total or 0) / (open_weight or 1), None
    while level != before:  # only sums reach the driver; every round but the last caps at least one more source
        before = level
        full = F.col("source_size") * most < F.lit(level) * F.col("weight")
        r = t.agg(F.sum(F.when(full, F.col("source_size") * most)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        level = (total - (r["capped"] or 0)) / r["open"] if r["open"] else level
    target = F.least((F.col("source_size") * most).cast("double"), F.lit(float(level)) * F.col("weight"))
    return t.select("source", "source_size", "place", target.alias("target"))


def mixed(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: (id_col, _h, source, size, source_size, target, taken, copies).

    Size is the number of words; a null or empty text has none and is never taken. A null source is a source of
    its own, the last. ``taken`` is copies times size, at most ``most`` times the size. The order depends on
    ids and sizes only, so reruns agree; repeated rows are queued one by one. _h is the hash of the text. Other columns
    are ignored.
    """
    base = docs.select(
        F.col(id_col).alias("_id"), F.hash(F.col(text_col)).alias("_h"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
    )
    base = stored(base.withColumn("_r", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    targets = stored(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    queued = running_sum(base, ["source"], ["_r", "size", "_h"], "size", "_cum")
    both = queued.join(targets, queued["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    both = stored(both.drop("_r"))
    budget = both.agg(F.sum("size")).first()[0] or 0

    def finish(copy: Column) -> Column:
        return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("_cum")) / F.col("target"))

    copies = both.filter("size > 0").select("size", "place", F.explode(F.array(*[finish(F.lit(i)) for i in range(most)])).alias("finish"))
    served = running_sum(copies, [], ["finish", "place"], "size", "_all")
    last = served.filter(F.col("_all") <= budget).agg(F.max(F.struct("finish", "place")).alias("m")).first()["m"]
    if last is None:
        n = F.lit(0)
    else:
        end, place = F.lit(last["finish"]), F.lit(last["place"])
        copies = [finish(F.lit(i)) for i in range(most)]
        n = sum((F.when((c < end) | ((c == end) & (F.col("place") <= place)), 1).otherwise(0) for c in copies), F.lit(0))
    n = F.when((F.col("size") > 0) & (F.col("target") > 0), n).otherwise(0).cast("long")
    return both.select(
        F.col("_id").alias(id_col), "_h", F.col("source").alias(source_col), "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``taken`` and ``copies`` (replacing columns of those names).

    Rows that share id and text get the same number of copies, the largest of them."""
    m = mixed(docs, weights, most, id_col, text_col, source_col).filter("copies > 0")
    m = m.groupBy(F.col(id_col).alias("_id"), "_h").agg(F.max("taken").alias("_taken"), F.max("copies").alias("_copies"))
    d = docs.drop("taken", "copies").withColumn("_hash", F.hash(F.col(text_col)))
    both = d.join(m, d[id_col].eqNullSafe(m["_id"]) & (d["_hash"] == m["_h"]))
    return both.drop("_id", "_h", "_hash").withColumnsRenamed({"_taken": "taken", "_copies": "copies"})
