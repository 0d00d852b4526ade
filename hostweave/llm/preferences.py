"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns (same role and text) is rendered once as the prompt; what follows in each
conversation is its completion. Spans give the characters of a completion that are trained on: the text and end
mark of assistant turns, not the turn headers and not other roles.

Turns are numbered and offsets are summed by range-sorted running sums, so a conversation with a third of all turns is
not put through one task until its own text is joined together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostweave.llm.fair_mix import running_sum
from hostweave.llm.tables import stored

TRAINED = "assistant"


def rendered(role: Column, text: Column) -> tuple[Column, Column]:
    """(header, body with its end mark) of a turn. Marks inside a text are broken up by a backslash."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n")), F.concat(safe, F.lit("<|end|>\n"))


def _numbered(turns: DataFrame, pair: str, turn: str, role: str, text: str, side: str) -> DataFrame:
    t = turns.filter(F.col(pair).isNotNull()).select(
        F.col(pair).alias("_pair"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"), F.lit(1).alias("_one"), F.lit(side).alias("_side")
    )
    return running_sum(t, ["_pair"], ["_turn", "_role", "_text"], "_one", "_place")


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per id that has turns in both tables: (pair, n_common, prompt, chosen, rejected, chosen_spans,
    rejected_spans). Spans are arrays of (begin, end) in characters of the completion.

    Turns go by ``turn``, ties by role and text. Null texts are empty, a null role is "unknown"; turns without an
    id belong to no conversation. Equal conversations have empty completions. Repeated rows are repeated turns. Ids
    in one table only are left out; other columns are ignored.
    """
    a, b = (_numbered(d, pair, turn, role, text, s) for d, s in ((chosen, "c"), (rejected, "r")))
    same = F.col("a._role").eqNullSafe(F.col("b._role")) & F.coalesce("a._text", F.lit("")).eqNullSafe(F.coalesce("b._text", F.lit("")))
    met = a.alias("a").join(b.alias("b"), ["_pair", "_place"], "full")
    met = met.select("_pair", "_place", F.col("a._side").isNotNull().alias("_a"), F.col("b._side").isNotNull().alias("_b"), (F.col("a._side").isNotNull() & F.col("b._side").isNotNull() & same).alias("_same"))
    common = met.groupBy("_pair").agg(
        F.coalesce(F.min(F.when(~F.col("_same"), F.col("_place"))) - 1, F.max("_place")).alias("n_common"), F.max("_a").alias("_a"), F.max("_b").alias("_b")
    )
    common = stored(common.filter("_a AND _b").select("_pair", "n_common"))

    both = a.unionByName(b).join(common, "_pair")
    both = both.filter("_place > n_common OR _side = 'c'").withColumn("_piece", F.when(F.col("_place") <= F.col("n_common"), "p").otherwise(F.col("_side")))
    head, body = rendered(F.col("_role"), F.col("_text"))
    both = both.select("_pair", "_piece", "_place", head.alias("_head"), body.alias("_body"), (F.col("_role") == TRAINED).alias("_trained"))
    both = both.withColumn("_size", F.length("_head") + F.length("_body"))
    both = running_sum(both, ["_pair", "_piece"], ["_place"], "_size", "_end")
    span = F.when(F.col("_trained"), F.struct((F.col("_end") - F.length("_body")).alias("begin"), F.col("_end").alias("end")))
    joined = both.groupBy("_pair", "_piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.concat("_head", "_body").alias("t")))), lambda x: x["t"]), "").alias("t"),
        F.array_sort(F.collect_list(span)).alias("s"),
    )
    parts = joined.groupBy("_pair").agg(*[F.max(F.when(F.col("_piece") == p, F.col(c))).alias(f"{c}{p}") for p in "pcr" for c in "ts"])
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    out = common.join(parts, "_pair", "left")
    return out.select(
        F.col("_pair").alias(pair), F.col("n_common").cast("long").alias("n_common"),
        *[F.coalesce(f"t{p}", F.lit("")).alias(n) for p, n in (("p", "prompt"), ("c", "chosen"), ("r", "rejected"))],
        *[F.coalesce(f"s{p}", none).alias(n) for p, n in (("c", "chosen_spans"), ("r", "rejected_spans"))],
    )


def next_reply(turns: DataFrame, pair: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rejected conversations for a table of good ones: the last turn of each conversation that ends with an assistant turn is
    answered by the reply that follows in the order of ids (the first one's for the last). Conversations that end
    otherwise give none. Exactly one row is replaced, by a row that stays last: the turns, roles and texts of a conversation are
    in order, and where others have the number of the last turn, its reply has the next number."""
    known = turns.filter(F.col(pair).isNotNull())
    last = known.groupBy(pair).agg(F.max(F.struct(turn, role, text)).alias("l"))
    last = last.filter(F.col(f"l.{role}") == TRAINED).select(F.col(pair).alias("_p"), F.col(f"l.{turn}").alias("_t"), F.col(f"l.{text}").alias("_x"), F.lit(1).alias("_one"))
    place = stored(running_sum(last, [], ["_p"], "_one", "_n"))
    n = place.agg(F.max("_n")).first()[0] or 1
    after = place.select(F.when(F.col("_n") == 1, F.lit(n)).otherwise(F.col("_n") - 1).cast("long").alias("_n"), F.col("_x").alias("_reply"))
    swap = place.select("_p", "_t", "_x", F.col("_n").cast("long").alias("_n")).join(after, "_n").drop("_n")
    all_turns = known.join(swap, known[pair] == swap["_p"])
    is_last = F.col(turn).eqNullSafe(F.col("_t")) & F.col(role).eqNullSafe(F.lit(TRAINED)) & F.col(text).eqNullSafe(F.col("_x"))
    kept = all_turns.filter(~is_last).select(pair, turn, role, text)
    # of rows that repeat the last one, all but one are kept
    level = all_turns.filter(F.col(turn).eqNullSafe(F.col("_t"))).groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_level"), F.count(F.when(is_last, 1)).alias("_copies"))
    level = level.filter("_level > 1")
    more = swap.join(level, F.col("_p") == F.col("_q")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).filter("_copy > 1")
    more = more.select(F.col("_p").alias(pair), F.col("_t").alias(turn), F.lit(TRAINED).alias(role), F.col("_x").alias(text))
    number = F.when(F.col("_q").isNull(), F.col("_t")).otherwise(F.coalesce("_t", F.lit(-1)) + 1).cast(known.schema[turn].dataType)
    reply = swap.join(level, F.col("_p") == F.col("_q"), "left")
    return kept.unionByName(more).unionByName(reply.select(F.col("_p").alias(pair), number.alias(turn), F.lit(TRAINED).alias(role), F.col("_reply").alias(text)))
