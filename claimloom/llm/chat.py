"""Cumulative-snapshot collapse of logged conversations, then rendering.

Services log a conversation again after every turn, so short logs are prefixes of longer
ones. Each conversation gets a rolling digest per turn; a conversation whose last digest
stands among the inner digests of another one is a snapshot and goes (left anti join).
Digests roll as a running exclusive-or of digests of (place, role, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per maximal conversation: ``conv_id``, ``n_turns``, ``rendered``.

    Turns are ordered by number (null last), role and text; gaps and repeated numbers don't
    matter, repeated rows are turns of their own. Null role or text counts as the empty string.
    Of conversations with the same turns the smallest id stays. Rows without a
    conversation id belong to none and are left out. Other columns are ignored.
    Rendered: ``<|role|>``, new line, text, new line for each turn.
    """
    t = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("__turn"),
        F.coalesce(F.col(role), F.lit("")).alias("__role"), F.coalesce(F.col(text), F.lit("")).alias("__text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("__turn").asc_nulls_last(), "__role", "__text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    digest = lambda seed: F.xxhash64(F.lit(seed), "__place", F.length("__role"), "__role", "__text")
    rolled = (
        t.withColumn("__place", F.row_number().over(order))
        .withColumn("h1", F.bit_xor(digest(1)).over(upto)).withColumn("h2", F.bit_xor(digest(2)).over(upto))
        .withColumn("__more", F.lead(F.lit(1)).over(order).isNotNull())
        .select("conv_id", "__place", "h1", "h2", "__more")
    )
    rolled = materialize(rolled, "chat-prefixes")
    whole = rolled.filter("not __more").groupBy("h1", "h2", "__place").agg(F.min("conv_id").alias("conv_id"))
    inner = rolled.filter("__more").select("h1", "h2", "__place").distinct()
    kept = whole.join(inner, ["h1", "h2", "__place"], "left_anti").select("conv_id", F.col("__place").cast("long").alias("n_turns"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("__turn").isNull(), "__turn", "__role", "__text")))
    said = F.transform(ordered, lambda x: F.concat(F.lit("<|"), x["__role"], F.lit("|>\n"), x["__text"], F.lit("\n")))
    return (
        t.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_join(said, "").alias("rendered"))
        .join(kept, "conv_id").select("conv_id", "n_turns", "rendered")
    )
