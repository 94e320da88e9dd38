"""Chat formatting after a collapse of cumulative snapshots.

A chat log often stores a conversation again after each turn. A conversation is dropped if its turns
(role and text, in order) are a proper prefix of another one's; of equal conversations the smallest
id stays. Rolling hashes of turn prefixes find this with two anti-joins; then the rest is rendered.

Turns are ordered by turn, role, text; nulls come first. Null role counts as "unknown", null text as
empty, turns with a null conv_id form one conversation, repeated rows are turns of their own. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, and the 128-bit hash of the turns up to pos. Texts are hashed before the shuffle."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    own = turns.select("conv_id", "turn", role.alias("role"), F.sha2(F.concat(role, F.lit("\x00"), text), 256).alias("h"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "h")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = own.withColumn("pos", F.row_number().over(order))
    # A turn's hash depends on its place, so the XOR of a prefix identifies the sequence.
    return placed.select("conv_id", "pos", F.bit_xor(F.xxhash64("pos", "h")).over(upto).alias("a"), F.bit_xor(F.xxhash64("h", "pos", F.lit("b"))).over(upto).alias("b"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_copies (equal conversations, itself included)."""
    prefixes = _prefixes(turns)
    full = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("x")).select("conv_id", "x.*")
    classes = full.groupBy("pos", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("conv_id"))).alias("m"), F.count("*").alias("n_copies"))
    classes = classes.select("pos", "a", "b", F.col("m.conv_id").alias("conv_id"), "n_copies")
    # Only proper prefixes: of each conversation all but its last turn. A common one is one key after the aggregation.
    last = W.partitionBy("conv_id").orderBy("pos")
    proper = prefixes.withColumn("next", F.lead("pos").over(last)).where(F.col("next").isNotNull()).select("pos", "a", "b").distinct()
    kept = classes.join(proper, ["pos", "a", "b"], "left_anti")
    return kept.select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept`` with the conversations' text, a block for each turn."""
    rows = turns.select(F.col("conv_id").alias("__id"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.sha2(F.concat("role", F.lit("\x00"), "text"), 256))
    joined = kept.join(rows, F.col("conv_id").eqNullSafe(F.col("__id"))).drop("__id")
    grouped = joined.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("turn", "role", "h", "text"))).alias("t"))
    block = lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))
    nulls_first = F.concat(F.filter("t", lambda x: x["turn"].isNull()), F.filter("t", lambda x: x["turn"].isNotNull()))
    return grouped.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform(nulls_first, block), "").alias("text"))


def chat(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, text."""
    return render(turns, collapse(turns))
