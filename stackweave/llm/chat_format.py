"""Chat formatting after cumulative-snapshot collapse (native: DataFrame functions only).

Logs hold the same conversation again and again, each time some turns longer. Rolling hashes over the turns name every
prefix; a conversation whose whole hash is that of a proper prefix of a longer one is dropped by an anti-join, and of
identical ones the smallest conv_id stays. Only what stays is rendered.

The hash of a prefix rolls on by exclusive or: each turn adds two 64-bit hashes of its place and its SHA-256. It takes one
sorted pass over a conversation's turns, however many, and no list of hashes is carried from turn to turn.

Defined results: turns go by (turn, role, text), nulls first, and exactly repeated turns count once; a null role is
"unknown" and a null text empty; the rows of a null conv_id are one conversation; an empty table gives no rows; other
columns are ignored. A conversation is one row of the result, so it must fit in a row; no other group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TEMPLATE = "<|{role}|>\n{text}\n"


def cleaned(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n, whole, h1, h2: the hash of each prefix of n different turns; ``whole`` marks the longest."""
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = F.lag("text").over(ordered).eqNullSafe(F.col("text")) & F.lag("role").over(ordered).eqNullSafe(F.col("role")) & F.lag("turn").over(ordered).eqNullSafe(F.col("turn"))
    # a text is never null, so the first turn of a conversation repeats nothing
    once = turns.withColumn("again", again).filter(~F.col("again"))
    digest = F.sha2(F.concat_ws("\x1f", F.length("role").cast("string"), "role", "text"), 256)
    numbered = once.withColumns({"n": F.row_number().over(ordered), "whole": F.lead("text").over(ordered).isNull(), "digest": digest})
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    rolled = [F.bit_xor(F.xxhash64(F.lit(k), "n", "digest")).over(so_far).alias(f"h{k}") for k in (1, 2)]
    return numbered.select("conv_id", "n", "whole", *rolled)


def render(turns: Column) -> Column:
    head, middle, tail = TEMPLATE.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    parts = F.transform(turns, lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail)))
    return F.array_join(parts, "")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies (identical conversations), rendered."""
    turns = cleaned(turns)
    prefixes = materialize(prefix_hashes(turns), "chat-prefixes")  # no texts: read twice below
    heads = prefixes.filter("whole").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = prefixes.filter("not whole").select("n", "h1", "h2").distinct()
    maximal = heads.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")
    kept = turns.join(maximal, turns["conv_id"].eqNullSafe(maximal["conv_id"]), "inner").select(turns["conv_id"], "turn", "role", "text", "n_turns", "copies")
    listed = kept.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("ts"))
    return listed.select("conv_id", "n_turns", "copies", render(F.col("ts")).alias("rendered"))
