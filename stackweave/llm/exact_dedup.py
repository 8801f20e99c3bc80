"""Exact deduplication by skew-safe combining (native: DataFrame functions only).

Texts are equal when identical after lower-casing A-Z; null counts as empty. Three combining stages, each grouping by the
full normalised text and not by its digest alone:

1. local: the partial aggregate of each task merges the equal texts that the task has read;
2. salted: groups of (digest, salt, text) merge, so that no digest is the work of one task;
3. global: the salt winners of a text merge into one row, with a bit mask of the salts that hold members.

Rows then look their group up by (digest, salt): at most ``SALTS`` rows for each text, and a hot text is spread over as
many tasks. If one digest ever stands for two texts, the lookup compares the texts as well: a join by (digest, text) without
salts, so whole texts are shuffled once more and a hot text is one key, which the engine's skew join splits. The rows are
the same either way.

Defined results: repeated rows count as members; of rows with an equal doc_id all stay if that doc_id wins; a null doc_id
loses to any other, and a group of nulls keeps its null rows; an empty table gives no rows; other columns pass through, but
for those named like a column of the result (in any case of letters), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialize, others

SALTS = 48  # bits of the mask: below 63
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per input row: its columns without the text, and keep_id, group_size, kept, text_sha256."""
    norm, salt, mask, size = fresh(docs, "norm", "salt", "mask", "size")
    rest = others(docs, text_col, *MADE)
    lowered: Column = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    salt_of = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(salts)).cast("int")
    keyed = docs.select(*rest, lowered.alias(norm)).withColumn("text_sha256", digest(F.col(norm))).withColumn(salt, salt_of)

    salted = keyed.groupBy("text_sha256", salt, norm).agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias(size))
    held_salts = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(salt))).alias(mask)
    # the text leaves the row once it is compared: what is written holds digests only
    groups = salted.groupBy("text_sha256", norm).agg(F.max("keep_id").alias("keep_id"), F.sum(size).alias("group_size"), held_salts)
    winners = materialize(groups.select("text_sha256", "keep_id", "group_size", mask), "dedup-winners")
    clashes = winners.groupBy("text_sha256").count().filter("count > 1")

    lookup = [F.col("text_sha256"), F.col("keep_id"), F.col("group_size")]
    key = ["text_sha256", salt]
    if clashes.isEmpty():
        held = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.call_function("getbit", F.col(mask), s) == 1)
        side = winners.select(*lookup, F.explode(held).alias(salt))
    else:
        side, key = groups.select(*lookup, norm), ["text_sha256", norm]
    out = keyed.join(side, key)
    same = F.col(id_col).eqNullSafe(F.col("keep_id"))
    return out.select(*rest, "keep_id", "group_size", same.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; of repeated rows with the winning doc_id one stays."""
    sha, keep_id, digest = fresh(docs, "sha", "keep", "digest")
    groups = exact_groups(docs.select(id_col, text_col), id_col=id_col, text_col=text_col)
    keep = groups.filter("kept").select(F.col(id_col).alias(keep_id), F.col("text_sha256").alias(digest)).distinct()
    own = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
    stay = own.join(keep, own[id_col].eqNullSafe(keep[keep_id]) & (own[sha] == keep[digest]), "left_semi")
    return stay.dropDuplicates([id_col, sha]).drop(sha)
