"""Secret scan with corpus-wide ownership frequency (native: DataFrame functions only).

Base spans come from three patterns. The method then looks at candidates in the whole corpus: the hash of each candidate
value is counted over distinct repositories and owners. A value that many owners or many repositories hold is a widely
copied example; one that a single owner holds in few repositories and that looks live (long, mixed, varied) is
owner-specific. Bare tokens, which no base pattern names, become spans of kind "token" where they are owner-specific and
live-looking; base spans always stay. ``counts`` has for each of the spans, in their order, repositories:owners.

A text is read once and gives its matches, each with the length of the gap before it; places are running sums over these,
and what overlaps is found by one pass over the spans of a text in either direction, so a text with many matches takes time
in proportion to them. Counting goes in steps (hash, owner, repository), then (hash, owner), then hash, each with a partial
aggregate, so a value in a third of all rows is merged before it is dealt out. Rows find their verdicts by (hash, salt).

Defined results: a null text is empty and has no spans; a null owner or repository counts as one more owner or repository;
repeated rows come back once each; an empty table gives no rows; other columns pass through, but for those named like a
column of the result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialize, others

# The base patterns and the least lengths of what they match.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run never holds a longer match
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "token")
# A bare token: a whole run of 20 and more of these characters, with a digit anywhere.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}"
PATTERNS = (ASSIGN, ACCESS, HEX, TOKEN)

EXAMPLE_OWNERS = 3  # a value of as many owners is a copied example
EXAMPLE_REPOS = 10  # and so is one in as many repositories, even of one owner
SALTS = 16
MADE = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "n_example", "n_live", "counts")
MATCHES = "array<struct<rank:int,nth:int,gap:int,size:int,counts:boolean,hash:bigint,live:boolean>>"


def matched(text: Column, rank: int) -> Column:
    """All matches of a kind in order: gap before it and size in code points, whether it is long enough, its value's hash."""
    pattern = PATTERNS[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def one(m: Column, nth: Column) -> Column:
        value = F.regexp_extract(m["whole"], pattern, 2) if rank == 0 else m["whole"]
        long_enough = F.length(value) >= ASSIGN_VALUE if rank == 0 else F.lit(True)
        return F.struct(F.lit(rank).alias("rank"), nth.alias("nth"), F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("size"), long_enough.alias("counts"), F.xxhash64(value).alias("hash"), live_looking(value).alias("live"))

    each = F.transform(F.arrays_zip(found.alias("whole"), gaps.alias("gap")), one)
    return F.when(F.rlike(text, F.lit(pattern)), each).otherwise(F.array().cast(MATCHES))


def live_looking(value: Column) -> Column:
    """Long, with letters and digits, and with many different characters."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 8)


def located(matches: DataFrame, row: str) -> DataFrame:
    """The matches as spans [start, end): those long enough, and of bare tokens those that overlap no base span."""
    of_kind = Window.partitionBy(row, "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(of_kind)
    spans = matches.repartition(row).withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("counts")
    base = F.col("rank") < 3
    # spans of one place: base ones come first in either direction
    before = Window.partitionBy(row).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(row).orderBy(F.desc("start"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0))
    ahead = F.min(F.when(base, F.col("start"))).over(after)
    met = (reach > F.col("start")) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return spans.withColumn("met", met).filter(base | ~F.col("met")).drop("met", "gap", "nth", "size", "counts")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """Columns of ``docs`` without the text; n_assign, n_access, n_hex, base_sha256, spans; n_token, n_example, n_live, counts."""
    rest = others(docs, text_col, *MADE)
    row, matches, owner_of, repo_of = fresh(docs, "row", "matches", "owner_of", "repo_of")
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner, repo = F.coalesce(F.col(owner_col).cast("string"), F.lit("")), F.coalesce(F.col(repo_col or id_col).cast("string"), F.lit(""))
    found = docs.select(*rest, owner.alias(owner_of), repo.alias(repo_of), F.monotonically_increasing_id().alias(row), F.concat(*(matched(text, k) for k in range(len(KINDS)))).alias(matches))
    # texts end here: what is written has lengths and hashes only
    rows = materialize(found, "secret-matches")
    each = rows.select(F.col(row).alias("row"), F.col(owner_of).alias("owner"), F.col(repo_of).alias("repo"), F.explode(matches).alias("m")).select("row", "owner", "repo", "m.*")
    spans = materialize(located(each, "row").withColumn("salt", F.pmod("row", F.lit(SALTS))), "secret-spans")

    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.bit_or(F.expr("shiftleft(1L, cast(salt as int))")).alias("mask"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.bit_or("mask").alias("mask"))
    by_hash = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.bit_or("mask").alias("mask"))
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col("mask"), s) == 1)
    verdicts = by_hash.select("hash", "owners", "repos", F.explode(held).alias("salt"))
    judged = spans.select("row", "start", "end", "rank", "live", "hash", "salt").join(verdicts, ["hash", "salt"])
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    own = (F.col("owners") == 1) & ~example & F.col("live")
    stays = judged.select("row", F.struct("start", "rank", "end", "repos", "owners").alias("s"), example.alias("example"), own.alias("own")).filter((F.col("s.rank") < 3) | F.col("own"))
    of_row = stays.groupBy(F.col("row").alias(row)).agg(
        F.array_sort(F.collect_list("s")).alias(matches),
        *(F.count_if(F.col("s.rank") == k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.count_if(F.col("example")).alias("n_example"),
        F.count_if(F.col("own")).alias("n_live"),
    )
    out = rows.select(*rest, row).join(of_row, row, "left")
    all_spans = F.coalesce(F.col(matches), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,repos:bigint,owners:bigint>>"))
    counts = F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["repos"], s["owners"])), ",").alias("counts")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    base = F.sha2(listed(F.filter(all_spans, lambda s: s["rank"] < 3)), 256)
    return out.select(*rest, count("n_assign"), count("n_access"), count("n_hex"), base.alias("base_sha256"), listed(all_spans).alias("spans"), count("n_token"), count("n_example"), count("n_live"), counts)
