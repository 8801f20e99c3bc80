"""Best-fit packing of tokenized documents by large-item matching over the histogram of all lengths.

Tasks tokenize whole texts and write one row for each piece with its length and its rank among the task's pieces of that
length. The lengths' histogram (a row for each of at most ``capacity`` lengths, whatever the corpus) is all that the
driver sees. It packs counts, not documents: pieces above a third of the capacity are matched, at most two to a bin, each
with the tightest gap; smaller ones best-fit what is left, longest first. The result is a table of slots by (length,
rank), whose size depends on the number of lengths alone; every piece finds its slot by its global rank. No piece is
moved, grouped or capped, and the packing is that of one global best-fit over the whole corpus.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed once each; an empty table gives
no rows; other columns are ignored; a text of special-token strings takes the plain tokenizer's reading.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices

CAPACITY = 2048
END_ID = 0

_ENCODERS: dict[tuple[str, str | None], Callable[[str], list[int]]] = {}


def encoder(json_file: str, ranks_file: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids of the tokenizer file. If the same vocabulary is given as ranks too, tiktoken encodes (the ids are the
    same, four times as fast) what holds no special token's string."""
    if (json_file, ranks_file) not in _ENCODERS:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(json_file)
        encode = lambda text: plain.encode(text, add_special_tokens=False).ids
        if ranks_file:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            special = [x.content for x in plain.get_added_tokens_decoder().values()]
            slow = encode
            encode = lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)
        _ENCODERS[json_file, ranks_file] = encode
    return _ENCODERS[json_file, ranks_file]


PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, chunk int, rank bigint"
PIECES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("chunk", pa.int32()), ("rank", pa.int64())])


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of so many ids: the first takes what full ones leave."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def tokenized(docs: DataFrame, files: tuple[str, str | None], capacity: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each piece; chunk and rank number the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, chunk = encoder(*files), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, 256):
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.array([*(encode(text) if text else ()), END_ID], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), chunk, int(seen[length])))
                        seen[length] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PIECES_SCHEMA)], schema=PIECES_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, PIECES)


def pack_counts(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packs counts[length] items of each length: (bins, [(length, items of it in each bin)]), bins of one make together."""
    open_bins: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]  # by gap

    def put(gap: int, bins: int, made: list) -> None:
        if bins:
            open_bins[gap].append((bins, made))

    def fill(length: int, left: int, most: int, gaps: range) -> int:
        """Puts items into the tightest gaps first, at most so many to a bin; returns how many are left."""
        for gap in gaps:
            while left and open_bins[gap]:
                bins, made = open_bins[gap].pop()
                each = min(most, gap // length)
                full = min(bins, left // each)
                put(gap - each * length, full, [*made, (length, each)])
                left -= full * each
                rest = bins - full
                if rest and 0 < left < each:
                    put(gap - left * length, 1, [*made, (length, left)])
                    left, rest = 0, rest - 1
                put(gap, rest, made)
                if rest:
                    break
            if not left:
                break
        return left

    def start(length: int, left: int, most: int) -> None:
        each = min(most, capacity // length)
        put(capacity - each * length, left // each, [(length, each)])
        if left % each:
            put(capacity - left % each * length, 1, [(length, left % each)])

    for length in range(capacity, 0, -1):
        n = int(counts[length])
        if not n:
            continue
        large = 3 * length > capacity  # two of these fill a bin but for a small gap
        left = fill(length, n, 1 if large else capacity, range(length, capacity + 1))
        start(length, left, 2 if large else capacity)
    return [x for of_gap in open_bins for x in of_gap]


def slot_table(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Slots by length and first rank: of rank r, bin ``first + (r - rank) // each``, offset ``at + (r - rank) % each * length``."""
    used, rows, first = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for bins, made in pack_counts(counts, capacity):
        at = 0
        for length, each in made:
            rows.append((length, used[length], first, each, at))
            used[length] += bins * each
            at += each * length
        first += bins
    rows.sort()
    names = ("length", "rank", "first", "each", "at")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T))


PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_files: tuple[str, str | None], *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(tokenized(docs, tokenizer_files, capacity, id_col, text_col), "pieces")
    by_chunk = materialize(pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_chunk.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_chunk.groupBy("length").agg(F.sum("n")).toLocalIterator():  # at most a row for each length
        counts[length] = n
    slots = spark.sparkContext.broadcast(slot_table(counts, capacity))
    ranked = pieces.join(bases, ["chunk", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    wide = 1 << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = slots.value
        keys = t["length"] * wide + t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, length * wide + rank, side="right") - 1
            nth = rank - t["rank"][k]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t["first"][k] + nth // t["each"][k]), pa.array(t["at"][k] + nth % t["each"][k] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PACKED)
