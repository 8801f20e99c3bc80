"""Benchmark decontamination by a distributed positional inverted index.

The index is document-partitioned: each shard (a slice of documents) stores, for every term of the benchmark, the postings
(document, positions) of its own documents, as rows of a table in the shared folder. Terms that no benchmark item holds
can't take part in a match and have no list. Corpus-wide list lengths come from the index and order the terms of each
window. A shard goes from each of its own rare terms to the windows whose rarest term it is; their places are intersected
with the offset-adjusted lists of the other terms, rarest first, until what is left are exact phrases. Proximity matches
(all terms of a window no further than a span from one of its rarest term, in any order) come from the same lists. A shard's work grows with its
postings of rarest terms, not with the benchmark.

Queries go to the shards in blocks of bounded size: what is broadcast at once is at most ``BLOCK_WORDS`` windows of
``WINDOW`` numbers and ``BLOCK_BYTES`` of terms; longer items are cut into stretches that share a window less one word. A
larger benchmark takes several passes over the documents, and the hits of the passes are merged.

Defined results: a null text or item has no words; an item of fewer words than the window is one window; equal windows of
several items count for each of these; repeated rows come back once each, repeated items count once; without items no row
is hit; an empty table gives no rows; other columns pass through, but for those named like a column of the result, which
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, materialize, others, slices

# Fixed value: the words of a lower-cased text, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, over its UTF-8 bytes.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
PROXIMITY = 15  # words on either side of a window's rarest term
BLOCK_WORDS, BLOCK_BYTES = 1_000_000, 64_000_000
SHARD_CHARS = 2_000_000
PAIRS = 250_000  # places and windows that are compared at once
MADE = ("n_words", "hits", "items", "near")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items and their words in blocks of at most so many words and bytes (one word may be of more)."""
    held: list[tuple[str, list[bytes]]] = []
    n = size = 0
    least = max(block_words, window)
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_col).distinct().toLocalIterator():
        found = words(text)
        start = 0
        while start == 0 or start + window - 1 < len(found):
            end, of_part = start, 0
            while end < len(found) and end - start < least and (of_part + len(found[end]) <= block_bytes or end - start < window):
                of_part += len(found[end])
                end += 1
            if held and (n + end - start > block_words or size + of_part > block_bytes):
                yield held
                held, n, size = [], 0, 0
            held.append((str(item), found[start:end]))
            n, size = n + end - start, size + of_part
            if end == len(found):
                break
            start = end - window + 1
    if held:
        yield held


class Windows:
    """The distinct windows of a block of items: a row of term numbers each (-1 beyond its end), and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.terms: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.names)}
        grids, owners = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for item, found in items:
            ids = np.array([self.terms.setdefault(w, len(self.terms)) for w in found], dtype=np.int32)
            if not len(ids):
                continue
            if len(ids) >= window:
                grids.append(np.lib.stride_tricks.sliding_window_view(ids, window))
            else:
                grids.append(np.pad(ids, (0, window - len(ids)), constant_values=-1)[None])
            owners.append(np.full(len(grids[-1]), number[item], np.int64))
        every, of = np.concatenate(grids), np.concatenate(owners)
        self.grid, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), of]), axis=1)
        self.owner_starts = np.searchsorted(pairs[0], np.arange(len(self.grid) + 1))
        self.owners = pairs[1].astype(np.int32)


@dataclass
class Queries:
    """Windows as shards search them: each with its places ordered by the rarity of their terms, sorted by the rarest term."""

    grid: np.ndarray
    order: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray  # of each term: where the windows begin whose rarest term it is
    owner_starts: np.ndarray
    owners: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, windows: Windows, length: np.ndarray) -> Queries:
        grid = windows.grid
        rarity = np.where(grid < 0, np.iinfo(np.int64).max, np.append(length, 0)[grid])
        order = np.argsort(rarity, axis=1, kind="stable").astype(np.int8)
        rarest = np.take_along_axis(grid, order[:, :1].astype(np.int64), axis=1)[:, 0] if len(grid) else np.empty(0, np.int32)
        by = np.argsort(rarest, kind="stable")
        counts = np.diff(windows.owner_starts)[by]
        at = np.concatenate([np.arange(a, b) for a, b in zip(windows.owner_starts[by], windows.owner_starts[by + 1])]) if len(by) else np.empty(0, np.int64)
        return cls(grid[by], order[by], (grid[by] >= 0).sum(axis=1), np.searchsorted(rarest[by], np.arange(len(length) + 1)), np.cumsum(np.append(0, counts)), windows.owners[at], windows.names)


def postings(terms: dict[bytes, int], texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Word counts of the texts, and (term, row, position) sorted by them."""
    counts, ids = [], []
    for text in texts:
        found = words(text)
        counts.append(len(found))
        ids.extend(map(terms.get, found, repeat(-1)))
    term = np.array(ids, dtype=np.int32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    starts = np.cumsum([0, *counts])[:-1]
    position = np.arange(len(term), dtype=np.int64) - np.repeat(starts, counts)
    known = np.flatnonzero(term >= 0)
    order = known[np.argsort(term[known], kind="stable")]
    return counts, term[order], row[order], position[order].astype(np.int32)


def shards(batch: pa.RecordBatch, text: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many characters of text each."""
    size, start = 0, 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()):
        size += n
        if size >= chars or k + 1 == batch.num_rows:
            yield batch.slice(start, k + 1 - start)
            size, start = 0, k + 1


def index_type(kept: T.StructType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    fields = [("docs", T.ArrayType(kept)), ("n_words", longs), ("terms", T.ArrayType(T.IntegerType())), ("lengths", longs), ("rows", T.BinaryType()), ("positions", T.BinaryType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def build_index(docs: DataFrame, text: str, terms) -> DataFrame:
    """docs -> one row for each shard: its documents without the text, their word counts, its terms, the lengths of the
    terms' lists and, list after list, row and position of each posting."""
    kept = T.StructType([f for f in docs.schema.fields if f.name != text])
    schema = to_arrow_schema(index_type(kept))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shards(whole, text, SHARD_CHARS):
                counts, term, row, position = postings(terms.value, batch.column(text).to_pylist())
                at = np.flatnonzero(np.diff(term, prepend=-1))
                lengths = np.diff(np.append(at, len(term)))
                names = [n for n in batch.schema.names if n != text]
                docs_of = pa.table([batch.column(n) for n in names], names=names).to_struct_array().combine_chunks()
                one = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), docs_of)
                cols = [one.cast(schema.field("docs").type), pa.array([counts], pa.list_(pa.int64())), pa.array([term[at]], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int64())), pa.array([row.tobytes()], pa.binary()), pa.array([position.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(build, index_type(kept))


TERM = 1 << 36  # a posting's key: its term's place in the shard times this, and its place among all words of the shard


@dataclass
class Shard:
    n: int
    terms: np.ndarray
    cuts: np.ndarray
    bases: np.ndarray  # where each document's words begin; documents are further apart than any span
    keys: np.ndarray

    @classmethod
    def of(cls, shard: dict, gap: int) -> Shard:
        counts = np.array(shard["n_words"], dtype=np.int64)
        bases = gap + np.cumsum(np.append(0, counts + gap))[:-1]
        rows, at = np.frombuffer(shard["rows"], np.int32), np.frombuffer(shard["positions"], np.int32)
        cuts = np.cumsum(np.append(0, np.array(shard["lengths"], dtype=np.int64)))
        keys = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) * TERM + bases[rows] + at
        return cls(len(counts), np.array(shard["terms"], dtype=np.int64), cuts, bases, keys)

    def first(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a posting of the term lies between low and high, both inclusive."""
        if not len(self.keys):
            return np.zeros(len(term), dtype=bool)
        local = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        at = np.minimum(np.searchsorted(self.keys, local * TERM + low), len(self.keys) - 1)
        key = self.keys[at]
        return (self.terms[local] == term) & (key >= local * TERM + low) & (key <= local * TERM + high)

    def row(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, place, side="right") - 1


def candidates(shard: Shard, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of a rarest term, window) in parts of bounded size."""
    first, last = q.starts[shard.terms], q.starts[shard.terms + 1]
    for t in np.flatnonzero(last > first):
        places = shard.keys[shard.cuts[t] : shard.cuts[t + 1]] - t * TERM
        for a in range(first[t], last[t], PAIRS):
            some = np.arange(a, min(last[t], a + PAIRS))
            step = max(PAIRS // len(some), 1)
            for b in range(0, len(places), step):
                part = places[b : b + step]
                yield np.repeat(part, len(some)), np.tile(some, len(part))


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small parts together, up to about PAIRS."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def intersect(shard: Shard, q: Queries, place: np.ndarray, window: np.ndarray, span: int | None) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the candidates once every other term, rarest first, is where the window has it (or within the span).

    Places of what is left are those of the window's first word (or of its rarest term)."""
    if span is None:
        place = place - q.order[window, 0]
    for k in range(1, q.grid.shape[1]):
        if not len(place):
            break
        offset = q.order[window, k].astype(np.int64)
        term = q.grid[window, offset]
        low, high = (place + offset, place + offset) if span is None else (place - span, place + span)
        left = (term < 0) | shard.first(term.astype(np.int64), low, high)
        place, window = place[left], window[left]
    return place, window


def items_by_row(shard: Shard, q: Queries, row: np.ndarray, window: np.ndarray) -> pa.Array:
    """Of each row the names of the items that hold one of its windows, sorted."""
    pairs = np.unique(row * (len(q.grid) + 1) + window)
    row, window = np.divmod(pairs, len(q.grid) + 1)
    counts = q.owner_starts[window + 1] - q.owner_starts[window]
    at = np.repeat(q.owner_starts[window] - np.append(0, np.cumsum(counts))[:-1], counts) + np.arange(counts.sum())
    n = max(len(q.names), 1)
    row, item = np.divmod(np.unique(np.repeat(row, counts) * n + q.owners[at]), n)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(shard.n + 1)), pa.int32()), pa.array(q.names, pa.string()).take(pa.array(item)))


def search(stored: dict, q: Queries, proximity: int | None) -> tuple[list[bytes], pa.Array, pa.Array]:
    """Of each document: hit positions (sorted int32 as bytes), items with exact and with near matches."""
    width = q.grid.shape[1]
    shard = Shard.of(stored, (proximity or 0) + width + 1)
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    exact, near = [none], [none]
    for place, window in gathered(candidates(shard, q)):
        found = intersect(shard, q, place, window, None)
        exact.append((np.repeat(found[0], q.sizes[found[1]]) + spread(q.sizes[found[1]]), np.repeat(found[1], q.sizes[found[1]])))
        if proximity is not None:
            place, window = intersect(shard, q, place, window, proximity)
            both = np.unique(shard.row(place) * (len(q.grid) + 1) + window)
            near.append(np.divmod(both, len(q.grid) + 1))
    place, window = map(np.concatenate, zip(*exact))
    row = shard.row(place)
    items = items_by_row(shard, q, row, window)
    place = np.unique(place)
    row = shard.row(place)
    cuts = np.searchsorted(row, np.arange(shard.n + 1))
    at = (place - shard.bases[row]).astype(np.int32)
    near_row, near_window = map(np.concatenate, zip(*near))
    return [at[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], items, items_by_row(shard, q, near_row, near_window)


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def match(index: DataFrame, queries, proximity: int | None) -> DataFrame:
    """One row for each document of the index: its columns, n_words, hits (sorted int32 positions as bytes), items with
    exact and with near matches."""
    kept = index.schema["docs"].dataType.elementType
    made = [("n_words", T.LongType()), ("hits", T.BinaryType()), ("items", T.ArrayType(T.StringType())), ("near", T.ArrayType(T.StringType()))]
    out = T.StructType(kept.fields + [T.StructField(n, t) for n, t in made])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                shard = {k: batch.column(k)[0].as_py() for k in ("n_words", "terms", "lengths", "rows", "positions")}
                docs_of = batch.column("docs").flatten().flatten()
                hits, items, near = search(shard, queries.value, proximity)
                found = [pa.array(shard["n_words"], pa.int64()), pa.array(hits, pa.binary()), items, near]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*docs_of, *found], schema)], schema=schema)

    return index.mapInArrow(run, out)


def union_of_hits(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, parts: hits of several blocks, items, near) -> key, hits, items, near."""
    schema = to_arrow_schema(T.StructType([rows.schema[key], T.StructField("hits", T.BinaryType()), rows.schema["items"], rows.schema["near"]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [np.unique(np.concatenate([np.frombuffer(h, np.int32) for h in part])).tobytes() for part in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(key), pa.array(hits, pa.binary()), batch.column("items"), batch.column("near")], schema)], schema=schema)

    return rows.mapInArrow(run, f"{key} bigint, hits binary, items array<string>, near array<string>")


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, proximity: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the text, with n_words, hits (sorted hit word positions), items and near (item ids)."""
    sc = docs.sparkSession.sparkContext
    text, key = fresh(docs, "words_of", "row_key")
    own = others(docs, text_col, *MADE)
    docs = docs.select(*own, F.col(text_col).alias(text))

    def searched(part: DataFrame, items: list, number: int) -> DataFrame:
        windows = Windows(items, window)
        index = materialize(build_index(part, text, sc.broadcast(windows.terms)), f"postings-{number}")
        length = np.zeros(len(windows.terms), dtype=np.int64)
        each = index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy("x.terms").agg(F.sum("x.lengths"))
        for term, n in each.toLocalIterator():  # a row for each term of the block at most
            length[term] = n
        return match(index, sc.broadcast(Queries.of(windows, length)), proximity)

    found = blocks(benchmark, item_col, item_text, window, block_words)
    first, second = next(found, []), next(found, None)
    if second is None:
        return searched(docs, first, 0)
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    hits = counts = None
    for number, items in enumerate(chain([first, second], found)):
        part = searched(keyed.select(key, text), items, number)
        counts = part.select(key, "n_words") if counts is None else counts
        part = part.filter((F.octet_length("hits") > 0) | (F.size("near") > 0)).drop("n_words")
        hits = part if hits is None else hits.unionByName(part)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = union_of_hits(hits.groupBy(key).agg(F.collect_list("hits").alias("parts"), every("items"), every("near")), key)
    none = F.array().cast("array<string>")
    out = keyed.drop(text).join(counts, key).join(merged, key, "left")
    return out.select(*own, "n_words", F.coalesce("hits", F.lit(b"")).alias("hits"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def carried(docs: DataFrame, benchmark: DataFrame, text_col: str, columns: list[str], **options) -> tuple[DataFrame, dict[str, str]]:
    """The hits of ``docs`` beside its columns under names that can't clash, and these names."""
    names = {c: f"own_{k}" for k, c in enumerate(columns)}
    renamed = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(text_col).alias("searched"))
    return find_hits(renamed, benchmark, text_col="searched", **options), names


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", proximity: int | None = PROXIMITY, **options) -> DataFrame:
    """``docs`` without the text, with n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity
    match of any of their windows; exact ones count)."""
    found, names = carried(docs, benchmark, text_col, others(docs, text_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"), proximity=proximity, **options)
    n_hit = (F.octet_length("hits") / 4).cast("long")
    made = [n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near")]
    return found.select(*(F.col(n).alias(c) for c, n in names.items()), "n_words", *made)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark window occurs in, with their own columns."""
    found, names = carried(docs, benchmark, text_col, docs.columns, **options)
    return found.filter(F.octet_length("hits") == 0).select(*(F.col(n).alias(c) for c, n in names.items()))
