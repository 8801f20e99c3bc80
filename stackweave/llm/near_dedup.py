"""Near-duplicates by an LSH forest, every candidate pair confirmed on full sets.

1. Every text gives its set of distinct shingles (64-bit hashes) and ``TREES`` x ``LEVELS`` one-byte min-hashes.
2. Texts with equal sets are one class, stood for by its smallest doc_id; copies are never paired.
3. A tree is the classes in the sorted order of its levels. The orders of all trees are range-partitioned and swept;
   neighbours with a longest common prefix of at least ``DEPTH`` levels are candidates. The depth adapts to the region:
   where few share a prefix, one level less is enough. A check on other trees' hashes drops neighbours of low similarity.
   A pair at similarity 0.75 shares no prefix of any tree with probability (1 - 0.75**5)**48, two in a million.
4. Candidates make regions (their connected components). In a region all pairs are compared on full sets, by an inverted
   list of its shingles. A large region is cut by the sizes of its sets into bands, of which only a band and the next can
   hold a link, and bands into chunks; each pair of chunks is a cell of its own, so no region is one task and no pair of it
   is left out, however many partners a text has. A cell returns a spanning forest of its links. The price: a band of n
   different texts takes up to n * n / 2 comparisons, spread over cells, and up to n / ``CHUNK_MOST`` copies of each set.
5. The links' connected components are the result.

What the probability in 3 leaves out: neighbours more than two rows apart and the check can part two texts of one region in
a tree; they stay in one region as long as some chain of neighbours of any tree leads from one to the other. The tests
count the links that are found among texts around 0.75 inside crowds of half-similar ones.

Defined results: null and empty texts have no shingles and are linked with nothing, nor are rows without doc_id (whose
component is null); texts of fewer words than a shingle are one shingle; repeated rows come back once each; an empty table
gives no rows; other columns pass through, but for those named like a column of the result, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, materialize, others, slices
from .components import connected_components

SHINGLE = 5
PERCENT = 75
TREES, LEVELS = 48, 6
DEPTH = 5
SPARSE = 16  # texts of a region in which one level less is enough
CHECK, CHECK_LEAST = 16, 8  # bytes of other trees that go with a row, and how many have to agree
CHUNK_DOCS, CHUNK_MOST, CHUNK_SHINGLES = 256, 8192, 2_000_000
BAND = float(np.log(1.34))  # of set sizes: a link's sizes differ by 4/3 at most, so its sets lie in one band or in two next to each other
SALTS = 48

_RANDOM = np.random.default_rng(20260101)
_A = _RANDOM.integers(1, 1 << 63, size=TREES * LEVELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, size=TREES * LEVELS, dtype=np.uint64)
_P = _RANDOM.integers(1, 1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CACHED_WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text. Of bytes, lower() changes A-Z and split() parts at space and 09-0D only."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(w) < SHINGLE:
        return mixed((w * _P[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h += w[k : k + n] * _P[k]
    return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> bytes:
    """One byte of each min-hash."""
    least = np.full(TREES * LEVELS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        h = shingles[None, k : k + 1024] * _A[:, None]
        h += _B[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes()


def digest_of(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def sketches(docs: DataFrame, text_col: str, digest: str = "digest", signature_name: str = "signature") -> DataFrame:
    """docs (without the text) with n_shingles, digest (of the set; null if empty) and signature."""
    ready = docs.select(*others(docs, text_col), text_col)
    more = [T.StructField("n_shingles", T.LongType()), T.StructField(digest, T.BinaryType()), T.StructField(signature_name, T.BinaryType())]
    out = T.StructType([*ready.schema.fields[:-1], *more])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in slices(whole, 512):
                n, digests, signatures = [], [], []
                for text in batch.column(batch.num_columns - 1).to_pylist():
                    s = shingle_set(text, hashes)
                    n.append(len(s))
                    digests.append(digest_of(s.tobytes()) if len(s) else None)
                    signatures.append(signature(s) if len(s) else None)
                cols = [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return ready.mapInArrow(run, out)


def tree_rows(classes: DataFrame) -> DataFrame:
    """A row of each class for each tree: place (the tree, then its levels, in one number), id, check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2048):
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(ids), TREES, LEVELS)
                flat = s.reshape(len(ids), -1)
                for t in range(TREES):
                    place = np.full(len(ids), t, dtype=np.int64)
                    for level in range(LEVELS):
                        place = (place << 8) | s[:, t, level]
                    others = (np.arange(CHECK) + (t + 1 + t % 3) * LEVELS) % (TREES * LEVELS)
                    check = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CHECK), len(ids), [None, pa.py_buffer(np.ascontiguousarray(flat[:, others]))])
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(ids), check.cast(pa.binary())], names=["place", "id", "check"])

    return classes.select("id", "signature").mapInArrow(run, "place bigint, id bigint, check binary")


def common_levels(x: np.ndarray) -> np.ndarray:
    """How many levels two places share, of their exclusive or; -1 in different trees."""
    levels = np.full(len(x), LEVELS, dtype=np.int64)
    for k in range(LEVELS + 1):
        levels -= x >= (1 << (8 * k))
    return levels


def neighbours(place: np.ndarray, ids: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of a sorted stretch: up to two rows apart, deep enough and similar enough by the check."""
    region = place >> (8 * (LEVELS - DEPTH + 1))
    starts = np.flatnonzero(np.diff(region, prepend=-1))
    sizes = np.diff(np.append(starts, len(region)))
    size = np.repeat(sizes, sizes)
    a, b = [], []
    chained = np.zeros(max(len(place) - 1, 0), dtype=bool)  # rows that are joined with the next already
    for apart in (1, 2):
        if len(place) <= apart:
            break
        levels = common_levels(place[apart:] ^ place[:-apart])
        near = np.flatnonzero((levels >= DEPTH) | ((levels == DEPTH - 1) & (size[apart:] <= SPARSE)))
        near = near[(check[near] == check[near + apart]).sum(axis=1) >= CHECK_LEAST]
        if apart == 1:
            chained[near] = True
        else:
            near = near[~(chained[near] & chained[near + 1])]
        a.append(ids[near])
        b.append(ids[near + apart])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def swept(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of all trees, from one range-partitioned sort."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["part", "a", "b", "place", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail = None
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            check = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(ids), CHECK)
            if first is None:
                first = (place[:2], ids[:2], check[:2])
            if tail is not None:
                place, ids, check = (np.concatenate([x, y]) for x, y in zip(tail, (place, ids, check)))
            a, b = neighbours(place, ids, check)
            tail = (place[-2:], ids[-2:], check[-2:])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), part, np.int32)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], names=names)
        if first is not None:
            edge = [(p, i, c.tobytes()) for x in (first, tail) for p, i, c in zip(*x)]
            edge = sorted(set(edge))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(edge), pa.int32()), pa.array([e[1] for e in edge], pa.int64()), pa.nulls(len(edge), pa.int64()), pa.array([e[0] for e in edge], pa.int64()), pa.array([e[2] for e in edge], pa.binary())], names=names)

    ordered = rows.repartitionByRange(n, "place", "id").sortWithinPartitions("place", "id")
    found = materialize(ordered.mapInArrow(run, "part int, a bigint, b bigint, place bigint, check binary"), "neighbours")
    # four rows of each partition: pairs across the partitions' ends
    ends = sorted((r.place, r.a, bytes(r.check)) for r in found.filter("b is null").toLocalIterator())
    across: list[tuple[int, int]] = []
    if ends:
        check = np.frombuffer(b"".join(e[2] for e in ends), dtype=np.uint8).reshape(len(ends), CHECK)
        a, b = neighbours(np.array([e[0] for e in ends], dtype=np.int64), np.array([e[1] for e in ends], dtype=np.int64), check)
        across = list(zip(a.tolist(), b.tolist()))
    pairs = found.filter("b is not null").select("a", "b")
    if across:
        pairs = pairs.union(spark.createDataFrame(across, "a bigint, b bigint"))
    return pairs.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cell_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], within: bool) -> list[tuple[int, int]]:
    """Spanning forest of the exact links between the two sides of a cell, or within one chunk."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owners = np.repeat(np.arange(n), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    lists = owners[order]  # of each shingle, the documents that hold it, in order
    starts = np.searchsorted(code[order], np.arange(code.max() + 2))
    of_doc = np.cumsum(np.append(0, sizes))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x in range(n) if within else np.flatnonzero(sides == 0):
        codes = code[of_doc[x] : of_doc[x + 1]]
        first, lengths = starts[codes], starts[codes + 1] - starts[codes]
        shared = lengths > 1
        first, lengths = first[shared], lengths[shared]
        if not len(first):
            continue
        at = np.repeat(first - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        common = np.bincount(lists[at], minlength=n)
        linked = 100 * common >= PERCENT * (sizes[x] + sizes - common)
        linked &= (np.arange(n) > x) if within else (sides == 1)
        for y in np.flatnonzero(linked).tolist():
            p, q = root(int(x)), root(y)
            if p != q:
                parent[p] = q
                links.append((int(ids[x]), int(ids[y])))
    return links


def confirmed(candidates: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b): enough to connect all that exact links connect, of all pairs within the candidates' regions."""
    regions = connected_components(candidates)
    sized = regions.join(classes.select("id", "digest", "n_shingles"), "id")
    whole = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    small = (F.col("n") <= 2 * CHUNK_DOCS) & (F.col("shingles") <= CHUNK_SHINGLES)
    per_chunk = F.least(F.greatest(F.lit(CHUNK_DOCS), F.col("n") / 32), F.lit(CHUNK_MOST))
    banded = materialize(sized.join(whole.select("component", small.alias("small"), per_chunk.alias("per_chunk")), "component").select("id", "digest", "component", "n_shingles", "small", "per_chunk", F.when(F.col("small"), 0).otherwise(F.floor(F.log("n_shingles") / BAND)).cast("int").alias("band")), "bands")
    counts = banded.groupBy("component", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.first("per_chunk").alias("per_chunk"), F.first("small").alias("small"))
    chunks = counts.select("component", "band", F.when(F.col("small"), 1).otherwise(F.greatest(F.ceil(F.col("n") / F.col("per_chunk")), F.ceil(F.col("shingles") / CHUNK_SHINGLES))).cast("int").alias("chunks"))
    # each band with the numbers of chunks of the bands beside it
    beside = chunks.select("component", F.explode(F.array(*(F.struct((F.col("band") + k).alias("band"), *(F.when(F.lit(k == j), F.col("chunks")).alias(n) for j, n in ((1, "below"), (0, "chunks"), (-1, "above")))) for k in (-1, 0, 1)))).alias("b")).select("component", "b.*")
    around = beside.groupBy("component", "band").agg(*(F.max(n).alias(n) for n in ("below", "chunks", "above"))).filter("chunks is not null")
    placed = banded.join(around, ["component", "band"]).select("id", "digest", "component", "band", "below", "chunks", "above", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int").alias("chunk"))
    # the texts in regions grow with the corpus, so their join is the same at every size: by id, never a broadcast. Of several
    # texts of an id the one of the class is taken, by its digest
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(placed.hint("merge"), "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for everything in batches:
            for batch in slices(everything, 512):
                found = [shingle_set(t, hashes).tobytes() for t in batch.column(1).to_pylist()]
                own = pa.array([digest_of(s) == d for s, d in zip(found, batch.column(2).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.binary())], names=["id", "digest", "component", "band", "below", "chunks", "above", "chunk", "shingles"]).filter(own)

    held = texts.select("id", "text", "digest", "component", "band", "below", "chunks", "above", "chunk").mapInArrow(sets, "id bigint, digest binary, component bigint, band int, below int, chunks int, above int, chunk int, shingles binary")
    numbered = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    # the cells of a set: with every chunk of its own band, of the band below (of which it is side 1) and above
    own = F.transform(numbered("chunks"), lambda k: F.struct(F.col("band").alias("band"), F.least("chunk", k).alias("low"), F.greatest("chunk", k).alias("high"), (F.col("chunk") > k).cast("int").alias("side"), F.lit(False).alias("across")))
    lower = F.transform(numbered("below"), lambda k: F.struct((F.col("band") - 1).alias("band"), k.alias("low"), F.col("chunk").alias("high"), F.lit(1).alias("side"), F.lit(True).alias("across")))
    upper = F.transform(numbered("above"), lambda k: F.struct(F.col("band").alias("band"), F.col("chunk").alias("low"), k.alias("high"), F.lit(0).alias("side"), F.lit(True).alias("across")))
    cells = held.select("id", "digest", "component", "shingles", F.explode(F.concat(own, lower, upper)).alias("c")).select("id", "digest", "component", "shingles", "c.*")

    def compare(cell: pa.Table) -> pa.Table:
        ids = cell.column("id").to_numpy()
        seen: dict[bytes, int] = {}
        for k, d in enumerate(cell.column("digest").to_pylist()):
            seen.setdefault(d, k)  # a repeated row is there once
        once = np.array([seen[d] for d in sorted(seen)])
        sets_of = [np.frombuffer(cell.column("shingles")[int(k)].as_py(), dtype=np.uint64) for k in once]
        within = cell.column("low")[0] == cell.column("high")[0] and not cell.column("across")[0].as_py()
        found = cell_links(ids[once], cell.column("side").to_numpy()[once], sets_of, bool(within))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return materialize(cells.groupBy("component", "band", "across", "low", "high").applyInArrow(compare, "a bigint, b bigint"), "links")


def shared_ids(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of ids that stand on several different texts with the classes of all of them."""
    several = materialize(keyed.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least != most").select("id"), "several-texts")
    if several.isEmpty():
        return several.select(F.col("id").alias("a"), F.col("id").alias("b"))
    met = keyed.join(several, "id").select(F.col("id").alias("a"), "digest").distinct()
    return met.join(classes.select("digest", F.col("id").alias("b")), "digest").select("a", "b")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_shingles, component_id and kept."""
    own = others(docs, text_col, "n_shingles", "component_id", "kept")
    digest, signed, salt, component = fresh(docs, "digest", "signature", "salt", "component")
    salted = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias(salt)
    sketched = materialize(sketches(docs.select(*own, text_col), text_col, digest, signed).select("*", salted), "sketches")
    usable = sketched.filter(F.col(digest).isNotNull() & F.col(id_col).isNotNull())
    keyed = usable.select(F.col(digest).alias("digest"), F.col(id_col).cast("long").alias("id"), F.col("n_shingles"), F.col(signed).alias("signature"), F.col(salt).alias("salt"))
    merged = keyed.groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    classes = materialize(merged, "classes")
    links = confirmed(swept(tree_rows(classes)), docs, classes, id_col, text_col).union(shared_ids(keyed, classes))
    joined = connected_components(links)
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col("mask"), s) == 1)
    # of every class its component, once for each salt that has members
    known = classes.select(F.col("digest").alias(digest), "id", "mask").join(joined, "id", "left").select(digest, F.coalesce("component", "id").alias(component), F.explode(held).alias(salt))
    out = sketched.join(known, [digest, salt], "left")
    of_row = F.when(F.col(id_col).isNotNull(), F.coalesce(component, F.col(id_col)))
    return out.select(*own, "n_shingles", of_row.alias("component_id"), of_row.eqNullSafe(F.col(id_col)).alias("kept"))


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their own columns."""
    gone = near_groups(docs.select(id_col, text_col), id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
