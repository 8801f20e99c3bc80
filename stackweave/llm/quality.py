"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Texts become hashed byte-trigram counts and a few shape measures, over the whole text. A bounded sample of labelled rows
(``MAX_LABELLED``, half of each label at most) gives document frequencies and a truncated singular value decomposition;
its vectors and labels are broadcast (``MAX_LABELLED`` x ``DIMS`` floats). Every document is projected and compared with
all of them by exact blocked cosine products; its nearest ones vote, weighted by similarity.

Only labels.quality of rows with crc32(doc_id as text) mod 4 other than 2 is learnt from; score inputs are texts alone.

Defined results: null and empty texts have no neighbours and score the share of label 1 among the sampled rows of either
label, 0.5; of several labels of a doc_id the largest counts, and of several rows of a labelled doc_id the greatest text
is learnt from; without labels all score 0.5; repeated rows come back once each; an empty table gives no rows; other
columns pass through, but for those named like a column of the result, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, others, slices

MAX_LABELLED = 4096  # the bound of the fitting sample
BUCKETS = 2048
DIMS = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
SHAPES = 16
SHAPE_WEIGHT = 0.5
FIT_ROWS = 512  # of the sample that the fit weighs at once
SPARE = 16  # axes carried beyond DIMS while the subspace settles
ROUNDS = 16


def byte_classes() -> np.ndarray:
    """A class for each byte: 0 lower letters, 1 upper, 2 digits, 3 space, 4 line ends, 5 stops, 6 other marks, 7 beyond ASCII."""
    of = np.full(256, 6, dtype=np.int64)
    of[128:] = 7
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:?'\"-()")):
        of[list(chars)] = k
    return of


CLASSES = byte_classes()


def measures(texts: list[str | None]) -> np.ndarray:
    """len(texts) x (BUCKETS + SHAPES): trigram counts, then shape measures, all over whole texts."""
    out = np.zeros((len(texts), BUCKETS + SHAPES), dtype=np.float32)
    for k, text in enumerate(texts):
        if not text:
            continue
        b = np.frombuffer(text.encode(), dtype=np.uint8)
        n = len(b)
        w = b.astype(np.uint32)
        if n >= 3:
            h = w[:-2] * np.uint32(0x9E3779B1) + w[1:-1] * np.uint32(0x85EBCA6B) + w[2:] * np.uint32(0xC2B2AE35)
            out[k, :BUCKETS] = np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), minlength=BUCKETS)
        shares = np.bincount(CLASSES[b], minlength=8) / n
        words = text.split()
        different = len(set(words))
        repeated = sum(map(str.__eq__, words, words[1:]))
        lines = text.split("\n")
        m = max(len(words), 1)
        tri = out[k, :BUCKETS]
        more = [different / m ** 0.85, repeated / m, min(n / m, 20) / 20, len(set(lines)) / len(lines), float(tri.max()) / max(n, 1), min(np.log1p(m) / 10, 1), sum(map(str.isupper, words)) / m, min(len(lines) / m, 1)]
        out[k, BUCKETS:] = [*shares, *more]
    return out


@dataclass
class Model:
    idf: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def rows(self, raw: np.ndarray) -> np.ndarray:
        """Weighted and scaled term rows."""
        terms = np.log1p(raw[:, :BUCKETS]) * self.idf
        terms /= np.maximum(np.linalg.norm(terms, axis=1, keepdims=True), 1e-9)
        return np.hstack([terms, (raw[:, BUCKETS:] - self.centre) / self.spread * SHAPE_WEIGHT / np.sqrt(SHAPES)])

    def latent(self, rows: np.ndarray) -> np.ndarray:
        at = rows @ self.axes
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)

    def project(self, raw: np.ndarray) -> np.ndarray:
        return self.latent(self.rows(raw))

    def scores(self, raw: np.ndarray) -> np.ndarray:
        empty = ~raw.any(axis=1)
        near = self.project(raw) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 4 + 1e-9
        voted = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(empty, 0.5, voted)


def main_axes(rows: np.ndarray) -> np.ndarray:
    """The DIMS first right singular vectors of ``rows`` by subspace iteration, without a square of all columns."""
    width = min(DIMS + SPARE, rows.shape[1])
    base = np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(ROUNDS):
        base = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(base)[0]))[0]
    seen = rows @ base
    values, turn = np.linalg.eigh((seen.T @ seen).astype(np.float64))
    return (base @ turn[:, np.argsort(values)[::-1][:DIMS]]).astype(np.float32)


def fit(raw: np.ndarray, labels: np.ndarray) -> Model:
    """Fits on the measures ``raw``, which it overwrites: the driver holds the sample once."""
    df = (raw[:, :BUCKETS] > 0).sum(axis=0)
    idf = np.log((1 + len(raw)) / (1 + df)).astype(np.float32) + np.float32(0.1)
    shapes = raw[:, BUCKETS:]
    model = Model(idf, shapes.mean(axis=0), shapes.std(axis=0) + np.float32(1e-3), np.zeros(0), np.zeros(0), labels.astype(np.float32))
    for k in range(0, len(raw), FIT_ROWS):
        raw[k : k + FIT_ROWS] = model.rows(raw[k : k + FIT_ROWS])
    model.axes = main_axes(raw)
    model.vectors = model.latent(raw)
    return model


MEASURED = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("raw", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fits on at most so many labelled rows outside the held-out fold, chosen by a hash of their ids."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    usable = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("quality"))
    half = max_labelled // 2
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("quality") == label).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(half)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most max_labelled rows: of rows that share a doc_id the one of the greatest text counts
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.max("quality").alias("quality"), F.max(text_col).alias("text")).select("quality", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 64):
                raw = measures(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in raw], pa.binary())], names=["quality", "raw"])

    got = sample.mapInArrow(measured, MEASURED).toArrow()
    if not got.num_rows:
        return None
    raw = np.empty((got.num_rows, BUCKETS + SHAPES), dtype=np.float32)
    for k, x in enumerate(got.column("raw")):
        raw[k] = np.frombuffer(zlib.decompress(x.as_buffer()), np.float32)
    quality = got.column("quality").to_numpy()
    del got
    return fit(raw, quality)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **options) -> DataFrame:
    """``docs`` (without the text unless it is to be kept) with held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, **options))
    own = others(docs, "held_out", "score", "predicted", *(() if keep_text else (text_col,)))
    (whole,) = fresh(docs, "whole")
    held_out = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2).alias("held_out")
    ready = docs.select(*own, held_out, F.col(text_col).alias(whole))
    out = T.StructType([*ready.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 128):
                texts = batch.column(batch.num_columns - 1).to_pylist()
                score = np.full(len(texts), 0.5) if model.value is None else model.value.scores(measures(texts)).astype(np.float64)
                score = np.clip(score, 0.0, 1.0)
                cols = [*batch.columns[:-1], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return ready.mapInArrow(run, out)
