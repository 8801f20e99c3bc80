"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words (runs of letters, with an end mark) and their prefixes of 3 to 8 letters, over whole texts.
The model is fitted in four steps, none of which moves a text:

1. Candidates: terms of at least 3 toxic texts, and more frequent there than in clean ones, in a sample of at most
   ``max_labelled`` labelled rows (half of each label; at most ``MAX_CANDIDATES`` by chi-square).
2. One pass over all texts turns each into its candidate terms with their counts and a signature, the least hash of its
   word triples, and writes that narrow table; everything later reads it instead of texts.
3. Of labelled rows outside the held-out fold one of each signature and label teaches, so a group of near-copies teaches
   once. Over all of them each term gets its share of toxic texts; terms whose share is at least ``SURE`` at 95 %
   confidence stay (at most ``MAX_TERMS`` by chi-square). A term weighs inverse document frequency, over all documents,
   times the odds of that lower bound.
4. At most ``max_labelled`` of the teaching rows (half of each label), as unit vectors of those terms and of one
   background term that every text has, make the index: postings in blocks of examples, and for each term and block the
   largest weight. It is broadcast; its size is bounded by ``max_labelled`` x the terms kept.

A text's nearest ``NEIGHBOURS`` examples are exact: blocks are weighed in falling order of their bounds until none can
reach the last neighbour. Votes are weighted by 1 / (distance + ``SOFTEN``); votes of the examples themselves, each left
out of its own, restore the labels' true shares in bins made monotone, which gives the score.

Only labels.toxic of rows with crc32(doc_id as text) mod 5 other than 0 is learnt from; score inputs are texts alone.

Defined results: null and empty texts have the background term only and score as the clean texts nearest them; of several
labels of a doc_id the largest counts; without labels, or with one label alone, nothing is toxic for certain: all score
that label's share, 0 without labels; examples at the distance of the last neighbour share the places left; repeated rows
come back once each; a null doc_id is not held out and teaches nothing; an empty table gives no rows; other columns pass
through, but for those named like a column of the result, which are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, fresh, materialize, others, slices

MAX_LABELLED = 4096  # the bound of the fitting samples
MAX_CANDIDATES = 32768
MAX_TERMS = 1024
LEAST_TEXTS = 3  # toxic texts that a term needs
SURE = 0.5
BACKGROUND = 8.0
NEIGHBOURS = 15
SOFTEN = 0.02
BLOCK = 64  # examples of an index block
THRESHOLD = 0.5
BINS = 10

WORD = re.compile(r"[^\W\d_]+")
GAP = re.compile(r"[\W\d_]")
PIECE = 1 << 20  # characters of a text that are split into words at once
REMEMBERED = 300_000  # words whose terms a task remembers


def pieces(text: str) -> Iterator[str]:
    """The lower-cased text in pieces that end between words, unless a word is longer than a piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = GAP.search(text, end, end + PIECE)
            end = gap.start() if gap else end + PIECE
        yield text[at:end].lower()
        at = end


def terms_of(word: str) -> list[str]:
    return [word[:k] for k in range(3, min(len(word), 8) + 1)] + [word + ">"]


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = zlib.crc32(word.encode())
        return out


def read_text(text: str | None, hashes: WordHashes) -> tuple[Counter, int]:
    """The counts of a text's words and its signature."""
    counts: Counter = Counter()
    least, tail = None, np.zeros(0, np.uint64)
    for piece in pieces(text or ""):
        words = WORD.findall(piece)
        counts.update(words)
        h = np.concatenate([tail, np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))])
        if len(h) >= 3:
            mixed = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            low = int(mixed.min())
            least = low if least is None else min(least, low)
        tail = h[-2:]
    if least is None:  # fewer than three words: all of them
        least = zlib.crc32(" ".join(counts).encode())
    return counts, least - (1 << 63)


class Known(dict):
    """The candidate terms of a word, as ids; words without any are remembered too."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = tuple(self.ids[t] for t in terms_of(word) if t in self.ids)
        return out


@dataclass
class Model:
    """``weight`` of each kept term by candidate id, the examples' index and the calibration."""

    column: np.ndarray  # by candidate id: the row in the index, or -1
    weight: np.ndarray
    ids: np.ndarray  # of the examples, in index order
    toxic: np.ndarray
    names: list[str] = field(default_factory=list)
    lists: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # a term's examples and weights, background last
    starts: np.ndarray | None = None  # terms x blocks + 1: where a block begins in a term's list
    most: np.ndarray | None = None  # terms x blocks: the largest weight
    levels: np.ndarray | None = None
    only: float = 0.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index rows and unit weights of a text's candidate terms; the background comes last."""
        rows = self.column[found]
        rows, counts = rows[rows >= 0], counts[rows >= 0]
        weights = np.append((1 + np.log(counts)) * self.weight[rows], BACKGROUND)
        return np.append(rows, len(self.weight)), weights / np.linalg.norm(weights)

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n, blocks = len(vectors), -(-len(vectors) // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(self.weight) + 1)]
        for k, (rows, weights) in enumerate(vectors):
            for row, w in zip(rows.tolist(), weights.tolist()):
                postings[row].append((k, w))
        self.lists = [(np.array([k for k, _ in p], np.int64), np.array([w for _, w in p])) for p in postings]
        self.most = np.zeros((len(postings), blocks))
        for row, (at, w) in enumerate(self.lists):
            np.maximum.at(self.most[row], at // BLOCK, w)
        edges = np.arange(blocks + 1) * BLOCK
        self.starts = np.array([np.searchsorted(at, edges) for at, _ in self.lists]).reshape(len(postings), blocks + 1)

    def nearest(self, rows: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples and their cosines, exactly, with all that tie with the last; ``without`` leaves one example out."""
        bounds = weights @ self.most[rows]
        best, at = np.zeros(0), np.zeros(0, np.int64)
        for block in np.argsort(-bounds, kind="stable"):
            if len(best) >= NEIGHBOURS and bounds[block] < best[-1] - 1e-12:
                break
            lo, hi = block * BLOCK, min((block + 1) * BLOCK, len(self.ids))
            scores = np.zeros(hi - lo)
            for row, w in zip(rows, weights):
                a, b = self.starts[row, block], self.starts[row, block + 1]
                if a < b:
                    examples, held = self.lists[row]
                    scores[examples[a:b] - lo] += w * held[a:b]
            mine = np.arange(lo, hi)
            if lo <= without < hi:
                mine, scores = np.delete(mine, without - lo), np.delete(scores, without - lo)
            best, at = np.append(best, np.round(scores, 12)), np.append(at, mine)
            order = np.lexsort((at, -best))
            best, at = best[order], at[order]
            if len(best) > NEIGHBOURS:
                last = np.searchsorted(-best, -best[NEIGHBOURS - 1], "right")
                best, at = best[:last], at[:last]
        return at, best

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        w = 1 / (np.maximum(1 - cosine, 0) + SOFTEN)
        if len(at) > NEIGHBOURS:  # those that tie with the last share the places left
            tied = cosine == cosine[-1]
            w[tied] *= (NEIGHBOURS - (~tied).sum()) / tied.sum()
        return float((w * self.toxic[at]).sum() / w.sum()) if len(at) else 0.0

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], share: tuple[float, float]) -> None:
        """Toxic shares by bins of the votes that each example gets without itself; ``share`` restores either label's true number."""
        votes = np.array([self.vote(*self.nearest(r, w, k)) for k, (r, w) in enumerate(vectors)])
        weight = np.where(self.toxic == 1, share[1], share[0])
        bins = np.minimum((votes * BINS).astype(int), BINS - 1)
        middle = (np.arange(BINS) + 0.5) / BINS  # two texts of a bin's own middle, for bins that few reach
        held = np.bincount(bins, weight, BINS) + 2
        groups = [[v, h, 1] for v, h in zip((np.bincount(bins, weight * self.toxic, BINS) + 2 * middle) / held, held)]
        k = 1
        while k < len(groups):  # pools neighbours that fall
            if groups[k - 1][0] > groups[k][0]:
                (v, h, n), (w, i, m) = groups[k - 1 : k + 1]
                groups[k - 1 : k + 1] = [[(v * h + w * i) / (h + i), h + i, n + m]]
                k = max(1, k - 1)
            else:
                k += 1
        self.levels = np.concatenate([[v] * n for v, _, n in groups])

    def score(self, found: np.ndarray, counts: np.ndarray) -> tuple[float, str, str]:
        """Score, nearest examples as doc_id:label:cosine, and the terms shared with the nearest toxic one."""
        if self.levels is None:
            return self.only, "", ""
        rows, weights = self.vector(found, counts)
        at, cosine = self.nearest(rows, weights)
        score = float(np.interp(self.vote(at, cosine), (np.arange(BINS) + 0.5) / BINS, self.levels))
        near = ",".join(f"{self.ids[k]}:{int(self.toxic[k])}:{c:.3f}" for k, c in zip(at[:3], cosine))
        shared = []
        first = next((k for k in at if self.toxic[k]), None)
        if first is not None:
            for row, w in zip(rows[:-1], weights):
                held = self.lists[row][0]
                i = np.searchsorted(held, first)
                if i < len(held) and held[i] == first:
                    shared.append((-w, self.names[row]))
        return score, near, ",".join(t for _, t in sorted(shared)[:5])


def lower_bound(hits: int, all_: int) -> float:
    """Of a share, at 95 % confidence (Wilson)."""
    p, z = hits / all_, 1.96
    return (p + z * z / (2 * all_) - z * math.sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))) / (1 + z * z / all_)


def teaching(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 != 0))
    return usable.groupBy(F.col(id_col).alias("label_id")).agg(F.when(F.max(label_col) > 0, 1).otherwise(0).alias("toxic"))


def halves(rows: DataFrame, max_labelled: int) -> DataFrame:
    """At most half of the bound of either label, by a hash of the ids."""
    parts = [rows.filter(F.col("toxic") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled // 2) for label in (0, 1)]
    return parts[0].unionByName(parts[1])


def find_candidates(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Terms that the sampled toxic texts have more often than the clean ones."""
    sample = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(seeds), F.col("doc") == F.col("label_id")).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hashes = (Counter(), Counter()), WordHashes()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts, _ = read_text(text.as_py(), hashes)
                seen[toxic].update({t for w in counts for t in terms_of(w)})
                seen[toxic][""] += 1  # texts
        names = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[0][t] for t in part], pa.int64()), pa.array([seen[1][t] for t in part], pa.int64())], names=["term", "clean", "toxic"])

    counted = materialize(sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a")), "terms")
    total = counted.filter("term = ''").first()
    if total is None or not total.a or not total.b:
        discard(counted)
        return []
    a, b, n1, n0 = F.col("a").cast("double"), F.col("b").cast("double"), float(total.a), float(total.b)
    cross = a * (n0 - b) - b * (n1 - a)
    worth = cross * cross / ((a + b) * (n1 + n0 - a - b + 1))
    top = counted.filter(f"term <> '' and a >= {LEAST_TEXTS}").filter(a * n0 > 2 * b * n1).orderBy(worth.desc(), "term").limit(MAX_CANDIDATES)
    found = [r.term for r in top.select("term").collect()]  # at most MAX_CANDIDATES
    discard(counted)
    return found


def narrow(docs: DataFrame, candidates: list[str], id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """Each row's other columns with its candidate terms, their counts and its signature; and the names of those three."""
    names = fresh(docs, "term_ids", "term_counts", "signature")
    own = others(docs, text_col)
    ids = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(candidates)})
    out = T.StructType([*docs.select(*own).schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = Known(ids.value), WordHashes()
        for whole in batches:
            for batch in slices(whole, 256):
                found, times, signs = [], [], []
                for text in batch.column(batch.num_columns - 1):
                    counts, sign = read_text(text.as_py(), hashes)
                    mine: Counter = Counter()
                    for word, n in counts.items():
                        for t in known[word]:
                            mine[t] += n
                    keys = sorted(mine)
                    found.append(keys)
                    times.append([min(mine[t], 2**31 - 1) for t in keys])
                    signs.append(sign)
                cols = [*batch.columns[:-1], pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(signs, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    (whole,) = fresh(docs, "whole_text")
    return docs.select(*own, F.col(text_col).alias(whole)).mapInArrow(run, out), names


def fit(read: DataFrame, names: list[str], candidates: list[str], labels: DataFrame, id_col: str, max_labelled: int) -> Model:
    found, times, sign = names
    labelled = read.select(F.col(id_col).alias("doc"), F.col(found).alias("found"), F.col(times).alias("times"), F.col(sign).alias("sign"))
    once = labelled.join(labels, F.col("doc") == F.col("label_id")).groupBy("toxic", "sign").agg(F.max_by(F.struct("label_id", "found", "times"), F.struct("label_id", F.size("found"))).alias("r"))
    once = materialize(once.select("toxic", "r.*"), "taught")
    shares = dict(once.groupBy("toxic").count().collect())
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    model = Model(np.full(len(candidates), -1), np.zeros(0), np.zeros(0), np.zeros(0), only=1.0 if n1 and not n0 else 0.0)
    if n0 and n1:
        # at most MAX_CANDIDATES rows each
        hits = once.select("toxic", F.explode("found").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect()
        everywhere = dict(read.select(F.explode(found).alias("term")).groupBy("term").count().collect())
        docs = read.count()
        kept = []
        for r in hits:
            a, n = int(r.a), int(r.n)
            if a >= LEAST_TEXTS and (low := lower_bound(a, n)) >= SURE:
                b = n - a
                worth = (a * (n0 - b) - b * (n1 - a)) ** 2 / (n * (n0 + n1 - n + 1))
                odds = math.log(max(low / (1 - low) * n0 / n1, 1.01))
                kept.append((-worth, candidates[r.term], r.term, math.log(1 + docs / everywhere[r.term]) * odds))
        kept = sorted(kept)[:MAX_TERMS]
        model.names = [t for _, t, _, _ in kept]
        model.weight = np.array([w for *_, w in kept])
        for k, (*_, term, _) in enumerate(kept):
            model.column[term] = k
        rows = halves(once, max_labelled).collect()  # at most max_labelled rows of candidate ids
        made = [(model.vector(np.array(r.found, int), np.array(r.times, float)), r) for r in rows]
        # examples that share their heaviest term lie in the same blocks
        made.sort(key=lambda x: (int(x[0][0][np.argmax(x[0][1])]), x[1].label_id))
        vectors = [v for v, _ in made]
        model.ids = np.array([r.label_id for _, r in made])
        model.toxic = np.array([r.toxic for _, r in made], float)
        model.index(vectors)
        ones = float(model.toxic.sum())
        model.calibrate(vectors, (n0 / (len(rows) - ones), n1 / ones))
    discard(once)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the text, with held_out, score, predicted, the nearest examples and the evidence terms."""
    taught = teaching(labels, id_col, label_col)
    seeds = halves(taught, max_labelled)
    candidates = find_candidates(docs, seeds, id_col, text_col)
    read, names = narrow(docs, candidates, id_col, text_col)
    read = materialize(read, "read-texts")
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(read, names, candidates, taught, id_col, max_labelled))
    own = others(docs, text_col, "held_out", "score", "predicted", "nearest", "evidence")
    held_out = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0) & F.col(id_col).isNotNull()
    ready = read.select(*own, held_out.alias("held_out"), *names[:2])
    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("nearest", T.StringType()), T.StructField("evidence", T.StringType())]
    out = T.StructType([*ready.schema.fields[:-2], *more])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, int)
        empty = model.value.score(none, none)
        for whole in batches:
            for batch in slices(whole, 1024):
                got = []
                for found, times in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                    f = found.values.to_numpy()
                    got.append(model.value.score(f, times.values.to_numpy()) if (model.value.column[f] >= 0).any() else empty)
                score = np.array([s for s, _, _ in got])
                cols = [*batch.columns[:-2], pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([x for _, x, _ in got], pa.string()), pa.array([x for *_, x in got], pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(cols, schema)], schema=schema)

    return ready.mapInArrow(run, out)
