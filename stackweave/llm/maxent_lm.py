"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) is a product over classes within classes: the ``KNOWN`` most frequent words, and one leaf for all rarer
ones, are the leaves of a ``WIDTH``-way tree balanced by frequency, and each step down the tree is a softmax over the
branches of one node. So every known word is chosen by its history, a frequent one in one or two steps. Within the leaf of
rarer words the add-one unigram distribution holds. Softmaxes are log-linear in a bias of the node and in hashed features:
node with last word (an n-gram feature) and node with the word before the last (a skip feature).

Counts cover every training text. The tree, the vocabulary and the table of hashed rows grow with the distinct tokens of
the corpus, up to ``KNOWN`` words and ``MOST_ROWS`` rows, so what is broadcast stays bounded (8 MB of weights). Weights come
from rounds of distributed gradient updates: a round's texts are one of ``ROUNDS`` disjoint parts of the training fold, so
that all of it is used once; a round's texts are dealt to shards, as many as their tokens ask for, by a hash of id and text,
and lie there in the order of that hash, so files, partitions and cores don't change what is learnt. Every shard
runs Adagrad steps from the round's weights over its texts, in sparse numpy batches, and passes on the rows that it changed;
changes of a row are averaged in three levels, each shard weighing as much as its squared gradients of that row. Scoring
broadcasts the weights and the known words; rarer words are looked up by a join.

Defined results: a null text is empty and has the end token alone; rows with a null doc_id train (their id text is empty);
repeated rows come back once each; without training texts N = V = 0 and every token has the probability 1; an empty table
gives no rows; other columns pass through, but for those named like a column of the result, which are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, materialize, others, slices

WIDTH = 16  # branches of a node
KNOWN = 65_536
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 17  # of hashed features
ROUNDS = 2
STEP_TOKENS = 8192
RATE, SHARE = 0.25, np.float32(0.3)
SHARD_TOKENS, LEAST_SHARD_TOKENS, FEW = 8_000_000, 1_000_000, 8  # that a shard trains on in a round; up to FEW shards are smaller
PART_TOKENS = 400_000  # distinct tokens that a task holds before it passes its counts on
BLOCK_ROWS = 4096  # rows of the table that are merged together
NEVER = -1e4  # logit of a branch that leads nowhere
FURTHEST = 60.0  # from 0 that a logit counts
END = b""  # the end token: no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words between space and 09-0D, lower-cased A-Z, then the end."""
    found = text.encode().lower().split() if text else []  # bytes: A-Z and the named spaces only
    found.append(END)
    return found


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def count_tokens(texts: DataFrame) -> DataFrame:
    """text -> token, c: tasks add up what they can hold, then counts merge by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
            held.clear()
            return out

        for whole in batches:
            for batch in slices(whole, 512):
                for text in batch.column(0).to_pylist():
                    for t in tokens(text):
                        held[t] = held.get(t, 0) + 1
                if len(held) > PART_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def balanced_tree(weights: list[float]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The tree of least mean depth over leaves of such weights: (logarithms of the weights of every node's branches, the
    way to each leaf as (node, branch) from the root on)."""
    n = len(weights)
    spare = WIDTH - 1 if n == 1 else -(n - 1) % (WIDTH - 1)
    heap = [(0.0, -1 - k) for k in range(spare)] + [(w, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    children: dict[int, list[tuple[float, int]]] = {}
    while len(heap) > 1:
        least = [heapq.heappop(heap) for _ in range(WIDTH)]
        children[n + len(children)] = least
        heapq.heappush(heap, (sum(w for w, _ in least), n + len(children) - 1))
    ways: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    bias = []
    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
    while todo:
        node, way = todo.pop()
        number, row = len(bias), np.full(WIDTH, NEVER)
        bias.append(row)
        for branch, (w, child) in enumerate(children[node]):
            if child >= 0:
                row[branch] = np.log(w)
                if child < n:
                    ways[child] = [*way, (number, branch)]
                else:
                    todo.append((child, [*way, (number, branch)]))
        row -= row.max()
    return np.array(bias, dtype=np.float32), ways


class Vocabulary:
    """The most frequent words by falling count, their ranks and counts, and their ways down the tree; the last way is that
    of all rarer words."""

    def __init__(self, rows: list[tuple[bytes, int]], total: int, distinct: int):
        self.rank = {t: k for k, (t, _) in enumerate(rows)}
        self.counts = np.array([*(c for _, c in rows), 0], dtype=np.int64)
        self.total, self.distinct = total, distinct
        self.tail = total - int(self.counts.sum()) + distinct - len(rows) + 1
        self.bias, ways = balanced_tree([*(float(c) for _, c in rows), float(self.tail)])
        self.depth = np.array([len(w) for w in ways], dtype=np.int64)
        self.first = np.cumsum(self.depth) - self.depth
        self.nodes, self.branches = np.array([step for way in ways for step in way], dtype=np.int64).reshape(-1, 2).T.copy()
        self.rows = int(min(max(1 << max(distinct // 2, 1).bit_length(), LEAST_ROWS), MOST_ROWS))

    def ids(self, found: list[bytes]) -> np.ndarray:
        """Ranks; those of rarer words are -1."""
        get = self.rank.get
        return np.fromiter((get(t, -1) for t in found), dtype=np.int64, count=len(found))

    def start_weights(self) -> np.ndarray:
        """A row for each node, which holds the unigram distribution, then the hashed rows."""
        blocks = -(-(len(self.bias) + self.rows) // BLOCK_ROWS)
        w = np.zeros((blocks * BLOCK_ROWS, WIDTH), dtype=np.float32)
        w[: len(self.bias)] = self.bias
        return w


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        h = (h ^ np.atleast_1d(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def histories(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: its leaf, and hashes of the last word and of the word before it; beyond a text's start there is none."""
    leaf = np.where(ids >= 0, ids, -1)
    before, skip = np.empty_like(leaf), np.empty_like(leaf)
    before[1:], before[:1] = leaf[:-1], -2
    skip[2:], skip[:2] = leaf[:-2], -2
    before[starts] = -2
    skip[starts] = -2
    later = starts + 1
    skip[later[later < len(skip)]] = -2
    return leaf, hashed(5, before + 2), hashed(7, skip + 2)


def steps(v: Vocabulary, leaf: np.ndarray, before: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All steps down the tree to the leaves: where each leaf's begin, the branches taken, and the rows of their features."""
    depth = v.depth[leaf]
    begin = np.cumsum(depth) - depth
    token = np.repeat(np.arange(len(leaf)), depth)
    at = v.first[leaf][token] + np.arange(len(token)) - begin[token]
    node = v.nodes[at]
    row = lambda h: (hashed(h[token], node) & np.uint64(v.rows - 1)).astype(np.int64) + len(v.bias)
    return begin, v.branches[at], [node, row(before), row(skip)]


def logits(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of the features' rows, within what a float's exponential can hold; biases have 0 as their largest."""
    z = table.take(rows[0], axis=0)
    for of_feature in rows[1:]:
        z += table.take(of_feature, axis=0)
    return np.clip(z, -FURTHEST, FURTHEST, out=z)


ONES = np.ones(WIDTH, dtype=np.float32)


def log_probability(table: np.ndarray, rows: list[np.ndarray], branch: np.ndarray) -> np.ndarray:
    z = logits(table, rows)
    own = z[np.arange(len(z)), branch]
    np.exp(z, out=z)
    return own - np.log(z @ ONES)


def learn(table: np.ndarray, squares: np.ndarray, rows: list[np.ndarray], branch: np.ndarray) -> None:
    """One Adagrad step on the rows' features, with one rate for each row: squares has 1 + ``SHARE`` times its squared gradients."""
    gradient = logits(table, rows)
    np.exp(gradient, out=gradient)
    gradient /= (gradient @ ONES)[:, None]
    gradient[np.arange(len(branch)), branch] -= 1
    of_branch = np.ascontiguousarray(gradient.T, dtype=np.float64)
    for of_feature in rows:
        keys = np.sort((of_feature << 32) | np.arange(len(of_feature)))
        order, at = keys & 0xFFFFFFFF, keys >> 32
        new = np.diff(at, prepend=-1) != 0
        place = np.empty(len(at), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        at = at[new]
        g = np.empty((len(at), WIDTH), dtype=np.float32)
        for k in range(WIDTH):
            g[:, k] = np.bincount(place, of_branch[k], len(at))
        seen = squares[at] + SHARE * np.einsum("ij,ij->i", g, g)
        squares[at] = seen
        g *= (RATE / np.sqrt(seen))[:, None]
        table[at] = table.take(at, axis=0) - g


def stretches(texts: Iterator[list[str | None]], vocabulary: Vocabulary, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token ids of whole texts, some texts together, with the texts' starts."""
    held: list[np.ndarray] = []
    n = 0
    for some in texts:
        for text in some:
            held.append(vocabulary.ids(tokens(text)))
            n += len(held[-1])
            if n >= size:
                yield np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
                held, n = [], 0
    if held:
        yield np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]


def in_parts(v: Vocabulary, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``steps`` of at most STEP_TOKENS tokens at once, in order."""
    leaf, before, skip = histories(ids, starts)
    for a in range(0, len(ids), STEP_TOKENS):
        some = slice(a, a + STEP_TOKENS)
        yield steps(v, leaf[some], before[some], skip[some])


CHANGES = "part int, block int, rows binary, mass binary, change binary"


def train_round(texts: DataFrame, vocabulary, weights: np.ndarray) -> np.ndarray:
    """The weights after the steps of all shards of texts(shard, place, text)."""
    start = texts.sparkSession.sparkContext.broadcast(weights)

    def run(shard: pa.Table) -> pa.Table:
        v, w, squares = vocabulary.value, start.value.copy(), np.ones(len(start.value), dtype=np.float32)
        ordered = shard.take(pc.sort_indices(shard, [("place", "ascending"), ("text", "ascending")])).column("text")
        texts_of = (ordered.slice(k, 256).to_pylist() for k in range(0, len(ordered), 256))
        for ids, starts in stretches(texts_of, v, STEP_TOKENS):
            for _, branch, rows in in_parts(v, ids, starts):
                learn(w, squares, rows, branch)
        w -= start.value
        mass, part = squares - 1, shard.column("shard")[0].as_py() // 16
        found = {n: [] for n in ("part", "block", "rows", "mass", "change")}
        for block in range(len(w) // BLOCK_ROWS):
            of = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
            changed = np.flatnonzero(mass[of] > 0)
            if len(changed):
                for n, value in zip(found, (part, block, changed.astype(np.int32).tobytes(), mass[of][changed].tobytes(), w[of][changed].tobytes())):
                    found[n].append(value)
        return pa.table([pa.array(c, t) for c, t in zip(found.values(), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=list(found))

    def merged(some: pd.DataFrame) -> pd.DataFrame:
        """Means of each row's changes, weighted by their squared gradients."""
        mass, change = np.zeros(BLOCK_ROWS, np.float64), np.zeros((BLOCK_ROWS, WIDTH), np.float64)
        for r, m, c in sorted(zip(some["rows"], some["mass"], some["change"]), key=lambda x: bytes(x[1])):
            at, m = np.frombuffer(r, np.int32), np.frombuffer(m, np.float32).astype(np.float64)
            mass[at] += m
            change[at] += m[:, None] * np.frombuffer(c, np.float32).reshape(-1, WIDTH)
        at = np.flatnonzero(mass > 0)
        cols = [at.astype(np.int32), mass[at].astype(np.float32), (change[at] / mass[at, None]).astype(np.float32)]
        return pd.DataFrame({"part": [int(some["part"].iloc[0]) // 16], "block": [int(some["block"].iloc[0])], **{n: [c.tobytes()] for n, c in zip(("rows", "mass", "change"), cols)}})

    changes = texts.groupBy("shard").applyInArrow(run, CHANGES)
    # shards by sixteens, these by sixteens again, then the rest: no group is larger than the shards' 256th part
    for _ in range(2):
        changes = changes.groupBy("part", "block").applyInPandas(merged, CHANGES)
    last = changes.groupBy("block").applyInPandas(merged, CHANGES)
    out = weights.copy()
    for row in last.select("block", "rows", "change").toLocalIterator():  # the table, of bounded size
        out[row.block * BLOCK_ROWS + np.frombuffer(row.rows, np.int32)] += np.frombuffer(row.change, np.float32).reshape(-1, WIDTH)
    return out


LOG10 = float(np.log(10))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """The table of token counts, the vocabulary and the weights, from the rows that aren't held out."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(id_col))
    counts = materialize(count_tokens(training.select(text_col)), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "token").limit(KNOWN)  # KNOWN rows
    vocabulary = Vocabulary([(bytes(r.token), r.c) for r in top.toLocalIterator()], total, distinct)
    words = spark.sparkContext.broadcast(vocabulary)
    weights = vocabulary.start_weights()
    part = F.pmod(F.xxhash64(F.lit("round"), F.col(id_col)), F.lit(max(rounds, 1)))
    n = total / max(rounds, 1)
    shards = int(max(n // SHARD_TOKENS, min(FEW, n // LEAST_SHARD_TOKENS))) + 1
    place = F.xxhash64(F.col(id_col), F.col(text_col))
    dealt = training.select(F.pmod(F.xxhash64(place), F.lit(shards)).cast("int").alias("shard"), place.alias("place"), F.col(text_col).alias("text"), part.alias("round"))
    for k in range(rounds if total else 0):
        weights = train_round(dealt.filter(F.col("round") == k).drop("round"), words, weights)
    return counts, vocabulary, weights


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without the text, with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    vocabulary_table, vocabulary, weights = train(docs, id_col=id_col, text_col=text_col, rounds=rounds)
    total, distinct = vocabulary.total, vocabulary.distinct
    words = spark.sparkContext.broadcast(vocabulary)
    model = spark.sparkContext.broadcast(weights)

    own = others(docs, text_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    whole_text, rares, row_id = fresh(docs, "whole_text", "rares", "row_id")
    base_sum, model_sum, known_sum, found_sum, logs_sum = fresh(docs, "base_sum", "model_sum", "known_sum", "found_sum", "logs_sum")
    ready = docs.select(*own, held_out(id_col).alias("held_out"), F.col(text_col).alias(whole_text))
    rare = T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())]))
    more = [("n_tokens", T.LongType()), (known_sum, T.LongType()), (base_sum, T.DoubleType()), (model_sum, T.DoubleType()), (rares, rare)]
    out = T.StructType([*ready.schema.fields[:-1], *(T.StructField(n, t) for n, t in more)])
    schema = to_arrow_schema(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = words.value, model.value
        log_count = np.log10(v.counts + 1.0)
        for whole in batches:
            for batch in slices(whole, 64):
                found = [tokens(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                if not found:
                    continue
                lengths = np.array(list(map(len, found)))
                starts = np.cumsum([0, *lengths])[:-1]
                ids = v.ids([t for f in found for t in f])
                p = np.concatenate([np.add.reduceat(log_probability(w, rows, branch).astype(np.float64), begin) for begin, branch, rows in in_parts(v, ids, starts)]) / LOG10
                base = log_count[ids]  # a rarer word's count is added by the join
                p[ids < 0] -= np.log10(v.tail)
                sums = [np.add.reduceat(x, starts) for x in (base, p, (ids >= 0).astype(np.int64))]
                unknown = []
                for f, a, n in zip(found, starts, lengths):
                    counts: dict[bytes, int] = {}
                    for k in np.flatnonzero(ids[a : a + n] < 0):
                        counts[f[k]] = counts.get(f[k], 0) + 1
                    unknown.append([{"token": t, "n": c} for t, c in counts.items()])
                cols = [*batch.columns[:-1], pa.array(lengths, pa.int64()), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), pa.array(unknown, schema.field(rares).type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    scored = materialize(ready.mapInArrow(score, out).withColumn(row_id, F.monotonically_increasing_id()), "scored")
    each = scored.select(F.col(row_id).alias("row"), F.explode(rares).alias("r")).select("row", F.col("r.token").alias("token"), F.col("r.n").alias("n"))
    # a word beyond the known ones has less than a share of 1 / KNOWN of the training tokens
    of_row = each.join(vocabulary_table, "token").groupBy("row").agg(F.sum("n").alias("found"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    of_row = of_row.select(F.col("row").alias(row_id), F.col("found").alias(found_sum), F.col("logs").alias(logs_sum))
    result = scored.join(of_row, row_id, "left")
    logs, known = F.coalesce(logs_sum, F.lit(0.0)), F.col(known_sum) + F.coalesce(found_sum, F.lit(0))
    denominator = float(np.log10(total + distinct + 1))
    return result.select(*own, "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col(base_sum) + logs - F.col("n_tokens") * denominator).alias("base_score"), (F.col(model_sum) + logs).alias("score"))
