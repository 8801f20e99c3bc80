"""Conversation structure repair: the cheapest edits by bidirectional Dijkstra over the edit lattice.

Rows are damaged by a hash of conversation and turn, equal rows of a turn are counted together before the shuffle, and a row
whose role and text an earlier turn has is marked by a join with the first turn of each role and text. The rows are then dealt by ranges of (conversation, turn, role,
text), so a long conversation spreads over tasks. A task cuts its rows into fragments of one conversation and at most
``FRAGMENT`` rows. Nodes of a fragment's lattice are (rows done, roles so far: none, s, u or a); edits are its edges. From
each start a forward heap and, from each end, a reverse heap run towards each other until no crossing can be cheaper or
equal; of all crossings of least cost the least concatenated audit counts. Conversations inside a task are solved there.
Of those at a task's edges, which others may share, the fragments with their solutions for all starts and ends go on by
conversation and are joined in order: audits of equal cost and ends never begin with one another, so the least of a join is the join
of the least. Memory there is one fragment, and for each end an audit and a hash in progress.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an empty turn of
user or assistant 5; a truncated row that isn't deleted adds 5. Roles so far are initials of roles as they stand, in either
case as written; a role that begins otherwise than with s, u, a can't be kept.

Defined results: a null conv_id is a conversation of its own, a null turn comes first; in the hashed key and in roles and
texts a null is one space; rows of one turn are taken by role, then text, as damaged; repeated rows are repeated rows of the
turn; an empty role can't be kept; a conversation without rows after damage has zeros, an empty audit and the empty
string's hash; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize

FRAGMENT = 512
FRAGMENT_CHARS = 1 << 22
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Roles so far (none, s, u, a) by the next initial.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
STATES = (0, 1, 2, 3)
BLANK_CHARS = r"[^\x20\x09-\x0D]"
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

Row = tuple[str, str]  # initial of the role, fault: '' or b(lank), d(uplicate), t(runcated)
Best = tuple[int, str]  # cost, audit


def edits(rows: list[Row]) -> list[list[list[tuple[int, int, int, str]]]]:
    """For each node (rows done, state) its edges: rows done, state, cost, letter."""
    out = []
    for i in range(len(rows) + 1):
        per_state = []
        for state in STATES:
            edges = [(i, to, INSERT, "I") for role, to in NEXT[state].items() if role in ROLES]
            if i < len(rows):
                initial, fault = rows[i]
                edges.append((i + 1, state, DELETE, "D"))
                if fault not in ("b", "d"):
                    more = CUT_SHORT if fault == "t" else 0
                    for role, to in NEXT[state].items():
                        if role == initial:
                            edges.append((i + 1, to, KEEP + more, "K"))
                        elif role in ROLES:
                            edges.append((i + 1, to, REROLE + more, "R"))
            per_state.append(edges)
        out.append(per_state)
    return out


def least(rows: list[Row], start: int, ends: tuple[int, ...]) -> Best | None:
    """The cheapest edits from ``start`` to one of ``ends``, with the least audit."""
    ahead = edits(rows)
    back: dict[tuple[int, int], list[tuple[int, int, int, str]]] = {}
    for i, per_state in enumerate(ahead):
        for state, edges in enumerate(per_state):
            for to_i, to_s, cost, letter in edges:
                back.setdefault((to_i, to_s), []).append((i, state, cost, letter))
    n = len(rows)
    # of equal costs, nodes with fewer rows done come first ahead, those with more come first in reverse: so what an edge
    # of no cost leads to is final when it is reached
    sides = [{(0, start): (0, "")}, {(n, end): (0, "") for end in ends}]
    heaps = [[(0, 0, start)], [(0, -n, end) for end in ends]]
    heapq.heapify(heaps[1])
    final: list[dict[tuple[int, int], Best]] = [{}, {}]
    best: int | None = 0 if (0, start) in sides[1] else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, place, state = heapq.heappop(heaps[side])
        node = (abs(place), state)
        if node in final[side] or sides[side][node][0] < cost:
            continue
        mine = final[side][node] = sides[side][node]
        edges = ahead[node[0]][state] if side == 0 else back.get(node, [])
        for i, s, step, letter in edges:
            to, audit = (i, s), mine[1] + letter if side == 0 else letter + mine[1]
            if to not in final[side] and (to not in sides[side] or (cost + step, audit) < sides[side][to]):
                sides[side][to] = (cost + step, audit)
                heapq.heappush(heaps[side], (cost + step, i if side == 0 else -i, s))
                if to in sides[1 - side]:
                    total = cost + step + sides[1 - side][to][0]
                    best = total if best is None else min(best, total)
    # every cheapest path has a node that is final on one side and next to a final one on the other
    crossings = [(f[0] + sides[1][node][0], f[1] + sides[1][node][1]) for node, f in sides[0].items() if node in sides[1]]
    return min(crossings) if crossings else None


def repaired(rows: list[Row], texts: list[tuple[str, str]], audit: str, start: int) -> Iterator[str]:
    """The lines that an audit leaves, from a state."""
    k, state = 0, start
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        if letter == "K":
            role, text = texts[k]
            state = NEXT[state][rows[k][0]]
        else:
            initial = next(r for r in NEXT[state] if r in ROLES)
            role, text = ROLES[initial], "" if letter == "I" else texts[k][1]
            state = NEXT[state][initial]
        k += letter != "I"
        yield f"{role}:{text}"


def end_state(rows: list[Row], audit: str, start: int) -> int:
    k, state = 0, start
    for letter in audit:
        if letter != "D":
            state = NEXT[state][rows[k][0] if letter == "K" else next(r for r in NEXT[state] if r in ROLES)]
        k += letter != "I"
    return state


@dataclass
class Fragment:
    """Rows of one conversation that lie together, and their turns."""

    rows: list[Row] = field(default_factory=list)
    texts: list[tuple[str, str]] = field(default_factory=list)
    chars: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.rows.append((role[:1], fault))
        self.texts.append((role, text))
        self.chars += len(role) + len(text)
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1


@dataclass
class Joined:
    """What is known of a conversation's fragments so far."""

    best: dict[int, tuple[int, str, object, bool]]  # by state: cost, audit, hash in progress, whether it has a line
    counts: dict[str, int] = field(default_factory=lambda: dict(b=0, d=0, t=0, illegal=0))
    initial: str | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0

    @staticmethod
    def new() -> Joined:
        return Joined({0: (0, "", hashlib.sha256(), False)})

    def take(self, f: Fragment, solved: dict[tuple[int, int], Best]) -> None:
        found: dict[int, tuple[int, str, int, str]] = {}
        for start, (cost, audit, _, _) in self.best.items():
            for end in STATES:
                if (start, end) in solved:
                    more, tail = solved[start, end]
                    option = (cost + more, audit + tail, start, tail)
                    if end not in found or option[:2] < found[end][:2]:
                        found[end] = option
        new = {}
        for end, (cost, audit, start, tail) in found.items():
            _, _, before, some = self.best[start]
            digest = before.copy()
            for line in repaired(f.rows, f.texts, tail, start):
                digest.update(("\n" if some else "").encode() + line.encode("utf-8", "surrogatepass"))
                some = True
            new[end] = (cost, audit, digest, some)
        self.best = new
        for initial, fault in f.rows:
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.initial = initial
        if f.first_turn is not None:
            self.turns += f.turns - (f.first_turn == self.last_turn)
            self.first_turn = f.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = f.last_turn

    def result(self) -> tuple:
        cost, audit, digest, _ = min((self.best[e] for e in ENDS if e in self.best), key=lambda b: b[:2])
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.counts["illegal"], cost, audit, digest.hexdigest()


def solve(f: Fragment, starts: tuple[int, ...], ends: tuple[int, ...]) -> dict[tuple[int, int], Best]:
    return {(s, e): b for s in starts for e in ends if (b := least(f.rows, s, (e,))) is not None}


def damaged(conversations: DataFrame, id_col: str) -> DataFrame:
    """Equal rows of a turn once, with ``times`` (0 for what is dropped) and whether their role and text came in an earlier turn."""
    c = conversations.select(F.col(id_col).alias("conv"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x), F.lit(" ")).alias(x) for x in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = c.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))
    rows = rows.withColumn("role", F.when(F.col("times") == 0, "").otherwise(F.col("role"))).withColumn("text", F.when(F.col("times") == 0, "").otherwise(F.col("text")))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = rows.withColumn("digest", F.when(F.col("times") > 0, F.sha2("text", 256)))
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    firsts = rows.filter("times > 0").groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("first"))
    met = rows.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return met.select("conv", "turn", "role", "text", "times", F.coalesce(F.col("first") < order, F.lit(False)).alias("seen"))


def fault_of(text: str, seen: bool) -> str:
    last = LAST.search(text)
    return "b" if last is None else "d" if seen else "" if last[1] in ".!?" else "t"


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, list[Fragment] | Iterator[Fragment]]]:
    """Yields (conversation, None or fragment) in order; None begins a conversation."""
    current, fragment, begun = None, Fragment(), False
    for batch in batches:
        for conv, turn, role, text, times, seen in zip(*(column.to_pylist() for column in batch.columns)):
            if not begun or conv != current:
                if begun and fragment.rows:
                    yield current, fragment
                current, fragment, begun = conv, Fragment(), True
                yield conv, None
            for copy in range(times):
                if len(fragment.rows) >= FRAGMENT or fragment.chars >= FRAGMENT_CHARS:
                    yield current, fragment
                    fragment = Fragment()
                fault = fault_of(text, seen or copy > 0)
                fragment.add(turn, role, text, fault)
    if begun and fragment.rows:
        yield current, fragment


RESULT = [("gaps", T.LongType()), ("blank", T.LongType()), ("duplicate", T.LongType()), ("truncated", T.LongType()), ("illegal", T.LongType()), ("cost", T.LongType()), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
PARTS = "task int, place int, rows array<struct<initial:string,fault:string>>, texts array<struct<role:string,text:string>>, first_turn long, last_turn long, turns int, solved array<struct<start:int,end:int,cost:long,audit:string>>"


def repair(conversations: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation."""
    spark = conversations.sparkSession
    dealt = damaged(conversations, id_col)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text"]
    dealt = dealt.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    results = T.StructType([T.StructField("conv", conversations.schema[id_col].dataType), *[T.StructField(*r) for r in RESULT]])
    both = T.StructType([*results.fields, *T._parse_datatype_string(PARTS).fields])
    schema, last = to_arrow_schema(both), len(RESULT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out = TaskContext.get().partitionId(), []

        def cut(force: bool) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 256):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in out], schema=schema)
                out.clear()

        def part(conv, place: int, f: Fragment) -> tuple:
            solved = [dict(start=s, end=e, cost=c, audit=a) for (s, e), (c, a) in solve(f, STATES, STATES).items()]
            rows = [dict(initial=i, fault=x) for i, x in f.rows]
            return (conv, *[None] * last, task, place, rows, [dict(role=r, text=t) for r, t in f.texts], f.first_turn, f.last_turn, f.turns, solved)

        # the first and the last conversation of a task may go on in others: their fragments are passed on. One conversation
        # is held back until the next begins; a long one is passed on as it comes
        number, place, conv, held, passed = 0, 0, None, [], False

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            nonlocal place
            if edge or passed:
                for f in held or ([] if passed else [Fragment()]):
                    out.append(part(conv, place, f))
                    place += 1
                    yield from cut(False)
            else:
                joined = Joined.new()
                for f in held:
                    b = least(f.rows, 0, ENDS)
                    joined.take(f, {(0, end_state(f.rows, b[1], 0)): b})
                out.append((conv, *joined.result(), *[None] * (len(both) - last - 1)))
            held.clear()
            yield from cut(False)

        for key, f in runs(batches):
            if f is None:
                if number:
                    yield from close(number == 1)
                number, conv, passed = number + 1, key, False
            else:
                held.append(f)
                if len(held) > 1:  # longer than a fragment
                    yield from close(True)
                    passed = True
        if number:
            yield from close(True)
        yield from cut(True)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, joined, begun, done = None, None, False, []
        names = to_arrow_schema(results)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if not begun or row["conv"] != current:
                    if begun:
                        done.append((current, *joined.result()))
                    current, joined, begun = row["conv"], Joined.new(), True
                if row["rows"]:
                    f = Fragment([(r["initial"], r["fault"]) for r in row["rows"]], [(r["role"], r["text"]) for r in row["texts"]], 0, row["first_turn"], row["last_turn"], row["turns"])
                    joined.take(f, {(s["start"], s["end"]): (s["cost"], s["audit"]) for s in row["solved"]})
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, x)) for x in done], schema=names)
            done.clear()
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, (current, *joined.result())))], schema=names)

    found = materialize(dealt.mapInArrow(work, both), "repairs")
    edges = found.filter("task is not null").repartition("conv").sortWithinPartitions("conv", "task", "place")
    whole = found.filter("task is null").select(*results.names)
    return whole.unionByName(edges.mapInArrow(join, results)).withColumnRenamed("conv", id_col)
