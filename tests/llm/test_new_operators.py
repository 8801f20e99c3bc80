"""Whitening against numpy and planted cases, conversation repair against a plain search, toxicity against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stackweave.llm import conversation_repair, toxicity, whitening

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
WS = " \t\n\r\x0b\x0c"


# --- conversation repair -------------------------------------------------------------------------------------------


def damage(rows):
    """rows: (conv, turn, role, text); what is left of each conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def plain(rows):
    """A forward table over (rows done, roles so far as text), least cost and then least audit."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(WS)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    states = {"": (0, "", ())}

    def better(into, state, option):
        if state not in into or option[:2] < into[state][:2]:
            into[state] = option

    def insert(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for r in follow[state]:
                    if r != "s":
                        better(states, r, (cost + 5, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[r])))
        return states

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in insert(states).items():
            better(new, state, (cost + 2, audit + "D", lines))
            if fault not in ("b", "d"):
                more = 5 if fault == "t" else 0
                for r in follow[state]:
                    if role[:1] == r:
                        better(new, r, (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                    elif r != "s":
                        better(new, r, (cost + more + 1, audit + "R", (*lines, {"u": "user", "a": "assistant"}[r] + ":" + text)))
        states = new
    cost, audit, lines = min((v for k, v in insert(states).items() if k in ("", "a")), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SHAPE = "conv_id long, turn long, role string, text string"


def repaired(df):
    got = conversation_repair.repair(df).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


def test_repair_of_given_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert repaired(df) == {c: plain(v) for c, v in damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]).items()}


def test_repair_of_odd_conversations(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "sudo", "User"], ["Hi.", "ok", " ", "", None, "a!\n", "Why? ", "x ", "é.", "a:b\nc."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles if c % 3 else roles[:3]), rng.choice(texts)) for c in range(120) for _ in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Null."), (500, 2, "user", "Alone."), (501, None, None, None)] + [(502, 7, "user", "Same.")] * 40
    df = spark.createDataFrame(rows, SHAPE).repartition(7)
    want = {c: plain(v) for c, v in damage(rows).items()}
    assert repaired(df) == want
    clash = df.withColumnRenamed("conv_id", "Conv").selectExpr("Conv as conv_id", "turn", "role", "text", "1 as digest", "2 as conv", "3 as times")
    assert repaired(clash) == want
    assert repaired(spark.createDataFrame([], SHAPE)) == {}


def test_repair_of_a_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Line {t}.", "cut", f"cut {t}"])) for t in range(3000)] + [(2, 0, "user", "Hi.")]
    want = {c: plain(v) for c, v in damage(rows).items()}
    assert repaired(spark.createDataFrame(rows, SHAPE)) == want


@pytest.mark.parametrize("seed", range(40))
def test_searches_from_both_ends_meet_in_the_least_audit(seed):
    rng = random.Random(seed)
    rows = [(rng.choice("suat"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randrange(0, 6))]
    for start, end in itertools.product(conversation_repair.STATES, repeat=2):
        found = []

        def walk(node, cost, audit, edges=conversation_repair.edits(rows)):
            if node == (len(rows), end):
                found.append((cost, audit))
            for i, s, step, letter in edges[node[0]][node[1]]:
                if letter != "I" or audit[-2:] != "II":
                    walk((i, s), cost + step, audit + letter)

        walk((0, start), 0, "")
        assert conversation_repair.least(rows, start, (end,)) == (min(found) if found else None)


# --- whitening -----------------------------------------------------------------------------------------------------


def by_hand(vectors):
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, n, s, values[::-1], axes[:, ::-1]


def test_whitening_equals_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(df).toPandas()
    source = df.toPandas()
    x, n, s, values, axes = by_hand(np.stack(source.embedding))
    assert (got.n == n).all() and got.identity_error.max() < 1e-9 and len(got) == 8 * n
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[source.vec_id].to_numpy()
    want = (x - s / n) @ axes[:, :8] / np.sqrt(values[:8])
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-9)
    assert (got[got.component == 3].set_index("vec_id").deviation.loc[source.vec_id].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [3.0, -1.0, 0.5]), (3, [2.0, 2.0, 0.5]), (3, [2.0, 2.0, 0.5]), (4, None), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [None, 1.0, 1.0]), (8, [1.0]), (None, [0.0, 0.0, 0.5]), (9, [])]
    shape = "vec_id long, embedding array<double>, w int, vector int"
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 2) for r in rows], shape)).toPandas()
    assert len(got) == 15 and set(got.component) == {1, 2, 3} and got.n.iloc[0] == 5
    assert got[got.component == 3].whitened.isna().all() and (got[got.component == 3].explained == 0).all()  # no variance
    assert got[got.component < 3].whitened.notna().all() and got.identity_error.max() < 1e-9
    same = whitening.whiten(spark.createDataFrame([(k, [1.0, 1.0], 1, 2) for k in range(3)], shape)).toPandas()
    assert same.whitened.isna().all() and same.explained.isna().all() and (same.deviation == 0).all() and (same.identity_error == 0).all()
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, 2)], shape)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, -1e300], 1, 2), (2, [1e12, -3e12], 1, 2), (3, [-1e300, 5.0], 1, 2)], shape)).toPandas()
    assert len(huge) == 6 and huge[huge.vec_id == 1].deviation.isna().all() and huge.identity_error.max() < 1e-4


def test_polynomial_is_exact_and_repeated_roots_give_orthogonal_components(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-1000, 1000, (9, 5)).astype(object)
    m = (a.T @ a).tolist()
    poly = whitening.characteristic(spark, m)
    for t in range(-3, 4):  # against exact elimination of t - m
        rest = [[Fraction((t if i == j else 0) - m[i][j]) for j in range(5)] for i in range(5)]
        det = Fraction(1)
        for k in range(5):
            det *= rest[k][k]
            for i in range(k + 1, 5):
                f = rest[i][k] / rest[k][k]
                rest[i] = [x - f * y for x, y in zip(rest[i], rest[k])]
        assert det == sum(c * t**k for k, c in enumerate(poly))
    roots = whitening.largest_roots([576, -496, 156, -21, 1], 4)  # (t - 4) ** 3 (t - 9)
    assert [(float(r), k) for r, k in roots] == [(9.0, 1), (4.0, 3)]
    vectors = np.array(whitening.null_vectors([[4, 0, 0], [0, 9, 0], [0, 0, 4]], roots[1][0], 2), dtype=float) / 2.0**whitening.BITS
    assert np.allclose(vectors @ vectors.T, np.eye(2)) and np.allclose(vectors[:, 1], 0)


def test_limbs_hold_whole_longs():
    x = np.array([[0, -1, 1 << 62], [-(1 << 63), (1 << 63) - 1, 123456]])
    total = sum(part.astype(np.int64).astype(object) * (1 << (whitening.LIMB * k)) for k, part in enumerate(whitening.limbs(x)))
    assert (total == x.astype(object)).all()


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs.select("doc_id", "text"), labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = got.toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.95 and ((held.predicted == 1) & (held.toxic == 0)).sum() <= 1


def test_block_index_equals_brute_force():
    rng = np.random.default_rng(2)
    terms, n = 40, 300
    model = toxicity.Model(np.arange(terms), rng.uniform(1, 9, terms), np.arange(n), rng.integers(0, 2, n).astype(float))
    model.names = [str(k) for k in range(terms)]
    texts = [np.sort(rng.choice(terms, rng.integers(0, 6), replace=False)) for _ in range(n)]
    vectors = [model.vector(t, rng.integers(1, 5, len(t)).astype(float)) for t in texts]
    model.index(vectors)
    dense = np.zeros((n, terms + 1))
    for k, (rows, w) in enumerate(vectors):
        dense[k, rows] = w
    for k in range(0, n, 7):
        cos = np.round(dense @ dense[k], 9)
        cut = np.sort(cos)[-toxicity.NEIGHBOURS]
        at, got = model.nearest(*vectors[k])
        assert set(at) == set(np.nonzero(cos >= cut)[0]) and np.allclose(np.sort(got), np.sort(cos[cos >= cut]))


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(1)
    some = lambda: " ".join("".join(rng.choices("aeioulmnrst", k=6)) for _ in range(12))
    bad = [(k, f"{some()} you utter grumblefex {some()}") for k in range(60)]
    good = [(100 + k, f"{some()} a calm note about gardens {some()}") for k in range(200)]
    docs = [*bad, *good, (900, None), (901, ""), (902, "x" * 3_000_000), (903, "word " * 400_000 + "grumblefex"), (None, "no id"), (904, bad[0][1]), (904, bad[0][1])]
    shape = "doc_id long, text string, score int, Toxic string, signature int"
    df = spark.createDataFrame([(*d, 5, "x", 7) for d in docs], shape)
    labels = spark.createDataFrame([(k, 1) for k, _ in bad] + [(k, 0) for k, _ in good] + [(None, 1), (100, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, labels)
    assert "Toxic" in got.columns and "signature" in got.columns
    rows = got.collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    assert all(by_id[k].predicted == 1 for k, _ in bad) and all(by_id[k].predicted == 0 for k, _ in good)
    assert by_id[900].predicted == by_id[901].predicted == by_id[902].predicted == 0 and by_id[900].score == by_id[901].score
    assert by_id[904].predicted == 1 and not by_id[None].held_out and "grumblef" in by_id[904].evidence
    assert math.isclose(by_id[903].score, by_id[904].score, abs_tol=0.5)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(df, none).collect()} == {0.0}
    assert {r.score for r in toxicity.score_toxicity(df, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_toxicity(spark.createDataFrame([], shape), labels).count() == 0
