"""Corpus operators against brute force on hard cases: ties, repeats, nulls, clashing names, long texts, chains, crowds."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackweave.llm import chat_format, decontamination, exact_dedup, html_text, maxent_lm, near_dedup, packing, quality, secret_scan, warc
from stackweave.llm.components import connected_components
from stackweave.llm.queries import ORACLE_SQL, tokenizer_files

CLASHING = ["__norm", "norm", "salt", "mask", "size", "digest", "__digest", "signature", "component", "row", "matches", "owner_of", "repo_of", "sha", "keep", "KEEP_ID", "Kept", "group_size", "text_sha256", "n_shingles", "component_id", "held_out", "Score", "predicted", "whole", "words_of", "row_key", "n_words", "hits", "items", "near", "n_near", "spans", "counts", "row_id", "rares", "base_sum", "logs_sum", "n_chars", "source_html", "own_0", "searched", "id", "a", "b", "n", "rank", "length"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words5(text):
    return [w for w in re.split("[ \t-\r]+", lower(text)) if w]


def shingles(text):
    w = words5(text)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def components_of(sets):
    """Brute force: every pair of different sets."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= 75 * large:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (small + large - common):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: root(i) for i in sets}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(0, None, "s0"), (1, "", "s1"), (2, "Two WORDS", None), (3, "two words", "s1")]
    base = [f"w{rng.randrange(80)}" for _ in range(60)]
    for k in range(4, 24):
        w = list(base)
        for _ in range(k // 4):
            w[rng.randrange(60)] = f"x{rng.randrange(999)}"
        rows.append((k, " ".join(w) + (" password=hunter2233 " if k % 5 == 0 else ""), f"s{k % 3}"))
    rows += [rows[7], rows[7], (None, "lost and found again in here", "s0"), (30, "long " * 20_000, "s2")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)


OPERATORS = {
    "exact": (lambda d, x: exact_dedup.exact_groups(d), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]),
    "near": (lambda d, x: near_dedup.near_groups(d), ["doc_id", "n_shingles", "component_id", "kept"]),
    "contamination": (lambda d, x: decontamination.contamination(d, x["bench"]), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]),
    "secrets": (lambda d, x: secret_scan.scan_secrets(d), ["doc_id", "n_assign", "base_sha256", "spans", "n_live", "counts"]),
    "language model": (lambda d, x: maxent_lm.score_texts(d), ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]),
    "quality": (lambda d, x: quality.score_quality(d, x["labels"]), ["doc_id", "held_out", "predicted"]),
    "packing": (lambda d, x: packing.pack(d, tokenizer_files()), ["doc_id", "piece", "start", "length", "ids_crc32"]),
    "exact rows": (lambda d, x: exact_dedup.exact_dedup(d), ["doc_id", "source"]),
    "near rows": (lambda d, x: near_dedup.near_dedup(d), ["doc_id", "source"]),
    "clean rows": (lambda d, x: decontamination.drop_contaminated(d, x["bench"]), ["doc_id", "text", "source"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_repeated_rows_change_nothing(spark, docs, name):
    run, made = OPERATORS[name]
    tables = {
        "bench": spark.createDataFrame([("i", "two words"), ("j", "lost and found again in here")], "item_id string, text string"),
        "labels": spark.createDataFrame([(k, int(k < 12)) for k in range(4, 24)] + [(5, 0), (None, 1), (6, None)], "doc_id bigint, quality int"),
    }
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    key = lambda df: Counter(tuple(r) for r in df.select(*made).collect())
    plain, out = run(docs, tables), run(wide, tables)
    assert key(out) == key(plain) and sum(key(plain).values()) > 0
    if name.endswith("rows"):
        assert out.columns == wide.columns
    elif name != "packing":
        lost = {c.lower() for c in plain.columns}
        assert {c for c in CLASHING if c.lower() not in lost} <= set(out.columns)
    if name in ("exact", "near", "contamination", "secrets", "language model", "quality"):
        assert out.count() == docs.count()


def test_pages_with_clashing_columns(spark):
    rows = [(k, f"http://h/{k}", f"<article><p>Body {k % 3} of the page.</p></article>") for k in range(6)] + [(6, None, None), (6, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", F.lit("x").alias("text"), F.lit(1).alias("N_CHARS"), F.lit(2).alias("source_html"), F.lit(3).alias("key"), F.lit(4).alias("payload"))
    got = Counter((r.page_id, r.text, r.n_chars, r.source_html) for r in html_text.extract_text(pages).collect())
    assert got == Counter([(k, f"Body {k % 3} of the page.", 19, 2) for k in range(6)] + [(6, "", 0, 2)] * 2)
    assert html_text.extract_text(pages.limit(0)).count() == 0
    assert warc.archive_and_read(pages).count() == 8


# --- operator 1


def test_tied_turns_equal_the_sql(spark, tmp_path):
    import duckdb

    rows = []
    for k in range(30):
        rows += [(2 * k, 0, "user", f"a{k}"), (2 * k + 1, 0, "user", f"a{k}"), (2 * k + 1, 0, "user", f"b{k * 7 % 30}")]
    rows += [(None, 0, "user", "a0"), (None, None, None, None), (70, 1, "user", "x"), (70, 1, "user", "x"), (71, 1, "user", "x"), (71, 1, "Assistant", "x"), (72, 1, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").select("*", F.lit(1).alias("n"), F.lit(1).alias("h1"))
    turns.write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/t/*.parquet'")
    want = Counter(con.execute(ORACLE_SQL["op1_chat_format"]).fetchall())
    assert Counter(tuple(r) for r in chat_format.format_chats(turns).collect()) == want


def test_long_conversations_take_linear_time(spark):
    turns = spark.range(60_000).select(F.expr("id div 30000").alias("conv_id"), F.expr("id % 30000").alias("turn"), F.lit("user").alias("role"), F.expr("concat('t', id % 30000)").alias("text"))
    longer = turns.filter("conv_id = 0 or turn < 29999")
    began = time.time()
    got = chat_format.format_chats(longer).collect()
    assert [(r.conv_id, r.n_turns, r.copies) for r in got] == [(0, 30_000, 1)] and got[0].rendered.endswith("t29999\n")
    assert time.time() - began < 60


# --- operator 2

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
BARE = re.compile(r"[A-Za-z0-9+/_-]+")


def brute_spans(text):
    text, base = text or "", []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                base.append((m.start(), rank, m.end(), kind, value))
    tokens = []
    for m in BARE.finditer(text):
        if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _, _ in base):
            tokens.append((m.start(), 3, m.end(), "token", m[0]))
    return sorted(base + tokens)


def test_secrets_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bits = ["password", "Token", ": ", "=", "'", '"', "api_key", "AKIA" + "A1" * 9, "deadbeef" * 4, "é", " ", "x7Qm2Lp9Zt4Rk8Wv1Ns6Yb3", "abc123", "/", "\n", "secret=", "0123456789abcdef01234567"]
    rows += [(10_000 + k, "".join(rng.choice(bits) for _ in range(40)), f"o{k % 4}") for k in range(150)]
    rows += [(20_000, " ".join(f"{k:024x}" for k in range(3000)), "many"), (20_001, None, None), (20_001, None, None), (10_000, rows[-150][1], "o0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    found = [(doc, owner or "", brute_spans(text)) for doc, text, owner in rows]
    holders = defaultdict(set)
    for doc, owner, spans in found:
        for *_, value in spans:
            holders[value].add((owner, str(doc)))
    want = Counter()
    for doc, owner, spans in found:
        kept, base = [], []
        for start, rank, end, kind, value in spans:
            repos, owners = len(holders[value]), len({o for o, _ in holders[value]})
            example = owners >= 3 or repos >= 10
            live = owners == 1 and not example and len(value) >= 16 and bool(re.search("[0-9]", value)) and bool(re.search("[A-Za-z]", value)) and len(set(value)) >= 8
            if rank < 3 or live:
                kept.append((f"{kind}:{start}:{end}", f"{repos}:{owners}", example, live))
            base += [f"{kind}:{start}:{end}"] * (rank < 3)
        count = lambda kind: sum(s.startswith(kind) for s, *_ in kept)
        want[doc, count("assign"), count("access"), count("hex"), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(k[0] for k in kept), count("token"), sum(k[2] for k in kept), sum(k[3] for k in kept), ",".join(k[1] for k in kept)] += 1
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "n_example", "n_live", "counts"]
    assert Counter(tuple(r) for r in secret_scan.scan_secrets(docs).select(*names).collect()) == want


# --- operator 3


def test_headings_and_deep_pages():
    story = "<p>The first part of the story is long enough to count.</p><p>And so is its second part, with more words.</p>"
    page = f'<nav><a href=x>m</a></nav><article><h2 id="search-methods">Search</h2><h2 id="related">Related</h2>{story}</article>'
    assert html_text.main_text(page).startswith("Search Related The first part")
    plain = html_text.main_text(story)
    assert html_text.main_text(f"<div>{story}</div><aside><article><p>Teaser short card</p></article></aside>") == plain
    assert plain in html_text.main_text(f"<div>{story}</div><article><p>Teaser short card</p></article>")
    began = time.time()
    assert html_text.main_text("<div>" * 100_000 + "deep") == "deep"
    html_text.main_text("<b><div>" + "<i>" * 50_000 + "</b>" * 50_000)
    html_text.main_text("<div>" * 30_000 + "<p>x</p></b></td>" * 30_000)
    html_text.main_text("<div class=ad>" * 30_000 + "<p>x" * 30_000)
    assert time.time() - began < 30


# --- operator 5


def test_proximity_against_brute_force(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(60)))) for k in range(80)] + [(99, None)]
    items = [("p", "a b c d e f g h i j k"), ("q", "l a l"), ("r", "zz a"), ("s", None), ("t", "b b b b b b b b b b b b")]
    docs, bench = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    freq = Counter(w for _, t in texts for w in (t or "").split())
    windows = defaultdict(set)
    for item, text in items:
        w = (text or "").split()
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[k : k + 10])].add(item)
    for span in (3, 15):
        want = {}
        for doc, text in texts:
            w, near = (text or "").split(), set()
            for window, owners in windows.items():
                rarest = min(range(len(window)), key=lambda k: (freq[window[k]], k))
                for p, term in enumerate(w):
                    if term == window[rarest] and set(window) <= set(w[max(p - span, 0) : p + span + 1]):
                        near |= owners
            want[doc] = len(near)
        assert {r.doc_id: r.n_near for r in decontamination.contamination(docs, bench, proximity=span).collect()} == want
        assert any(want.values())


def test_large_benchmarks_in_bounded_blocks():
    rng = np.random.default_rng(2)
    found = [b"%d" % k for k in rng.integers(0, 300_000, 1_000_000)]
    began = time.time()
    windows = decontamination.Windows([("big", found)], 10)
    queries = decontamination.Queries.of(windows, rng.integers(0, 99, len(windows.terms)))
    assert queries.grid.nbytes + queries.order.nbytes + queries.owners.nbytes + queries.starts.nbytes + queries.owner_starts.nbytes < 80_000_000
    assert time.time() - began < 60
    shard = decontamination.postings(windows.terms, [" ".join(w.decode() for w in found[5000:6000])])
    counts, term, row, position = shard
    at = np.flatnonzero(np.diff(term, prepend=-1))
    stored = {"n_words": counts, "terms": term[at], "lengths": np.diff(np.append(at, len(term))), "rows": row.tobytes(), "positions": position.tobytes()}
    began = time.time()
    hits, items, near = decontamination.search(stored, queries, 15)
    assert len(np.frombuffer(hits[0], np.int32)) == 1000 and items.to_pylist() == near.to_pylist() == [["big"]]
    assert time.time() - began < 20


def test_one_item_of_many_blocks(spark):
    text = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"w{k}" for k in range(90, 130))), (3, "nothing here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("one", text), ("two", "w3")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontamination.contamination(docs, bench, block_words=25).collect()}
    assert got == {1: (300, 300, 2), 2: (40, 40, 1), 3: (2, 0, 0)}


# --- operator 6


def test_scores_against_brute_force(spark):
    rng = random.Random(8)
    texts = [(k, " ".join(rng.choice(["the cat", "a dog", "sat on", "the mat", f"n{rng.randrange(300)}"]) for _ in range(60))) for k in range(150)] + [(900, None), (901, "Never seen the cat"), (902, ""), (902, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    counts, v, w = maxent_lm.train(docs)
    count_of = {bytes(r.token): r.c for r in counts.collect()}
    assert len(v.rank) == len(count_of) and v.tail == 1
    ways = [[(int(v.nodes[f + k]), int(v.branches[f + k])) for k in range(d)] for f, d in zip(v.first, v.depth)]

    def probability(leaf, before, skip):
        """By plain products down the tree."""
        hashes = [int(maxent_lm.hashed(salt, np.array([x + 2]))[0]) for salt, x in ((5, before), (7, skip))]
        p = 0.0
        for node, branch in ways[leaf]:
            rows = [node, *(int(maxent_lm.hashed(np.array([h], np.uint64), np.array([node]))[0]) % v.rows + len(v.bias) for h in hashes)]
            z = [sum(float(w[r, b]) for r in rows) for b in range(maxent_lm.WIDTH)]
            top = max(z)
            p += z[branch] - top - math.log(sum(math.exp(x - top) for x in z))
        return p / math.log(10)

    got = maxent_lm.score_texts(docs).collect()
    assert len(got) == len(texts)
    for r in random.Random(1).sample(got, 25) + [r for r in got if r.doc_id >= 900]:
        text = next(t for k, t in texts if k == r.doc_id)
        ids = [v.rank.get(t, -1) for t in [*(x.encode() for x in words5(text)), b""]]
        at = lambda k: ids[k] if k >= 0 else -2
        want = sum(probability(i, at(k - 1), at(k - 2)) + (0 if i >= 0 else -math.log10(v.tail)) for k, i in enumerate(ids))
        assert math.isclose(r.score, want, rel_tol=1e-4)
    # the words that may follow a history share all of its probability
    assert math.isclose(sum(10 ** probability(leaf, 3, 5) for leaf in range(len(ways))), 1, rel_tol=1e-4)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_untrained_scores_are_unigrams(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "KNOWN", 20)  # most words share the last leaf
    rng = random.Random(6)
    texts = [(k, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(50))) for k in range(60)]
    got = maxent_lm.score_texts(spark.createDataFrame(texts, "doc_id bigint, text string"), rounds=0).collect()
    c = Counter(w for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2 for w in [*t.split(), ""])
    known = {w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20]}
    tail = sum(n + 1 for w, n in c.items() if w not in known) + 1
    total = sum(c[w] for w in known) + tail
    for r in got:
        want = sum(math.log10((c[w] if w in known else c[w] + 1) / total) for w in [*dict(texts)[r.doc_id].split(), ""])
        assert math.isclose(r.score, want, rel_tol=1e-5)


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(400) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r.train_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in maxent_lm.score_texts(docs).collect()} == {(0, 0, 0.0, 0.0)}


# --- operator 7


def test_archives_of_odd_urls_against_a_table(spark):
    rng = random.Random(2)
    urls = ["http://a\tb.org/x", "http://a\nb.org/x", "http://a\r\nb.org/\x00y", "http:///nohost", "", None, "http://x.org/" + "q" * 100_000, "  http://sp.org/a b ", "\x85  ", "http://ü.example/ä?ö", "a: b: c", "http://u@h.org:80/p#f", "WARC/1.1\r\n\r\n"]
    bodies = [None, "", "<p>one</p>", "<p>zwei ü</p>", "x" * 200_000, "\r\n\r\n", "\x00\x01"]
    rows = [(k if k % 11 else None, rng.choice(urls), rng.choice(bodies)) for k in range(1, 300)] + [(500, urls[0], bodies[2])] * 3 + [(-4, urls[1], bodies[3])]
    first = {}
    for page, _, body in rows:
        key = (body or "").encode()
        least = -math.inf if page is None else page
        first[key] = min(first.get(key, math.inf), least)
    want = Counter()
    for page, _, body in rows:
        data = (body or "").encode()
        kind = "response" if (-math.inf if page is None else page) == first[data] else "revisit"
        refers = first[data] if kind == "revisit" and first[data] != -math.inf else None
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers] += 1
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert Counter(tuple(r) for r in warc.archive_and_read(pages).collect()) == want


# --- operator 8


def test_chain_of_revisions(spark):
    """Each text shares most with the next only; 140 make one group."""
    rng = random.Random(1)
    stream = [f"w{rng.randrange(10**6)}" for _ in range(200 + 20 * 140)]
    docs = spark.createDataFrame([(1000 - k, " ".join(stream[20 * k : 20 * k + 200])) for k in range(140)], "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_groups(docs).collect()} == {861}


def test_components_of_paths_and_stars(spark):
    order = np.random.default_rng(4).permutation(10_000) + 30_000
    edges = [(k, k + 1) for k in range(9_999)] + [(29_999 - k, 29_998 - k) for k in range(9_999)] + [(int(a), int(b)) for a, b in zip(order, order[1:])]
    edges += [(50_000, 50_000 + k) for k in range(1, 3000)] + [(60_000 + k, 69_999) for k in range(3000)] + [(1, 1), (None, 4), (5, 6), (5, 6)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: 0 for k in range(10_000)} | {k: 20_000 for k in range(20_000, 30_000)} | {k: 30_000 for k in range(30_000, 40_000)} | {50_000 + k: 50_000 for k in range(3000)} | {60_000 + k: 60_000 for k in range(3000)} | {69_999: 60_000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def crowd(rng, n, kept, size):
    """n texts that each keep a share of one template's words, in stretches."""
    template = [f"t{k}" for k in range(size)]
    texts = []
    for _ in range(n):
        w = list(template)
        for start in range(0, size, 10):
            if rng.random() > kept:
                w[start : start + 10] = [f"r{rng.randrange(10**7)}" for _ in range(10)]
        texts.append(w)
    return texts


@pytest.mark.parametrize("kept", [0.55, 0.8, 0.93])
def test_all_links_in_crowds(spark, kept, monkeypatch):
    """Crowds of half-similar texts with pairs planted close to 0.75, through bands, chunks and cells."""
    monkeypatch.setattr(near_dedup, "CHUNK_DOCS", 40)
    rng = random.Random(int(kept * 100))
    texts = crowd(rng, 420, kept, 200) + crowd(rng, 60, kept, 270)
    for k in range(0, 100, 2):  # one in seven shingles changes: similarity about 0.76
        w = list(texts[k])
        start = rng.randrange(150)
        w[start : start + 22] = [f"p{rng.randrange(10**7)}" for _ in range(22)]
        texts[k + 1] = w
    docs = {k: " ".join(w) for k, w in enumerate(texts)}
    sets = {k: shingles(t) for k, t in docs.items()}
    want = components_of(sets)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(6)).collect()}
    missed = [k for k in want if got[k] != want[k]]
    assert not missed
    assert len(set(want.values())) < len(docs) - 30


# --- operators 9 and 10


def test_packing_needs_no_more_bins_than_first_fit():
    rng = np.random.default_rng(7)
    for _ in range(25):
        lengths = sorted(rng.integers(1, 101, size=int(rng.integers(1, 400))).tolist(), reverse=True)
        gaps = []
        for x in lengths:
            for k, gap in enumerate(gaps):
                if gap >= x:
                    gaps[k] -= x
                    break
            else:
                gaps.append(100 - x)
        counts = np.bincount(lengths, minlength=101)
        assert sum(bins for bins, _ in packing.pack_counts(counts, 100)) <= len(gaps) + 1


def test_votes_against_brute_force(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(2, 24)] + [(30, 1), (4, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    for r in quality.score_quality(docs, labels, keep_text=True).collect():
        raw = quality.measures([r.text])
        if not r.text:
            want = 0.5
        else:
            at = model.project(raw)[0]
            near = sorted(((float(at @ x), float(y)) for x, y in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
            weights = [max(c, 0) ** 4 + 1e-9 for c, _ in near]
            want = sum(x * y for x, (_, y) in zip(weights, near)) / sum(weights)
        assert abs(r.score - want) < 1e-3 and r.predicted == int(r.score >= 0.7)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("turn", [1, -1])
def test_different_texts_of_one_id_keep_all_their_links(spark, turn):
    rng = random.Random(11)
    a, b = ([rng.choice("abcdefghijklmnop") * 3 + str(k) for k in range(60)] for _ in range(2))
    near = lambda words: " ".join([*words[:-2], "other", "end"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (0, " ".join(b)), (7, "alone in this table of texts")]
    got = near_dedup.near_groups(spark.createDataFrame(rows[::turn], "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 0), (7, 7)} and len(got) == 6


@pytest.mark.parametrize("broken", ["<a ", '<a b="', "<a \"'>", "<!- ", "<a b='c\" d=\">", "</script ", "<script ", "<p x='>"])
def test_broken_markup_takes_linear_time(broken):
    import time

    from stackweave.llm import html_text

    began = time.time()
    html_text.Page("<body><p>One.</p>" + broken * 100_000)
    html_text.Page("<body><p>One.</p>" + broken * 100_000 + ">")
    assert time.time() - began < 6


def test_tags_end_outside_quotes():
    from stackweave.llm import html_text

    found = [(name, attributes.strip(), closes) for _, _, name, attributes, closes in html_text.tags("<P class='a>b'>x</p><!-- <i> --><br/><a href=\"c>d\" e><q f='g>h>")]
    assert found == [("p", "class='a>b'", False), ("p", "", True), ("", "", False), ("br", "/", False), ("a", 'href="c>d" e', False), ("q", "f='g", False)]


def test_scores_of_the_language_model_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: (r.base_score, r.score) for r in maxent_lm.score_texts(d).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(8)))
    assert one.keys() == many.keys() and all(np.allclose(one[k], many[k], rtol=1e-6) for k in one)
