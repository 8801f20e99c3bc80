"""Corpus operators on small fixtures, against brute force, round trips and exact rules."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stackweave.llm import chat_format, decontamination, exact_dedup, html_text, maxent_lm, near_dedup, packing, quality, secret_scan, warc
from stackweave.llm.components import connected_components
from stackweave.llm.queries import tokenizer_files

DOCS = "doc_id bigint, text string, keep_id string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta"]) + str(rng.randrange(60)) for _ in range(120)]
    rows = [(0, None, "x"), (1, "", "x"), (2, "one two", "x"), (3, "ONE two", "x"), (4, " ".join(base), "x")]
    for k in range(5, 40):
        w = list(base)
        for _ in range(k // 3):
            w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
        rows.append((k, " ".join(w), "x"))
    rows += [(40, "word " * 5000, "x"), (41, rows[9][1].upper().replace("É", "é"), "x"), (41, rows[9][1].upper().replace("É", "é"), "x"), (None, "lost", "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups(docs):
    rows = docs.collect()
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_dedup(docs).count() == len(groups)


def test_exact_groups_compare_texts_when_digests_clash(docs):
    from pyspark.sql import functions as F

    clash = exact_dedup.exact_groups(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    plain = exact_dedup.exact_groups(docs)
    key = lambda df: Counter((r.doc_id, r.keep_id, r.group_size) for r in df.collect())
    assert key(clash) == key(plain)


def test_near_groups_against_all_pairs(docs):
    sets = {}
    for r in docs.filter("doc_id is not null").collect():
        w = lower(r.text).split(" ") if r.text else []
        w = [x for x in w if x]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 90), (90, 70), (7, 7)], "a bigint, b bigint")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(31)} | {50: 50, 70: 50, 90: 50}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    for df in (exact_dedup.exact_groups(none), near_dedup.near_groups(none), decontamination.contamination(none, bench), packing.pack(none, tokenizer_files()), quality.score_quality(none, labels), maxent_lm.score_texts(none), secret_scan.scan_secrets(none, owner_col="keep_id")):
        assert df.count() == 0
    assert warc.archive_and_read(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")).count() == 0


@pytest.mark.parametrize("block_words", [4_000_000, 10])
def test_contamination_brute_force(spark, docs, block_words):
    text4 = docs.filter("doc_id = 4").first().text.split(" ")
    items = [("long", " ".join(text4[20:45])), ("short", "One TWO"), ("none", None), ("far", "never there at all in any of these texts of ours now"), ("twice", " ".join(text4[30:41]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        w = word.findall(lower(text))
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    want = Counter()
    for r in docs.collect():
        w, hit, found = word.findall(lower(r.text)), set(), set()
        for window, owners in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= owners
        want[r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = decontamination.contamination(docs, bench, block_words=block_words).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_secret_spans(spark):
    token = "x7Qm2Lp9Zt4Rk8Wv1Ns6Yb3"
    texts = [f'é password = "hunter22" and AKIA{"A1" * 9}', "secret=token: abcdefgh", "deadbeef" * 4 + " token:abc", f"bare {token} here", None]
    docs = spark.createDataFrame([(k, t, f"o{k}") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 1, 0)
    assert got[0].spans.split(",")[0] == "assign:2:22"
    assert got[1].n_assign == 0 and got[1].spans == ""  # the first match is too short, and takes the word of the second
    assert got[2].spans == "hex:0:32"
    assert got[3].n_token == 1 and got[3].spans == f"token:5:{5 + len(token)}"
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    copied = spark.createDataFrame([(k, f"bare {token} here", f"o{k}") for k in range(4)], "doc_id bigint, text string, source string")
    assert {r.n_token for r in secret_scan.scan_secrets(copied).collect()} == {0}


def test_secret_tokens_with_late_digits_and_many_repositories(spark):
    late, sample = "sk_live_aBcDeFgHiJkLmNoPqRsT7u8", "x7Qm2Lp9Zt4Rk8Wv1Ns6Yb3"
    texts = [f"bare {late} here", "a-word-without-any-number-in-it", f"{sample} and {late}"] + [f"bare {sample}"] * 30
    docs = spark.createDataFrame([(k, t, "o") for k, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert (got[0].n_token, got[0].n_live, got[0].spans, got[0].counts) == (1, 1, f"token:5:{5 + len(late)}", "2:1")
    assert got[1].spans == got[1].counts == ""
    assert (got[2].n_token, got[2].spans) == (1, f"token:{len(sample) + 5}:{len(sample) + 5 + len(late)}")
    assert {got[k].n_token for k in range(3, 33)} == {0}
    named = docs.filter("doc_id > 2").selectExpr("doc_id", f"'password={sample}' as text", "source")
    assert {(r.n_assign, r.n_example, r.n_live, r.counts) for r in secret_scan.scan_secrets(named).collect()} == {(1, 1, 0, "30:1")}


def test_chat_prefixes(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (4, 0, None, None)]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")).collect()}
    assert set(got) == {2, 4} and got[2].copies == 2 and got[2].rendered == "<|user|>\na\n<|assistant|>\nb\n"
    assert got[4].n_turns == 1 and got[4].rendered == "<|unknown|>\n\n"


def test_html():
    page = '<html><body><nav><a href=x>menu</a></nav><div class="cookie-notice">ok?</div><article><h1>T &amp; t</h1><p>One<b>two</b> three<p>four<!-- no --><script>var t="</p>"</script></article><div id="comments"><p>bad</p></div><footer>f</footer>'
    assert html_text.main_text(page) == "T & t Onetwo three four"
    assert html_text.main_text(None) == "" and html_text.main_text("<p>cut <b") == "cut"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_of_pages_without_an_article_or_with_a_small_one():
    main = "<div>" + "".join(f"<p>Sentence {k} of the long main text goes on for quite a while here.</p>" for k in range(8)) + "</div>"
    text = html_text.main_text(main)
    assert text.startswith("Sentence 0") and text.endswith("here.") and "Sentence 7" in text
    for card in ("<article><a href=x>Teaser</a></article>", "<article><p>Short card.</p></article>"):
        for page in (main + card, card + main, f"<div>{card}{main}</div>"):
            assert text in html_text.main_text(page)
    assert "Teaser" not in html_text.main_text(main + "<article><a href=x>Teaser</a></article>")


def test_html_keeps_marked_wrappers_of_the_text():
    body = "<h1>Title</h1><p>The first part of the text is long enough.</p><p>The second part is as long as the first.</p>"
    text = "Title The first part of the text is long enough. The second part is as long as the first."
    nav = "<nav><a href=x>menu</a></nav>"
    for name in ("content with-sidebar", "no-ads", "social-science", "search-result-body", "widget"):
        assert html_text.main_text(f"{nav}<div class='{name}'><article>{body}</article></div><p>x</p>") == text
        assert html_text.main_text(f"{nav}<div class='{name}'>{body}</div>") == text
    for opened in ("<nav><a href=x>menu</a>", "<aside>note", "<div class=ad>buy"):
        assert html_text.main_text(f"<div>{opened}</div><article>{body}</article>") == text
        assert html_text.main_text(f"{opened}<article>{body}</article>") == text
    assert html_text.main_text(f"<article>{body}<div class='ad-slot'><p>buy</p></div></article><div id=comments><article class=comment><p>{text * 3}</p></article></div>") == text
    assert html_text.main_text(f"<div>{body}</div><aside><article><p>Card text.</p></article></aside>") == text


def test_warc_round_trip(spark):
    rows = [(3, "http://b.example.org/x y", "<p>é</p>"), (1, "http://a.example.org/", "<p>é</p>"), (2, None, None), (4, "HTTP://A.example.org:80/q?b", ""), (5, "u", "other"), (5, "u", "other")]
    got = sorted(warc.archive_and_read(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(1, 9, digest("<p>é</p>"), "response", None), (2, 0, digest(""), "response", None), (3, 9, digest("<p>é</p>"), "revisit", 1), (4, 0, digest(""), "revisit", 2)] + [(5, 5, digest("other"), "response", None)] * 2
    assert [tuple(r) for r in got] == want


def test_packing(docs):
    files = tokenizer_files()
    plain = packing.encoder(files[0])
    got = packing.pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), files).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in docs.filter("doc_id is not null").collect():
        ids = np.array([*(plain(r.text) if r.text else ()), 0], dtype="<u4")
        at = 0
        for k, p in enumerate(sorted(by_doc[r.doc_id], key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for pieces in by_bin.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_pack_counts_keeps_every_item_and_fits():
    rng = np.random.default_rng(3)
    for _ in range(30):
        counts = np.zeros(101, dtype=np.int64)
        counts[rng.integers(1, 101, size=20)] = rng.integers(0, 50, size=20)
        used = np.zeros(101, dtype=np.int64)
        for bins, made in packing.pack_counts(counts, 100):
            assert bins > 0 and sum(a * b for a, b in made) <= 100
            assert sum(each for length, each in made if 3 * length > 100) <= 2
            for length, each in made:
                used[length] += bins * each
        assert (used == counts).all()


def test_language_model(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(f"w{min(int(rng.expovariate(0.3)), 40)}" for _ in range(200))) for k in range(120)] + [(200, None), (201, "never Seen")]
    got = {r.doc_id: r for r in maxent_lm.score_texts(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)).collect()}
    words = {k: [*lower(t).split(), ""] for k, t in texts}
    c = Counter(w for k, ws in words.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in words.items():
        r = got[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_quality_learns(spark):
    rng = random.Random(2)
    good = [(k, " ".join(rng.choice(["the", "river", "moved", "slowly", "home", "again"]) for _ in range(60)) + ".") for k in range(80)]
    bad = [(k, " | ".join(f"{rng.randrange(9999)}$$$" for _ in range(40))) for k in range(80, 160)]
    docs = spark.createDataFrame([*good, *bad, (500, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(160)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert all(got[k].predicted == int(k < 80) for k in range(160)) and got[500].score == 0.5
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
