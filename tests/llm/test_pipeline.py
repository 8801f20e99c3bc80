"""The pipeline's stages on planted documents, each held against brute force on its own input."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from stackweave.llm import quality
from stackweave.llm.queries import tokenizer_files
from tests.llm.test_edges import components_of, lower, shingles

COLUMNS = ["doc_id", "text", "source", "extra"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("sf")
    plain = ["the", "river", "moved", "slowly", "home", "again", "under", "old", "bridge", "and", "people", "watched", "it", "quietly"]
    prose = lambda n: " ".join(rng.choice(plain) + str(rng.randrange(40)) for _ in range(n)) + "."
    passage = prose(30)
    rows = [(k, prose(80), f"s{k % 4}", k) for k in range(60)]
    rows += [(100 + k, " | ".join(f"{rng.randrange(9999)}$$$" for _ in range(40)), "junk", 0) for k in range(40)]
    rows += [(200 + k, rows[k % 5][1].upper() if k % 2 else rows[k % 5][1], "copies", k) for k in range(20)]  # exact copies
    for k in range(30):  # near copies: chains from texts 10 to 14
        w = rows[10 + k % 5][1].split()
        w[rng.randrange(70)] = f"new{k}"
        rows.append((300 + k, " ".join(w), "near", k))
    rows += [(400 + k, f"{prose(40)} {passage} {prose(40)}", "tainted", k) for k in range(6)]
    rows += [(500, None, "none", 0), (501, "", "none", 0), (502, rows[3][1], "copies", 1), (502, rows[3][1], "copies", 1), (None, prose(50), "no id", 0), (503, prose(4000), "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(40)] + [(7, 0, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", passage), ("j", None), ("k", "never there at all")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_against_brute_force(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    kept = corpus_pipeline.materialize(stages["quality"](spark, docs, sf_dir), "t1")
    assert kept.columns == COLUMNS
    scored = quality.score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=True).filter("score >= 0.7")
    first = rows_of(kept)
    assert Counter(first) == Counter(rows_of(scored))
    assert not [r for r in first if r[2] in ("junk", "none")] and len([r for r in first if r[2] not in ("junk", "none")]) == docs.filter("source not in ('junk', 'none')").count()

    exact = corpus_pipeline.materialize(stages["exact_dedup"](spark, kept, sf_dir), "t2")
    groups = defaultdict(list)
    for r in first:
        groups[lower(r[1])].append(r)
    best = {text: max((r[0] for r in group if r[0] is not None), default=None) for text, group in groups.items()}
    second = rows_of(exact)
    assert Counter((r[0], lower(r[1])) for r in second) == Counter((i, t) for t, i in best.items()) and set(second) <= set(first)

    near = corpus_pipeline.materialize(stages["near_dedup"](spark, exact, sf_dir), "t3")
    label = components_of({r[0]: shingles(r[1]) for r in second if r[0] is not None})
    third = rows_of(near)
    assert Counter(third) == Counter(r for r in second if r[0] is None or label[r[0]] == r[0])
    assert len(third) < len(second) - 20

    clean = corpus_pipeline.materialize(stages["decontamination"](spark, near, sf_dir), "t4")
    fourth = rows_of(clean)
    assert [r for r in third if r[2] == "tainted"] and not [r for r in fourth if r[2] == "tainted"]
    assert Counter(fourth) == Counter(r for r in third if r[2] != "tainted")

    whole = corpus_pipeline.run(spark, sf_dir).collect()
    packed = stages["packing"](spark, clean, sf_dir).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(whole) == key(packed)
    from stackweave.llm import packing

    encode = packing.encoder(tokenizer_files()[0])
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({r[0]: len(encode(r[1])) + 1 for r in fourth})
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(tokens.values()) // 2048) + 1


def test_stages_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)["quality"](spark, docs, str(tmp_path)).count() == 0
    assert dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path)).count() == docs.count()


def test_entry_registers_the_pipeline_as_one_of_the_corpus_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11))
