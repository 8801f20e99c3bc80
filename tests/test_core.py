import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from stackweave.functions import numeric as num
from stackweave.operators import frames, stats
from stackweave.plans import align_queries, correct_queries, fit_queries, more_queries, stack_queries  # noqa: F401  (they add their queries)
from stackweave.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df):
    one = lambda x: f"{x + 0.0:.5f}" if isinstance(x, float) else str(x)
    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_every_query_has_sql_but_the_listed():
    assert set(QUERIES) - set(ORACLE_SQL) == {"sp08_solve_shifts", "sp18_even_odd_frc", "sp07_sharpest_shifts", "sp09_rejected_pairs", "wn05_smooth_trajectory", "sp11_autologistic_weights"}


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_total_arithmetic(spark):
    f = lambda x: F.lit(float(x))
    assert value(spark, num.int_div(F.lit(7), F.lit(0))) == 0
    assert value(spark, num.int_div(F.lit(-7), F.lit(2))) == -3
    assert value(spark, num.int_mod(F.lit(-7), F.lit(3))) == -1
    assert value(spark, num.floor_mod(f(-7.5), f(2))) == 0.5
    assert value(spark, num.floor_mod(f(7.5), f(-2))) == -0.5
    assert math.isnan(value(spark, num.floor_mod(f(1), f(0))))
    assert value(spark, num.true_div(f(1), f(0))) == math.inf
    assert value(spark, num.true_div(f(-1), f(0))) == -math.inf
    assert math.isnan(value(spark, num.true_div(f(0), f(0))))
    assert value(spark, num.log(f(0))) == -math.inf
    assert math.isnan(value(spark, num.log(f(-1))))
    assert value(spark, num.float_greater(F.lit(float("nan")), f(1))) is False
    assert value(spark, num.int_pow(F.lit(3), 5)) == 243


def test_complex(spark):
    z = num.complex_of(F.lit(3.0), F.lit(-4.0))
    assert value(spark, num.complex_abs(z)["re"]) == 5.0
    root = value(spark, num.complex_sqrt(z))
    assert (root.re, root.im) == (2.0, -1.0)
    one = value(spark, num.complex_div(z, z))
    assert (one.re, one.im) == (1.0, 0.0)


def test_moves_are_inverse(spark):
    px = spark.createDataFrame([(0, k, [float(k * 64 + i) for i in range(64)]) for k in range(3)], "stack_id int, frame int, px array<double>")
    p = frames.as_pixels(px, 8)
    back = frames.roll(frames.roll(p, 3, 5, 8, 8), -3, -5, 8, 8)
    assert back.exceptAll(p).isEmpty() and p.exceptAll(back).isEmpty()
    four = p
    for _ in range(4):
        four = frames.rot90(four, 8)
    assert four.exceptAll(p.select(four.columns)).isEmpty()


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5, "g string, v double")
    got = {r.bin: r.n for r in stats.histogram(df, "v", 4, ["g"]).collect()}
    assert sum(got.values()) == 5 and len(got) == 4


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "stackweave.llm", None)
    monkeypatch.setitem(sys.modules, "stackweave.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(entry)
    assert "ex01_project" in entry.queries() and not any(q.startswith("op1_") for q in entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_nothing_outside_names_the_llm_subpackage():
    import pathlib

    package = pathlib.Path(entry_file()).parent / "stackweave"
    outside = [p for p in package.rglob("*.py") if "llm" not in p.relative_to(package).parts]
    assert outside and not [p for p in outside if re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M)]


def entry_file():
    import __spark_entry__

    return __spark_entry__.__file__


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from stackweave import scratch

    conf = {}
    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=conf.get)))
    with pytest.raises(ValueError):
        scratch.scratch_dir(session)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert scratch.scratch_dir(session) == "hdfs://x/y"


def test_scratch_tables_are_discarded(spark):
    import os

    from stackweave import scratch

    table = scratch.materialize(spark.range(3), "three")
    folder = table.scratch_path.removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(folder)
    scratch.discard(table)
    assert not os.path.exists(folder)
