"""Files at rest: the stream and the windows agree with a plain loop."""

import datetime as dt
import random

from stackweave.streaming import stable

SHAPE = "path string, mtime timestamp, size long, seen timestamp"
AT = dt.datetime(2024, 1, 1)


def observations():
    rng, rows = random.Random(4), []
    for name in ("a", "b", "c", "d", "e"):
        mtime, size = 0, 1 << 19
        for second in range(0, 200, 1):
            if rng.random() < 0.25:
                mtime, size = second, size + rng.choice([0, 1 << 18, 1 << 19])
            if rng.random() < 0.8:
                rows.append((name, AT + dt.timedelta(seconds=mtime), size, AT + dt.timedelta(seconds=second)))
    return sorted(rows, key=lambda r: (r[3], r[0]))


def plain(rows, quiet=5.0):
    out = set()
    for path in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == path]
        runs = [r for k, r in enumerate(mine) if k == 0 or mine[k - 1][1:3] != r[1:3]]
        for k, (_, mtime, size, seen) in enumerate(runs):
            end = seen + dt.timedelta(seconds=quiet)
            if size >= 1 << 20 and (k + 1 == len(runs) or runs[k + 1][3] >= end):
                out.add((path, mtime, size, end))
    return out


def test_windows_equal_a_loop(spark):
    rows = observations()
    df = spark.createDataFrame([*rows, ("a", None, None, None)], SHAPE).repartition(3)
    got = [tuple(r) for r in stable.stable_runs(df).collect()]
    assert set(got) == plain(rows) and len(got) == len(set(got)) > 20
    assert stable.stable_runs(df.limit(0)).count() == 0


def test_replayed_stream_equals_the_windows(spark, tmp_path):
    rows = observations()
    rows.append(("end", AT, 1, AT + dt.timedelta(hours=1)))  # moves the watermark past the last timers
    rows.append(("end", AT, 1, AT + dt.timedelta(hours=2)))
    for k in range(0, len(rows), 60):
        part = spark.createDataFrame(rows[k : k + 60], SHAPE)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k:05d}")
    source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink = stable.stable_files(source).writeStream.format("memory").queryName("at_rest").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    sink.awaitTermination()
    got = [tuple(r) for r in spark.table("at_rest").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
