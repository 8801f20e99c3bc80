"""Files that have come to rest: modification time and size stood still for a while, and the file isn't too small.

``stable_runs`` finds them in a table of observations by windows; ``stable_files`` on a stream, with a state for each path and timers in event time.
Both tell of every rest once, at the same moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LEAST = 1 << 20  # bytes
QUIET = 5.0  # seconds
SHAPE = "path string, mtime timestamp, size long, stable_at timestamp"


def stable_runs(observations: DataFrame, quiet: float = QUIET, least: int = LEAST) -> DataFrame:
    """observations(path, mtime, size, seen) -> path, mtime, size, stable_at: every run of equal times and sizes of a path, in the
    order of sight, that lasted ``quiet`` seconds before another began, or that nothing followed. Observations of one
    moment are taken by mtime, then size; those without a moment are left out."""
    order = Window.partitionBy("path").orderBy("seen", "mtime", "size")
    same = F.col("mtime").eqNullSafe(F.lag("mtime").over(order)) & F.col("size").eqNullSafe(F.lag("size").over(order))
    first = F.row_number().over(order) == 1
    starts = observations.filter("seen is not null").withColumn("__new", first | ~same).filter("__new")
    following = F.lead("seen").over(order)
    ends = starts.withColumn("__next", following).filter(f"size >= {int(least)}")
    at = F.col("seen") + F.make_interval(secs=F.lit(float(quiet)))
    return ends.withColumn("stable_at", at).filter("__next is null or __next >= stable_at").select("path", "mtime", "size", "stable_at")


def stable_files(observations: DataFrame, quiet: float = QUIET, least: int = LEAST, late: str = "0 seconds") -> DataFrame:
    """The same on a stream. A rest is told once the watermark (``late`` behind the newest sight) has passed it, or a change after
    it is seen. The state of a path is what was last seen, since when, and whether it was told; sights that are older than that are dropped."""
    wait = pd.Timedelta(seconds=quiet)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mtime, size, since, last, told = state.get if state.exists else (None, None, None, None, True)
        since, last = (pd.Timestamp(v) if v is not None else None for v in (since, last))
        out = []

        def tell(now: pd.Timestamp) -> None:
            nonlocal told
            if not told and now >= since + wait:
                told = True
                out.append((key[0], mtime, size, since + wait))

        if state.hasTimedOut:
            tell(since + wait)
        else:
            rows = pd.concat(batches).sort_values(["seen", "mtime", "size"])
            for m, s, seen in zip(rows["mtime"], rows["size"], rows["seen"]):
                if last is not None and seen < last:
                    continue
                last, s = seen, int(s)
                if since is None or m != mtime or s != size:
                    if since is not None:
                        tell(seen)
                    mtime, size, since, told = m, s, seen, s < least
        state.update((mtime, size, since, last, told))
        if not told:
            state.setTimeoutTimestamp(max(int((since + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "mtime", "size", "stable_at"])

    used = observations.select("path", "mtime", "size", "seen").filter("seen is not null and mtime is not null and size is not null").withWatermark("seen", late)
    held = "mtime timestamp, size long, since timestamp, last timestamp, told boolean"
    return used.groupBy("path").applyInPandasWithState(run, SHAPE, held, "append", GroupStateTimeout.EventTimeTimeout)
