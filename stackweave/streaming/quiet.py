"""Detection of stable files: a file is stable once nothing was observed of it for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_sessions(observations: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of observations that a gap of silence ends. On a stream give ``late`` (the watermark); a session is then
    emitted once it has been quiet for so long."""
    source = observations.withWatermark(at, late) if late else observations
    window = F.session_window(F.col(at), gap).alias("session")
    out = source.groupBy(key, window).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session.start").alias("began"), F.col("session.end").alias("stable_at"), "n")
