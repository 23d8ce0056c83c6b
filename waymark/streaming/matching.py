"""Matching a stream of points: every micro-batch against the network at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waymark.operators.candidates import select_candidates
from waymark.plans.params import DEFAULT, DecodeParams


def match_stream(points: DataFrame, segments: DataFrame, out: str, checkpoint: str, params: DecodeParams = DEFAULT, **trigger) -> StreamingQuery:
    """Candidates of each batch of points, written as Parquet below `out`, one folder a batch; a batch that is run again after a
    failure overwrites its own folder, so each point counts once. There is no state and hence no watermark."""

    def batch(df: DataFrame, number: int) -> None:
        select_candidates(df, segments, params).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
