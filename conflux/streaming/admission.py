"""Deadline admission on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "run long, delivered double, on_time long, late long, winner long"


def streaming_incumbents(events: DataFrame, initial: float = 0.0) -> DataFrame:
    """Running result of each run (run, t, id, value, deadline): the state is one row per run.

    Late events are counted and never dropped, so there is no watermark; a value counts only if its time is strictly
    before the deadline, and an equal value does not replace the incumbent unless it is earlier.  In update mode every
    touched run is emitted once per batch, and after the last batch the rows equal final_incumbents() of all events.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, value, t, winner, on_time, late = state.get if state.exists else (False, 0.0, 0, 0, 0, 0)
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.t < r.deadline:
                    on_time += 1
                    if not found or (r.value, -r.t, -r.id) > (value, -t, -winner):
                        found, value, t, winner = True, float(r.value), int(r.t), int(r.id)
                else:
                    late += 1
        state.update((found, value, t, winner, on_time, late))
        yield pd.DataFrame({"run": [key[0]], "delivered": [max(value, initial) if found else initial], "on_time": [on_time], "late": [late], "winner": pd.array([winner if found else None], dtype="Int64")})

    return events.select("run", "t", "id", "value", "deadline").groupBy("run").applyInPandasWithState(
        fold, RESULT, "found boolean, value double, t long, winner long, on_time long, late long", "update", GroupStateTimeout.NoTimeout
    )


def spent_requests(requests: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First launch of each request key: a request is spent once launched, whatever becomes of it (stateful dedup).

    With an event-time column a key is forgotten once ``delay`` has passed since it came, as no run lasts that long; without
    one, state keeps every key, which only a bounded stream can afford.
    """
    keys = ["run", "action", "cap", "workpoint"]
    if time is None:
        return requests.dropDuplicates(keys)
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert_latest(batch: DataFrame, epoch: int, path: str) -> None:
    """foreachBatch sink: writes a batch under its epoch; one that is replayed takes the place of its first try."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")


def latest(spark: SparkSession, path: str, key: str = "run") -> DataFrame:
    """The last row of every key in a table of ``upsert_latest``."""
    rows = spark.read.option("basePath", path).parquet(path)
    own = [c for c in rows.columns if c != "epoch"]
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*own), "epoch").alias("x")).select("x.*")


def compacted(spark: SparkSession, path: str, target: str, key: str = "run") -> int:
    """Writes the last rows as epoch 0 of another table, which later epochs go on from; returns the last epoch it holds."""
    last = spark.read.option("basePath", path).parquet(path).agg(F.max("epoch")).first()[0]
    upsert_latest(latest(spark, path, key), 0, target)
    return int(last or 0)
