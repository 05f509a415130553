"""Reading inputs, bounded batches of texts, and intermediate tables (see ``conflux.shared``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from conflux.shared import dropped, shared_dir, stored
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

__all__ = ["bounded", "dropped", "parquet_batches", "shared_dir", "stored", "table"]

#: Most rows and bytes of an Arrow batch of whole texts: without a bound, ten thousand long texts would meet in one batch.
LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded; every operator that hands whole texts to Python calls it.

    Spark reads these settings when the plan runs, so they stay; a smaller value of the caller is left as it is.
    """
    conf = df.sparkSession.conf
    for key, most in LIMITS.items():
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def parquet_batches(files: list[str], rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a stored table, inside a task."""
    for file in files:
        at, place = fs.FileSystem.from_uri(file)
        with at.open_input_file(place) as f:
            yield from pq.ParquetFile(f).iter_batches(rows, columns=columns)
