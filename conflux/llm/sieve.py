"""A bitmap of ids that keeps rows out of a shuffle.

Ids are hashed to the bits of a bitmap in the shared folder, of 16 bits an id but never more than ``MOST`` bits, so what
a task loads has a fixed bound.  A row whose bit is unset has none of the ids; a row whose bit is set may have one and
needs an exact join.  With so many ids that the bitmap is full, every row takes the join: slower, and still right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded, stored

LEAST, MOST = 1 << 16, 1 << 28


class Sieve:
    def __init__(self, ids: DataFrame):
        """``ids`` has one column of longs."""
        ids = ids.toDF("id").where("id is not null")
        self.bits = min(MOST, max(LEAST, 1 << (16 * ids.count()).bit_length()))
        spots = ids.select(self.spot(F.col("id")).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("held"))
        self.table = stored(words, "sieve")
        self.files = self.table.inputFiles()

    def spot(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("long")), F.lit(self.bits))

    def loader(self):  # noqa: ANN201  (a function for tasks; it holds names of files alone)
        files, bits = list(self.files), self.bits

        def load() -> np.ndarray:
            words = np.zeros(bits >> 6, np.uint64)
            for file in files:
                at, place = fs.FileSystem.from_uri(file)
                with at.open_input_file(place) as f:
                    for batch in pq.ParquetFile(f).iter_batches(1 << 16, columns=["word", "held"]):
                        words[batch.column("word").to_numpy()] = batch.column("held").to_numpy().view(np.uint64)
            return words

        return load

    def split(self, rows: DataFrame, key: str, hit: bool) -> DataFrame:
        """The rows whose bit is set, or those whose bit is not; rows without a key are in neither."""
        load = self.loader()
        spotted = bounded(rows).where(F.col(key).isNotNull()).withColumn("_spot", self.spot(F.col(key)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = None
            for batch in batches:
                words = load() if words is None else words
                kept = batch.filter(pa.array(found(words, batch.column(batch.num_columns - 1).to_numpy()) == hit))
                if kept.num_rows:
                    yield kept.select(list(range(batch.num_columns - 1)))

        return spotted.mapInArrow(run, rows.schema)


def found(words: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (words[spots >> 6] >> (spots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
