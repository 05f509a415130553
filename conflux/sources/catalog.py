"""Catalog of a dataset's sources and graphs, from small metadata documents alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits that a catalog counts, in this order: fixed values.
SPLITS = ("TRAIN", "VALIDATION", "TEST")


def read_documents(spark: SparkSession, path: str, schema: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON documents, one a file, with ``file``; and (file, warning) of those that are left out.

    One bad document does not end the scan: what is no JSON of the schema, or has no ``key``, is told and not listed.
    """
    read = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = read.select("*", F.col("_metadata.file_path").alias("file"))
    warning = F.when(F.col("_bad").isNotNull(), "unreadable").when(F.col(key).isNull(), f"no {key}")
    return rows.where(warning.isNull()).drop("_bad"), rows.where(warning.isNotNull()).select("file", warning.alias("warning"))


def catalog(sources: DataFrame, graphs: DataFrame, planned: int) -> tuple[DataFrame, DataFrame]:
    """Sources (scene_id, source_group, split, status, full, crossing) with what was made of them, and graphs (graph_id,
    source_group, arrays) with ``completed``.

    A source is completed if its recorded status is success, and only then has counts and completed graphs: those of its
    source group whose arrays are there.  Without a manifest (null status) it is not_generated.  A graph is completed if its
    arrays are there and a completed source has its group; a null group links with nothing.  Splits are upper-cased.
    """
    done = F.coalesce(F.col("status") == "success", F.lit(False))
    made = graphs.groupBy("source_group").agg(F.count_if("arrays").alias("made"))  # before the join: a group may hold most graphs
    rows = sources.join(made, "source_group", "left").withColumn("completed", done)
    only = lambda c: F.when(F.col("completed"), c)
    listed = rows.select(
        "scene_id", "source_group", F.upper("split").alias("split"), F.coalesce("status", F.lit("not_generated")).alias("status"), "completed",
        only(F.col("full")).alias("full"), only(F.col("crossing")).alias("crossing"),
        F.coalesce(only(F.col("made")), F.lit(0)).cast("long").alias("completed_graphs"), F.lit(planned).cast("long").alias("planned_graphs"),
    )
    groups = sources.where(done).select("source_group").distinct().withColumn("has", F.lit(True))
    linked = graphs.join(groups, "source_group", "left")
    return listed, linked.select("graph_id", "source_group", (F.coalesce("has", F.lit(False)) & F.coalesce("arrays", F.lit(False))).alias("completed"))


def catalog_summary(listed: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: sources and graphs planned and completed, contacts of completed sources, and sources of each split."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    here = lambda s: F.col("split") == s
    splits = [F.count_if(cond).alias(f"{s.lower()}_{kind}") for s in SPLITS for kind, cond in (("planned", here(s)), ("completed", here(s) & F.col("completed")))]
    one = listed.agg(
        F.count(F.lit(1)).alias("planned_sources"), F.count_if("completed").alias("completed_sources"), total("planned_graphs").alias("planned_graphs"),
        total("full").alias("full"), total("crossing").alias("crossing"), *splits,
    )
    return one.join(F.broadcast(linked.agg(F.count_if("completed").alias("completed_graphs"))))  # single rows
