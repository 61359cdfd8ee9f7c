"""What has to be done again: files without a result, changed since their result, or named by the user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(files: DataFrame, done: DataFrame, forced: list[str] | None = None) -> DataFrame:
    """``file, modified`` to be processed; ``done`` is (file, finished), compared by the file's name without regard to case."""
    key = F.lower(F.col("file").cast("string"))
    last = done.groupBy(key.alias("_k")).agg(F.max("finished").alias("finished"))
    wanted = F.lower(F.col("file").cast("string")).isin([f.lower() for f in forced or []])
    d = files.withColumn("_k", key).join(last, "_k", "left")
    return d.where(F.col("finished").isNull() | (F.col("modified") > F.col("finished")) | wanted).select(*files.columns)


def stale_groups(inputs: DataFrame, outputs: DataFrame, key: str = "folder") -> DataFrame:
    """The groups of inputs (key, modified) without any output (key, modified), or whose newest input is newer than their oldest output.

    A group with some outputs may lack others: those have no records.
    """
    newest = inputs.groupBy(key).agg(F.max("modified").alias("_in"))
    oldest = outputs.groupBy(key).agg(F.min("modified").alias("_out"))
    return newest.join(oldest, key, "left").where(F.col("_out").isNull() | (F.col("_out") < F.col("_in"))).select(key)
