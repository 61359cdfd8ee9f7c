"""Results of files kept up to date: arrivals as a stream, changes by their times.

Each file's results are one partition, which a later run of the file replaces, so a batch that is done
again after a failure leaves the same result. What is done stands in a table of (file, finished), where
``finished`` is the time of the input that was read; a file is done again only if it is newer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators import increments
from kinforge.operators.checkpoints import cut
from kinforge.sources import ged

PATTERN = "*.[gG][eE][dD]"
RAW = "path string, modificationTime timestamp, length long, content binary"
DONE = "file string, finished timestamp"
#: files of one batch; their texts and nodes are what a batch holds
MOST = 1000


def _named(raw: DataFrame) -> DataFrame:
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("modificationTime").alias("modified"), ged.decode_udf("content").alias("text"))


def arrivals(spark: SparkSession, path: str, pattern: str = PATTERN, most: int = MOST) -> DataFrame:
    """A stream of ``file, modified, text`` of the files that come into a folder."""
    stream = spark.readStream.format("binaryFile").schema(RAW).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(most))
    return _named(stream.load(path))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def done(spark: SparkSession, path: str) -> DataFrame:
    """``file, finished`` of what is done; empty at first."""
    return spark.read.schema(DONE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], DONE)


def apply(files: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, state: str, forced: list[str] | None = None) -> None:
    """Convert those of ``files`` (file, modified, text) that are not done, replace their partitions, and note them as done.

    ``convert`` takes (file, text) and returns rows with a column file. A file without rows loses what
    an earlier run of it left.
    """
    spark = files.sparkSession
    todo = increments.stale(files.select("file", "modified"), done(spark, state), forced).groupBy("file").agg(F.max("modified").alias("modified"))
    todo = cut(todo)
    if todo.isEmpty():
        return
    newest = files.join(todo, ["file", "modified"], "left_semi").dropDuplicates(["file"])
    rows = convert(newest.select("file", "text"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)
    written = spark.read.parquet(out).select(F.col("file").cast("string")).distinct() if _exists(spark, out) and rows.columns and _has_data(spark, out) else todo.select("file").limit(0)
    gone = todo.join(cut(rows.select("file").distinct()), "file", "left_anti").join(written, "file", "left_semi")
    for r in gone.select("file").collect():  # file names of one batch
        _delete(spark, f"{out}/file={_escaped(spark, r['file'])}")
    todo.select("file", F.col("modified").alias("finished")).write.mode("append").parquet(state)


def _has_data(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any(x.isDirectory() and x.getPath().getName().startswith("file=") for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))


def _escaped(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def keep_up(spark: SparkSession, path: str, convert: Callable[[DataFrame], DataFrame], out: str, state: str, checkpoint: str, pattern: str = PATTERN, most: int = MOST) -> None:
    """Work off all files that have come since the last call, in batches of ``most``; the checkpoint tells which have been seen."""
    query = arrivals(spark, path, pattern, most).writeStream.foreachBatch(lambda batch, _: apply(batch, convert, out, state)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def catch_up(spark: SparkSession, path: str, convert: Callable[[DataFrame], DataFrame], out: str, state: str, forced: list[str] | None = None, pattern: str = PATTERN) -> None:
    """Work off files of a folder that have changed since they were done, which a stream of arrivals does not tell, and those named.

    Times are compared first, without reading the files; contents are read from the oldest changed time on.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    listed = raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("modificationTime").alias("modified"))
    todo = cut(increments.stale(listed, done(spark, state), forced))
    oldest = todo.agg(F.min("modified")).first()[0]
    if oldest is not None:
        new = _named(raw.where(F.col("modificationTime") >= F.lit(oldest))).join(todo, ["file", "modified"], "left_semi")
        apply(new, convert, out, state, forced)
