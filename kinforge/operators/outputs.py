"""Results as other tools expect them: composed letters, JSON arrays over several text files, side tables of contributors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def composed(values: pd.Series) -> pd.Series:
    """Texts in the composed form of their letters (NFC); null stays null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(rows: DataFrame) -> DataFrame:
    """The rows with every text in composed form, in lists, maps and records too.

    Nested columns go through their JSON text: no sign of its syntax composes with a mark behind it.
    """

    def one(f: T.StructField) -> Column:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.StringType):
            return composed(c).alias(f.name)
        if isinstance(kind, T.ArrayType | T.MapType | T.StructType) and "string" in kind.simpleString():
            return F.from_json(composed(F.to_json(c)), kind).alias(f.name)
        return c

    return rows.select(*[one(f) for f in rows.schema.fields])


def array_lines(rows: DataFrame, order: tuple[str, ...], files: DataFrame | None = None) -> DataFrame:
    """``file, last, order..., line``: each file's records as the lines of one JSON array, by columns whose values differ within a file.

    The first line begins with a bracket, the others with a comma, and one more closes the array.
    ``files`` (file) names those that get an empty array if they have no records. Null parts are left out.
    """
    key = F.struct(*order)
    record = F.to_json(F.struct(*[c for c in rows.columns if c not in ("file", *order)]))
    first = rows.groupBy("file").agg(F.min(key).alias("_first"))
    body = rows.select("file", F.lit(False).alias("last"), *order, record.alias("_json")).join(first, "file")
    body = body.select("file", "last", *order, F.concat(F.when(key == F.col("_first"), "[").otherwise(","), "_json").alias("line"))
    every = first if files is None else first.join(files.select("file").distinct(), "file", "full")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    end = every.select("file", F.lit(True).alias("last"), *[F.lit(None).cast(kinds[c]).alias(c) for c in order], F.when(F.col("_first").isNull(), "[]").otherwise("]").alias("line"))
    return body.unionByName(end)


def write_arrays(rows: DataFrame, path: str, order: tuple[str, ...], files: DataFrame | None = None) -> None:
    """A folder for each file; its text files, put together by name, are one JSON array. No task holds a whole array."""
    keys = ["file", "last", *order]
    lines = array_lines(rows, order, files).repartitionByRange(*keys).sortWithinPartitions(*keys)
    lines.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)


def read_contributors(spark: SparkSession, path: str) -> DataFrame:
    """``contributor, url, intro`` from a JSON object of contributors by name; nothing from a text that is no such object."""
    raw = spark.read.text(path, wholetext=True)
    known = F.from_json("value", "map<string, struct<url: string, intro: string>>")
    return raw.select(F.explode(known).alias("contributor", "of")).select("contributor", "of.url", "of.intro")
