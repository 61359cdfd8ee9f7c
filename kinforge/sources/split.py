"""Lines of files of any size, read in byte ranges by many tasks.

Spark's text reader hands out the ranges and keeps a line's bytes as they are. One pass numbers the
lines, joins signs that a continuation has cut in two, and counts what tells a file's character set;
the counts of a file are added up, its set is settled as in ``ged.decode``, and its lines are decoded.
A line's number is the start of its range and its place there, so numbers rise through the file. A sign
cut in two just where a range ends stays cut. Files in UTF-16 have other line ends and are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.operators.checkpoints import cut
from kinforge.sources import charsets, ged

COUNTS = ("pairs", "slavic", "high", "runs", "west", "central", "bad", "size")
SIGNS = ("c1", "disguised")
PASSED = f"file string, no long, raw binary, start binary, {', '.join(f'{c} long' for c in COUNTS)}, {', '.join(f'{c} boolean' for c in SIGNS)}"
#: bytes of a file's start in which its header is looked for
HEAD = 4096
_BEGINS = re.compile(rb"^\d+ CONC (?=[\x80-\xbf])")


def signs(raw: bytes) -> tuple:
    """What a line says about the character set of its file, in the order of ``COUNTS`` and ``SIGNS``."""
    if raw.isascii():
        return (0,) * (len(COUNTS) - 1) + (len(raw) + 1, False, False)
    line = b"\n" + raw + b"\n"
    west, central = raw.decode("cp1252", "replace"), raw.decode("cp1250", "replace")
    return (
        len(charsets._PAIRS.findall(raw)), len(charsets._SLAVIC.findall(raw)), len(re.findall(rb"[\x80-\xff]", raw)), sum(len(x) for x in charsets._CYRILLIC.findall(raw)),
        len(charsets._WESTERN.findall(west)), len(charsets._CENTRAL.findall(central)), raw.decode("utf-8", "replace").count("�"), len(raw) + 1, not charsets.is_ansel(raw), charsets.looks_like_1250(line),
    )


def passed(raw: DataFrame) -> DataFrame:
    """Numbered lines with what they say; ``raw`` is (file, block, value), in the order in which a range is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, i, held = None, 0, None
        for d in batches:
            out = []
            for file, block, value in zip(d["file"], d["block"], d["value"]):
                value = bytes(value).replace(b"\0", b"")
                if (file, block) != key:
                    if held is not None:
                        out.append(held)
                    key, i, held = (file, block), 0, None
                cut_sign = held is not None and held[2][-1:] >= b"\x80" and _BEGINS.match(value)
                if cut_sign:
                    held = (*held[:2], held[2] + value[cut_sign.end() :])
                else:
                    if held is not None:
                        out.append(held)
                    held = (file, block + i, value)
                i += 1
            yield _frame(out)
        if held is not None:
            yield _frame([held])

    return raw.mapInPandas(run, PASSED)


def _frame(lines: list[tuple]) -> pd.DataFrame:
    names = ["file", "no", "raw", "start", *COUNTS, *SIGNS]
    return pd.DataFrame([(f, no, raw, raw if no < HEAD else None, *signs(raw)) for f, no, raw in lines], columns=names)


def settled(start: list[bytes], **n: int) -> str:
    """The codec of a file, by its first lines and the sums over all of its lines."""
    first = b"\n".join(start)
    named = ged.CHAR_LINE.search(first[:HEAD])
    name = named[1].decode("latin-1").upper() if named else None
    codec = ged.CHARSETS.get(name)
    if codec == "utf-16" or codec == "ansel" and n["c1"]:
        codec = None
    if name in (None, "UTF-8", "UTF8") and n["pairs"] >= charsets.MANY_PAIRS and n["pairs"] >= n["slavic"]:
        return "prefix"
    if not n["bad"]:
        likely = "utf-8"
    elif n["high"] >= 20 and n["runs"] > 0.8 * n["high"]:
        likely = "cp1251"
    else:
        likely = "cp1252" if not n["disguised"] and n["west"] > 2 * n["central"] + 1 else "cp1250"
    codec = "utf-8" if first.startswith(b"\xef\xbb\xbf") else codec or likely
    if codec == "utf-8" and n["bad"] and (n["disguised"] or n["bad"] >= max(10, n["size"] // 1000)):
        return likely
    return codec


def decoded(raw: bytes, codec: str) -> str:
    if codec == "prefix":
        return charsets.from_prefix_letters(raw)
    if codec == "ansel":
        return charsets.from_ansel(raw)
    return (raw.translate(charsets.DOS_BYTES) if codec == "cp1250" else raw).decode(codec, "replace")


@F.pandas_udf(T.StringType())
def _decode(raw: pd.Series, codec: pd.Series) -> pd.Series:
    return pd.Series([decoded(bytes(r), c) for r, c in zip(raw, codec)], dtype=object)


@F.pandas_udf(T.StringType())
def _settle(counts: pd.DataFrame) -> pd.Series:
    return pd.Series([settled([bytes(x["raw"]) for x in r.pop("start")], **r) for r in counts.to_dict("records")], dtype=object)


def _name(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1)


def read_lines(spark: SparkSession, path: str, pattern: str = "*.[gG][eE][dD]") -> DataFrame:
    """``file, no, line`` of every file below a folder, for ``ged.lines_to_nodes``."""
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    d = text.select(_name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    lines = cut(passed(d))
    per_file = lines.groupBy("file").agg(
        F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("no", F.col("start").alias("raw"))))).alias("start"), *[F.sum(c).alias(c) for c in COUNTS], *[F.bool_or(c).alias(c) for c in SIGNS]
    )
    wide = F.get("start", F.lit(0))["raw"]
    other = F.coalesce(F.startswith(wide, F.lit(b"\xff")) | F.startswith(wide, F.lit(b"\xfe")), F.lit(False))
    codecs = cut(per_file.select("file", F.when(other, None).otherwise(_settle(F.struct("start", *COUNTS, *SIGNS))).alias("codec")))
    plain = lines.join(codecs.where("codec is not null"), "file").select("file", "no", F.regexp_replace(_decode("raw", "codec"), "^﻿", "").alias("line"))
    rest = codecs.where("codec is null").select("file")
    if rest.isEmpty():
        return plain
    whole = ged.read_files(spark, path, pattern).join(rest, "file", "left_semi")
    return plain.unionByName(whole.select("file", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no").cast("long")))
