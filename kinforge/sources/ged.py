"""Reading line-oriented tree files: decoding, lines, nodes, records, writing.

``nodes`` is the canonical table: file, rec (record number), ord (place in the file, with room for
generated nodes between), parent (the ord of the parent), level, pointer, tag, value, rec_tag and
path (the ords from the record's line down to the node).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.sources import charsets

#: fixed values: header names of character sets and their codecs
CHARSETS = {
    "UTF-8": "utf-8", "UTF8": "utf-8", "UNICODE": "utf-16", "UTF-16": "utf-16", "ASCII": "ascii", "ANSI_1250": "cp1250", "CP1250": "cp1250", "WINDOWS-1250": "cp1250",
    "CP1251": "cp1251", "WINDOWS-1251": "cp1251", "CP1252": "cp1252", "WINDOWS-1252": "cp1252", "ISO-8859-1": "latin-1", "ISO8859-1": "latin-1", "LATIN1": "latin-1", "LATIN-1": "latin-1", "ISO-8859-2": "iso8859-2",
    "IBM": "cp437", "IBMPC": "cp437", "IBM-PC": "cp437", "OEM": "cp437", "MAC": "mac_roman", "MACOS": "mac_roman", "MACINTOSH": "mac_roman", "ANSEL": "ansel",
}
CHAR_LINE = re.compile(rb"(?im)^\s*\d\s+CHAR\s+(.+?)\s*$")
LINE = r"^\s*(\d{1,2})\s+(?:(@[^@]+@)\s+)?(\S+)(?: (.*))?$"
RECORD = r"^\s*00?\s+\S"
MAX_LEVEL = 9
#: line numbers that one task counts records in
RANGE = 1 << 16


def header_codec(raw: bytes) -> tuple[str | None, str | None]:
    """The header's character set by name, and its codec where the name is known and the bytes do not belie it.

    A header that can be read byte by byte is not in UTF-16, and ANSEL has no bytes from 0x80 to 0x9F.
    """
    named = CHAR_LINE.search(raw[:4096])
    name = named[1].decode("latin-1").upper() if named else None
    codec = CHARSETS.get(name)
    return name, None if codec == "utf-16" or codec == "ansel" and not charsets.is_ansel(raw) else codec


def decode(raw: bytes) -> str:
    """Text of a file: by the marks at its start, else by the header's character set, else by its bytes.

    UTF-8 that does not fit is windows-1250 if it shows that set's letters, else it is read with
    replacements if there are few, else by its bytes.
    """
    raw = bytes(raw)
    if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
        text = raw.decode("utf-16", "replace").replace("\0", "")
    else:
        raw = raw.replace(b"\0", b"")
        if b"\n" not in raw:
            raw = raw.replace(b"\r", b"\n")
        before = None
        while raw != before:  # a sign of several bytes that a continuation line has cut in two
            before, raw = raw, re.sub(rb"([\x80-\xff])\r?\n\d+ CONC ([\x80-\xbf])", rb"\1\2", raw)
        text = _decoded(raw)
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _decoded(raw: bytes) -> str:
    name, codec = header_codec(raw)
    if charsets.has_prefix_letters(raw, name):
        return charsets.from_prefix_letters(raw)
    codec = "utf-8-sig" if raw.startswith(b"\xef\xbb\xbf") else codec or charsets.guessed(raw)
    if codec == "ansel":
        return charsets.from_ansel(raw)
    if codec.startswith("utf-8"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            lenient = raw.decode(codec, "replace")
            if not charsets.looks_like_1250(raw) and lenient.count("\ufffd") < max(10, len(raw) // 1000):
                return lenient
            codec = charsets.guessed(raw)
    return (raw.translate(charsets.DOS_BYTES) if codec == "cp1250" else raw).decode(codec, "replace")


@F.pandas_udf(T.StringType())
def decode_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raw in batches:
        yield raw.map(decode)


def fix_1252_as_1250(text):
    """Letters that windows-1252 shows for windows-1250 bytes, only where some are present."""
    return F.when(text.rlike("[èÈæÆ]"), F.translate(text, "èÈæÆ", "čČćĆ")).otherwise(text)


def read_files(spark: SparkSession, path: str, pattern: str = "*.[gG][eE][dD]") -> DataFrame:
    """``file, modified, text`` of every file below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("modificationTime").alias("modified"), decode_udf("content").alias("text"))


def lines_to_nodes(lines: DataFrame) -> DataFrame:
    """``file, no, line`` to nodes. Lines that do not fit the grammar continue the value of the line before them."""
    place = "decimal(20,6)"
    above = [F.when(F.col("level") >= k, F.col(f"a{k}")) for k in range(MAX_LEVEL + 1)]
    path = F.filter(F.array(*above), lambda x: x.isNotNull())
    for k in (3, 2, 1, 0):  # no level is missing as a rule
        path = F.when((F.col("level") == k) & reduce(and_, [F.col(f"a{i}").isNotNull() for i in range(k + 1)]), F.array(*[F.col(f"a{i}") for i in range(k + 1)])).otherwise(path)
    return _placed(lines).select("file", "rec", F.col("no").cast(place).alias("ord"), _parent().cast(place).alias("parent"), "level", "pointer", "tag", "value", "rec_tag", path.cast(f"array<{place}>").alias("path"))


def lines_to_read(lines: DataFrame, marks: dict[str, Column] | None = None, heads: dict[str, Column] | None = None) -> DataFrame:
    """Nodes that are only read: places are the line numbers themselves, as nothing is put between them, and there is no path.

    ``marks`` and ``heads`` are aggregates over the nodes of each record, which lie together here and need no
    shuffle for them: by ``no``, ``level``, ``tag``, ``value`` and the columns of ``with_top``. The first stand at every node, the others at the record's own line.
    """
    marks, heads = marks or {}, heads or {}
    d = _placed(lines, ("rec", "file"), marks | heads)
    told = [*marks, *[F.when(F.col("level") == 0, F.col(c)).alias(c) for c in heads]]
    return d.select("file", "rec", F.col("no").cast("long").alias("ord"), _parent().cast("long").alias("parent"), "level", "pointer", "tag", "value", "rec_tag", *told)


def _tops(so_far: WindowSpec, place: str) -> list[Column]:
    return [F.last(F.when(F.col("level") == 1, F.col(c)), True).over(so_far).alias(name) for c, name in (("tag", "top"), (place, "at"))]


def with_top(nodes: DataFrame) -> DataFrame:
    """The nodes with ``top`` and ``at``: tag and place of the element of level 1 that they are or stand below."""
    return nodes.select("*", *_tops(W.partitionBy("rec", "file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0), "ord"))


def _parent() -> Column:
    """The latest line of a higher level in the record; levels beyond the deepest count as that one."""
    up = F.coalesce(*[F.when(F.col("level") > k, F.col(f"a{k}")) for k in reversed(range(MAX_LEVEL))])
    deepest = F.filter(F.array(*[F.col(f"a{k}") for k in range(MAX_LEVEL + 1)]), lambda x: x.isNotNull())
    return F.when(F.col("level").between(1, MAX_LEVEL), up).when(F.col("level") > MAX_LEVEL, F.try_element_at(deepest, F.greatest(F.size(deepest) - 1, F.lit(1))))


def _placed(lines: DataFrame, record: tuple[str, str] = ("file", "rec"), told: dict[str, Column] | None = None) -> DataFrame:
    """``file, rec, no, level, pointer, tag, value, rec_tag`` and ``a0`` to ``a9``, the latest line of each level so far in the record.

    Record starts are counted for ranges of line numbers, so that a file of any size is read by
    many tasks; everything below a record is worked out within it. The counts and the lines come from
    one shuffle, so the lines are made once. Sorts tell rows apart by their first key: numbers stand before
    the file's name, save where what follows needs records in the order of ``record``. ``told`` are aggregates over each record.
    """
    d = lines.where(F.trim("line") != "").select("file", F.floor(F.col("no") / RANGE).alias("_range"), "no", "line").where("file is not null and _range is not null").repartition("_range", "file")
    # the last number says where a range ends; it keeps the columns those of the lines, which lets both read the same shuffle
    ranges = d.groupBy("file", "_range").agg(F.sum(F.col("line").rlike(RECORD).cast("long")).alias("n"), F.max("no").alias("_last"))
    earlier = W.partitionBy("file").orderBy("_last").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("file", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    d = d.join(ranges, ["_range", "file"])
    d = d.select("file", "_range", "_before", "no", "line", _parts().alias("_parts"))
    d = d.select("file", "_range", "_before", "no", "line", "_parts", F.when(F.size("_parts") == 4, F.col("_parts")[0].try_cast("int")).alias("level"))
    fits, part = F.col("level").isNotNull(), lambda i: F.col("_parts")[i]
    d = d.select("file", "_range", "_before", "no", "level", F.when(fits, F.nullif(part(1), F.lit(""))).alias("pointer"), F.when(fits, part(2)).otherwise("CONC").alias("tag"), F.when(fits, part(3)).otherwise(F.col("line")).alias("value"))
    rec = F.col("_before") + F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(W.partitionBy("_range", "file").orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    d = d.select("file", rec.alias("rec"), "no", "level", "pointer", "tag", "value")
    so_far = W.partitionBy(*record).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    # lines that do not fit are of level 1 only before any that does, so these say what stands above
    d = d.select("file", "rec", "no", F.coalesce("level", F.last("level", True).over(so_far) + 1).alias("level"), "pointer", "tag", "value", *_tops(so_far, "no"))
    whole = so_far.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    above = [F.last(F.when(F.col("level") == k, F.col("no")), True).over(so_far).alias(f"a{k}") for k in range(MAX_LEVEL + 1)]
    return d.select("*", F.first("tag").over(so_far).alias("rec_tag"), *above, *[c.over(whole).alias(name) for name, c in (told or {}).items()])


def _parts() -> Column:
    """Level, pointer, tag and value of a line in one reading of it; something else than four parts where it does not fit."""
    apart = F.split(F.regexp_replace("line", LINE + "(?s:.*)", "$1\n$2\n$3\n$4"), "\n", 4)
    return F.when(F.contains("line", F.lit("\n")), F.array(*[F.regexp_extract("line", LINE, i) for i in range(1, 5)])).otherwise(apart)


def text_to_nodes(files: DataFrame) -> DataFrame:
    """``file, text`` to nodes."""
    return lines_to_nodes(files.select("file", F.posexplode(F.split("text", "\n")).alias("no", "line")))


def serialize(nodes: DataFrame) -> DataFrame:
    """``file, text``: the nodes in order as lines, for files that fit a row; ``write`` is for any size."""
    line = F.concat_ws(" ", F.col("level").cast("string"), "pointer", "tag", F.nullif("value", F.lit("")))
    per = nodes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return per.select("file", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def write(nodes: DataFrame, path: str) -> None:
    """A folder for each file, with its lines in order over text files that sort by name; no task holds a whole file."""
    line = F.concat_ws(" ", F.col("level").cast("string"), "pointer", "tag", F.nullif("value", F.lit("")))
    lines = nodes.repartitionByRange("file", "ord").sortWithinPartitions("file", "ord")
    lines.select("file", line.alias("value")).write.partitionBy("file").text(path)


def utf8_header(nodes: DataFrame) -> DataFrame:
    """The first CHAR of each file says UTF-8."""
    first = nodes.where(F.col("tag") == "CHAR").groupBy("file").agg(F.min("ord").alias("_c"))
    return nodes.join(first, "file", "left").withColumn("value", F.when(F.col("ord") == F.col("_c"), "UTF-8").otherwise(F.col("value"))).select(*nodes.columns)


def full_text(nodes: DataFrame) -> DataFrame:
    """``file, ord, text``: each node's value with its continuations, CONC raw and CONT behind a space."""
    parts = nodes.where(F.col("tag").isin("CONC", "CONT")).groupBy("file", F.col("parent").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.when(F.col("tag") == "CONT", " ").otherwise(""), F.coalesce("value", F.lit(""))).alias("v")))).alias("p"))
    own = nodes.where(~F.col("tag").isin("CONC", "CONT")).select("file", "ord", "value")
    return own.join(parts, ["file", "ord"], "left").select("file", "ord", F.concat(F.coalesce("value", F.lit("")), F.coalesce(F.array_join(F.transform("p", lambda x: x["v"]), ""), F.lit(""))).alias("text"))


def software(nodes: DataFrame) -> DataFrame:
    """``file, name, version, corporation`` from the header alone."""
    head = nodes.where((F.col("rec") == 1) & (F.col("rec_tag") == "HEAD"))
    sour = head.where((F.col("tag") == "SOUR") & (F.col("level") == 1)).select("file", F.col("ord").alias("s"), F.col("value").alias("source"))
    below = head.where(F.col("level") == 2).join(sour, "file").where(F.col("parent") == F.col("s"))

    def pick(tag: str):
        return F.coalesce(F.max(F.when(F.col("tag") == tag, F.col("value"))), F.lit(""))

    named = below.groupBy("file").agg(pick("NAME").alias("name"), pick("VERS").alias("version"), pick("CORP").alias("corporation"))
    return nodes.select("file").distinct().join(named, "file", "left").na.fill("", ["name", "version", "corporation"])
