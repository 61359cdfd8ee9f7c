"""One pass of marks over the records serves every way to hide persons, with or without paths."""

from pyspark.sql import functions as F

from kinforge.operators import privacy
from kinforge.sources import ged

LINES = ["0 @I1@ INDI", "1 SEX M", "1 NAME Ana /Kos/", "2 GIVN Ana", "3 NOTE x", "1 NAME Other /Kos/", "1 BIRT", "0 @I2@ INDI", "1 FAMC @F1@", "0 @I3@ INDI", "1 NAME B /C/", "1 DEAT"]


def test_marks_are_shared_and_need_no_path(spark):
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(LINES)], "file string, no long, line string")
    n = ged.lines_to_nodes(lines).drop("path")
    d = privacy.marked(n, privacy.without_death(n))
    rest = ["0  INDI", "1 FAMC @F1@", "0  INDI", "1 NAME B /C/", "1 DEAT "]
    name = {"private": ["1 NAME <private>"], "initials": ["1 NAME A. /K./", "2 GIVN A."], "name": ["1 NAME Ana /Kos/", "2 GIVN Ana", "3 NOTE x"]}
    for how, own in name.items():
        out = privacy.hidden_in_filtered(d, how)
        assert out.columns == n.columns
        got = [r[0] for r in out.orderBy("ord").select(F.concat_ws(" ", F.col("level").cast("string"), F.when(F.col("level") == 0, "").alias("p"), "tag", F.when(F.col("level") > 0, F.coalesce("value", F.lit(""))))).collect()]
        assert got == ["0  INDI", "1 SEX M", *own, rest[0], *(["1 NAME <private>"] if how == "private" else []), *rest[1:]]
