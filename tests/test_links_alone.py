"""Links and years are told without what nobody asks for: names for years, relatives for links."""

from kinforge.operators import export
from kinforge.sources import ged

TEXT = ["0 @I1@ INDI", "1 NAME A /B/", "1 NOTE https://data.matricula-online.eu/en/a/b/c/MKP-1/?pg=2", "1 FAMS @F1@", "0 @I2@ INDI", "1 NAME NN", "0 @I3@ INDI", "1 NAME private", "1 BIRT", "2 DATE 1800", "1 FAMC @F1@", "0 @F1@ FAM", "1 HUSB @I1@", "1 WIFE @I2@", "1 CHIL @I3@"]


def test_links_are_those_of_persons_and_families(spark):
    n = ged.lines_to_read(spark.createDataFrame([("a", i, x) for i, x in enumerate(TEXT)], "file string, no long, line string")).cache()
    rows = lambda d: sorted(map(str, d.select("file", "id", "links").collect()))
    people, families = export.all_links(n)
    assert rows(people) == rows(export.person_links(n)) == rows(export.persons(n))
    assert rows(families) == rows(export.families(n)) and "MKP-1" in rows(families)[0]
