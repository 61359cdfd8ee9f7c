import re

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = [r["surname"] for r in entry.entry(spark).collect()]
    assert rows and rows == sorted(rows)


def test_names_are_plain():
    assert all(re.fullmatch(r"[a-z0-9_]+", q) for q in entry.queries())
