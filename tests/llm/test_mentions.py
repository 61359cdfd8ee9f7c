import re

import pytest

from kinforge.llm import op9_pii as op9


def test_bare_mentions_are_replaced(spark):
    text = "Smith was late. James Smith came. Smith left; James did too, Smithson's and Иван's friend Mary not."
    rows = [(1, text), (2, "The Smith works."), (3, "Herr Wagner kam, 10.0.0.1. Wagner ging")]
    out = {r["doc_id"]: r for r in op9.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = out[1]["text"]
    assert not re.search(r"\b(Smith|James)\b", new) and "Smithson's" in new and "friend Mary not." in new
    given, surname = re.search(r"late\. (\w+) (\w+) came", new).groups()
    assert new == text.replace("James", given).replace("Smithson", "_").replace("Smith", surname).replace("_", "Smithson")
    assert [out[k]["n_entities"] for k in (1, 2, 3)] == [4, 0, 3]
    assert out[2]["text"] == rows[1][1] and "Wagner" not in out[3]["text"]


@pytest.mark.parametrize("number", ["+33612345678", "+4915112345678", "06 12 34 56 78", "+33 6 12 34 56 78", "06.12.34.56.78", "+1 (555) 123-4567", "+49 151 12 34 56 78"])
def test_phone_forms(spark, number):
    r = op9.replace(spark.createDataFrame([(1, f"Call {number}, or not.")], "doc_id long, text string")).first()
    assert r["n_entities"] == 1 and re.fullmatch(re.sub(r"\d", "0", re.escape(f"Call {number}, or not.")).replace("0", r"\d"), r["text"]) and number not in r["text"]
