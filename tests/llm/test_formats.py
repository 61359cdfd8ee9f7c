import re

import pytest

from kinforge.llm import op9_pii as op9

VALUES = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "078-05-1120", "2001:db8:85a3:0:0:8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "ana.kovac@mail.example.org", "+33612345678", "10.20.30.40", "4539 1488 0343 6467", "0123456789abcdef0123456789abcdef"]


def spelled(iban):
    whole = re.sub(" ", "", iban)
    return int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4]))


def test_no_value_is_left_and_formats_stay(spark):
    rows = [(i, f"Here is {v}, once more {v}; Ana Kovač wrote it. Kovač knows.", "kept") for i, v in enumerate(VALUES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_entities string")
    out = {r["doc_id"]: r for r in op9.replace(docs).collect()}
    new = []
    for i, v in enumerate(VALUES):
        t = out[i]["text"]
        assert v not in t and "Kovač" not in t and out[i]["n_entities"] == 4
        one, two = re.fullmatch(r"Here is (.*), once more (.*); \S+ (\S+) wrote it\. (\S+) knows\.", t).group(1, 2)
        assert one == two and len(one) == len(v) and [c.isalnum() for c in one] == [c.isalnum() for c in v] or i in (5, 7)
        new.append(one)
    assert spelled(new[0]) % 97 == spelled(new[1]) % 97 == 1 and new[0][:2] == "GB" and new[5].endswith(".org")
    assert len({*new}) == len(new) and docs.columns == op9.replace(docs).columns
    assert {r["text"] for r in op9.replace(docs, secret_key="other").collect()}.isdisjoint(r["text"] for r in out.values())


def test_a_full_format_gets_longer_surrogates(spark):
    ips = [("ssn", f"{i:03d}-00-0000") for i in range(3)]
    assert op9.distinct_surrogates(spark.createDataFrame(ips, "kind string, value string")).select("surrogate").distinct().count() == 3
    digits = spark.createDataFrame([("other", str(i)) for i in range(10)], "kind string, value string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(op9, "ATTEMPTS", 2)
        got = op9.distinct_surrogates(digits).collect()
    assert len({r["surrogate"] for r in got}) == 10 and {r["surrogate"] for r in got}.isdisjoint(r["value"] for r in got)


def test_scopes_of_code_are_no_addresses(spark):
    text = "use a::b and std::c or 1::2, at fe80::1 or 2001:db8::7 or ::1"
    out = op9.replace(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["n_entities"] == 2 and all(x in out["text"] for x in ("a::b", "std::c", "1::2")) and "fe80" not in out["text"] and "2001" not in out["text"]


def test_many_values_and_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Mail a{i % 3}b@x.org and a{i % 3}b@x.org") for i in range(30)], "doc_id long, text string")
    want = {(r["doc_id"], r["text"]) for r in op9.replace(docs).collect()}
    monkeypatch.setattr(op9, "SIDE_LIMIT", 0)
    assert {(r["doc_id"], r["text"]) for r in op9.replace(docs).collect()} == want and len({t for _, t in want}) == 3
    assert op9.replace(docs.limit(0)).count() == 0
