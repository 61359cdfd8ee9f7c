from kinforge.llm import op9_pii as op9


def test_given_names_stay_apart(spark):
    names = [n for group in op9.GIVEN.values() for n in group]
    for key in (op9.KEY, "another"):
        got = {r["value"]: r["surrogate"] for r in op9.distinct_surrogates(spark.createDataFrame([("token", n) for n in names], "kind string, value string"), key).collect()}
        assert len(set(got.values())) == len(names) == len(got)
        assert all(got[n] != n and got[n] in group for group in op9.GIVEN.values() for n in group)
