"""The living, against passes over the persons one after another."""

import random
import re

import pytest

from kinforge.operators import privacy, process
from kinforge.sources import ged

AS_OF, N = 2020, 100


def tree_text(people, families):
    """GED lines of people {id: children lines} and families {id: [(tag, id)]}."""
    out = ["0 HEAD"]
    for i, lines in people.items():
        out += [f"0 @{i}@ INDI", *lines]
    for f, members in families.items():
        out += [f"0 @{f}@ FAM", *[f"1 {t} @{i}@" for t, i in members]]
    return "\n".join([*out, "0 TRLR", ""])


def by_hand(people, families, hides=True):
    """Who is hidden, by visiting the persons in order until a pass hides nobody."""
    year = {i: next((int(x.split()[-1]) for x in lines if x.startswith("2 DATE")), None) for i, lines in people.items()}
    dead = {i for i, lines in people.items() if "1 DEAT Y" in lines}
    marked = {i for i, lines in people.items() if any(re.search("living", x) for x in lines)}
    named = {i for i, lines in people.items() if "1 NAME <private>" in lines}
    hidden, gone = set(named), set()
    for _ in range(20):
        before = len(gone)
        for i, lines in people.items():
            if i in named or i in gone:
                continue
            hit = i in marked
            if not hit and i not in dead and year[i] is not None:
                hit = AS_OF - year[i] < N
            elif not hit and i not in dead:
                guesses = []
                for x in lines:
                    home, _, f = x[2:].partition(" ")
                    if home not in ("FAMC", "FAMS") or f.strip("@") not in families:
                        continue
                    there = [(t, m) for t, m in families[f.strip("@")] if m in people]
                    pair, young = [m for t, m in there if t != "CHIL"], [m for t, m in there if t == "CHIL"]
                    if home == "FAMC":
                        hit |= bool(pair) and all(m in hidden for m in pair)
                        guesses += [year[m] + 35 for m in pair if year[m] and m not in gone]
                    else:
                        hit |= any(m in hidden for m in pair if m != i) or bool(young) and all(m in hidden for m in young)
                        guesses += [year[m] - 35 for m in young if year[m] and m not in gone]
                hit |= bool(guesses) and AS_OF - min(guesses) < N
            if hit:
                gone.add(i)
                if hides:
                    hidden.add(i)
        if len(gone) == before:
            break
    return gone


def random_tree(rng):
    ids = [f"I{k}" for k in range(rng.randrange(2, 26))]
    people, families = {i: [f"1 NAME P{i} /X/"] for i in ids}, {}
    for k in range(rng.randrange(1, 14)):
        members = [("HUSB" if rng.random() < 0.5 else "WIFE", i) for i in rng.sample(ids, min(len(ids), rng.choice([1, 2, 2])))] + [("CHIL", i) for i in rng.sample(ids, min(len(ids), rng.randrange(0, 4)))]
        families[f"F{k}"] = members + ([("CHIL", "nobody")] if rng.random() < 0.1 else [])
        for t, i in members:
            people[i].append(f"1 {'FAMC' if t == 'CHIL' else 'FAMS'} @F{k}@")
    for i in ids:
        if rng.random() < 0.3:
            people[i] += ["1 BIRT", f"2 DATE {rng.choice([1850, 1880, 1900, 1915, 1925, 1950, 1990])}"]
        if rng.random() < 0.2:
            people[i].append("1 DEAT Y")
        if rng.random() < 0.05:
            people[i].append("1 NOTE living, no details")
        elif rng.random() < 0.05:
            people[i][0] = "1 NAME <private>"
    order = ids[:]
    rng.shuffle(order)
    return {i: people[i] for i in order}, families


@pytest.mark.parametrize("hides", [True, False])
def test_random_trees_as_by_hand(spark, hides):
    rng = random.Random(11 + hides)
    trees = {f"{k}.ged": random_tree(rng) for k in range(400)}
    n = ged.text_to_nodes(spark.createDataFrame([(f, tree_text(*t)) for f, t in trees.items()], "file string, text string"))
    heads = n.where("level = 0 and tag = 'INDI'").select("file", "rec", "pointer")
    got = {(r["file"], r["pointer"].strip("@")) for r in privacy.living(n, AS_OF, N, hides_names=hides).join(heads, ["file", "rec"]).collect()}
    assert got == {(f, i) for f, t in trees.items() for i in by_hand(*t, hides)}
    assert len(got) > 500


def hidden(spark, people, families=None):
    n = ged.text_to_nodes(spark.createDataFrame([("a.ged", tree_text(people, families or {}))], "file string, text string"))
    heads = n.where("level = 0 and tag = 'INDI'").select("file", "rec", "pointer")
    return {r["pointer"].strip("@") for r in privacy.living(n, AS_OF, N).join(heads, ["file", "rec"]).collect()}


def test_undated_spouse_of_a_hidden_person_is_hidden_and_years_do_not_chain(spark):
    couple = {"A": ["1 NAME Ada /Z/", "1 BIRT", "2 DATE 1990", "1 FAMS @F@"], "B": ["1 NAME Bor /Z/", "1 FAMS @F@"]}
    assert hidden(spark, couple, {"F": [("HUSB", "B"), ("WIFE", "A")]}) == {"A", "B"}
    line = {"A": ["1 NAME A /Z/", "1 BIRT", "2 DATE 1870", "1 FAMS @F@"], "B": ["1 NAME B /Z/", "1 FAMC @F@", "1 FAMS @G@"], "C": ["1 NAME C /Z/", "1 FAMC @G@", "1 FAMS @H@"], "D": ["1 NAME D /Z/", "1 FAMC @H@"]}
    assert hidden(spark, line, {"F": [("HUSB", "A"), ("CHIL", "B")], "G": [("HUSB", "B"), ("CHIL", "C")], "H": [("HUSB", "C"), ("CHIL", "D")]}) == set()


def test_single_persons(spark):
    date = lambda tag, d, *more: [f"1 {tag}", f"2 DATE {d}", *more]
    people = {
        "A": ["1 NAME A /Z/", *date("BIRT", 1990)], "B": ["1 NAME B /Z/", *date("BIRT", 1900)], "C": ["1 NAME C /Z/", *date("BIRT", 1990), *date("DEAT", 2001)],
        "D": ["1 NAME D /Z/"], "E": ["1 NAME Living /Z/", *date("BIRT", 1700)], "F": ["1 NAME Privatov /Z/"], "G": ["1 NAME G /Z/", "1 BIRT", *date("BAPM", 1995)],
        "H": ["1 NAME H /Z/", *date("BIRT", 1700), *date("BIRT", "19__")], "I": ["1 NAME I /Z/", *date("BIRT", "ABT 185_")], "J": ["1 NAME J /Z/", *date("BIRT", 1990), "1 DEAT N"], "K": ["1 NAME K /privat/"],
    }
    assert hidden(spark, people) == {"A", "E", "G", "H", "J", "K"}


def test_no_people_and_dangling_pointers(spark):
    assert hidden(spark, {}) == set()
    assert hidden(spark, {"A": ["1 NAME A /Z/", "1 FAMC @F@", "1 FAMS @none@"]}, {"F": [("HUSB", "gone"), ("WIFE", "lost")]}) == set()


def test_whole_run_hides_in_all_forms(spark):
    couple = {"A": ["1 NAME Ada /Zor/", "1 BIRT", "2 DATE 1990", "1 FAMS @F@"], "B": ["1 NAME Bor /Zor/", "1 FAMS @F@"]}
    n = ged.text_to_nodes(spark.createDataFrame([("a.ged", tree_text(couple, {"F": [("HUSB", "B"), ("WIFE", "A")]}))], "file string, text string"))
    names = lambda how: [r["value"] for r in process.hide(n, how, AS_OF).where("tag = 'NAME'").orderBy("ord").collect()]
    assert names("living100y_private") == ["<private>", "<private>"]
    assert names("living100y_initials") == ["A. /Z./", "Bor /Zor/"]
    assert names("living100y_name_only") == ["A. /Zor/", "Bor /Zor/"]
