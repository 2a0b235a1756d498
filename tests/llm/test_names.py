"""Names: every rule, what must stay apart, and odd input."""

from chronoloom.llm.names import deletions, distance, link_names, name_pairs, read_person

SCHEMA = "name string, organisation boolean, n bigint, entity string, kind string"


def links(spark, names, organisations=()):
    rows = [(n, n in organisations, 1, "clash", "clash") for n in names]
    got = link_names(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["name"]: r["entity"] for r in got}


def test_people(spark):
    one = ["Björn Kirelley", "BJÖRN KIRELLEY", "Kirelley, Björn", "KIRELLEY Björn", "Dr. Björn Kirelley", "Bjoern Kirelley", "Bjorn Kirelley", "B. Kirelley", "Kirelley B", "Björn A. Kirelley", "Bjorn Kirellley", "Björn  Kirelley"]
    other = ["Oluwaseun Kirelley", "O. Kirelley", "Oluwaseun Kirlley"]
    third = ["Robert Dopirtini", "Bob Dopirtini", "Rob Dopirtini", "Dopirtini, R."]
    got = links(spark, one + other + third)
    assert len({got[n] for n in one}) == 1 and len({got[n] for n in other}) == 1 and len({got[n] for n in third}) == 1
    assert len(set(got.values())) == 3


def test_composed_and_decomposed_marks_are_two_strings_of_one(spark):
    pair = ("Zoë Zukildadze", "Zoë Zukildadze")
    got = links(spark, pair)
    assert got[pair[0]] == got[pair[1]]


def test_ambiguous_initials_link_to_nobody(spark):
    got = links(spark, ["Samuel Krato", "Susanna Krato", "S. Krato", "Krato, Samuel", "Krato, Susanna"])
    assert got["S. Krato"] not in (got["Samuel Krato"], got["Susanna Krato"])
    assert got["Samuel Krato"] != got["Susanna Krato"]


def test_organisations(spark):
    one = ["Mesonkud Labs", "Mesonkud Laboratories", "Mesonkud Lab", "Mesonkud Labs Inc.", "The Mesonkud Labs", "Mesonkud"]
    two = ["Dopavdom Institute of Memory Systems", "Inst. of Memory Systems Dopavdom", "Dopavdom IMS", "Dopavdom Institute for Memory Systems"]
    three = ["Dopenkud Foundation", "Foundation Dopenkud", "Fundación Dopenkud"]
    four = ["Dopenkud Research Centre", "Dopenkud R.C.", "Dopenkud Res. Ctr.", "Centre of Research Dopenkud", "Dopenkud Research Center"]
    got = links(spark, [*one, *two, *three, *four, "Dopenkud"], {*one, *two, *three, *four, "Dopenkud"})
    assert [len({got[n] for n in x}) for x in (one, two, three, four)] == [1, 1, 1, 1]
    assert len({got[x[0]] for x in (one, two, three, four)}) == 4
    assert got["Dopenkud"] not in (got[three[0]], got[four[0]])  # two could be meant


def test_odd_input(spark):
    assert links(spark, []) == {}
    got = links(spark, [None, "", "   ", "et al.", "123", "?", "X", "Ann Lee", "Ann Lee", "a" * 5000, "Ann " + "Lee " * 300])
    assert "Ann Lee" in got and "et al." not in got and "" not in got
    pairs = name_pairs(link_names(spark.createDataFrame([("Ann Lee", False, 1, "", ""), ("Lee, Ann", None, 2, "", "")], SCHEMA))).collect()
    assert [tuple(p) for p in pairs] == [("Ann Lee", "Lee, Ann")]


def test_pieces():
    assert distance("robert", "robret") == 1 and distance("a", "a") == 0 and distance("kirelley", "kirellley") == 1
    assert deletions("ab", 1) == {"ab", "a", "b"}
    assert read_person("J.L. Stagelund")["initial"] == "j" and read_person("42") is None


def test_long_parts_meet_over_pieces_at_bounded_cost():
    from random import Random

    from chronoloom.llm.names import PIECED, edit_keys

    rng = Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    for n in (PIECED - 3, PIECED - 1, PIECED, PIECED + 1, PIECED + 3, 200):
        for _ in range(60):
            a = b = word(n)
            for _ in range(2):
                i = rng.randrange(len(b) - 1)
                b = rng.choice((b[:i] + b[i + 1 :], b[:i] + "k" + b[i:], b[:i] + b[i + 1] + b[i] + b[i + 2 :], b[:i] + "k" + b[i + 1 :]))
            assert edit_keys(a, 2) & edit_keys(b, 2)
    assert len(edit_keys(word(5000), 2)) <= 125


def test_forms_one_letter_off_and_run_together():
    from chronoloom.llm.names import FORMS, form_of, one_edit, read_organisation

    assert read_organisation("Dopenkud ReseachCentre") == ["dopenkud", "research", "centre"]
    assert form_of("laboratoires") == form_of("laboratorie") == "labs" and form_of("observatories") == "observatories" and form_of("x" * 5000) == "x" * 5000
    for x in ("fundation", "reserach", "univeristy", "academyy", "institut", "socitey"):
        assert form_of(x) in FORMS or not any(one_edit(f, x) for f in FORMS)


def test_a_mistyping_counts_by_the_rarity_of_its_target(spark):
    names = ["Ann Kirelley", "Kirelley, Ann", "Ann Kirellley", "Ada Stagelund", "Stagelund, Ada"]
    got = {r["name"]: r for r in link_names(spark.createDataFrame([(n, False, 1, "", "") for n in names], SCHEMA)).collect()}
    assert got["Ann Kirellley"]["entity"] == got["Ann Kirelley"]["entity"] and got["Ann Kirellley"]["confidence"] < got["Ann Kirelley"]["confidence"] == 1
    assert all(0 < r["confidence"] <= 1 for r in got.values())


def test_classes_and_pairs_of_an_entity_with_many_names(spark, monkeypatch):
    from chronoloom.llm import names as module

    monkeypatch.setattr(module, "SHARE", 5)
    links = spark.createDataFrame([(f"n{i:02d}", "e", "p") for i in range(23)] + [("solo", "f", "p")], "name string, entity string, kind string")
    pairs = [tuple(r) for r in module.name_pairs(links).collect()]
    assert len(pairs) == len(set(pairs)) == 23 * 22 // 2
    assert {r["name"]: r["links"] for r in module.name_classes(links).collect()} == {f"n{i:02d}": 22 for i in range(23)} | {"solo": 0}
