"""Scanned pages: what is found on made pages, clean text left alone, odd input."""

from chronoloom.llm.scans import faulty_lines, page_value, paragraphs, repair_cost, skeleton

S = "id string, text string, page int, paper_id string, kind string, line int, word string"
CLEAN = "the memory index evaluates the knowledge graph and the ranking function remains stable under the construction of a non-monotonic operator . "


def page(n):
    return [f"{n}   A. Author et al." if n % 2 == 0 else f"A study of graphs   {n}" if n > 1 else "A study of graphs"]


def body(n):
    """Lines of a page; the first and last differ from page to page."""
    own = ("alpha beta", "gamma delta", "epsilon zeta", "theta iota")[n - 1]
    return [
        f"The {own} index evaluates the knowledge graph and the rank-",
        *BODY,
        f"and of the {own} index of the knowledge graph constru-",
    ]


BODY = [
    "ing function remains stable under the construct1on of a non-",
    "monotonic operator and the ra~nking function of the graph",
    "and the memory index evaluates the knowledge graph at all",
    "times under the \ufb01xed construction of the ranking function",
]


def chunks(spark):
    rows = [("clean", CLEAN * 300, None, "other"), ("null", None, 1, "scan"), ("blank", " \n ", 9, "scan2")]
    for n in (1, 2, 3, 4):
        head = [*page(n), "A. Author", ""] if n == 1 else [*page(n), "", f"ction of the {n * 37}th memory index evaluates the graph of"]
        rows.append((f"p{n}", "\n".join([*head, *body(n)]), n, "scan"))
    rows.append(rows[-1])
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], S)


def test_faulty_lines(spark):
    found = {(r["chunk_id"], r["kind"], r["line_no"]) for r in faulty_lines(chunks(spark)).collect()}
    assert {x for x in found if x[1] == "header"} == {(f"p{n}", "header", 1) for n in (2, 3, 4)}
    for n, first in ((1, 4), (2, 4), (3, 4), (4, 4)):
        mine = {(k, line) for c, k, line in found if c == f"p{n}"}
        assert ("hyphen", first) in mine and ("hyphen", first + 1) not in mine  # non-monotonic keeps its hyphen
        assert {("chars", first + 1), ("chars", first + 2), ("chars", first + 4)} <= mine
        assert ("hyphen", first + 5) in mine or n == 4  # its rest stands on the next page
    assert not {x for x in found if x[0] in ("clean", "null", "blank")}


def test_paragraphs(spark):
    text = " ".join(r["text"] for r in paragraphs(chunks(spark)).orderBy("paragraph").collect())
    assert "the ranking function remains stable under the construction of a non-monotonic operator" in text
    assert "constructionofthe" not in text and "graph construction of the" in text and "Author et al" not in text


def test_empty(spark):
    assert faulty_lines(chunks(spark).where("id = 'q'")).count() == 0
    assert paragraphs(chunks(spark).where("id = 'clean'")).count() == 0


def test_pieces():
    assert [page_value(x) for x in ("- llO7 -", "[218]", "xvii", "p. 4", "1 / 9", "0.65.", "word")] == [1107, 218, 17, 4, 1, None, None]
    assert repair_cost("constru~ction", "construction") < 0.5 and repair_cost("kemel", "kernel") < 0.5 and repair_cost("cat", "dog") > 1
    assert skeleton("TRACKlNG") == skeleton("TRACKING")


def test_parameters_on_both_sides_of_their_limits(spark):
    wide = max(len(x) for n in (1, 2, 3, 4) for x in body(n))
    found = lambda **more: {tuple(r) for r in faulty_lines(chunks(spark), **more).collect()}
    assert found(wide=wide) == found() and not found(wide=wide - 1) and not found(narrow=wide + 1)
    assert {x for x in found(longest=10) if x[1] == "chars"} < {x for x in found() if x[1] == "chars"}


def test_headers_by_repetition_over_papers(spark):
    """A running header that a paper has once is one if other papers have it, misread or not; other lines aren't."""
    from chronoloom.llm.scans import read_pages

    rows = []
    for p in range(6):
        names = ["Annals of Remembered Things, Vol. 7 (1999)", "Annals of Remembered Thlngs, Vol. 9 (2001)"]
        rows += [(f"{p}.1", "\n".join(["A title of its own " + "abcdef"[p] * 9, "", *BODY, "its own end " + "mnopqr"[p] * 40, names[p % 2]]), 1, f"paper{p}", "x", 1, "y")]
        rows += [(f"{p}.2", "\n".join(["An opening line of body text " + "ghijkl"[p] * 12, "stuvwx"[p] * 50, *BODY, "abcdef"[p] * 50, "ghijkl"[p] * 50]), 2, f"paper{p}", "x", 1, "y")]
    got = {r["id"]: r["header"] for r in read_pages(spark.createDataFrame(rows, S)).collect()}
    assert all(got[f"{p}.1"] == [len(BODY) + 4] and got[f"{p}.2"] == [] for p in range(6))


def test_what_is_no_print():
    from chronoloom.llm.scans import look, printed_as

    assert [look(x) for x in ("ﬁxed,", "|", "2O19.", "1990s", "s2", "word")] == [("ﬁxed", "ligature"), ("|", "stray"), ("2o19", "number"), ("1990s", ""), ("s2", "number"), ("word", "")]
    assert [printed_as("ﬁxed", "ligature"), printed_as("|", "stray"), printed_as("2o19", "number")] == ["fixed", "", "2019"]
    assert repair_cost("2o19", "2019") < 0.5 and repair_cost("|", "") < 0.5 and repair_cost("ﬁxed", "fixed") < 0.5
