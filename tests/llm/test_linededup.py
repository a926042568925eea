import pytest

from leafmill.llm import linededup

OWN = "Line {} says something of its own at some length."


@pytest.mark.parametrize("most", [linededup.BROADCAST_LINES, 0])
def test_boilerplate_of_one_host_goes(docs, untouched, most):
    rows = [(i, OWN.format(i) + ("\n  Share this page \nshared by two" if i < 2 else "\nShare this page"), "a") for i in range(40)]
    rows += [(100 + i, OWN.format(i) + ("\nShare this page" if i == 0 else ""), "b") for i in range(40)]
    rows += [(200, None, "a"), (201, "", "a"), (202, OWN.format(3), None), (203, "Share this page\n\nShare this page", "a"), (203, "Share this page\n\nShare this page", "a")]
    own = docs(rows)
    out = linededup.drop_lines(own, broadcast_lines=most)
    got = {(r["doc_id"], r["text"]): r["n_dropped"] for r in out.collect()}
    assert got[0, OWN.format(0) + "\nshared by two"] == 1 and got[7, OWN.format(7)] == 1
    assert got[100, OWN.format(0) + "\nShare this page"] == 0
    assert got[201, ""] == 0 and got[202, OWN.format(3)] == 0 and got[200, None] == 0
    assert got[203, ""] == 2
    assert out.count() == own.count()
    untouched(out)


def test_stage_keeps_rows_and_columns(docs, untouched):
    own = docs([(i, f"{OWN.format(i)}\nMenu", "a") for i in range(9)] + [(3, None, "a")])
    out = linededup.dedup(own)
    assert out.columns == own.columns and out.count() == 10
    assert all(r["n_chars"] == len(r["text"]) for r in out.where("text is not null").collect())
    untouched(out)


def test_copies_are_one_page(docs):
    page = "\n".join(OWN.format(i) for i in range(5))
    own = docs([(i, page, "a") for i in range(30)] + [(100 + i, OWN.format(50 + i) + "\nMenu", "a") for i in range(8)])
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(own).collect()}
    assert all(got[i] == page for i in range(30)) and all(got[100 + i] == OWN.format(50 + i) for i in range(8))


def test_pages_of_boilerplate_alone_end_empty(docs):
    own = docs([(i, f"same line\nother {i % 2}", "tiny") for i in range(2)] + [(9, "same line", "tiny"), (10, "single", "alone")])
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(own).collect()}
    assert got == {0: "other 0", 1: "other 1", 9: "", 10: "single"}
    # a floor is an option
    assert {r["text"] for r in linededup.dedup(own, min_pages=4).where("doc_id = 9").collect()} == {"same line"}
    assert linededup.dedup(own.where("false")).count() == 0
