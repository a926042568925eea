import random

import pytest

from leafmill.llm import blocklabel as b

PAGE = (
    '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Head</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body>'
    '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">two</a></li><li><a href="/c">three</a></li></ul></nav><!-- ad 0 --><div class="ad">Some odd words here.</div>'
    "<article><h1>A title of it</h1><p><b>The first&nbsp;&amp; best\n  one of all.<br><p>Second words went here, and there.</p><p>Third.</p></article><footer>&copy; x.example.org &middot; Words at the end.</footer></body></html>"
)


@pytest.fixture(scope="module")
def weights():
    return b.train()


def test_blocks():
    own = b.cut(PAGE)
    assert [x.text for x in own] == ["One", "two", "three", "Some odd words here.", "A title of it", "The first & best one of all.", "Second words went here, and there.", "Third.", "© x.example.org · Words at the end."]
    assert own[0].linked == 3 and own[3].linked == 0
    body, article, p, ad = (b.element(t, a) for t, a in (("body", ""), ("article", ""), ("p", ""), ("div", ' class="ad"')))
    html = b.element("html", ' lang="en"')
    assert abs(own[5].path - (body + article + p + 0.7 * html)).max() < 1e-5 and abs(own[3].path - (html + body + ad)).max() < 1e-5
    assert [x.text for x in b.cut("a < b<p>c<!-- <p>x</p> -->d</q></p><script>if (a<b) {}</script>e<li>f<li>g")] == ["a < b", "cd", "e", "f", "g"]
    assert b.cut("") == [] and b.cut("<script>never closed <p>x") == [] and [x.text for x in b.cut("<p")] == ["<p"]
    assert len(b.cut("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_held_out_accuracy(weights):
    """Generated pages that training never saw, and the layout of raw pages."""
    right = total = exact = 0
    for k in range(300):
        page, main = b.generate(random.Random(f"other-{k}"))
        own = b.cut(page)
        (p,) = b.label([own], weights)
        hits = [(y > 0.5) == (x.text in main) for x, y in zip(own, p)]
        right, total, exact = right + sum(hits), total + len(hits), exact + all(hits)
    assert right / total > 0.97 and exact > 200


def test_extract(spark, weights):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, "u", PAGE, "x"), (4, "u", PAGE, "x"), (5, "u", "<p>" + "word " * 50_000 + "</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    out = b.extract(pages, weights)
    got = {r["page_id"]: r for r in out.collect()}
    want = "A title of it\n\nThe first & best one of all.\n\nSecond words went here, and there.\n\nThird."
    assert got[1]["main_text"] == got[4]["main_text"] == want
    assert got[2]["main_text"] == got[3]["main_text"] == "" and got[5]["n_blocks"] == 1
    assert out.count() == 6 and out.columns[:4] == pages.columns
    assert b.extract(pages.where("false"), weights).count() == 0


def test_batches_don_t_matter(weights):
    pages = [b.cut(b.generate(random.Random(k))[0]) for k in range(40)]
    alone = [b.label([p], weights)[0] for p in pages]
    for x, y in zip(b.label(pages, weights), alone):
        assert abs(x - y).max(initial=0) < 1e-4


SHAPES = [
    # no names, no structural tags
    ("<div><div><a href='/'>Start</a> <a href='/n'>News</a> <a href='/k'>Contact</a></div><div><h1>How the old bridge was repaired</h1><div>The bridge over the river had been closed for two years. Last week it was opened again.</div>"
     "<div>Engineers replaced all of the cables, and the deck got a new surface. Traffic is light so far.</div><div>The mayor thanked everyone who helped, and said that the work had cost less than expected.</div></div>"
     "<div><a href='/i'>Impressum</a> | <a href='/d'>Datenschutz</a></div></div>",
     ["How the old bridge was repaired", "The bridge over the river had been closed for two years. Last week it was opened again.",
      "Engineers replaced all of the cables, and the deck got a new surface. Traffic is light so far.", "The mayor thanked everyone who helped, and said that the work had cost less than expected."]),
    # a blog with sidebar, comments and a form
    ("<html><body><header><h2>My garden</h2><nav><a href=/>Home</a><a href=/about>About</a></nav></header><main><h1>Planting beans</h1><p>Beans like warm soil. Wait until the nights are mild.</p>"
     "<ul><li>Dig a hole that is two fingers deep.</li><li>Put three seeds into each.</li></ul><p>Water them in the morning, never at noon.</p></main>"
     "<aside><h3>Popular posts</h3><ul><li><a href=/1>Ten tips</a></li><li><a href=/2>Roses</a></li></ul></aside><section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>Thanks, this helped me a lot!</p></div></section>"
     "<form><label>Your mail</label><input><button>Subscribe</button></form><footer>Copyright 2020 Someone</footer></body></html>",
     ["Planting beans", "Beans like warm soil. Wait until the nights are mild.", "Dig a hole that is two fingers deep.", "Put three seeds into each.", "Water them in the morning, never at noon."]),
    # unclosed paragraphs after a banner
    ("<body><div id=cookie-banner><p>This site uses cookies.<button>OK</button></div><div class=post><h1>Night trains return</h1><p>More people take the train at night again.<p>Operators have ordered new cars.<p>Tickets go on sale in spring.</div>"
     "<div class=related><h4>Related</h4><a href=/x>Buses</a><a href=/y>Ferries</a></div>",
     ["Night trains return", "More people take the train at night again.", "Operators have ordered new cars.", "Tickets go on sale in spring."]),
]


def test_pages_of_other_shapes(weights):
    """Written by hand, not by the generator."""
    right = total = 0
    for page, want in SHAPES:
        own = b.cut(page)
        assert [x.text for x in own if x.text in want] == want
        (p,) = b.label([own], weights)
        right += sum((y > 0.5) == (x.text in want) for x, y in zip(own, p))
        total += len(own)
    assert right / total >= 0.9, [(x.text, round(float(y), 2)) for page, _ in SHAPES for x, y in zip(b.cut(page), b.label([b.cut(page)], weights)[0])]


def test_long_pages_are_groups_of_their_own(weights, monkeypatch):
    pages = [b.cut("<p>x y.</p>" * n) for n in (3, 2000, 5, 1900, 4)]
    whole = b.label(pages, weights)
    monkeypatch.setattr(b, "CELLS", 10)
    for x, y in zip(whole, b.label(pages, weights)):
        assert abs(x - y).max() < 1e-4


def test_other_columns_keep_their_values(spark, weights):
    names = ["_text", "_page", "_n_main", "_n_blocks", "text", "page"]
    pages = spark.createDataFrame([(1, PAGE, *names)], ["page_id", "html", *names])
    row = b.extract(pages, weights).first()
    assert [row[n] for n in names] == names and row["n_main"] == 4 and row["html"] == PAGE
