"""Functions against literal readings and known values."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import a1, excel, numberformat, tokens
from leafmill.operators import inference
from leafmill.sources import builders, containers, html


def estimate(text):
    """The token rule, character by character."""
    ascii_ = run = numbers = delimiters = separators = other = 0
    after = False
    for c in text:
        if "0" <= c <= "9":
            run, after = run + 1, True
            continue
        numbers, run = numbers + (run + 2) // 3, 0
        if c == "|":
            delimiters += 1
        elif after and c in ",.":
            separators += 1
        elif ord(c) < 128:
            ascii_ += 1
        else:
            other += 1
        after = False
    numbers += (run + 2) // 3
    return (ascii_ + 3) // 4 + numbers + delimiters + separators + (other * 7 + 7) // 8


def test_token_estimate(spark):
    rng = random.Random(0)
    texts = ["", "1,234.5|", "日本語 12", *("".join(rng.choice("ab 1239,.|é日\n") for _ in range(rng.randrange(60))) for _ in range(300))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens.token_estimate(F.col("t")).alias("n")).collect()
    assert all(r["n"] == estimate(texts[r["i"]]) for r in got)


@given(st.integers(1, 18278))
@settings(max_examples=50, deadline=None)
def test_column_letters_round_trip(n):
    assert a1.column_number(builders.letters(n)) == n


EXPRESSIONS = [
    ("=1+2*3", 7), ("-2^2", 4), ("2^3^2", 64), ("10%", 0.1), ("MOD(-7,3)", 2), ("ROUND(2.5,0)", 3), ("ROUND(-2.5,0)", -3), ("ROUND(1234,-2)", 1200), ("ROUNDUP(1.21,1)", 1.3), ("INT(-1.5)", -2), ("TRUNC(-1.5)", -1),
    ('LEN("a""b")', 3), ('UPPER("ab")&1', "AB1"), ('IF(1>2,"x","y")', "y"), ('IFERROR(1/0,"e")', "e"), ("1/0", "#DIV/0!"), ('"a"+1', "#VALUE!"), ('"a"="A"', True), ('EXACT("a","A")', False), ('"z"<TRUE', True), ("5<\"a\"", True),
    ("XOR(TRUE,TRUE,TRUE)", True), ("NOT(0)", True), ('FIND("c","abc")', 3), ('SEARCH("C","abc")', 3), ('FIND("x","abc")', "#VALUE!"), ("YEAR(60)", 1900), ("MONTH(60)", 2), ("DAY(60)", 29), ("DAY(61)", 1), ("YEAR(45000)", 2023),
    ("WEEKDAY(1)", 1), ("DATE(2024,2,29)", 45351), ('VALUE("12")+1', 13), ('TRIM("  a   b ")', "a b"), ('RIGHT("abc",2)', "bc"), ('MID("abcdef",2,3)', "bcd"), ("ISERR(1/0)", True), ("ISNA(1)", False),
]


def test_expressions(spark):
    one = spark.range(1)
    for text, want in EXPRESSIONS:
        v = one.select(excel.compile_expression(text, {}).alias("v")).first()["v"]
        got = bool(v["num"]) if v["kind"] == "boolean" else v["num"] if v["kind"] == "number" else v["text"]
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, text


def test_unknown_poisons_and_bad_text_is_refused(spark):
    assert spark.range(1).select(excel.compile_expression("1+NOSUCH(2)", {}).alias("v")).first()["v"]["kind"] == "unknown"
    for text in ("1+", "(1", "1 2", "@"):
        with pytest.raises(ValueError):
            excel.compile_expression(text, {})


FORMATS = [
    (1234.5, "#,##0.00", "1,234.50"), (-1234.5, "#,##0;(#,##0)", "(1,235)"), (0, "0;-0;\"zero\"", "zero"), (0.256, "0.0%", "25.6%"), (12345, "0.00E+00", "1.23E+04"), (1.5, "# ?/?", "1 1/2"), (0.333, "?/?", "1/3"),
    (5, "[>=5]\"big\";\"small\"", "big"), (3, "[>=5]\"big\";\"small\"", "small"), (45351, "yyyy-mm-dd", "2024-02-29"), (60, "d mmm yyyy", "29 Feb 1900"), (0.5, "h:mm AM/PM", "12:00 PM"), (1.5, "[h]:mm", "36:00"), (1234567, "#,##0,", "1,235"),
    (2, "General", "2"), (0.1, "General", "0.1"), (7, "000", "007"), (1.10, "0.##", "1.1"), (45351, "dddd", "Thursday"), (None, "0", ""), (0.0423, "mm:ss", "00:55"), (12.3, "[$€-407] 0.0", "€ 12.3"), (-5, "0", "-5"), (2.5, "0", "3"),
]


@pytest.mark.parametrize("value,code,want", FORMATS)
def test_number_formats(value, code, want):
    assert numberformat.render(value, code) == want


def test_label_assignment_is_the_best_matching(spark):
    rng = random.Random(1)
    pairs = [(c, lab, e, round(rng.random(), 3)) for c in range(20) for lab in range(5) for e in rng.sample(range(6), 4)]
    got = inference.assign_labels(spark.createDataFrame(pairs, "canvas_id long, label_id int, edge_id int, score double")).collect()
    for c in range(20):
        own = {(lab, e): s for k, lab, e, s in pairs if k == c}
        best = max(sum(own.get((lab, e), -9) if e is not None else 0 for lab, e in enumerate(choice)) for choice in itertools.product([None, *range(6)], repeat=5) if len([e for e in choice if e is not None]) == len({e for e in choice if e is not None}))
        mine = [(r["label_id"], r["edge_id"]) for r in got if r["canvas_id"] == c]
        assert len({e for _, e in mine}) == len(mine) and math.isclose(sum(own[m] for m in mine), best, abs_tol=1e-9)


def test_connection_search_is_the_best_joint_choice(spark):
    rng = random.Random(2)
    rows = [(c, k, s, d, round(rng.random(), 3)) for c in range(25) for k in range(3) for s, d in rng.sample([(a, b) for a in range(3) for b in range(3) if a != b], 4)]
    got = inference.solve_connections(spark.createDataFrame(rows, "canvas_id long, connector_id int, src int, dst int, score double")).collect()
    for c in range(25):
        options = [[((s, d), v) for i, k, s, d, v in rows if i == c and k == n] for n in range(3)]
        costs = {}
        for choice in itertools.product(*options):
            ends = [e for e, _ in choice]
            costs[tuple(ends)] = -sum(v for _, v in choice) + 0.25 * sum(e in ends[:n] for n, e in enumerate(ends))
        best = min(costs.values())
        mine = {r["connector_id"]: ((r["src"], r["dst"]), r["margin"]) for r in got if r["canvas_id"] == c}
        ends = tuple(mine[n][0] for n in range(3))
        assert math.isclose(costs[ends], best, abs_tol=1e-9)
        for n in range(3):
            other = min(v for k, v in costs.items() if k[n] != ends[n])
            assert math.isclose(mine[n][1], other - best, abs_tol=1e-6)


def test_publish_is_whole_or_nothing(spark, tmp_path):
    from leafmill.storage import publish

    target = f"file://{tmp_path}/out"
    with pytest.raises(Exception):
        publish(spark.range(5).selectExpr("assert_true(id < 3) x"), target)
    assert list(tmp_path.iterdir()) == []
    publish(spark.range(5), target)
    with pytest.raises(FileExistsError):
        publish(spark.range(9), target)
    assert spark.read.parquet(target).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out"]


def test_containers_refuse_and_survive(spark):
    bomb = builders.package({"a": "0" * 2_000_000, "../x": "1"})
    assert {c for c, _ in containers.problems(bomb)} == {"compression_ratio", "path_traversal"}
    assert containers.problems(b"nothing") == [("broken_zip", "")]
    evil = builders.package({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})
    files = spark.createDataFrame([("a.docx", evil), ("b.docx", b"PK\x03\x04broken"), ("c.docx", builders.docx([("Heading", 2, "T & t"), ("Table", 0, "a\tb\nc\td")]))], "path string, content binary")
    read = containers.read_files(files, "docx")
    got = [(r["path"], r["kind"], r["level"], r["text"]) for r in read.where("error is null").collect()]
    assert got == [("c.docx", "Heading", 2, "T & t"), ("c.docx", "Table", 0, "a\tb\nc\td")]
    assert {r["path"] for r in containers.failures(read).collect()} == {"a.docx", "b.docx"}
    assert containers.detect("x.txt", bomb) == ("zip", "") and containers.detect("x.doc", builders.pdf([[]])) == ("pdf", "extension_mismatch")


def test_tracked_changes_and_hidden_runs():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>a</w:t></w:r><w:ins><w:r><w:t>b</w:t></w:r></w:ins><w:del><w:r><w:delText>c</w:delText></w:r></w:del><w:r><w:rPr><w:vanish/></w:rPr><w:t>d</w:t></w:r></w:p>"
    doc = builders.package({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    assert [containers.docx_nodes(doc, v)[0][3] for v in ("final", "reject", "markup")] == ["ab", "ac", "abc"]


def test_data_source(spark, tmp_path):
    from leafmill.sources.adapter import register

    for k in range(3):
        (tmp_path / f"{k}.xlsx").write_bytes(builders.xlsx({"S": [(1, 1, f"v{k}", None), (2, 28, "x", "=A1")]}))
    register(spark)
    got = spark.read.format("leafmill_files").option("kind", "xlsx").load(str(tmp_path)).select("path", "row_no", "col_no", "value", "formula").collect()
    assert sorted(tuple(r) for r in got) == sorted(x for k in range(3) for x in ((f"{k}.xlsx", 1, 1, f"v{k}", None), (f"{k}.xlsx", 2, 28, "x", "A1")))


def test_html_nodes():
    page = '<title>t</title><nav><a>menu</a></nav><article><h1>T</h1><p>a <b>b<br>c<p>d &amp; e<script>x("</p>")</script><ul><li>1<li>2</ul></article><footer>f</footer>'
    assert [(k, layer, t) for _, k, _, layer, t in html.nodes_of(page)] == [
        ("Paragraph", "Furniture", "menu"), ("Heading", "Body", "T"), ("Paragraph", "Body", "a b c"), ("Paragraph", "Body", "d & e"), ("ListItem", "Body", "1"), ("ListItem", "Body", "2"), ("Paragraph", "Furniture", "f"),
    ]


def test_character_references_need_their_semicolon():
    page = "<h1>a&amp;&amp;&amp</h1><p>b&amp;lt; &quot;c&quot;&quot &#65;&#65 &x; &copy;&copy &amp;amp; &notit; R&D &</p><p class='a&amp;ad'>f</p>"
    assert [(k, layer, t) for _, k, _, layer, t in html.nodes_of(page)] == [("Heading", "Body", "a&&&amp"), ("Paragraph", "Body", 'b&lt; "c"&quot A&#65 &x; ©&copy &amp; &notit; R&D &'), ("Paragraph", "Body", "f")]


def test_streams(spark, tmp_path):
    from leafmill.streaming import ingest

    docs = spark.createDataFrame([(i, f"# T{i}\n\ntext {i}") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    query = ingest.ingest(ingest.arriving(spark, f"{tmp_path}/in", docs.schema, 1), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 40 and out.select("doc_id").distinct().count() == 20
