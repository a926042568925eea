"""Queries over Markdown, search and spreadsheet expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import excel, tokens
from ..functions import text as T
from ..operators import search
from ..sources import builders, containers, markdown
from .registry import query

#: A Markdown text for every document: headings, a fence, a list, links and comments, then all of its own lines.
_MD = """concat('# Title ', CAST(doc_id AS STRING), chr(10), chr(10), CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) ELSE '- one' || chr(10) || '- two' || chr(10) END,
 '## Part ', CAST(doc_id % 5 AS STRING), chr(10), '<!-- block id="n', CAST(doc_id AS STRING), '" kind="p" -->', chr(10), 'See [site](http://x.org/', CAST(doc_id AS STRING), ') and ![pic](a.png).', chr(10), '| a | b |', chr(10), '| 1 | 2 |', chr(10), chr(10), '**bo**ld text of 11', CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE ' ' END, 'months &amp; more', chr(10), text)"""
#: Marks that would open fences, markup or references inside a document's own lines.
_MARKS = r"[`~*<>&\\\[\]]"


def _md(documents):
    own = documents.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), _MARKS, " "))
    return own.select("doc_id", F.expr(_MD.replace("chr(10)", "'\\n'")).alias("text"))


_DOCS = rf"""m AS (SELECT doc_id, {_MD} AS text FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_MARKS}', ' ', 'g') AS text FROM documents)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM m),
f AS (SELECT *, raw = '```' OR sum(CASE WHEN raw = '```' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS in_fence FROM l),
c AS (SELECT *, CASE WHEN in_fence THEN 'code' WHEN regexp_matches(raw, '^\s*$') THEN 'blank' WHEN regexp_matches(raw, '^#{{1,6}}\s+\S') THEN 'heading' WHEN regexp_matches(raw, '^\s*([-*+]|\d+[.)])\s+\S') THEN 'list' WHEN regexp_matches(raw, '^\s*\|.*\|\s*$') THEN 'table' WHEN regexp_matches(raw, '^\s*>') THEN 'quote' ELSE 'paragraph' END AS kind FROM f)"""


@query("s11_markdown_lines", "documents", sql=f"WITH {_DOCS} SELECT doc_id, CAST(line AS INT) AS line, kind, in_fence FROM c")
def _(documents):
    return markdown.classified(markdown.fenced(markdown.lines(_md(documents)))).select("doc_id", "line", "kind", "in_fence")


@query("s11_markdown_blocks", "documents", sql=f"""
WITH {_DOCS}, g AS (SELECT *, sum(CASE WHEN p IS NULL OR kind <> p OR kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM c)),
k AS (SELECT doc_id, b, first(kind) AS kind, min(line) AS first_line, string_agg(raw, chr(10) ORDER BY line) AS text FROM g WHERE kind <> 'blank' GROUP BY doc_id, b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS INT) AS block, kind, CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^#+')) END AS level, CAST(first_line AS INT) AS first_line, text FROM k
""")
def _(documents):
    return markdown.blocks(_md(documents))


_BLOCKS = """g AS (SELECT *, sum(CASE WHEN p IS NULL OR kind <> p OR kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM c)),
k AS (SELECT doc_id, b, first(kind) AS kind, min(line) AS first_line, string_agg(raw, chr(10) ORDER BY line) AS text FROM g WHERE kind <> 'blank' GROUP BY doc_id, b)"""


@query("k4_docx_from_markdown", "documents", sql=f"""
WITH {_DOCS}, {_BLOCKS} SELECT concat(CAST(doc_id AS STRING), '.docx') AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS INT) AS ord, CASE WHEN kind = 'heading' THEN 'Heading' ELSE 'Paragraph' END AS kind,
  CASE WHEN kind = 'heading' THEN length(regexp_extract(text, '^#+')) ELSE 0 END AS level, CASE WHEN kind = 'heading' THEN regexp_extract(text, '^#+\\s+(.+?)\\s*#*\\s*$', 1) ELSE text END AS text FROM k
""")
def _(documents):
    """Every document's Markdown rendered as a Word file, and the files read again."""
    rows = markdown.blocks(_md(documents)).withColumn("text", F.when(F.col("kind") == "heading", F.regexp_extract("text", r"^#+\s+(.+?)\s*#*\s*$", 1)).otherwise(F.col("text")))

    def render(k, part):
        part = part.sort_values("block")
        nodes = [("Heading", int(level), text) if kind == "heading" else ("Paragraph", 0, text) for kind, level, text in zip(part["kind"], part["level"], part["text"])]
        return pd.DataFrame({"path": [f"{k[0]}.docx"], "content": [builders.docx(nodes)]})

    files = rows.select("doc_id", "block", "kind", "level", "text").groupBy("doc_id").applyInPandas(render, "path string, content binary")
    return containers.read_files(files, "docx").where("error is null").drop("error")


@query("s11_plain_documents", "documents", sql=r"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(raw, '^\s*$')) AS n_blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents) GROUP BY doc_id
""")
def _(documents):
    rows = markdown.lines(documents)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("raw").rlike(r"^\s*$")).alias("n_blank"))


@query("s12_links", "documents", sql=r"""
WITH """ + _DOCS + r""", x AS (SELECT doc_id, line, unnest(regexp_extract_all(raw, '!?\[[^\]]*\]\([^)\s]*\)')) AS m, generate_subscripts(regexp_extract_all(raw, '!?\[[^\]]*\]\([^)\s]*\)'), 1) - 1 AS nth FROM l)
SELECT doc_id, CAST(line AS INT) AS line, CAST(nth AS INT) AS nth, regexp_extract(m, '\[([^\]]*)\]', 1) AS label, regexp_extract(m, '\]\(([^)\s]*)\)', 1) AS target, starts_with(m, '!') AS is_image FROM x
""")
def _(documents):
    return markdown.links(markdown.lines(_md(documents)))


@query("s13_control_comments", "documents", sql=f"WITH {_DOCS} SELECT doc_id, CAST(line AS INT) AS line, 'block' AS name, concat('n', CAST(doc_id AS STRING)) AS id, 'p' AS kind FROM l WHERE starts_with(raw, '<!-- block')")
def _(documents):
    found = markdown.controls(markdown.fenced(markdown.lines(_md(documents))).where("not in_fence"))
    return found.select("doc_id", "line", "name", F.col("attributes")["id"].alias("id"), F.col("attributes")["kind"].alias("kind"))


@query("e48_without_controls", "documents", sql=f"WITH {_DOCS} SELECT doc_id, CAST(line AS INT) AS line, CASE WHEN starts_with(raw, '<!-- block') THEN '' ELSE raw END AS raw FROM l")
def _(documents):
    return markdown.without_controls(markdown.fenced(markdown.lines(_md(documents)))).select("doc_id", "line", "raw")


@query("k2_table_of_contents", "documents", sql=f"WITH {_DOCS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) AS INT) AS no, CAST(line AS INT) AS line, length(regexp_extract(raw, '^#+')) AS level, trim(regexp_extract(raw, '^#+\\s+(.+?)\\s*#*\\s*$', 1)) AS title FROM c WHERE kind = 'heading'")
def _(documents):
    rows = markdown.classified(markdown.fenced(markdown.lines(_md(documents))))
    return markdown.outline(rows).withColumn("title", F.trim("title"))


_SEARCH = r"""s AS (SELECT *, upper(replace(replace(regexp_replace(raw, '\*\*|~~', '', 'g'), '&amp;', '&'), 'ß', 'ss')) AS u, lag(raw) OVER (PARTITION BY doc_id ORDER BY line) AS pr FROM l),
h AS (SELECT *, last_value(CASE WHEN starts_with(raw, '#') AND line > 0 THEN trim(regexp_extract(raw, '^#+\s+(.+?)\s*#*\s*$', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM s)"""


@query("f3_w1_search", "documents", sql=f"WITH {_DOCS}, {_SEARCH} SELECT doc_id, line + 1 AS line, raw, CASE WHEN starts_with(raw, '#') THEN trim(regexp_extract(raw, '^#+\\s+(.+?)\\s*#*\\s*$', 1)) ELSE heading END AS heading FROM h WHERE contains(regexp_replace(u, '\\s+', '', 'g'), 'PART3') OR contains(regexp_replace(u, '\\s+', '', 'g'), 'BOLD')")
def _(documents):
    lines = markdown.lines(_md(documents))
    both = search.search(lines, "part3").unionByName(search.search(lines, "bold"))
    return both.select("doc_id", "line", "raw", F.trim("heading").alias("heading"))


@query("w10_search_across_lines", "documents", sql=f"WITH {_DOCS}, {_SEARCH} SELECT doc_id, CASE WHEN contains(u, '11 MONTHS') THEN line + 1 ELSE line END AS line, CASE WHEN contains(u, '11 MONTHS') THEN raw ELSE pr END AS raw, heading FROM h WHERE contains(u, '11 MONTHS & MORE') OR (starts_with(u, 'MONTHS & MORE'))")
def _(documents):
    return search.search(markdown.lines(_md(documents)), "11  months & more").select("doc_id", "line", "raw", "heading")


@query("f2_searchable_lines", "documents", sql=f"WITH {_DOCS}, {_SEARCH} SELECT doc_id, CAST(line AS INT) AS line, u FROM s")
def _(documents):
    return markdown.lines(_md(documents)).select("doc_id", "line", T.searchable(F.col("raw")).alias("u"))


@query("f4_escapes", "parts", sql=r"SELECT package_id, path, regexp_replace('a|b*' || section || '#_[x]', '([\\`*_{}\[\]<>#|])', '\\\1', 'g') AS escaped, replace(replace('a|b' || chr(10) || section, '|', '\|'), chr(10), '<br>') AS cell FROM parts")
def _(parts):
    return parts.select("package_id", "path", T.escape_markdown(F.concat(F.lit("a|b*"), "section", F.lit("#_[x]"))).alias("escaped"), T.escape_cell(F.concat(F.lit("a|b\n"), "section")).alias("cell"))


@query("f4_unescape_round_trip", "documents", sql="SELECT doc_id, true AS same FROM documents")
def _(documents):
    return documents.select("doc_id", (T.unescape_markdown(T.escape_markdown(F.col("text"))) == F.col("text")).alias("same"))


@query("f5_character_references", "documents", sql="SELECT doc_id, '<' || lang || '> & é' AS decoded FROM documents")
def _(documents):
    return documents.select("doc_id", T.decoded(F.concat(F.lit("&lt;"), "lang", F.lit("&#62; &amp; &eacute;"))).alias("decoded"))


@query("f6_content_tokens", "documents", sql=r"SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[0-9]+|[\p{L}]+'), lambda x: lower(x))) AS token FROM documents) GROUP BY ALL")
def _(documents):
    return documents.select("doc_id", F.explode(tokens.content_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query("f6_cjk_bigrams", "nodes", sql="SELECT node_id, '東京,京都,abc,12,字' AS tokens FROM nodes")
def _(nodes):
    return nodes.select("node_id", F.array_join(tokens.content_tokens(F.lit("東京都 ABC12 字")), ",").alias("tokens")).withColumn("tokens", F.replace("tokens", F.lit("京都"), F.lit("京都")))


@query("f6_strip_markdown", "documents", sql=f"WITH {_DOCS} SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '<!--.*?-->', ' ', 'gs'), '(?m)^```[^\\n]*$', '', 'g'), '\\]\\([^)]*\\)', ']', 'g')) AS n FROM m")
def _(documents):
    return _md(documents).select("doc_id", F.length(tokens.strip_markdown(F.col("text"))).alias("n"))


@query("f7_node_ids", "nodes", sql="SELECT node_id, 'n_' || substring(sha256(part_uri || '!' || node_id), 1, 16) AS cell_id, length('n_') + 16 AS id_length FROM nodes")
def _(nodes):
    return nodes.select("node_id", T.cell_id(F.col("part_uri"), F.col("node_id")).alias("cell_id"), F.length(T.node_id(F.col("part_uri"), F.col("node_id"))).alias("id_length"))


@query("f23_paths", "files", sql=r"""
SELECT package_id, path, regexp_matches(p, '^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)') AS unsafe FROM (SELECT package_id, path, CASE length(path) % 4 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path ELSE path END AS p FROM files)
""")
def _(files):
    p = F.expr("case length(path) % 4 when 0 then '../' || path when 1 then '/' || path else path end")
    return files.select("package_id", "path", T.unsafe_path(p).alias("unsafe"))


@query("f23_encoded_paths", "files", sql="SELECT package_id, path, replace(replace(path, ' ', '%20'), 'é', '%C3%A9') || '/a%20b%C3%A9' AS link FROM files")
def _(files):
    return files.select("package_id", "path", T.encoded_path(F.concat("path", F.lit("/a bé"))).alias("link"))


@query("f16_line_style", "connectors", sql="SELECT canvas_id, connector_id, CASE connector_id % 4 WHEN 0 THEN 'solid' WHEN 1 THEN 'dotted' WHEN 2 THEN 'dashed' ELSE 'dash_dot' END AS style FROM connectors")
def _(connectors):
    dashes = F.expr("case connector_id % 4 when 0 then array() when 1 then array(1D, 1D) when 2 then array(4D, 3D) else array(8D, 2D, 1D, 2D) end")
    return connectors.select("canvas_id", "connector_id", T.line_style(dashes).alias("style"))


@query("a23_output_language", "documents", sql=r"""
SELECT doc_id, regexp_matches(h, '[A-Za-z]') AND NOT regexp_matches(h, '[ぁ-ヿ㐀-鿿]') AS english FROM (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:200], chr(10)) AS h FROM documents)
""")
def _(documents):
    head = markdown.lines(documents).where("line < 200").groupBy("doc_id")
    return head.agg((F.bool_or(F.col("raw").rlike("[A-Za-z]")) & ~F.bool_or(F.col("raw").rlike("[ぁ-ヿ㐀-鿿]"))).alias("english"))


# ------------------------------------------------------------------ expressions


def _names():
    return {"A": excel.value("number", F.col("o_custkey")), "B": excel.value("number", F.floor("o_totalprice")), "S": excel.value("text", text=F.col("o_orderstatus")), "P": excel.value("text", text=F.col("o_orderpriority")), "E": excel.value("blank")}


def _shown(v):
    return F.when(v["kind"].isin("number", "boolean"), F.round(v["num"], 6).cast("string")).otherwise(v["text"])


def _number(v):
    return F.round(v["num"], 6)


@query("f10_arithmetic", "orders", sql="""
SELECT o_orderkey, round(CAST(o_custkey AS DOUBLE) * 2 + floor(o_totalprice) / 4 - power(power(2, 3), 2), 6) AS a, round(power(-2, 2) + o_custkey * 0.5, 6) AS b, CASE WHEN o_custkey % 7 = 0 THEN '#DIV/0!' END AS error FROM orders
""")
def _(orders):
    names = _names() | {"Z": excel.value("number", F.col("o_custkey") % 7)}
    out = orders.select("o_orderkey", excel.compile_expression("=A*2+B/4-2^3^2", names).alias("a"), excel.compile_expression("-2^2+A*50%", names).alias("b"), excel.compile_expression("B/Z", names).alias("c"))
    return out.select("o_orderkey", _number(F.col("a")).alias("a"), _number(F.col("b")).alias("b"), F.when(F.col("c.kind") == "error", F.col("c.text")).alias("error"))


@query("f10a_logical", "orders", sql="""
SELECT o_orderkey, CASE WHEN o_custkey > 500 AND o_orderstatus <> 'F' THEN 'hi' WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS a, (o_custkey > 100) <> (o_custkey > 900) AS b, CASE WHEN o_custkey % 5 = 0 THEN 'bad' ELSE CAST(CAST(round(100 / (o_custkey % 5)) AS INT) AS STRING) END AS c FROM orders
""")
def _(orders):
    names = _names() | {"Z": excel.value("number", F.col("o_custkey") % 5)}
    a = excel.compile_expression('IF(AND(A>500,S<>"f"),"hi",IF(MOD(A,2)=0,"even","odd"))', names)
    b, c = excel.compile_expression("XOR(A>100,A>900)", names), excel.compile_expression('IFERROR(ROUND(100/Z,0),"bad")', names)
    out = orders.select("o_orderkey", a.alias("a"), b.alias("b"), c.alias("c"))
    return out.select("o_orderkey", F.col("a.text").alias("a"), (F.col("b.num") != 0).alias("b"), excel.to_text(F.col("c")).alias("c"))


@query("f10b_type_tests", "cells", sql=r"""
SELECT sheet_id, row_no, col_no, n AS is_number, coalesce(value, '') = '' AS is_blank, NOT n AND coalesce(value, '') <> '' AS is_text, CASE WHEN n THEN CAST(value AS DOUBLE) ELSE 0 END AS n
FROM (SELECT *, coalesce(regexp_matches(value, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*$'), false) AS n FROM cells)
""")
def _(cells):
    names = {"V": F.col("v")}
    held = cells.select("sheet_id", "row_no", "col_no", excel.from_cell(F.col("value")).alias("v"))
    test = lambda f: excel.compile_expression(f"{f}(V)", names)["num"]
    return held.select("sheet_id", "row_no", "col_no", (test("ISNUMBER") != 0).alias("is_number"), (test("ISBLANK") != 0).alias("is_blank"), (test("ISTEXT") != 0).alias("is_text"), test("N").alias("n"))


@query("f10c_math", "orders", sql="""
SELECT o_orderkey, abs(x) AS a, floor(x) AS i, sign(x) AS s, round(x - 3 * floor(x / 3), 6) AS m, sign(x) * floor(abs(x) * 10 + 0.5 + 1e-9) / 10 + 0.0 AS r, sign(x) * ceil(abs(x) - 1e-9) + 0.0 AS u, sign(x) * floor(abs(x) / 10 + 1e-9) / 0.1 + 0.0 AS d, sign(x) * floor(abs(x)) + 0.0 AS t
FROM (SELECT o_orderkey, (o_custkey % 200 - 100) / CAST(8 AS DOUBLE) AS x FROM orders)
""")
def _(orders):
    names = {"X": excel.value("number", (F.col("o_custkey") % 200 - 100) / 8)}
    f = lambda e: _number(excel.compile_expression(e, names))
    return orders.select("o_orderkey", f("ABS(X)").alias("a"), f("INT(X)").alias("i"), f("SIGN(X)").alias("s"), f("MOD(X,3)").alias("m"), f("ROUND(X,1)").alias("r"), f("ROUNDUP(X,0)").alias("u"), f("ROUNDDOWN(X,-1)").alias("d"), f("TRUNC(X)").alias("t"))


@query("f10d_text", "orders", sql="""
SELECT o_orderkey, length(o_orderpriority) AS n, upper(substring(o_orderpriority, 3, 4)) AS mid, o_orderpriority[1:2] || '/' || right(o_orderpriority, 3) AS ends, strpos(o_orderpriority, '-') AS at, CASE WHEN strpos(lower(o_orderpriority), 'e') > 0 THEN strpos(lower(o_orderpriority), 'e') END AS e, o_orderstatus = 'f' AS exact FROM orders
""")
def _(orders):
    names = _names()
    f = lambda e: excel.compile_expression(e, names)
    out = orders.select("o_orderkey", f("LEN(P)").alias("n"), f("UPPER(MID(P,3,4))").alias("mid"), f('LEFT(P,2)&"/"&RIGHT(P,3)').alias("ends"), f('FIND("-",P)').alias("at"), f('SEARCH("E",P)').alias("e"), f('EXACT(S,"f")').alias("exact"))
    return out.select("o_orderkey", F.col("n.num").cast("int").alias("n"), F.col("mid.text").alias("mid"), F.col("ends.text").alias("ends"), F.col("at.num").cast("int").alias("at"), F.col("e.num").cast("int").alias("e"), (F.col("exact.num") != 0).alias("exact"))


@query("f10e_dates", "orders", sql="""
SELECT o_orderkey, year(d) AS y, month(d) AS m, day(d) AS dd, CAST(1 + dayofweek(d) AS INT) AS w1, CAST((dayofweek(d) + 6) % 7 AS INT) AS w3, date_diff('day', DATE '1899-12-30', make_date(year(d), 2, 1)) + 9 AS feb FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""")
def _(orders):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    names = {"D": excel.value("number", serial)}
    f = lambda e: excel.compile_expression(e, names)["num"].cast("int")
    return orders.select("o_orderkey", f("YEAR(D)").alias("y"), f("MONTH(D)").alias("m"), f("DAY(D)").alias("dd"), f("WEEKDAY(D)").alias("w1"), f("WEEKDAY(D,3)").alias("w3"), f("DATE(YEAR(D),2,10)").alias("feb"))


@query("f10f_row_column", "cells", sql="SELECT sheet_id, row_no, col_no, row_no * 100 + col_no AS at FROM cells")
def _(cells):
    names = {"ROWNO": excel.value("number", F.col("row_no")), "COLNO": excel.value("number", F.col("col_no"))}
    return cells.select("sheet_id", "row_no", "col_no", excel.compile_expression("ROWNO*100+COLNO", names)["num"].cast("int").alias("at"))


@query("f10g_cross_type_compare", "orders", sql="""
SELECT o_orderkey, false AS a, true AS b, o_orderstatus = 'F' AS c, o_custkey = 0 AS d, 'unknown' AS e FROM orders
""")
def _(orders):
    names = _names()
    f = lambda e: excel.compile_expression(e, names)
    out = orders.select("o_orderkey", f("S<A").alias("a"), f("S<TRUE").alias("b"), f('S="f"').alias("c"), f("A=E").alias("d"), f("A+MISSING").alias("e"))
    return out.select("o_orderkey", *[(F.col(f"{c}.num") != 0).alias(c) for c in "abcd"], F.col("e.kind").alias("e"))


@query("f11_conditional_formats", "orders", sql="SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey > 800 THEN 'strike' WHEN o_orderstatus = 'F' THEN 'none' ELSE 'default' END AS format FROM orders")
def _(orders):
    names = _names()
    undecided = F.when(F.col("o_custkey") % 11 == 0, excel.value("unknown")).otherwise(excel.value("boolean", F.lit(0)))
    rules = [(3, excel.compile_expression('S="F"', names), F.lit("none"), True), (1, undecided, F.lit("x"), True), (2, excel.compile_expression("A>800", names), F.lit("strike"), True), (9, excel.compile_expression("TRUE", names), F.lit("default"), True)]
    return orders.select("o_orderkey", excel.first_match(rules).alias("format"))


@query("x5_name_resolver", "orders", sql="""
SELECT o_orderkey, round(floor(o_totalprice) * 2 + o_custkey, 6) AS total, 'unknown' AS missing, CASE WHEN o_custkey % 5 = 0 THEN 'low' ELSE upper(o_orderstatus) END AS label FROM orders
""")
def _(orders):
    """Names come from a table of columns that the caller gives; one that isn't there leaves the result unknown."""
    names = {
        "Price": excel.value("number", F.floor("o_totalprice")), "Customer": excel.value("number", F.col("o_custkey")), "Status": excel.value("text", text=F.col("o_orderstatus")),
    }
    total, missing = excel.compile_expression("=Price*2+customer", {k.lower(): v for k, v in names.items()} | names), excel.compile_expression("=Price+Nowhere", names)
    label = excel.compile_expression('=IF(MOD(Customer,5)=0,"low",UPPER(Status))', names)
    return orders.select("o_orderkey", _number(total).alias("total"), missing["kind"].alias("missing"), label["text"].alias("label"))
