"""Queries over inference, number formats, HTML and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numberformat
from ..operators import inference, layout
from ..sources import html
from ..storage import shared_dir
from ..streaming import ingest
from .registry import query


@query("f9_number_formats", "orders", sql="""
SELECT o_orderkey, printf('%.2f', c / 100.0) AS fixed, CASE WHEN c % 2 = 0 THEN '(' || CAST(k AS STRING) || ')' ELSE CAST(k AS STRING) END AS signed, CAST(k AS STRING) || '%' AS percent,
  strftime(o_orderdate, '%Y-%m-%d') AS day, lpad(CAST(k AS STRING), 5, '0') || ' u' AS padded, CAST(k * 24 AS STRING) || ':00' AS elapsed
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 99991 AS c, o_custkey % 10000 + 1 AS k FROM orders)
""")
def _(orders):
    base = orders.selectExpr("*", "cast(floor(o_totalprice) as bigint) % 99991 c", "o_custkey % 10000 + 1 k")
    f = lambda v, code: numberformat.formatted(v, F.lit(code))
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    sign = F.when(F.col("c") % 2 == 0, -F.col("k")).otherwise(F.col("k"))
    return base.select(
        "o_orderkey", f(F.col("c") / 100, "0.00").alias("fixed"), f(sign, "0;(0)").alias("signed"), f(F.col("k") / 100, "0%").alias("percent"), f(serial, "yyyy-mm-dd").alias("day"),
        f(F.col("k"), '00000" u"').alias("padded"), f(F.col("k"), "[h]:mm").alias("elapsed"),
    )


@query("f9_simple_formats", "orders", sql="SELECT o_orderkey, printf('%.2f', CAST(floor(o_totalprice) AS BIGINT) / 4.0) AS shown FROM orders")
def _(orders):
    return orders.select("o_orderkey", numberformat.simple(F.floor("o_totalprice") / 4, 2, False).alias("shown"))


def _lines(cells):
    """Ruling lines of a 4 x 3 grid on each sheet; every sheet divisible by three lacks one inner line."""
    pages = cells.select(F.col("sheet_id").alias("doc_id"), F.lit(1).alias("page")).distinct()
    h = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).selectExpr("doc_id", "page", "true horizontal", "k * 20D fixed", "0D lo", "if(doc_id % 3 = 0 and k = 1, 40D, 120D) hi")
    v = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).selectExpr("doc_id", "page", "false horizontal", "k * 40D + if(doc_id % 2 = 0, 1D, 0D) fixed", "0D lo", "80D hi")
    return h.unionByName(v)


@query("g6_ruled_tables", "cells", sql="""
WITH s AS (SELECT DISTINCT sheet_id AS doc_id FROM cells), g AS (SELECT doc_id, r, c FROM s, (SELECT unnest(generate_series(0, 3)) AS r), (SELECT unnest(generate_series(0, 2)) AS c))
SELECT doc_id, 1 AS page, CAST(r AS INT) AS row_no, CAST(c AS INT) AS col_no, CASE WHEN doc_id % 3 = 0 AND r = 0 AND c > 0 THEN 2 ELSE 1 END AS row_span, 1 AS col_span FROM g WHERE NOT (doc_id % 3 = 0 AND r = 1 AND c > 0)
""")
def _(cells):
    return inference.ruled_tables(_lines(cells)).select("doc_id", "page", "row_no", "col_no", "row_span", "col_span")


@query("g7_aligned_tables", "shapes", sql="SELECT canvas_id, shape_id, shape_id // 4 AS row_no, shape_id % 4 AS col_no FROM shapes WHERE shape_id < 12")
def _(shapes):
    grid = shapes.selectExpr("canvas_id", "shape_id", "if(shape_id < 12, shape_id % 4 * 100D + canvas_id % 5, 1000D + shape_id * 50) x", "if(shape_id < 12, floor(shape_id / 4) * 50D, 1000D + shape_id * 50) y")
    return inference.aligned_tables(grid)


@query("g12_drawn_lines", "fragments", sql="""
SELECT doc_id, page, frag_id, CASE WHEN frag_id % 5 = 0 THEN 'strike' ELSE 'underline' END AS decoration FROM fragments WHERE frag_id % 5 IN (0, 1)
""")
def _(fragments):
    spaced = fragments.withColumn("y", F.col("frag_id") * 30.0)
    strokes = spaced.where("frag_id % 5 in (0, 1, 2)").selectExpr("doc_id", "page", "y + h * if(frag_id % 5 = 0, 0.5D, 1D) y", "x x1", "x + w * if(frag_id % 5 = 2, 0.3D, 1D) x2")
    return inference.drawn_lines(spaced, strokes)


def _pairs(connectors, shapes):
    near = layout.nearest_shapes(connectors, shapes, 100.0, 300.0)
    return near.selectExpr("canvas_id", "shape_id label_id", "connector_id edge_id", "round(1 - distance / 300, 6) score").where("score > 0.6")


@query("j14_label_assignment", "connectors", "shapes")
def _(connectors, shapes):
    """Largest total score of a matching; tested against all matchings by brute force."""
    return inference.assign_labels(_pairs(connectors, shapes))


@query("t4_connection_search", "connectors", "shapes")
def _(connectors, shapes):
    near = layout.nearest_shapes(connectors, shapes, 100.0, 400.0)
    a, b = near.selectExpr("canvas_id", "connector_id", "shape_id src", "distance da"), near.selectExpr("canvas_id", "connector_id", "shape_id dst", "distance db")
    both = a.join(b, ["canvas_id", "connector_id"]).where("src <> dst").selectExpr("canvas_id", "connector_id", "src", "dst", "round(1 - (da + db) / 800, 6) score")
    return inference.solve_connections(both)


@query("g11_sequence_diagrams", "shapes", sql="""
SELECT canvas_id, CAST(k + 1 AS INT) AS place, CASE WHEN k % 2 = 0 THEN 'actor0' ELSE 'actor1' END AS source, CASE WHEN k % 2 = 0 THEN 'actor1' ELSE 'actor' || CASE WHEN canvas_id % 2 = 0 THEN 2 ELSE 0 END END AS target, k % 2 = 1 AS is_reply
FROM (SELECT DISTINCT canvas_id FROM shapes), (SELECT unnest(generate_series(0, 3)) AS k)
""")
def _(shapes):
    base = shapes.select("canvas_id").distinct()
    heads = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).selectExpr("canvas_id", "k shape_id", "k * 200D x", "10D y", "80D w", "30D h", "concat('actor', k) label")
    lives = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).selectExpr("canvas_id", "k line_id", "k * 200D + 40 x1", "40D y1", "k * 200D + 40 x2", "400D y2", "true dashed")
    arrows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).selectExpr(
        "canvas_id", "10 + k line_id", "if(k % 2 = 0, 40D, 240D) x1", "100D + k * 40 y1", "if(k % 2 = 0, 240D, if(canvas_id % 2 = 0, 440D, 40D)) x2", "100D + k * 40 y2", "k % 2 = 1 dashed"
    )
    return inference.sequence_diagrams(heads, lives.unionByName(arrows))


@query("w14_column_order", "fragments", sql="""
WITH f AS (SELECT doc_id, page, frag_id, CASE WHEN frag_id % 2 = 0 THEN 40 ELSE 300 END AS x, y FROM fragments)
SELECT doc_id, page, frag_id, CASE WHEN x > 200 THEN 1 ELSE 0 END AS column, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY x, y, frag_id) AS INT) AS place FROM f
""")
def _(fragments):
    return inference.column_order(fragments.withColumn("x", F.when(F.col("frag_id") % 2 == 0, 40.0).otherwise(300.0)))


@query("f22_mermaid", "connectors", sql="""
SELECT canvas_id, 'flowchart TD' || chr(10) || string_agg('  n' || s || CASE WHEN path_kind <> 'BUILDING' THEN ' -->|' || path_kind || '| n' ELSE ' --> n' END || d, chr(10) ORDER BY s, d, path_kind <> 'BUILDING', path_kind) AS mermaid
FROM (SELECT canvas_id, connector_id AS s, connector_id + 1 AS d, path_kind FROM connectors) GROUP BY canvas_id
""")
def _(connectors):
    edges = connectors.selectExpr("canvas_id", "connector_id src", "connector_id + 1 dst", "if(path_kind = 'BUILDING', '', path_kind) label")
    return inference.mermaid(edges)


@query("t6_output_budget", "diagnostics", sql="""
SELECT doc_id, diag_id, CAST(place AS INT) AS place, greatest(n - 3, 0) AS omitted FROM (SELECT doc_id, diag_id, row_number() OVER (PARTITION BY doc_id ORDER BY severity, diag_id) AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM diagnostics) WHERE place <= 3
""")
def _(diagnostics):
    return inference.capped(diagnostics, "doc_id", ["severity", "diag_id"], 3).select("doc_id", "diag_id", "place", "omitted")


@query("s_html_nodes", "pages", sql=r"""
WITH a AS (SELECT page_id, string_split(regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<(p|h1)>', chr(1) || '\1>', 'g'), chr(1)) AS x FROM pages),
b AS (SELECT page_id, unnest(x[2:]) AS x, generate_subscripts(x[2:], 1) AS i FROM a),
t AS (SELECT page_id, i, CASE WHEN starts_with(x, 'h1>') THEN 'Heading' ELSE 'Paragraph' END AS kind,
  trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '^[^>]*>', ''), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS place, kind, text FROM t WHERE text <> ''
""")
def _(pages):
    """Blocks of the article with their text."""
    nodes = html.page_nodes(pages).where("layer = 'Body' and kind in ('Paragraph', 'Heading')")
    return nodes.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("ord")).alias("place"), "kind", "text")


@query("k2_readable_html", "nodes", sql="""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, node_id) AS INT) AS place, CASE WHEN kind IN ('Heading', 'ListItem') THEN kind ELSE 'Paragraph' END AS kind, CASE WHEN kind = 'Heading' THEN heading_level ELSE 0 END AS level, text FROM nodes WHERE text <> ''
""")
def _(nodes):
    """The documents as HTML, read again by the HTML source; the table of contents is furniture."""
    pages = html.readable(nodes).withColumnRenamed("doc_id", "page_id")
    back = html.page_nodes(pages).where("layer = 'Body'")
    return back.select(F.col("page_id").alias("doc_id"), F.row_number().over(W.partitionBy("page_id").orderBy("ord")).alias("place"), "kind", F.col("heading_level").alias("level"), "text")


_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100, 2) AS total FROM events GROUP BY ALL"


@query("x_event_windows", "events", sql=_WINDOWS)
def _(events):
    return ingest.windowed(events)


@query("x_event_sessions", "events", sql="""
WITH s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k
""")
def _(events):
    return ingest.sessions(events)


@query("x_streamed_blocks", "documents", sql=r"""
SELECT doc_id, count(*) AS n_lines, CAST(sum(length(raw)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents) WHERE trim(raw) <> '' GROUP BY doc_id
""")
def _(documents):
    """documents as a stream of files through the stateless line plan, into a table."""
    spark = documents.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    documents.repartition(4).write.parquet(f"{folder}/in")
    stream = ingest.lines(ingest.arriving(spark, f"{folder}/in", documents.schema, 2)).select("doc_id", "raw")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("raw")).alias("chars"))
