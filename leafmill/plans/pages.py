"""Queries over page layout and drawings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from .registry import query

_MID = "list_sort(list({0}))[CAST(floor(count(*) / 2) AS BIGINT) + 1]"


@query("a13_body_size", "fragments", sql=f"SELECT doc_id, CASE WHEN count(*) >= 3 THEN {_MID.format('font_size')} END AS body_size, count(*) AS n_lines FROM fragments WHERE length(text) >= 20 GROUP BY doc_id")
def _(fragments):
    return layout.body_size(fragments)


@query("a15_document_body_size", "nodes", sql=f"SELECT doc_id, coalesce(CASE WHEN count(*) >= 1 THEN {_MID.format('heading_level + 8')} END, 11) AS body_size FROM nodes WHERE length(text) >= 80 GROUP BY doc_id")
def _(nodes):
    sized = nodes.withColumn("font_size", F.col("heading_level") + 8)
    return layout.body_size(sized, 80, 1).select("doc_id", F.coalesce("body_size", F.lit(11)).alias("body_size"))


@query("a14_body_family", "fragments", sql="""
SELECT doc_id, CASE WHEN max(c) * 2 > sum(c) THEN first(font_family ORDER BY c DESC, font_family DESC) END AS family FROM (SELECT doc_id, font_family, sum(length(text)) AS c FROM fragments GROUP BY ALL) GROUP BY doc_id
""")
def _(fragments):
    return layout.body_family(fragments)


_MASK = r"regexp_replace(regexp_replace(lower(trim(text)), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')"


@query("a16_repeated_furniture", "fragments", sql=f"""
WITH p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM fragments GROUP BY doc_id), s AS (SELECT doc_id, CASE WHEN y < 60 THEN 'top' WHEN y > 340 THEN 'bottom' END AS place, {_MASK} AS key, count(DISTINCT page) AS n FROM fragments GROUP BY 1, 2, 3)
SELECT s.doc_id, place, key, n FROM s JOIN p USING (doc_id) WHERE place IS NOT NULL AND n >= ceil(pages / 2) AND n >= 2
""")
def _(fragments):
    return layout.repeated_furniture(fragments)


@query("e33_running_forms", "fragments", sql=f"""
SELECT doc_id, {_MASK} AS key, count(DISTINCT page) AS n, first(text ORDER BY page, frag_id) AS first, last(text ORDER BY page, frag_id) AS last FROM fragments GROUP BY 1, 2 HAVING count(DISTINCT page) > 1 AND contains(key, '#') AND key <> '#'
""")
def _(fragments):
    return layout.running_forms(fragments)


@query("e38_repeated_slide_footers", "fragments", sql=f"SELECT doc_id, page, frag_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, {_MASK}) AS n FROM fragments WHERE y >= 320) WHERE n >= 2")
def _(fragments):
    from pyspark.sql import Window as W

    low = fragments.where("y >= 320")
    return low.withColumn("n", F.count("*").over(W.partitionBy("doc_id", layout.masked(F.col("text"))))).where("n >= 2").select("doc_id", "page", "frag_id")


@query("f12_heading_level", "fragments", sql=f"""
WITH b AS (SELECT doc_id, CASE WHEN count(*) >= 3 THEN {_MID.format('font_size')} END AS bs FROM fragments WHERE length(text) >= 20 GROUP BY doc_id)
SELECT doc_id, page, frag_id, CASE WHEN font_size / bs >= 1.6 THEN 1 WHEN font_size / bs >= 1.2 THEN 2 WHEN bold AND length(text) <= 40 THEN 3 END AS level FROM fragments LEFT JOIN b USING (doc_id)
""")
def _(fragments):
    return layout.heading_level(fragments).select("doc_id", "page", "frag_id", "level")


_BANDS = """m AS (SELECT *, list_sort(list(h) OVER (PARTITION BY doc_id, page))[CAST(floor(count(*) OVER (PARTITION BY doc_id, page) / 2) AS BIGINT) + 1] AS mh FROM fragments),
g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x, frag_id) AS gap FROM m),
bands AS (SELECT *, CAST(sum(CASE WHEN gap > mh * 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, x, frag_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM g)"""


@query("a26_bands", "fragments", sql=f"WITH {_BANDS} SELECT doc_id, page, frag_id, band FROM bands")
def _(fragments):
    return layout.bands(fragments).select("doc_id", "page", "frag_id", "band")


@query("w13_reading_order", "fragments", sql=f"WITH {_BANDS} SELECT doc_id, page, frag_id, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY band, x, frag_id) AS INT) AS place FROM bands")
def _(fragments):
    return layout.reading_order(fragments).select("doc_id", "page", "frag_id", "place")


_RUNS = f"""WITH {_BANDS}, r AS (SELECT *, x - lag(x + w) OVER v AS gp FROM bands WINDOW v AS (PARTITION BY doc_id, page, band ORDER BY x, frag_id)),
runs AS (SELECT *, CAST(sum(CASE WHEN gp > h * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, band ORDER BY x, frag_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r)"""


@query("w15_line_runs", "fragments", sql=f"{_RUNS} SELECT doc_id, page, band, run, min(x) AS x, max(x + w) AS x2, string_agg(text, ' ' ORDER BY x, frag_id) AS text FROM runs GROUP BY doc_id, page, band, run")
def _(fragments):
    return layout.line_runs(fragments)


@query("w16_e29_paragraphs", "fragments", sql=r"""
WITH l AS (SELECT *, frag_id AS line FROM fragments), p AS (SELECT *, lag(text) OVER w AS pt, lag(font_size) OVER w AS ps, lag(x) OVER w AS px FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY page, line)),
g AS (SELECT *, CAST(sum(CASE WHEN pt IS NOT NULL AND NOT regexp_matches(pt, '[.!?。:]\s*$') AND ps = font_size AND NOT regexp_matches(text, '^\s*(\d+[.)]|[-•*])\s') AND x <= px + 10 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para FROM p)
SELECT doc_id, para, CAST(count(*) AS INT) AS n_lines, string_agg(text, ' ' ORDER BY page, line) AS text FROM g GROUP BY doc_id, para
""")
def _(fragments):
    return layout.paragraphs(fragments.withColumnRenamed("frag_id", "line"))


@query("w12_list_runs", "fragments", sql=r"""
WITH l AS (SELECT doc_id, page, frag_id AS line, text, row_number() OVER (PARTITION BY doc_id, page ORDER BY frag_id) AS n FROM fragments), i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM l WHERE regexp_matches(text, '^\s*(\d+[.)]|[-•*])\s'))
SELECT doc_id, page, CAST(run AS INT) AS run, min(line) AS first_line, count(*) AS n_items FROM i GROUP BY doc_id, page, run
""")
def _(fragments):
    return layout.list_runs(fragments.withColumnRenamed("frag_id", "line"))


@query("w12_list_levels", "fragments", sql="""
WITH RECURSIVE n AS (SELECT doc_id, page, frag_id AS line, x / 45.0 AS x, row_number() OVER (PARTITION BY doc_id, page ORDER BY frag_id) AS i FROM fragments),
f AS (SELECT doc_id, page, line, i, [CAST(x AS DOUBLE)] AS st FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.page, n.line, n.i, CASE WHEN len(list_filter(f.st, lambda s: s <= n.x + 1 AND abs(s - n.x) <= 1)) > 0 THEN list_filter(f.st, lambda s: s <= n.x + 1) ELSE list_append(list_filter(f.st, lambda s: s <= n.x + 1), CAST(n.x AS DOUBLE)) END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.page = f.page AND n.i = f.i + 1) SELECT doc_id, page, line, CAST(len(st) AS INT) AS level FROM f
""")
def _(fragments):
    return layout.list_levels(fragments.selectExpr("doc_id", "page", "frag_id line", "cast(x / 45 as double) x"), 1.0)


_D2 = "power(greatest(s.x - c.x1, c.x1 - s.x - s.w, 0), 2) + power(greatest(s.y - c.y1, c.y1 - s.y - s.h, 0), 2)"


@query("j9_t3_nearest_shapes", "connectors", "shapes", sql=f"""
WITH d AS (SELECT c.canvas_id, connector_id, shape_id, {_D2} AS d2 FROM connectors c JOIN shapes s ON s.canvas_id = c.canvas_id), r AS (SELECT *, row_number() OVER (PARTITION BY canvas_id, connector_id ORDER BY d2, shape_id) AS rank FROM d WHERE d2 <= 10000)
SELECT canvas_id, connector_id, shape_id, CAST(rank AS INT) AS rank, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= 4
""")
def _(connectors, shapes):
    return layout.nearest_shapes(connectors, shapes)


_TOUCH = "t AS (SELECT a.canvas_id, a.shape_id AS a, b.shape_id AS b FROM shapes a JOIN shapes b ON a.canvas_id = b.canvas_id AND a.shape_id < b.shape_id AND a.x - 40 <= b.x + b.w + 40 AND b.x - 40 <= a.x + a.w + 40 AND a.y - 40 <= b.y + b.h + 40 AND b.y - 40 <= a.y + a.h + 40)"


@query("j11_touching_shapes", "shapes", sql=f"WITH {_TOUCH} SELECT * FROM t")
def _(shapes):
    return layout.touching(shapes, 40.0)


@query("a22_clusters", "shapes", sql=f"""
WITH RECURSIVE {_TOUCH}, e AS (SELECT canvas_id, a, b FROM t UNION SELECT canvas_id, b, a FROM t UNION SELECT canvas_id, shape_id, shape_id FROM shapes),
c AS (SELECT canvas_id, a, b FROM e UNION SELECT c.canvas_id, c.a, e.b FROM c JOIN e ON c.canvas_id = e.canvas_id AND c.b = e.a) SELECT canvas_id, a AS shape_id, min(b) AS cluster FROM c GROUP BY canvas_id, a
""")
def _(shapes):
    return layout.clusters(shapes, layout.touching(shapes, 40.0))


@query("a25_scale", "shapes", sql=f"""
WITH s AS (SELECT canvas_id, {_MID.format('least(w, h)')} AS minor, sqrt(power(max(x + w) - min(x), 2) + power(max(y + h) - min(y), 2)) AS dg FROM shapes GROUP BY canvas_id)
SELECT canvas_id, minor, round(dg, 6) AS diagonal, round(least(greatest(minor * 0.45, dg * 0.01), dg * 0.06), 6) AS safe_radius, round(least(greatest(minor * 0.8, dg * 0.015), dg * 0.10), 6) AS balanced_radius FROM s
""")
def _(shapes):
    return layout.scale(shapes)


@query("j12_owned_fragments", "fragments", sql="""
WITH b AS (SELECT DISTINCT doc_id, page, k AS box_id, k * 100.0 AS l, k * 100.0 + 130 AS r, 30.0 AS t, 250.0 AS u FROM fragments, (VALUES (0), (1), (2), (3)) AS v(k)),
j AS (SELECT f.doc_id, f.page, frag_id, box_id, count(*) OVER (PARTITION BY f.doc_id, f.page, frag_id) AS n FROM fragments f JOIN b ON f.doc_id = b.doc_id AND f.page = b.page AND x + w / 2 >= l AND x + w / 2 < r AND y + h / 2 >= t AND y + h / 2 < u)
SELECT doc_id, page, frag_id, box_id FROM j WHERE n = 1
""")
def _(fragments):
    boxes = fragments.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("box_id")).selectExpr("*", "box_id * 100D left_", "box_id * 100D + 130 right_", "30D top", "250D bottom")
    return layout.owned_fragments(fragments, boxes)


@query("j13_overlap_columns", "shapes", sql="""
SELECT canvas_id, shape_id, min(k) AS first_col, max(k) AS last_col FROM shapes, (SELECT unnest(generate_series(0, 26)) AS k) WHERE least(x + w, k * 40 + 40) - greatest(x, k * 40) >= 20 GROUP BY canvas_id, shape_id
""")
def _(shapes):
    columns = shapes.select("canvas_id").distinct().select("canvas_id", F.explode(F.sequence(F.lit(0), F.lit(26))).alias("col_no")).selectExpr("*", "col_no * 40D x1", "col_no * 40D + 40 x2")
    return layout.overlap_columns(shapes, columns)


@query("f18_f19_connection_score", "connectors", sql="""
WITH s AS (SELECT canvas_id, connector_id, round((x1 / 1100 * 0.45 + y1 / 650 * 0.2 + x2 / 1100 * 0.15 + y2 / 650 * 0.1) / 0.9 - CASE WHEN resolved THEN 0 ELSE 0.6 END, 6) AS score, round(sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)), 6) AS span FROM connectors)
SELECT *, CASE WHEN score >= 0.75 AND span / 1000 >= 0.15 THEN 'High' WHEN score >= 0.5 AND span / 1000 >= 0.05 THEN 'Medium' ELSE 'Low' END AS class FROM s
""")
def _(connectors):
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    score = layout.connection_score(x1 / 1100, y1 / 650, x2 / 1100, y2 / 650, ~F.col("resolved"))
    out = connectors.select("canvas_id", "connector_id", F.round(score, 6).alias("score"), F.round(layout.distance(x1, y1, x2, y2), 6).alias("span"))
    return out.withColumn("class", layout.confidence_class(F.col("score"), F.col("span") / 1000))


@query("a24_f20_ocr_lines", "fragments", sql="""
WITH w AS (SELECT doc_id * 100 + page AS page, frag_id // 4 AS line, frag_id % 4 AS word, CASE WHEN frag_id % 3 = 0 THEN '日本' ELSE 'w' || frag_id END AS text, (frag_id % 4) * 44.0 AS l, 40.0 AS width, 12.0 AS height, w / 100 + 0.1 AS confidence FROM fragments),
p AS (SELECT *, lag(text) OVER v AS pt, lag(confidence) OVER v AS pc, l - lag(l + width) OVER v AS gap, row_number() OVER v AS n FROM w WINDOW v AS (PARTITION BY page, line ORDER BY word))
SELECT page, line, string_agg(CASE WHEN n = 1 OR coalesce(text = '日本' AND pt = '日本' AND least(confidence, pc) >= 0.6 AND gap <= height * 0.5, false) THEN text ELSE ' ' || text END, '' ORDER BY word) AS text, count(*) AS n, round(avg(confidence), 6) AS confidence FROM p GROUP BY page, line
""")
def _(fragments):
    words = fragments.selectExpr("doc_id * 100 + page page", "cast(floor(frag_id / 4) as int) line", "frag_id % 4 word", "case when frag_id % 3 = 0 then '日本' else 'w' || frag_id end text", "(frag_id % 4) * 44D left_", "40D width", "12D height", "w / 100 + 0.1D confidence")
    return layout.ocr_lines(words)


@query("w17_dash_runs", "connectors", sql="""
WITH s AS (SELECT canvas_id, 0 AS fixed, connector_id, k, connector_id * 200 + k * CASE WHEN resolved THEN 8 ELSE 20 END AS lo, connector_id * 200 + k * CASE WHEN resolved THEN 8 ELSE 20 END + 5 AS hi FROM connectors, (SELECT unnest(generate_series(0, 5)) AS k))
SELECT canvas_id, fixed, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY canvas_id, fixed, connector_id HAVING bool_and(hi - lo = 5) AND max(lo) - min(lo) = 40
""")
def _(connectors):
    strokes = connectors.select("canvas_id", F.lit(0).alias("fixed"), "connector_id", "resolved", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).selectExpr("canvas_id", "fixed", "connector_id * 200 + k * if(resolved, 8, 20) lo", "connector_id * 200 + k * if(resolved, 8, 20) + 5 hi")
    return layout.dash_runs(strokes).select("canvas_id", "fixed", "n", "lo", "hi")


@query("e25_scripts", "fragments", sql=f"""
WITH {_BANDS}, p AS (SELECT *, CASE WHEN frag_id % 5 = 4 THEN 6.0 ELSE 10.0 END AS fs, band * 20 + CASE WHEN frag_id % 5 = 4 AND page % 2 = 0 THEN 4 WHEN frag_id % 5 = 4 THEN -4 ELSE 0 END AS yy, frag_id * 50.0 AS xx FROM bands),
l AS (SELECT *, lag(fs) OVER v AS ps, lag(yy + 12) OVER v AS pb, lag(xx + 49) OVER v AS pe FROM p WINDOW v AS (PARTITION BY doc_id, page, band ORDER BY xx, frag_id))
SELECT doc_id, page, frag_id, CASE WHEN fs <= ps * 0.75 AND xx - pe <= ps * 0.3 AND (pb - yy - 12) / ps > 0.1 THEN 'super' WHEN fs <= ps * 0.75 AND xx - pe <= ps * 0.3 AND (pb - yy - 12) / ps < -0.1 THEN 'sub' END AS script FROM l
""")
def _(fragments):
    rows = layout.bands(fragments).selectExpr(
        "doc_id", "page", "frag_id", "band", "if(frag_id % 5 = 4, 6D, 10D) font_size", "cast(band * 20 + case when frag_id % 5 = 4 and page % 2 = 0 then 4 when frag_id % 5 = 4 then -4 else 0 end as double) y", "frag_id * 50D x", "49D w", "12D h"
    )
    return layout.scripts(rows).select("doc_id", "page", "frag_id", "script")


@query("e26_separator_rules", "fragments", sql="""
WITH h AS (SELECT doc_id, page, frag_id AS line_id, y, x AS a, x + w AS b FROM fragments WHERE frag_id % 4 = 0), v AS (SELECT doc_id, page, x AS f, y AS lo, y + 60 AS hi FROM fragments WHERE frag_id % 4 = 1)
SELECT doc_id, page, line_id FROM h WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = h.doc_id AND v.page = h.page AND f BETWEEN a - 2 AND b + 2 AND y BETWEEN lo - 2 AND hi + 2)
""")
def _(fragments):
    lines = fragments.where("frag_id % 4 < 2").selectExpr("doc_id", "page", "frag_id line_id", "frag_id % 4 = 0 horizontal", "if(frag_id % 4 = 0, y, x) fixed", "if(frag_id % 4 = 0, x, y) lo", "if(frag_id % 4 = 0, x + w, y + 60) hi")
    return layout.separators(lines)


@query("e27_annotation_markup", "fragments", sql="""
WITH a AS (SELECT doc_id, page, x + 10 AS x1, x + 60 AS x2, y - 2 AS y1, y + 14 AS y2, CASE frag_id % 3 WHEN 0 THEN 'strike' WHEN 1 THEN 'underline' ELSE 'link' END AS kind FROM fragments WHERE frag_id % 6 < 2)
SELECT f.doc_id, f.page, frag_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM fragments f JOIN a ON a.doc_id = f.doc_id AND a.page = f.page AND least(x2, x + w) - greatest(x1, x) >= w * 0.5 AND least(y2, y + h) - greatest(y1, y) > 0 GROUP BY ALL
""")
def _(fragments):
    notes = fragments.where("frag_id % 6 < 2").selectExpr("doc_id", "page", "x + 10 x1", "x + 60 x2", "y - 2 y1", "y + 14 y2", "case frag_id % 3 when 0 then 'strike' when 1 then 'underline' else 'link' end kind")
    return layout.marked_up(fragments, notes)


_CODES = "c AS (SELECT o_orderkey AS text_id, unnest(generate_series(0, 3)) AS pos, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS font, 65 + (o_custkey + unnest(generate_series(0, 3))) % 20 AS code, 8 + o_custkey % 5 AS size FROM orders)"


def _codes(orders):
    return orders.select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).selectExpr("o_orderkey text_id", "pos", "if(o_custkey % 2 = 0, 'A', 'B') font", "65 + (o_custkey + pos) % 20 code", "8 + o_custkey % 5 size")


@query("e22_decoded_codes", "orders", "nation", sql=f"WITH {_CODES} SELECT text_id, string_agg(CASE WHEN font = 'A' AND code - 65 IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) THEN 'x' || (code - 65) ELSE chr(CAST(code AS INT)) END, '' ORDER BY pos) AS text FROM c GROUP BY text_id")
def _(orders, nation):
    glyphs = nation.where("n_nationkey % 3 = 0").selectExpr("'A' font", "cast(n_nationkey + 65 as bigint) code", "concat('x', n_nationkey) char")
    return layout.decoded_codes(_codes(orders), glyphs)


@query("e23_measured_texts", "orders", "nation", sql=f"WITH {_CODES} SELECT text_id, round(sum(CASE WHEN font = 'A' THEN 300 + (code - 65) * 10 ELSE 500 END * size) / 1000, 6) AS width FROM c GROUP BY text_id")
def _(orders, nation):
    widths = nation.selectExpr("'A' font", "cast(n_nationkey + 65 as bigint) code", "300 + n_nationkey * 10 width")
    return layout.measured(_codes(orders), widths)


@query("e28_page_blocks", "fragments", sql="""
SELECT doc_id, page, frag_id AS ref, CASE WHEN frag_id % 7 = 0 THEN 'table' WHEN frag_id % 7 = 1 THEN 'image' ELSE 'text' END AS kind, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, CASE WHEN frag_id % 7 = 0 THEN 'table' WHEN frag_id % 7 = 1 THEN 'image' ELSE 'text' END, frag_id) AS INT) AS place FROM fragments
""")
def _(fragments):
    rows = fragments.withColumn("ref", F.col("frag_id"))
    return layout.page_blocks(rows.where("frag_id % 7 > 1"), rows.where("frag_id % 7 = 0"), rows.where("frag_id % 7 = 1")).select("doc_id", "page", "ref", "kind", "place")


@query("e41_layout_record", "cells", sql="""
WITH r AS (SELECT sheet_id, row_no, 4 + sum(length(coalesce(value, '')) + 3) AS n FROM cells GROUP BY sheet_id, row_no)
SELECT sheet_id, row_no, CAST(n AS BIGINT) AS length, CAST(coalesce(sum(n + 1) OVER (PARTITION BY sheet_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM r
""")
def _(cells):
    """Where each row's line starts in its sheet's text."""
    from pyspark.sql import Window as W

    rows = cells.groupBy("sheet_id", "row_no").agg((F.sum(F.length(F.coalesce("value", F.lit(""))) + 3) + 4).alias("length"))
    before = W.partitionBy("sheet_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)).cast("long"))


@query("k6_json_lines", "nodes", sql="SELECT node_id, kind, text, ord FROM nodes")
def _(nodes):
    """Nodes as JSON lines, read again under an explicit schema."""
    lines = nodes.select(F.to_json(F.struct("node_id", "kind", "text", "ord")).alias("line"))
    return lines.select(F.from_json("line", "node_id string, kind string, text string, ord int").alias("n")).select("n.*")


@query("k9_publish", "nodes", sql="SELECT node_id, kind, text, ord, true AS kept FROM nodes")
def _(nodes):
    """Published once and read back; a second table for the same target is refused and changes nothing."""
    import uuid

    from ..storage import publish, shared_dir

    path = f"{shared_dir(nodes.sparkSession)}/published-{uuid.uuid4().hex}"
    publish(nodes.select("node_id", "kind", "text", "ord"), path)
    try:
        publish(nodes.select("node_id"), path)
    except FileExistsError:
        refused = True
    else:
        refused = False
    return nodes.sparkSession.read.parquet(path).withColumn("kept", F.lit(refused))
