"""Queries over styles, numbering, slides, reviews and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import styles
from .registry import query


@query("e2_style_chains", "part", sql="""
WITH RECURSIVE s AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey % 30 > 0 THEN p_partkey - 1 END AS based_on, CASE WHEN p_size % 16 = 0 THEN p_size END AS value FROM part),
c AS (SELECT style_id, based_on, value, 0 AS d FROM s UNION ALL SELECT c.style_id, s.based_on, s.value, d + 1 FROM c JOIN s ON c.based_on = s.style_id WHERE c.value IS NULL)
SELECT style_id, max(value) AS value FROM c GROUP BY style_id
""")
def _(part):
    return styles.style_chain(part.selectExpr("p_partkey style_id", "case when p_partkey % 30 > 0 then p_partkey - 1 end based_on", "case when p_size % 16 = 0 then p_size end value"), "value")


@query("e1_hidden_runs", "nodes", "part", sql="""
WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN true WHEN p_size % 5 = 1 THEN false END AS v FROM part)
SELECT node_id, coalesce(CASE WHEN ord % 9 = 0 THEN true END, a.v, b.v, c.v, false) AS hidden FROM nodes LEFT JOIN s a ON a.id = ord LEFT JOIN s b ON b.id = heading_level LEFT JOIN s c ON c.id = partition_order
""")
def _(nodes, part):
    table = part.selectExpr("p_partkey style_id", "cast(null as bigint) based_on", "case when p_size % 5 = 0 then true when p_size % 5 = 1 then false end vanish")
    runs = nodes.selectExpr("node_id", "case when ord % 9 = 0 then true end vanish", "cast(ord as bigint) char_style", "cast(heading_level as bigint) para_style", "cast(partition_order as bigint) table_style")
    return styles.hidden_runs(runs, table).select("node_id", "hidden")


@query("e3_code_blocks", "nodes", sql="""
WITH p AS (SELECT doc_id, ord, text, kind IN ('Paragraph', 'ListItem') AND heading_level > 1 AS mono, trim(text) = '' AS blank FROM nodes), s AS (SELECT *, sum(CASE WHEN NOT blank AND NOT mono THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM p)
SELECT doc_id, min(ord) FILTER (WHERE NOT blank) AS first_ord, max(ord) FILTER (WHERE NOT blank) AS last_ord, count(*) FILTER (WHERE NOT blank) AS n FROM s WHERE mono OR blank GROUP BY doc_id, k HAVING count(*) FILTER (WHERE NOT blank) >= 2
""")
def _(nodes):
    return styles.code_blocks(nodes.selectExpr("doc_id", "ord", "text", "kind in ('Paragraph', 'ListItem') and heading_level > 1 mono"))


@query("e4_list_numbers", "nodes", sql="""
WITH RECURSIVE i AS (SELECT doc_id, node_id, (heading_level * 3 + ord) % 9 AS lv, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM nodes),
f AS (SELECT doc_id, 0::BIGINT AS n, CAST('' AS VARCHAR) AS node_id, 0 AS lv, CAST([0, 0, 0, 0, 0, 0, 0, 0, 0] AS INT[]) AS c FROM (SELECT DISTINCT doc_id FROM nodes)
  UNION ALL SELECT i.doc_id, i.n, i.node_id, i.lv, list_transform(f.c, lambda x, k: CASE WHEN k - 1 < i.lv THEN x WHEN k - 1 = i.lv THEN x + 1 ELSE 0 END) FROM f JOIN i ON i.doc_id = f.doc_id AND i.n = f.n + 1)
SELECT node_id, array_to_string(c[1:lv + 1], '.') AS number FROM f WHERE n > 0
""")
def _(nodes):
    items = nodes.selectExpr("doc_id", "1 num_id", "ord", "node_id", "(heading_level * 3 + ord) % 9 level")
    return styles.list_numbers(items).select("node_id", "number")


@query("e5_alternate_content", "nodes", sql="""
SELECT doc_id AS choice_id, first(node_id ORDER BY r IS NULL, ord) AS node_id FROM (SELECT doc_id, ord, node_id, CASE WHEN kind = 'Heading' THEN 'wps' WHEN kind = 'Image' THEN 'wpg' WHEN kind = 'Paragraph' THEN NULL ELSE 'x99' END AS r FROM nodes) WHERE r IN ('wps', 'wpg') OR r IS NULL GROUP BY doc_id
""")
def _(nodes):
    branches = nodes.selectExpr("doc_id choice_id", "ord", "node_id", "case when kind = 'Heading' then 'wps' when kind = 'Image' then 'wpg' when kind = 'Paragraph' then null else 'x99' end requires")
    return styles.first_branch(branches, ["wps", "wpg"]).select("choice_id", "node_id")


@query("e7_style_changes", "nodes", sql="""
SELECT node_id, array_to_string(list_filter([CASE WHEN heading_level % 2 <> ord % 2 THEN 'bold' END, CASE WHEN heading_level <> ord % 4 + 1 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS changed FROM nodes
""")
def _(nodes):
    before, after = F.create_map(F.lit("bold"), F.col("heading_level") % 2, F.lit("size"), F.col("heading_level")), F.create_map(F.lit("bold"), F.col("ord") % 2, F.lit("size"), F.col("ord") % 4 + 1)
    held = nodes.select("node_id", before.alias("a"), after.alias("b"))
    changed = F.filter(F.array_sort(F.map_keys("a")), lambda k: F.element_at(F.col("a"), k) != F.element_at(F.col("b"), k))
    return held.select("node_id", F.array_join(changed, ",").alias("changed"))


@query("f13_docx_headings", "orders", sql=r"""
WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN '1.2 ' || o_orderpriority WHEN o_custkey % 9 = 1 THEN o_orderpriority || '.' ELSE o_orderpriority END AS t, CASE WHEN o_custkey % 13 = 0 THEN o_custkey % 4 END AS ol,
  CASE WHEN o_custkey % 7 = 0 THEN 'heading ' || (1 + o_custkey % 3) ELSE 'Normal' END AS st, o_custkey % 2 = 0 AS bold, 8 + o_custkey % 13 AS fs FROM orders),
q AS (SELECT *, length(trim(t)) BETWEEN 2 AND 100 AND NOT regexp_matches(trim(t), '[.!?。！？]\s*$') AS short FROM p),
r AS (SELECT *, coalesce(CASE WHEN ol IS NOT NULL THEN ol + 1 END, CASE WHEN starts_with(st, 'heading') THEN CAST(st[-1] AS BIGINT) END) AS sure, CASE WHEN short AND bold AND starts_with(t, '1.2 ') THEN 2 WHEN short AND fs >= 16 AND fs >= 11 * 1.35 THEN 1 WHEN short AND bold AND fs >= 11 * 1.2 THEN 2 END AS guess FROM q)
SELECT o_orderkey, CAST(coalesce(sure, guess) AS INT) AS level, CASE WHEN sure IS NOT NULL THEN 1.0 WHEN guess IS NOT NULL THEN 0.85 END AS confidence FROM r
""")
def _(orders):
    rows = orders.selectExpr(
        "o_orderkey", "case when o_custkey % 9 = 0 then '1.2 ' || o_orderpriority when o_custkey % 9 = 1 then o_orderpriority || '.' else o_orderpriority end text", "case when o_custkey % 13 = 0 then cast(o_custkey % 4 as int) end outline",
        "case when o_custkey % 7 = 0 then 'heading ' || (1 + o_custkey % 3) else 'Normal' end style", "o_custkey % 2 = 0 bold", "cast(8 + o_custkey % 13 as double) font_size", "11D body_size",
    )
    return styles.docx_heading(rows).select("o_orderkey", "level", "confidence")


@query("e9_placeholder_bullets", "orders", "nation", sql="""
SELECT o_orderkey, coalesce(CASE WHEN o_custkey % 5 = 0 THEN '-' END, (SELECT min(n_name) FROM nation WHERE n_nationkey = o_custkey % 40 AND n_regionkey = o_custkey % 3), (SELECT min('m' || n_nationkey) FROM nation WHERE n_nationkey = o_custkey % 40)) AS bullet FROM orders
""")
def _(orders, nation):
    shapes = orders.selectExpr("o_orderkey", "o_custkey % 40 layout_id", "o_custkey % 40 master_id", "cast(o_custkey % 3 as int) level", "'body' ph_type", "case when o_custkey % 5 = 0 then '-' end bullet")
    layouts = nation.selectExpr("cast(n_nationkey as bigint) layout_id", "'body' ph_type", "n_regionkey level", "n_name bullet")
    masters = nation.selectExpr("cast(n_nationkey as bigint) master_id", "'body' ph_type", "explode(array(0, 1, 2)) level", "'m' || n_nationkey bullet")
    return styles.inherited(shapes, layouts, masters, "bullet").select("o_orderkey", "bullet")


_SLIDES = """s AS (SELECT canvas_id AS doc_id, shape_id // 5 + 1 AS slide, shape_id, CASE WHEN shape_id % 5 = 0 AND canvas_id % 2 = 0 THEN 'title' WHEN shape_id % 5 = 4 THEN 'ftr' ELSE '' END AS ph_type, y, CAST(10 + shape_id % 5 * 5 AS DOUBLE) AS fs,
  CASE WHEN shape_id % 7 = 3 THEN '' WHEN shape_id % 6 = 1 THEN 'Chapter ... 12' ELSE label END AS text, canvas_id % 4 = 1 AS hidden FROM shapes),
r AS (SELECT *, CASE WHEN ph_type = 'title' THEN 'title' WHEN ph_type = 'ftr' THEN 'furniture' WHEN text = 'Chapter ... 12' THEN 'contents' WHEN y < 108 AND fs >= 24 AND length(text) <= 60 THEN 'title' WHEN y > 486 THEN 'furniture' ELSE 'body' END AS role FROM s)"""


def _slides(shapes):
    rows = shapes.selectExpr(
        "canvas_id doc_id", "cast(floor(shape_id / 5) as int) + 1 slide", "shape_id", "case when shape_id % 5 = 0 and canvas_id % 2 = 0 then 'title' when shape_id % 5 = 4 then 'ftr' else '' end ph_type", "y", "cast(10 + shape_id % 5 * 5 as double) font_size",
        "case when shape_id % 7 = 3 then '' when shape_id % 6 = 1 then 'Chapter ... 12' else label end text", "canvas_id % 4 = 1 hidden",
    )
    return styles.slide_roles(rows)


@query("e10_slide_roles", "shapes", sql=f"WITH {_SLIDES} SELECT doc_id, shape_id, role FROM r")
def _(shapes):
    return _slides(shapes).select("doc_id", "shape_id", "role")


@query("e36_slide_headings", "shapes", sql=f"""
WITH {_SLIDES} SELECT doc_id, slide, '## Slide ' || slide || CASE WHEN count(*) FILTER (WHERE role = 'title') > 0 THEN ' — ' || (first(trim(text) ORDER BY role <> 'title', y, shape_id)) ELSE '' END || CASE WHEN bool_or(hidden) THEN ' (hidden)' ELSE '' END AS heading FROM r WHERE trim(text) <> '' GROUP BY doc_id, slide
""")
def _(shapes):
    return styles.slide_headings(_slides(shapes))


@query("e11_swimlanes", "shapes", sql="SELECT canvas_id, shape_id, 'lane' || CAST(floor((y + h / 2) / 150) AS INT) AS lane FROM shapes WHERE y + h / 2 < 600")
def _(shapes):
    rows = shapes.select("canvas_id").distinct().select("canvas_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).selectExpr("canvas_id", "concat('lane', k) lane", "k * 150D top", "k * 150D + 150 bottom")
    return styles.lanes(shapes, rows)


@query("e12_f17_connector_geometry", "connectors", "shapes", sql="""
SELECT c.canvas_id, connector_id, count(*) AS crossed FROM connectors c JOIN shapes s ON s.canvas_id = c.canvas_id
WHERE (CASE WHEN x1 = x2 THEN x1 BETWEEN x AND x + w ELSE true END) AND (CASE WHEN y1 = y2 THEN y1 BETWEEN y AND y + h ELSE true END)
  AND greatest(CASE WHEN x1 = x2 THEN 0 ELSE least((x - x1) / (x2 - x1), (x + w - x1) / (x2 - x1)) END, CASE WHEN y1 = y2 THEN 0 ELSE least((y - y1) / (y2 - y1), (y + h - y1) / (y2 - y1)) END, 0)
   <= least(CASE WHEN x1 = x2 THEN 1 ELSE greatest((x - x1) / (x2 - x1), (x + w - x1) / (x2 - x1)) END, CASE WHEN y1 = y2 THEN 1 ELSE greatest((y - y1) / (y2 - y1), (y + h - y1) / (y2 - y1)) END, 1)
GROUP BY c.canvas_id, connector_id
""")
def _(connectors, shapes):
    return styles.segment_hits(connectors, shapes).groupBy("canvas_id", "connector_id").agg(F.count("*").alias("crossed"))


@query("e17_cell_notes", "cells", sql="SELECT c.sheet_id, c.row_no, c.col_no, n.value AS note FROM cells c LEFT JOIN cells n ON n.sheet_id = c.sheet_id AND n.col_no = c.col_no AND n.row_no = c.row_no + 1 AND n.amount % 6 = 0")
def _(cells):
    notes = cells.where("amount % 6 = 0").select("sheet_id", (F.col("row_no") - 1).alias("row_no"), "col_no", F.col("value").alias("note"))
    return cells.join(notes, ["sheet_id", "row_no", "col_no"], "left").select("sheet_id", "row_no", "col_no", "note")


@query("e19_emu_positions", "cells", sql="""
WITH z AS (SELECT sheet_id, row_no AS i, 100 + max(style_id) * 10 AS size FROM cells GROUP BY sheet_id, row_no), p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sheet_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM z),
a AS (SELECT sheet_id, row_no * 10 + col_no AS anchor_id, amount % 1500 AS pos FROM cells WHERE col_no = 1)
SELECT a.sheet_id, anchor_id, i AS index, CAST(pos - lo AS BIGINT) AS "offset" FROM a JOIN p ON a.sheet_id = p.sheet_id AND pos >= lo AND pos < lo + size
""")
def _(cells):
    sizes = cells.groupBy("sheet_id", F.col("row_no").alias("index")).agg((F.max("style_id") * 10 + 100).alias("size"))
    anchors = cells.where("col_no = 1").selectExpr("sheet_id", "row_no * 10 + col_no anchor_id", "amount % 1500 position")
    return styles.emu_cells(anchors, sizes)


@query("e20_unprojected_shapes", "shapes", "connectors", sql="SELECT canvas_id, shape_id FROM shapes s WHERE NOT EXISTS (SELECT 1 FROM connectors c WHERE c.canvas_id = s.canvas_id AND (c.src_alias = s.alias OR c.dst_alias = s.alias))")
def _(shapes, connectors):
    shown = connectors.select("canvas_id", F.explode(F.array("src_alias", "dst_alias")).alias("alias"))
    return shapes.join(shown, ["canvas_id", "alias"], "left_anti").select("canvas_id", "shape_id")


@query("e24_visible_fragments", "fragments", sql="SELECT doc_id, page, frag_id FROM fragments WHERE x + w > 0 AND x < 450 AND y + h > 0 AND y < 350 AND NOT (bold AND frag_id % 2 = 0) AND font_family <> 'Serif'")
def _(fragments):
    clipped = (F.col("x") + F.col("w") <= 0) | (F.col("x") >= 450) | (F.col("y") + F.col("h") <= 0) | (F.col("y") >= 350)
    unseen = F.col("bold") & (F.col("frag_id") % 2 == 0)
    return fragments.where(~clipped & ~unseen & (F.col("font_family") != "Serif")).select("doc_id", "page", "frag_id")


@query("e31_chart_points", "cells", sql="SELECT a.sheet_id, a.row_no, a.value AS category, b.value AS val FROM cells a LEFT JOIN cells b ON a.sheet_id = b.sheet_id AND a.row_no = b.row_no AND b.col_no = 2 WHERE a.col_no = 1")
def _(cells):
    pick = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when(F.col("col_no") == c, F.struct("row_no", "value")))), lambda x: x).alias(n)
    rows = cells.groupBy("sheet_id").agg(pick(1, "c"), pick(2, "v"))
    flat = rows.select("sheet_id", F.explode("c").alias("c"), "v")
    return flat.select("sheet_id", F.col("c.row_no").alias("row_no"), F.col("c.value").alias("category"), F.get(F.filter("v", lambda x: x["row_no"] == F.col("c.row_no")), F.lit(0))["value"].alias("val"))


@query("e35_comment_places", "nodes", sql="""
WITH b AS (SELECT a.*, h.ord AS host FROM nodes a LEFT JOIN nodes h ON a.doc_id = h.doc_id AND a.parent_id = h.node_id), k AS (SELECT *, kind = 'Comment' AND host IS NOT NULL AS anch FROM b)
SELECT node_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN anch THEN host ELSE ord END, anch, ord, node_id) AS INT) AS place FROM k
""")
def _(nodes):
    return styles.comment_places(nodes).select("node_id", "place")


@query("j20_nested_tables", "nodes", sql="""
WITH RECURSIVE t AS (SELECT node_id AS id, CASE WHEN ord % 8 > 0 THEN 'n' || (CAST(substring(node_id, 2) AS BIGINT) - 1) END AS up, kind AS text FROM nodes),
f AS (SELECT id, up, text FROM t WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.up = t.id) UNION ALL SELECT t.id, t.up, t.text || ' [' || f.text || ']' FROM f JOIN t ON t.id = f.up)
SELECT id AS table_id, text FROM f WHERE up IS NULL OR NOT EXISTS (SELECT 1 FROM t h WHERE h.id = f.up)
""")
def _(nodes):
    return styles.nested_fold(nodes.selectExpr("node_id table_id", "case when ord % 8 > 0 then 'n' || (cast(substring(node_id, 2) as bigint) - 1) end parent_id", "ord", "kind text"))


@query("u1_ordered_union", "nodes", sql="""
SELECT doc_id, node_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'Heading' THEN 0 WHEN 'Image' THEN 1 WHEN 'SpeakerNotes' THEN 3 ELSE 2 END, ord, node_id) AS INT) AS place FROM nodes
""")
def _(nodes):
    from pyspark.sql import Window as W

    groups = [nodes.where(c).withColumn("_g", F.lit(i)) for i, c in enumerate(("kind = 'Heading'", "kind = 'Image'", "kind not in ('Heading', 'Image', 'SpeakerNotes')", "kind = 'SpeakerNotes'"))]
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out.select("doc_id", "node_id", F.row_number().over(W.partitionBy("doc_id").orderBy("_g", "ord", "node_id")).alias("place"))


@query("t1_t2_ordering", "documents", sql="SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) AS place FROM documents")
def _(documents):
    """Code-point order of the whole texts with an id tiebreak."""
    return styles.places(documents.select("doc_id", "text"), "text", "doc_id").select("doc_id", "place")


@query("f14_sheet_labels", "cells", sql=r"""
SELECT sheet_id, row_no, col_no, CASE WHEN regexp_matches(v, '^[■□●▼◆]|^\d+[.)] ') THEN 'section' WHEN regexp_matches(v, '[:：]\s*$') THEN 'label' WHEN regexp_matches(v, '^[^:：]{1,30}[:：]\s*\S') THEN 'key_value' ELSE 'plain' END AS kind
FROM (SELECT *, CASE style_id WHEN 0 THEN '■ ' || coalesce(value, '') WHEN 1 THEN coalesce(value, '') || ':' WHEN 2 THEN 'k: ' || coalesce(value, 'v') WHEN 3 THEN '3) ' || coalesce(value, '') ELSE coalesce(value, '') END AS v FROM cells)
""")
def _(cells):
    v = F.expr("case style_id when 0 then '■ ' || coalesce(value, '') when 1 then coalesce(value, '') || ':' when 2 then 'k: ' || coalesce(value, 'v') when 3 then '3) ' || coalesce(value, '') else coalesce(value, '') end")
    kind = F.when(v.rlike(r"^[■□●▼◆]|^\d+[.)] "), "section").when(v.rlike(r"[:：]\s*$"), "label").when(v.rlike(r"^[^:：]{1,30}[:：]\s*\S"), "key_value").otherwise("plain")
    return cells.select("sheet_id", "row_no", "col_no", kind.alias("kind"))


@query("f21_linear_math", "nodes", sql="""
SELECT doc_id AS eq_id, string_agg(CASE ord % 5 WHEN 0 THEN '(' || kind || ')/x' WHEN 1 THEN 'y^(' || layer || ')' WHEN 2 THEN 'z_2' WHEN 3 THEN '√(' || kind || ')' ELSE '+' END, '' ORDER BY ord) AS line FROM nodes GROUP BY doc_id
""")
def _(nodes):
    rows = nodes.selectExpr(
        "doc_id eq_id", "ord", "element_at(array('frac', 'sup', 'sub', 'rad', 'text'), ord % 5 + 1) kind", "element_at(array(kind, 'y', 'z', kind, '+'), ord % 5 + 1) a", "element_at(array('x', layer, '2', '', ''), ord % 5 + 1) b"
    )
    return styles.linear_math(rows)


@query("g10_character_grids", "cells", sql="""
WITH d AS (SELECT DISTINCT sheet_id, row_no FROM (SELECT sheet_id, row_no, CASE WHEN amount % 4 = 0 THEN value ELSE '' END AS value FROM cells) WHERE (value IN ('-', '|', '+') OR length(value) > 1)), g AS (SELECT *, row_no - row_number() OVER (PARTITION BY sheet_id ORDER BY row_no) AS g FROM d)
SELECT sheet_id, min(row_no) AS first_row, max(row_no) AS last_row FROM g GROUP BY sheet_id, g
""")
def _(cells):
    return styles.character_grid(cells.withColumn("value", F.expr("case when amount % 4 = 0 then value else '' end")))


@query("d3_dirty_cells", "cells", sql="""
WITH e AS (SELECT sheet_id, col_no IN (1, 6) AS is_text FROM cells WHERE amount % 50 = 0)
SELECT DISTINCT sheet_id, 'xl/worksheets/sheet' || sheet_id || '.xml' AS part, 'cell' AS reason FROM e UNION SELECT sheet_id, 'xl/sharedStrings.xml', 'text' FROM e WHERE is_text
UNION SELECT sheet_id, 'xl/calcChain.xml', 'formula' FROM cells WHERE formula IS NOT NULL AND sheet_id IN (SELECT sheet_id FROM e)
""")
def _(cells):
    edits = cells.where("amount % 50 = 0").selectExpr("sheet_id", "col_no in (1, 6) is_text")
    return styles.dirty_cells(edits, cells.where("formula is not null"))


@query("d4_apply_edits", "nodes", sql="""
SELECT node_id, CASE WHEN ord % 4 = 0 AND ord % 8 = 0 AND editability = 'EditableInPlace' THEN 'edited' WHEN ord % 4 = 0 AND ord % 8 = 0 THEN 'refused' ELSE 'kept' END AS status, CASE WHEN ord % 8 = 0 AND editability = 'EditableInPlace' THEN text || ' (new)' ELSE text END AS text FROM nodes
""")
def _(nodes):
    blocks = nodes.where("ord % 4 = 0").select(F.col("node_id").alias("id"), F.when(F.col("ord") % 8 == 0, F.concat("text", F.lit(" (new)"))).otherwise(F.col("text")).alias("text"))
    return styles.apply_edits(nodes, blocks).select("node_id", "status", "text")


@query("d7_changed_sources", "parts", "files", sql="""
SELECT coalesce(p.package_id, f.package_id) AS package_id, coalesce(p.path, f.path) AS path FROM (SELECT package_id, path, CAST(length(markdown) AS BIGINT) AS bytes, sha256(markdown) AS sha256 FROM parts) p FULL JOIN files f ON p.package_id = f.package_id AND p.path = f.path
WHERE p.sha256 IS DISTINCT FROM f.sha256 OR p.bytes IS DISTINCT FROM f.bytes
""")
def _(parts, files):
    return styles.changed_sources(parts.select("package_id", "path", F.octet_length("markdown").cast("long").alias("bytes"), F.sha2("markdown", 256).alias("sha256")), files)


@query("e44_sharing_decision", "orders", sql="""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_custkey % 5 = 0 THEN 'share' WHEN o_orderstatus = 'F' THEN 'share' WHEN o_custkey % 2 = 0 THEN 'share_with_traces' ELSE 'ask' END AS decision FROM orders
""")
def _(orders):
    rows = orders.selectExpr("o_orderkey", "o_custkey % 3 n_changes", "o_custkey % 5 n_comments", "if(o_orderstatus = 'F', 'sanitized', 'visible') policy", "o_custkey % 2 = 0 confirmed")
    return styles.sharing_decision(rows).select("o_orderkey", "decision")


@query("e45_image_sizes", "part", sql="SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' END AS kind, CASE WHEN p_partkey % 3 < 2 THEN 100 + p_size END AS width, CASE WHEN p_partkey % 3 < 2 THEN 300 + p_size END AS height FROM part")
def _(part):
    w, h = F.lpad(F.hex(F.col("p_size") + 100), 8, "0"), F.lpad(F.hex(F.col("p_size") + 300), 8, "0")
    little = lambda x: F.concat(F.substring(x, 7, 2), F.substring(x, 5, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), w, h)
    gif = F.concat(F.lit("474946383961"), little(w), little(h))
    content = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, gif).otherwise("00"))
    kind, width, height = styles.image_size(F.col("content"))
    return part.select("p_partkey", content.alias("content")).select("p_partkey", kind.alias("kind"), width.alias("width"), height.alias("height"))


@query("e51_structure_basis", "runs", sql="SELECT run, file_id, CASE WHEN failed THEN 'needs_comparison' WHEN has_warning THEN 'inferred' WHEN retention > 0.5 THEN 'source' ELSE 'none' END AS basis FROM runs")
def _(runs):
    flags = runs.selectExpr("run", "file_id", "failed needs_comparison", "has_warning inferred", "coalesce(retention > 0.5, false) has_structure")
    return styles.structure_basis(flags).select("run", "file_id", "basis")


@query("e52_unresolved_elements", "connectors", sql="SELECT canvas_id, CASE connector_id % 3 WHEN 0 THEN 'relation' WHEN 1 THEN 'text' ELSE 'element' END AS class, count(DISTINCT connector_id // 2) AS n FROM connectors WHERE NOT resolved GROUP BY 1, 2")
def _(connectors):
    items = connectors.selectExpr("canvas_id", "case connector_id % 3 when 0 then 'edge' when 1 then 'label' else 'node' end kind", "cast(floor(connector_id / 2) as int) item_id", "resolved")
    return styles.unresolved_elements(items)


@query("e39_chart_tables", "cells", sql="SELECT sheet_id, '| ' || string_agg(coalesce(value, '') || ' | ' || row_no, ' |' || chr(10) || '| ' ORDER BY row_no) || ' |' AS md FROM cells WHERE col_no = 2 GROUP BY sheet_id")
def _(cells):
    rows = cells.where("col_no = 2").groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("row_no", F.concat(F.lit("| "), F.coalesce("value", F.lit("")), F.lit(" | "), F.col("row_no").cast("string"), F.lit(" |")).alias("line")))).alias("x"))
    return rows.select("sheet_id", F.array_join(F.transform("x", lambda i: i["line"]), "\n").alias("md"))


@query("e40_visual_fallbacks", "connectors", sql="""
SELECT canvas_id, path_kind, count(*) AS n, array_to_string((list(connector_id ORDER BY connector_id))[1:3], ',') AS shown, greatest(count(*) - 3, 0) AS more FROM connectors WHERE NOT resolved GROUP BY canvas_id, path_kind
""")
def _(connectors):
    first = F.transform(F.slice(F.array_sort(F.collect_list("connector_id")), 1, 3), lambda x: x.cast("string"))
    return connectors.where("not resolved").groupBy("canvas_id", "path_kind").agg(F.count("*").alias("n"), F.array_join(first, ",").alias("shown"), F.greatest(F.count("*") - 3, F.lit(0)).alias("more"))


@query("s15_manifest_read", "parts", sql="SELECT package_id, path, CAST(length(markdown) AS BIGINT) AS bytes, length(markdown) > target AS exceeds_target FROM parts")
def _(parts):
    """Manifests as JSON, read back with an explicit schema and unknown versions refused."""
    item = F.struct("path", F.length("markdown").cast("long").alias("bytes"), (F.length("markdown") > F.col("target")).alias("exceeds_target"))
    text = parts.groupBy("package_id").agg(F.collect_list(item).alias("parts")).select("package_id", F.to_json(F.struct(F.lit("2.2").alias("schema_version"), "parts")).alias("json"))
    schema = "schema_version string, parts array<struct<path:string,bytes:bigint,exceeds_target:boolean>>"
    read = text.withColumn("m", F.from_json("json", schema)).where(F.col("m.schema_version").rlike(r"^[12]\.\d+$"))
    return read.select("package_id", F.inline("m.parts"))


@query("g9_overlay_glyphs", "cells", sql="""
SELECT c.sheet_id, c.row_no, c.col_no, CASE WHEN o.amount IS NULL THEN c.value WHEN o.amount % 3 = 0 THEN '○' || coalesce(c.value, '') WHEN o.amount % 3 = 1 THEN '→' || coalesce(c.value, '') ELSE c.value END AS shown FROM cells c LEFT JOIN cells o ON o.sheet_id = c.sheet_id AND o.row_no = c.row_no AND o.col_no = c.col_no + 1 AND o.amount % 8 = 0
""")
def _(cells):
    over = cells.where("amount % 8 = 0").selectExpr("sheet_id", "row_no", "col_no - 1 col_no", "case amount % 3 when 0 then '○' when 1 then '→' end glyph")
    return cells.join(over, ["sheet_id", "row_no", "col_no"], "left").select("sheet_id", "row_no", "col_no", F.when(F.col("glyph").isNotNull(), F.concat("glyph", F.coalesce("value", F.lit("")))).otherwise(F.col("value")).alias("shown"))
