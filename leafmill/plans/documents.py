"""Queries over nodes, their versions and packages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import a1, tokens
from ..operators import chunks, diff, policy
from .registry import query

_VISIBLE = "layer NOT IN ('Hidden', 'Metadata') AND kind NOT IN ('Comment', 'Revision', 'SpeakerNotes')"
_SANITIZED = f"{_VISIBLE} AND layer NOT IN ('Furniture', 'Derived') AND kind NOT IN ('Header', 'Footer', 'Footnote', 'Endnote', 'ImageText', 'Annotation')"


@query("p1_policy_visible", "nodes", sql=f"SELECT doc_id, node_id, kind, layer FROM nodes WHERE {_VISIBLE}")
def _(nodes):
    return policy.apply_policy(nodes, "visible").select("doc_id", "node_id", "kind", "layer")


@query("p1_policy_sanitized", "nodes", sql=f"SELECT doc_id, node_id, kind, layer FROM nodes WHERE {_SANITIZED}")
def _(nodes):
    return policy.apply_policy(nodes, "sanitized").select("doc_id", "node_id", "kind", "layer")


@query("p1_policy_complete", "nodes", sql="SELECT layer, kind, count(*) AS n FROM nodes GROUP BY layer, kind")
def _(nodes):
    return policy.apply_policy(nodes, "complete").groupBy("layer", "kind").agg(F.count("*").alias("n"))


@query("p2_sheet_selection", "cells", sql="""
SELECT concat('Sheet', CAST(sheet_id AS STRING)) AS sheet, count(*) AS n FROM cells WHERE sheet_id IN (1, 4, 9) GROUP BY sheet_id
""")
def _(cells):
    names = cells.sparkSession.createDataFrame([("SHEET1",), ("sheet4",), ("Sheet9",), ("nowhere",)], "sheet string")
    named = cells.withColumn("sheet", F.concat(F.lit("Sheet"), F.col("sheet_id").cast("string")))
    return policy.select_sheets(named, names).groupBy("sheet").agg(F.count("*").alias("n"))


@query("p2_unknown_sheets", "cells", sql="SELECT 'nowhere' AS sheet")
def _(cells):
    names = cells.sparkSession.createDataFrame([("SHEET1",), ("nowhere",)], "sheet string")
    return policy.unknown_sheets(cells.withColumn("sheet", F.concat(F.lit("Sheet"), F.col("sheet_id").cast("string"))), names)


@query("p3_cell_layer", "cells", sql="""
SELECT sheet_id, row_no, col_no, CASE WHEN hidden_row OR hidden_col OR sheet_state <> 'visible' THEN 'Hidden' ELSE 'Body' END AS layer FROM cells
""")
def _(cells):
    return cells.select("sheet_id", "row_no", "col_no", policy.cell_layer().alias("layer"))


@query("p4_content_text", "nodes", sql="""
SELECT node_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(kind, layer, text)
  WHEN 2 THEN concat(kind, chr(9), layer, chr(10), node_id, chr(9), part_uri) ELSE CASE WHEN trim(text) <> '' THEN text ELSE part_uri END END AS content FROM nodes
""")
def _(nodes):
    kind = F.element_at(F.array(*map(F.lit, ("text", "rich_text", "table", "reference"))), (F.col("doc_id") % 4 + 1).cast("int"))
    content = F.struct(
        kind.alias("kind"), F.col("text"), F.array("kind", "layer", "text").alias("runs"), F.array(F.array("kind", "layer"), F.array("node_id", "part_uri")).alias("rows"),
        F.col("part_uri").alias("reference"), F.col("text").alias("alt_text"),
    )
    held = nodes.select("node_id", content.alias("c"))
    return held.select("node_id", policy.content_text(held["c"]).alias("content"))


@query("p5_body_only", "nodes", sql="SELECT doc_id, count(*) AS n FROM nodes WHERE layer IN ('Body', 'Furniture') GROUP BY doc_id")
def _(nodes):
    return policy.body_only(nodes, furniture=True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("p6_blank_cells", "cells", sql="SELECT sheet_id, count(*) AS n FROM cells WHERE coalesce(value, '') = '' AND coalesce(formula, '') = '' GROUP BY sheet_id")
def _(cells):
    return cells.where(policy.blank_cell()).groupBy("sheet_id").agg(F.count("*").alias("n"))


@query("p7_formula_safety", "cells", sql="""
SELECT CASE WHEN contains(f, '[') OR contains(f, ']') OR contains(f, 'DDE') OR contains(f, 'WEBSERVICE') OR contains(f, 'CALL(') THEN 'Dangerous'
  WHEN contains(f, 'INDIRECT') OR contains(f, 'HYPERLINK') OR contains(f, 'IMPORT') THEN 'Suspicious' ELSE 'Safe' END AS safety, count(*) AS n
FROM (SELECT upper(coalesce(formula, '')) AS f FROM cells) GROUP BY 1
""")
def _(cells):
    return cells.groupBy(policy.formula_safety().alias("safety")).agg(F.count("*").alias("n"))


_RUNS = "SELECT node_id, unnest([0, 1, 2]) AS ord, unnest([kind, layer, text]) AS t, unnest([0, 1, 2]) = doc_id % 3 AS ins, unnest([0, 1, 2]) = (doc_id + 1) % 3 AS del FROM nodes"


def _runs(nodes):
    runs = nodes.select("node_id", "doc_id", F.posexplode(F.array("kind", "layer", "text")).alias("ord", "text"))
    return runs.select("node_id", "ord", "text", (F.col("ord") == F.col("doc_id") % 3).alias("inserted"), (F.col("ord") == (F.col("doc_id") + 1) % 3).alias("deleted"))


for _view, _keep, _shown in (("final", "NOT del", "t"), ("reject", "NOT ins", "t"), ("markup", "true", "CASE WHEN del THEN '~~' || t || '~~' WHEN ins THEN '<ins>' || t || '</ins>' ELSE t END")):
    query(f"p8_revision_{_view}", "nodes", sql=f"WITH r AS ({_RUNS}) SELECT node_id, string_agg({_shown}, '' ORDER BY ord) AS text FROM r WHERE {_keep} GROUP BY node_id")(
        lambda nodes, view=_view: policy.revision_view(_runs(nodes), view)
    )


@query("p9_heading_sized", "documents", sql=r"""
SELECT doc_id, CAST(i AS BIGINT) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
WHERE length(x) BETWEEN 2 AND 100 AND NOT regexp_matches(x, '[.!?。！？]\s*$') AND NOT regexp_matches(x, 'https?://')
""")
def _(documents):
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    return lines.where(policy.heading_sized(F.col("x"))).select("doc_id", F.col("line").cast("long"))


@query("p10_ocr_review", "runs", sql="SELECT file_id, run FROM runs WHERE coalesce(retention, 0) < 0.8")
def _(runs):
    return runs.withColumnRenamed("retention", "confidence").where(policy.needs_ocr_review()).select("file_id", "run")


@query("p11_furniture_role", "nodes", sql="""
SELECT node_id FROM nodes WHERE CASE WHEN kind = 'Header' THEN 'footer' WHEN kind = 'Image' THEN 'date' WHEN kind = 'Heading' THEN 'title' END IN ('footer', 'date', 'slide_number')
""")
def _(nodes):
    role = F.when(F.col("kind") == "Header", "footer").when(F.col("kind") == "Image", "date").when(F.col("kind") == "Heading", "title")
    return nodes.withColumn("role", role).where(policy.furniture_role()).select("node_id")


@query("p12_image_budget", "cells", sql="""
WITH RECURSIVE i AS (SELECT sheet_id AS doc_id, row_number() OVER (PARTITION BY sheet_id ORDER BY row_no, col_no) AS ord, concat(CAST(row_no AS STRING), '-', CAST(col_no AS STRING)) AS image_id, amount AS bytes FROM cells),
f AS (
  SELECT doc_id, ord, image_id, bytes <= 400000 AND bytes <= 3000000 AS ok, CASE WHEN bytes <= 400000 AND bytes <= 3000000 THEN bytes ELSE 0 END AS used FROM i WHERE ord = 1
  UNION ALL
  SELECT i.doc_id, i.ord, i.image_id, i.bytes <= 400000 AND f.used + i.bytes <= 3000000, f.used + CASE WHEN i.bytes <= 400000 AND f.used + i.bytes <= 3000000 THEN i.bytes ELSE 0 END
  FROM f JOIN i ON i.doc_id = f.doc_id AND i.ord = f.ord + 1)
SELECT doc_id, max(used) OVER (PARTITION BY doc_id) AS used, image_id FROM f QUALIFY ok OR count(*) FILTER (WHERE ok) OVER (PARTITION BY doc_id) = 0
""")
def _(cells):
    order = F.row_number().over(W.partitionBy("sheet_id").orderBy("row_no", "col_no"))
    images = cells.select(F.col("sheet_id").alias("doc_id"), order.alias("ord"), F.concat_ws("-", F.col("row_no").cast("string"), F.col("col_no").cast("string")).alias("image_id"), F.col("amount").alias("bytes"))
    return policy.image_budget(images, 400_000, 3_000_000)


@query("p13_range_filter", "cells", sql="SELECT sheet_id, count(*) AS n, count(value) AS filled FROM cells WHERE row_no BETWEEN 2 AND 7 AND col_no BETWEEN 2 AND 4 GROUP BY sheet_id")
def _(cells):
    return cells.where(policy.in_range("D7:$B$2")).groupBy("sheet_id").agg(F.count("*").alias("n"), F.count("value").alias("filled"))


_PROBES = "SELECT c_custkey / 4 AS doc_id, concat('prov', CAST(c_custkey % 4 AS STRING)) AS provider_id, c_nationkey % 2 AS priority, c_nationkey / 25.0 AS confidence, concat('1.', CAST(c_nationkey % 3 AS STRING)) AS version FROM customer"


def _probes(customer):
    return customer.selectExpr(
        "cast(floor(c_custkey / 4) as bigint) doc_id", "concat('prov', cast(c_custkey % 4 as string)) provider_id", "c_nationkey % 2 priority",
        "c_nationkey / 25D confidence", "concat('1.', cast(c_nationkey % 3 as string)) version",
    )


@query("s3_adapter_selection", "customer", sql=f"""
WITH p AS ({_PROBES.replace('c_custkey / 4 AS', 'CAST(floor(c_custkey / 4) AS BIGINT) AS').replace('c_nationkey / 25.0', 'c_nationkey / CAST(25 AS DOUBLE)')}), r AS (
  SELECT *, row_number() OVER w AS rank, lead(priority) OVER w AS p2, lead(confidence) OVER w AS c2 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY priority DESC, confidence DESC, provider_id))
SELECT doc_id, provider_id, priority, confidence, coalesce(p2 = priority AND confidence - c2 <= 0.05, false) AS ambiguous FROM r WHERE rank = 1
""")
def _(customer):
    return policy.select_adapter(_probes(customer))


@query("s4_provider_allowlist", "customer", sql="""
SELECT CASE WHEN (c_custkey % 4 = 0 AND c_nationkey % 3 = 0) OR (c_custkey % 4 = 2 AND c_nationkey % 3 = 1) THEN 'allowed' ELSE 'refused' END AS verdict, count(*) AS n FROM customer GROUP BY 1
""")
def _(customer):
    listed = customer.sparkSession.createDataFrame([("prov0", "1.0"), ("prov2", "1.1")], "provider_id string, version string")
    good, bad = policy.allowed_providers(_probes(customer), listed)
    both = good.withColumn("verdict", F.lit("allowed")).unionByName(bad.withColumn("verdict", F.lit("refused")))
    return both.groupBy("verdict").agg(F.count("*").alias("n"))


@query("s14_text_window", "documents", sql="SELECT doc_id, substring(text, 101, 80) AS part, CASE WHEN length(text) > 180 THEN 180 END AS next_offset FROM documents")
def _(documents):
    part, after = policy.window_text(F.col("text"), 100, 80)
    return documents.select("doc_id", part.alias("part"), after.alias("next_offset"))


@query("f1_token_estimate", "documents", sql=r"""
WITH t AS (SELECT doc_id, text AS t, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d, length(regexp_replace(text, '[^|]', '', 'g')) AS p,
  len(regexp_extract_all(text, '[0-9][,.]')) AS s, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o,
  list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: (length(x) + 2) // 3)) AS runs FROM documents)
SELECT doc_id, CAST((length(t) - d - p - s - o + 3) // 4 + coalesce(runs, 0) + p + s + (o * 7 + 7) // 8 AS BIGINT) AS tokens FROM t
""")
def _(documents):
    return documents.select("doc_id", tokens.token_estimate(F.col("text")).alias("tokens"))


@query("a7_tokens_by_language", "documents", sql=r"""
WITH t AS (SELECT lang, text AS t, length(regexp_replace(text, '[^0-9]', '', 'g')) AS d, length(regexp_replace(text, '[^|]', '', 'g')) AS p,
  len(regexp_extract_all(text, '[0-9][,.]')) AS s, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: (length(x) + 2) // 3)), 0) AS runs FROM documents)
SELECT lang, CAST(sum(CAST(ceil(((length(t) - d - p - s - o + 3) // 4 + runs + p + s + (o * 7 + 7) // 8) * 1.25) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS n FROM t GROUP BY lang
""")
def _(documents):
    return documents.groupBy("lang").agg(F.sum(tokens.token_estimate(F.col("text"), 1.25)).alias("tokens"), F.count("*").alias("n"))


@query("w1_current_heading", "nodes", sql="""
SELECT node_id, nullif(last_value(CASE WHEN kind = 'Heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY partition_order, ord, node_id ROWS UNBOUNDED PRECEDING), '') AS heading FROM nodes
""")
def _(nodes):
    return chunks.flat_heading(nodes).select("node_id", "heading")


@query("w2_heading_path", "nodes", sql="""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, node_id) AS i FROM nodes),
f AS (
  SELECT doc_id, 0::BIGINT AS i, CAST('' AS VARCHAR) AS node_id, '' AS layer, CAST([] AS STRUCT(l INT, t VARCHAR)[]) AS st FROM (SELECT DISTINCT doc_id FROM nodes)
  UNION ALL
  SELECT n.doc_id, n.i, n.node_id, n.layer, CASE WHEN n.kind = 'Heading' AND trim(n.text) <> '' THEN list_append(list_filter(f.st, lambda x: x.l < n.heading_level), {'l': n.heading_level, 't': trim(n.text)}) ELSE f.st END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)
SELECT node_id, CASE WHEN layer = 'Furniture' THEN '' ELSE array_to_string(list_transform(st, lambda x: x.t), ' > ') END AS path FROM f WHERE i > 0
""")
def _(nodes):
    return chunks.heading_path(nodes).select("node_id", F.array_join("heading_path", " > ").alias("path"))


_CHUNKS = """
WITH RECURSIVE b AS (SELECT *, last_value(CASE WHEN kind = 'Heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY partition_order, ord, node_id ROWS UNBOUNDED PRECEDING) AS hd FROM nodes WHERE layer = 'Body'),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, partition_order ORDER BY ord, node_id) AS i FROM b WHERE text <> ''),
f AS (
  SELECT doc_id, partition_order, i, node_id, text, layer, hd, 0 AS no, length(text) + 2 AS size FROM n WHERE i = 1
  UNION ALL
  SELECT n.doc_id, n.partition_order, n.i, n.node_id, n.text, n.layer, n.hd, CASE WHEN f.size + length(n.text) + 2 > 600 THEN f.no + 1 ELSE f.no END,
         CASE WHEN f.size + length(n.text) + 2 > 600 THEN length(n.text) + 2 ELSE f.size + length(n.text) + 2 END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.partition_order = f.partition_order AND n.i = f.i + 1),
g AS (SELECT doc_id, partition_order, no, string_agg(node_id, ',' ORDER BY i) AS node_ids, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, nullif(first(hd ORDER BY i), '') AS heading FROM f GROUP BY ALL)
"""


@query("w4_chunks", "nodes", sql=_CHUNKS + """
SELECT doc_id, partition_order, concat('chk_', CAST(partition_order AS STRING), '_', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY partition_order, no) AS STRING), 4, '0')) AS chunk_id,
       node_ids, 'Body' AS layer, heading, text, greatest(1, CAST(ceil(length(text) / 4) AS BIGINT)) AS estimated_tokens FROM g
""")
def _(nodes):
    return chunks.chunk(nodes, 600)


@query("w5_sections", "nodes", sql="""
WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, node_id) AS i FROM nodes),
e AS (SELECT c.doc_id, least(c.i, q.i) AS a, greatest(c.i, q.i) AS b FROM p c JOIN p q ON c.doc_id = q.doc_id AND c.parent_id = q.node_id),
n AS (SELECT p.*, lag(kind) OVER w AS pk, lag(parent_id) OVER w AS pp FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT n.*, NOT coalesce(kind = 'ListItem' AND pk = 'ListItem' AND pp IS NOT DISTINCT FROM parent_id, false)
  AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = n.doc_id AND e.a < n.i AND n.i <= e.b) AND coalesce(pk, '') <> 'Heading' AS may FROM n),
f AS (
  SELECT doc_id, i, node_id, 1 AS section, length(text) AS size FROM o WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.i, o.node_id, CASE WHEN o.may AND (o.kind = 'Heading' OR f.size >= 400) THEN f.section + 1 ELSE f.section END,
         CASE WHEN o.may AND (o.kind = 'Heading' OR f.size >= 400) THEN length(o.text) ELSE f.size + length(o.text) END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
SELECT doc_id, node_id, CAST(i AS INT) AS position, section FROM f
""")
def _(nodes):
    return chunks.sections(nodes, 400)


@query("w7_part_numbers", "nodes", sql="""
SELECT doc_id, partition_order, concat('part-', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY partition_order) AS STRING), 4, '0')) AS part_id, count(*) AS n_nodes FROM nodes GROUP BY doc_id, partition_order
""")
def _(nodes):
    return chunks.numbered(nodes)


@query("w8_projection_offsets", "nodes", sql="""
SELECT node_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY ord, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) AS length FROM nodes
""")
def _(nodes):
    return chunks.projection(nodes).select("node_id", "start", "length")


@query("k5_round_trip_markdown", "nodes", sql="""
WITH b AS (SELECT doc_id, ord, node_id, text, length(concat('<!-- block id="', node_id, '" kind="', kind, '" -->')) + 1 AS h FROM nodes)
SELECT node_id, CAST(coalesce(sum(h + length(text) + 2) OVER (PARTITION BY doc_id ORDER BY ord, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + h AS BIGINT) AS start, text AS slice, true AS marked FROM b
""")
def _(nodes):
    """The map read back: the stretch of the Markdown that it gives, and whether the comment before it names the node."""
    held = chunks.round_trip(nodes).select("doc_id", "markdown", F.inline("map"))
    slice_ = F.substr("markdown", (F.col("start") + 1).cast("int"), F.col("length"))
    mark = F.concat(F.lit('<!-- block id="'), F.col("node_id"), F.lit('"'))
    marked = F.contains(F.substring_index(F.substr("markdown", F.lit(1), (F.col("start") - 1).cast("int")), "\n", -1), mark)
    return held.select("node_id", F.col("start").cast("long").alias("start"), slice_.alias("slice"), marked.alias("marked"))


@query("k1_readable_markdown", "nodes", sql=f"""
SELECT doc_id, string_agg(CASE kind WHEN 'Heading' THEN repeat('#', heading_level) || ' ' || text WHEN 'ListItem' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY ord, node_id) AS markdown
FROM nodes WHERE {_VISIBLE} AND text <> '' GROUP BY doc_id
""")
def _(nodes):
    return chunks.readable(policy.apply_policy(nodes))


_DIFF = """
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.node_id, b.node_id) AS node_id, a.node_id IS NULL AS fresh, b.node_id IS NULL AS gone,
  a.text IS DISTINCT FROM b.text OR a.kind IS DISTINCT FROM b.kind OR a.layer IS DISTINCT FROM b.layer OR a.part_uri IS DISTINCT FROM b.part_uri OR a.doc_id IS DISTINCT FROM b.doc_id OR a.editability IS DISTINCT FROM b.editability AS changed,
  coalesce(a.layer, b.layer) = 'Derived' OR coalesce(a.editability, b.editability) = 'AnnotationOnly' AS derived, coalesce(b.layer, a.layer) = 'Derived' OR coalesce(b.editability, a.editability) = 'AnnotationOnly' AS still,
  coalesce(b.part_uri, a.part_uri) AS part_uri, a.ord FROM nodes a FULL JOIN edited b ON a.node_id = b.node_id),
d AS (SELECT doc_id, node_id, part_uri, still, CASE WHEN gone AND ord = 13 THEN 'ExplicitDelete' WHEN gone THEN 'MissingNode' WHEN fresh AND derived THEN 'UpdateDerivedAnnotation' WHEN fresh THEN 'InsertNode'
  WHEN changed AND derived THEN 'UpdateDerivedAnnotation' WHEN changed THEN 'ReplaceContent' END AS op FROM j),
p AS (SELECT doc_id, node_id, op, op NOT IN ('UpdateDerivedAnnotation', 'MissingNode') AND NOT still AS mutates, part_uri FROM d WHERE op IS NOT NULL)
"""


def _patches(nodes, edited):
    return diff.diff(nodes.select(*edited.columns), edited, nodes.where("ord = 13"))


@query("j1_d1_diff", "nodes", "edited", sql=f"WITH {_DIFF} SELECT * FROM p")
def _(nodes, edited):
    return _patches(nodes, edited)


@query("d2_dirty_parts", "nodes", "edited", sql=f"WITH {_DIFF} SELECT doc_id, string_agg(DISTINCT part_uri, ',' ORDER BY part_uri) AS parts, count(*) AS n_ops FROM p WHERE mutates GROUP BY doc_id")
def _(nodes, edited):
    return diff.dirty_parts(_patches(nodes, edited))


@query("j2_parents", "nodes", sql="""
SELECT a.node_id, b.kind AS parent_kind, length(b.text) AS parent_length FROM nodes a LEFT JOIN nodes b ON a.doc_id = b.doc_id AND a.parent_id = b.node_id
""")
def _(nodes):
    return diff.parents(nodes).select("node_id", "parent_kind", F.length("parent_text").alias("parent_length"))


@query("d5_graph_problems", "lineitem", sql="""
WITH n AS (SELECT l_orderkey AS doc_id, concat('n', CAST(l_linenumber AS STRING)) AS node_id, CASE WHEN l_partkey % 3 = 0 THEN concat('n', CAST(l_linenumber - 1 AS STRING)) END AS parent_id FROM lineitem)
SELECT doc_id, node_id, 'DuplicateId' AS problem FROM n GROUP BY doc_id, node_id HAVING count(*) > 1
UNION ALL SELECT doc_id, node_id, 'DanglingParent' FROM n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND m.node_id = n.parent_id)
""")
def _(lineitem):
    return diff.graph_problems(lineitem.selectExpr("l_orderkey doc_id", "concat('n', cast(l_linenumber as string)) node_id", "case when l_partkey % 3 = 0 then concat('n', cast(l_linenumber - 1 as string)) end parent_id"))


@query("n_unique_ids", "nodes", sql="""
WITH b AS (SELECT *, CASE WHEN ord % 6 = 5 THEN concat('node_', CAST(partition_order AS STRING), '_', CAST(row_number() OVER (PARTITION BY doc_id, partition_order ORDER BY ord, node_id) AS STRING)) ELSE concat('x', CAST(ord % 4 AS STRING)) END AS id FROM nodes),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY partition_order, ord, node_id) AS k FROM b)
SELECT doc_id, node_id AS row_id, CASE WHEN k > 1 THEN concat(id, '__', CAST(k AS STRING)) ELSE id END AS node_id FROM c
""")
def _(nodes):
    given = nodes.withColumn("row_id", F.col("node_id")).withColumn("node_id", F.when(F.col("ord") % 6 == 5, F.lit(" ")).otherwise(F.concat(F.lit("x"), (F.col("ord") % 4).cast("string"))))
    return diff.deduplicate_ids(given).select("doc_id", "row_id", "node_id")


_LISTED = "l AS (SELECT package_id, path, CAST(length(markdown) AS BIGINT) AS bytes, sha256(markdown) AS sha256 FROM parts)"


@query("k3_package_manifest", "parts", sql=f"WITH {_LISTED} SELECT package_id, path, bytes, sha256 FROM l")
def _(parts):
    return parts.select("package_id", "path", F.octet_length("markdown").cast("long").alias("bytes"), F.sha2("markdown", 256).alias("sha256"))


@query("j19_d6_integrity", "parts", "files", sql=f"""
WITH {_LISTED} SELECT coalesce(l.package_id, f.package_id) AS package_id, coalesce(l.path, f.path) AS path,
  CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN l.sha256 IS NULL THEN 'unlisted' WHEN l.bytes <> f.bytes THEN 'size' WHEN l.sha256 <> f.sha256 THEN 'hash' END AS problem
FROM l FULL JOIN files f ON l.package_id = f.package_id AND l.path = f.path
WHERE f.sha256 IS NULL OR l.sha256 IS NULL OR l.bytes <> f.bytes OR l.sha256 <> f.sha256
""")
def _(parts, files):
    listed = parts.select("package_id", "path", F.octet_length("markdown").cast("long").alias("bytes"), F.sha2("markdown", 256).alias("sha256"))
    return diff.file_integrity(listed, files)


@query("a6_package_sizes", "parts", sql="""
SELECT package_id, count(*) AS n_parts, CAST(sum(length(markdown)) AS BIGINT) AS total_chars, max(length(markdown)) AS max_chars, count(*) FILTER (WHERE length(markdown) > target) AS exceeding FROM parts GROUP BY package_id
""")
def _(parts):
    n = F.length("markdown")
    return parts.groupBy("package_id").agg(F.count("*").alias("n_parts"), F.sum(n).alias("total_chars"), F.max(n).alias("max_chars"), F.count_if(n > F.col("target")).alias("exceeding"))


@query("w9_part_links", "parts", sql="""
SELECT package_id, path, lag(path) OVER w AS previous_part, lead(path) OVER w AS next_part, CAST(row_number() OVER w AS INT) AS index, CAST(count(*) OVER (PARTITION BY package_id, table_id) AS BIGINT) AS count
FROM parts WINDOW w AS (PARTITION BY package_id, table_id ORDER BY ord)
""")
def _(parts):
    w, whole = W.partitionBy("package_id", "table_id").orderBy("ord"), W.partitionBy("package_id", "table_id")
    return parts.select("package_id", "path", F.lag("path").over(w).alias("previous_part"), F.lead("path").over(w).alias("next_part"), F.row_number().over(w).alias("index"), F.count("*").over(whole).alias("count"))


@query("d9_fidelity", "runs", sql="""
SELECT file_id, run, level, level IN ('F0', 'F1', 'F2') AS success FROM (SELECT file_id, run, CASE WHEN failed THEN 'FX' WHEN coalesce(retention, 0) >= 0.9 THEN 'F0' WHEN has_warning THEN 'F1' WHEN coalesce(spurious, 1) < 0.2 THEN 'F2' ELSE 'F3' END AS level FROM runs)
""")
def _(runs):
    checks = runs.withColumns({"same_bytes": F.coalesce("retention", F.lit(0.0)) >= 0.9, "same_graph": F.col("has_warning"), "same_text": F.coalesce("spurious", F.lit(1.0)) < 0.2})
    return diff.fidelity(checks).select("file_id", "run", "level", "success")


@query("d8_text_accounting", "fragments", sql="""
WITH c AS (SELECT doc_id, page * 100 + frag_id + CASE WHEN frag_id = 7 THEN 50 ELSE 0 END AS frag_id FROM fragments WHERE frag_id % 3 = 1),
t AS (SELECT doc_id, page * 100 + frag_id AS frag_id FROM fragments), f AS (SELECT doc_id, page * 100 + frag_id AS frag_id FROM fragments WHERE frag_id % 3 = 0 AND page > 1)
SELECT doc_id, frag_id, 'text' AS missing FROM t WHERE (doc_id, frag_id) NOT IN (SELECT doc_id, frag_id FROM c) AND (doc_id, frag_id) NOT IN (SELECT doc_id, frag_id FROM f)
UNION ALL SELECT doc_id, frag_id, 'cell' FROM c WHERE (doc_id, frag_id) NOT IN (SELECT doc_id, frag_id FROM t)
""")
def _(fragments):
    t = fragments.select("doc_id", "page", F.col("frag_id").alias("k"), (F.col("page") * 100 + F.col("frag_id")).alias("frag_id"))
    cells = t.where("k % 3 = 1").select("doc_id", (F.col("frag_id") + F.when(F.col("k") == 7, 50).otherwise(0)).alias("frag_id"))
    lost, odd = diff.unaccounted(t.select("doc_id", "frag_id"), cells, t.where("k % 3 = 0 and page > 1").select("doc_id", "frag_id"))
    return lost.withColumn("missing", F.lit("text")).unionByName(odd.withColumn("missing", F.lit("cell")))


@query("e53_stop_reasons", "orders", sql="""
SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 3 = 0 THEN 'conversion_review' END, CASE WHEN o_custkey % 5 = 0 THEN 'revision_sharing' END,
  CASE WHEN o_orderstatus = 'F' AND coalesce(CASE WHEN o_custkey % 4 = 0 THEN false WHEN o_custkey % 4 = 1 THEN true END, true) THEN 'hidden_content' END) AS reasons FROM orders
""")
def _(orders):
    packages = orders.selectExpr("o_orderkey", "o_custkey % 3 = 0 review", "o_custkey % 5 = 0 sharing", "if(o_orderstatus = 'F', 'complete', 'visible') policy", "case when o_custkey % 4 = 0 then false when o_custkey % 4 = 1 then true end has_hidden")
    return diff.stop_reasons(packages).select("o_orderkey", "reasons")


@query("f8_a1_addresses", "cells", sql="""
SELECT DISTINCT c, r, CASE WHEN c <= 26 THEN chr(CAST(64 + c AS INT)) WHEN c <= 702 THEN chr(CAST(64 + (c - 1) // 26 AS INT)) || chr(CAST(65 + (c - 1) % 26 AS INT))
  ELSE chr(CAST(65 + (c - 703) // 676 AS INT)) || chr(CAST(65 + ((c - 703) // 26) % 26 AS INT)) || chr(CAST(65 + (c - 703) % 26 AS INT)) END || CAST(r AS STRING) AS ref
FROM (SELECT 1 + amount % 16384 AS c, row_no AS r FROM cells)
""")
def _(cells):
    refs = cells.select((F.col("amount") % 16384 + 1).alias("c"), F.col("row_no").alias("r")).distinct()
    refs = refs.withColumn("ref", F.concat(a1.letters(F.col("c")), F.col("r").cast("string")))
    # decoding must give the numbers back
    return refs.where((a1.column_of(F.col("ref")) == F.col("c")) & (a1.row_of(F.col("ref")) == F.col("r")))
