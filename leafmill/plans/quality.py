"""Queries over corpus runs, diagnostics, checks and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import corpus, links
from .registry import query

#: The other version of a text: every fifth word gone, and an ending.
_OUTPUT = "array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 5 <> 0), ' ') || ' extra words here'"
_TOKENS = r"""list_transform(regexp_extract_all({t}, '[0-9]+|[\p{{L}}]+'), lambda x: lower(x))"""


def _versions(documents):
    output = F.concat(F.array_join(F.filter(F.split("text", " "), lambda w, i: (i + 1) % 5 != 0), " "), F.lit(" extra words here"))
    return corpus.token_counts(documents, "doc_id", tokens.content_tokens(F.col("text")), tokens.content_tokens(tokens.strip_markdown(output)))


_COUNTS = f"""a AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format(t='text')}) AS token FROM documents) GROUP BY ALL),
o AS (SELECT doc_id, {_OUTPUT} AS t FROM documents), b AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format(t='t')}) AS token FROM o) GROUP BY ALL),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.token, b.token) AS token, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.token = b.token)"""


@query("j18_a18_retention", "documents", sql=f"""
WITH {_COUNTS} SELECT doc_id, CAST(sum(x) AS BIGINT) AS source_tokens, CAST(sum(y) AS BIGINT) AS output_tokens, CASE WHEN sum(x) > 0 THEN round(sum(least(x, y)) / CAST(sum(x) AS DOUBLE), 6) END AS retention,
  CASE WHEN sum(y) > 0 THEN round(sum(greatest(y - x, 0)) / CAST(sum(y) AS DOUBLE), 6) END AS spurious_rate FROM j GROUP BY doc_id
""")
def _(documents):
    return corpus.retention(_versions(documents), "doc_id")


@query("a18_t5_missing_tokens", "documents", sql=f"""
WITH {_COUNTS}, r AS (SELECT doc_id, token, x - y AS missing, row_number() OVER (PARTITION BY doc_id ORDER BY x - y DESC, token) AS rank FROM j WHERE x > y) SELECT doc_id, CAST(rank AS INT) AS rank, token, missing FROM r WHERE rank <= 20
""")
def _(documents):
    return corpus.missing_tokens(_versions(documents), "doc_id")


_SUMMARY = """SELECT run, format, count(*) AS count, round(count(*) FILTER (WHERE failed) / CAST(count(*) AS DOUBLE), 6) AS failure_rate, round(count(*) FILTER (WHERE has_warning) / CAST(count(*) AS DOUBLE), 6) AS warning_rate,
  round(avg(retention), 6) AS retention_mean, count(retention) AS retention_samples, round(avg(spurious), 6) AS spurious_mean, round(quantile_cont(elapsed_ms, 0.5), 3) AS median_ms, round(quantile_cont(elapsed_ms, 0.95), 3) AS p95_ms FROM runs GROUP BY GROUPING SETS ((run), (run, format))"""


@query("a19_run_summary", "runs", sql=_SUMMARY)
def _(runs):
    return corpus.summarize(runs)


@query("j17_a21_regressions", "runs", sql=f"""
WITH s AS ({_SUMMARY}), l AS (UNPIVOT (SELECT run, coalesce(format, 'overall') AS scope, retention_mean, spurious_mean, warning_rate, failure_rate FROM s) ON retention_mean, spurious_mean, warning_rate, failure_rate INTO NAME metric VALUE value)
SELECT a.scope, a.metric, round((a.value - b.value) * 100, 3) AS delta_points, CASE WHEN a.metric = 'retention_mean' THEN round((a.value - b.value) * 100, 3) < -0.5 ELSE round((a.value - b.value) * 100, 3) > 0.5 END AS regressed
FROM l a JOIN l b ON a.scope = b.scope AND a.metric = b.metric WHERE a.run = 'current' AND b.run = 'baseline'
""")
def _(runs):
    return corpus.regressions(corpus.summarize(runs), 0.5)


@query("j17_u3_file_regressions", "runs", sql="""
WITH p AS (SELECT a.file_id, a.retention AS ra, b.retention AS rb, a.failed AS fa, b.failed AS fb, list_filter([a.code_a, a.code_b], lambda x: x IS NOT NULL) AS ca, list_filter([b.code_a, b.code_b], lambda x: x IS NOT NULL) AS cb
  FROM runs a JOIN runs b ON a.file_id = b.file_id WHERE a.run = 'current' AND b.run = 'baseline')
SELECT file_id, 'retention_drop' AS kind, CAST(round((rb - ra) * 100, 3) AS STRING) AS detail FROM p WHERE round((rb - ra) * 100, 3) > 40
UNION ALL SELECT file_id, 'new_failure', NULL FROM p WHERE NOT fb AND fa
UNION ALL SELECT file_id, 'new_warning', unnest(list_distinct(list_filter(ca, lambda x: NOT list_contains(cb, x)))) FROM p
""")
def _(runs):
    return corpus.file_regressions(runs, 40)


@query("a20_code_histogram", "runs", sql="""
SELECT run, code, count(*) AS n, CAST(row_number() OVER (PARTITION BY run ORDER BY count(*) DESC, code) AS INT) AS rank FROM (SELECT run, unnest([code_a, code_b]) AS code FROM runs) WHERE code IS NOT NULL GROUP BY run, code
""")
def _(runs):
    return corpus.code_histogram(runs)


@query("u4_format_union", "runs", sql="""
SELECT format, max(run = 'baseline') AS in_baseline, max(run = 'current') AS in_current FROM runs WHERE (run = 'baseline' AND format <> 'pdf') OR (run = 'current' AND format <> 'docx') GROUP BY format
""")
def _(runs):
    a = runs.where("run = 'baseline' and format <> 'pdf'").select("format").distinct().withColumn("in_baseline", F.lit(True))
    b = runs.where("run = 'current' and format <> 'docx'").select("format").distinct().withColumn("in_current", F.lit(True))
    return a.join(b, "format", "full_outer").na.fill(False)


@query("a5_diagnostic_groups", "diagnostics", sql="""
SELECT doc_id, code, severity, count(*) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY code, severity) AS INT) AS place FROM diagnostics GROUP BY doc_id, code, severity
""")
def _(diagnostics):
    return corpus.grouped_diagnostics(diagnostics)


@query("e43_coalesced_diagnostics", "diagnostics", sql="SELECT doc_id, code, node_id, message, severity, count(*) AS n, min(diag_id) AS first_id FROM diagnostics GROUP BY ALL")
def _(diagnostics):
    return corpus.coalesced_diagnostics(diagnostics)


@query("e43_warning_codes", "diagnostics", sql="SELECT diag_id, regexp_extract('[' || code || '] ' || message, '^\\[([A-Z]+[0-9]+)\\]', 1) AS warning FROM diagnostics")
def _(diagnostics):
    raw = diagnostics.select("diag_id", F.concat(F.lit("["), "code", F.lit("] "), "message").alias("raw"))
    return raw.select("diag_id", F.regexp_extract("raw", r"^\[([A-Z]+[0-9]+)\]", 1).alias("warning"))


@query("a4_review_required", "events", sql="""
SELECT doc_id, bool_or(kind IN ('page', 'ocr', 'table', 'sharing', 'image')) AS required, count(*) AS n_items FROM (SELECT CAST(floor(event_id / 3) AS BIGINT) AS doc_id, CASE WHEN user_id % 4 = 0 THEN 'ocr' WHEN user_id % 4 = 1 THEN 'table' ELSE 'text' END AS kind FROM events) GROUP BY doc_id
""")
def _(events):
    return corpus.review_required(events.selectExpr("cast(floor(event_id / 3) as bigint) doc_id", "case when user_id % 4 = 0 then 'ocr' when user_id % 4 = 1 then 'table' else 'text' end kind"))


@query("a3_export_summary", "nodes", sql="""
SELECT doc_id, count(*) AS nodes, count(*) FILTER (WHERE kind = 'Heading') AS headings, count(*) FILTER (WHERE kind = 'ListItem') AS list_items, count(*) FILTER (WHERE kind = 'Image') AS images,
  count(*) FILTER (WHERE kind IN ('Comment', 'Footnote')) AS notes, count(*) FILTER (WHERE layer = 'Hidden') AS hidden, count(DISTINCT part_uri) AS parts FROM nodes GROUP BY doc_id
""")
def _(nodes):
    return corpus.export_summary(nodes)


_CHECKS = (("a", "guard", "contains", "the", None, None), ("b", "guard", "not_contains", "token", None, None), ("c", "goal", "unique", "License", None, None), ("d", "goal", "regex", "[0-9]{3}", None, None), ("e", "goal", "count", "\n", 1, 20))


def _checked(documents):
    outputs = documents.select(F.col("lang").alias("target"), "doc_id", "text")
    rows = [(t, *c) for t in ("en", "de", "fr", "es") for c in _CHECKS]
    checks = documents.sparkSession.createDataFrame(rows, "target string, id string, severity string, type string, value string, least long, most long")
    return corpus.expectations(outputs, checks)


_EXPECT = """SELECT lang AS target, id, severity, CASE id WHEN 'a' THEN contains(text, 'the') WHEN 'b' THEN NOT contains(text, 'token') WHEN 'c' THEN len(string_split(text, 'License')) = 2
  WHEN 'd' THEN regexp_matches(text, '[0-9]{3}') ELSE len(string_split(text, chr(10))) - 1 BETWEEN 1 AND 20 END AS passed
  FROM documents, (VALUES ('a', 'guard'), ('b', 'guard'), ('c', 'goal'), ('d', 'goal'), ('e', 'goal')) AS c(id, severity)"""


@query("e49_expectations", "documents", sql=f"SELECT target, id, passed, count(*) AS n FROM ({_EXPECT}) GROUP BY ALL")
def _(documents):
    return _checked(documents).groupBy("target", "id", "passed").agg(F.count("*").alias("n"))


@query("e49_expectation_summary", "documents", sql=f"SELECT severity, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, bool_or(NOT passed) AND severity = 'guard' AS fails_run FROM ({_EXPECT}) GROUP BY severity")
def _(documents):
    return corpus.expectation_summary(_checked(documents))


@query("e46_output_collisions", "pages", sql="SELECT lower(t) AS target, count(DISTINCT page_id) AS n FROM (SELECT page_id, regexp_extract(url, '[^/]+$') AS t FROM pages) GROUP BY 1 HAVING count(DISTINCT page_id) > 1")
def _(pages):
    return corpus.output_collisions(pages.select(F.col("page_id").alias("input"), F.regexp_extract("url", "[^/]+$", 0).alias("target")))


@query("j3_image_assets", "images", "assets", sql="""
WITH h AS (SELECT *, lower(part_path) AS p, regexp_extract(lower(part_path), '[^/]+$') AS nm FROM assets), w AS (SELECT *, regexp_replace(lower(reference), '^/', '') AS p, regexp_extract(lower(reference), '[^/]+$') AS nm FROM images)
SELECT doc_id, node_id, reference, coalesce(
  (SELECT min(asset_id) FROM h WHERE h.doc_id = w.doc_id AND h.asset_id = w.reference),
  (SELECT CASE WHEN count(DISTINCT asset_id) = 1 THEN min(asset_id) END FROM h WHERE h.doc_id = w.doc_id AND contains(w.p, '/') AND (h.p = w.p OR ends_with(h.p, '/' || w.p))),
  (SELECT CASE WHEN count(DISTINCT asset_id) = 1 THEN min(asset_id) END FROM h WHERE h.doc_id = w.doc_id AND h.nm = w.nm)) AS asset_id FROM w
""")
def _(images, assets):
    return links.image_assets(images, assets)


@query("j4_attach_ocr", "nodes", sql="""
SELECT doc_id, node_id, CAST(ord AS DOUBLE) AS position, kind, layer, text FROM nodes UNION ALL SELECT doc_id, concat(node_id, '_ocr'), ord + 0.5, 'ImageText', 'Derived', concat('seen ', part_uri) FROM nodes WHERE kind = 'Image'
""")
def _(nodes):
    ocr = nodes.where("kind = 'Image'").select("doc_id", "node_id", F.concat(F.lit("seen "), "part_uri").alias("recognized"))
    return links.attach_ocr(nodes, ocr)


@query("j10_connector_alias", "connectors", "shapes", sql="""
SELECT canvas_id, connector_id, (SELECT CASE WHEN count(*) = 1 THEN min(shape_id) END FROM shapes s WHERE s.canvas_id = c.canvas_id AND s.alias = c.src_alias) AS src_shape,
  (SELECT CASE WHEN count(*) = 1 THEN min(shape_id) END FROM shapes s WHERE s.canvas_id = c.canvas_id AND s.alias = c.dst_alias) AS dst_shape FROM connectors c
""")
def _(connectors, shapes):
    return links.unique_alias(links.unique_alias(connectors, shapes, "src"), shapes, "dst").select("canvas_id", "connector_id", "src_shape", "dst_shape")


@query("j15_comment_anchors", "nodes", sql="""
SELECT a.node_id, b.text AS anchored FROM nodes a LEFT JOIN (SELECT doc_id, ord % 8 AS cid, min(text) AS text FROM nodes WHERE kind = 'Heading' GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.ord % 8 = b.cid WHERE a.kind = 'Comment'
""")
def _(nodes):
    anchors = nodes.where("kind = 'Heading'").groupBy("doc_id", (F.col("ord") % 8).alias("comment_id")).agg(F.min("text").alias("anchored"))
    return links.comment_anchors(nodes.where("kind = 'Comment'").withColumn("comment_id", F.col("ord") % 8), anchors).select("node_id", "anchored")


@query("a1_visual_accounting", "connectors", sql="""
SELECT canvas_id, count(*) AS recognized, count(*) FILTER (WHERE resolved) AS resolved, count(*) FILTER (WHERE NOT resolved) AS unresolved, count(DISTINCT path_kind) AS paths, true AS consistent FROM connectors GROUP BY canvas_id
""")
def _(connectors):
    return links.visual_accounting(connectors)


@query("a2_disposition_ledger", "connectors", "shapes", sql="""
WITH i AS (SELECT canvas_id, CASE connector_id % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'edge' WHEN 2 THEN 'label' END AS disposition, CASE WHEN resolved THEN CAST(x1 AS BIGINT) % 25 END AS target FROM connectors)
SELECT canvas_id, count(*) FILTER (WHERE disposition = 'node') AS node, count(*) FILTER (WHERE disposition = 'edge') AS edge, count(*) FILTER (WHERE disposition = 'label') AS label, count(*) FILTER (WHERE disposition IS NULL) AS unaccounted,
  count(*) FILTER (WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shapes s WHERE s.canvas_id = i.canvas_id AND s.shape_id = i.target)) AS invalid FROM i GROUP BY canvas_id
""")
def _(connectors, shapes):
    items = connectors.selectExpr("canvas_id", "case connector_id % 4 when 0 then 'node' when 1 then 'edge' when 2 then 'label' end disposition", "case when resolved then cast(x1 as bigint) % 25 end target")
    return links.disposition_ledger(items, shapes)


_BLOCKS = """b AS (SELECT sheet_id AS doc_id, row_no AS page, CASE WHEN max(amount) % 2 = 0 THEN 'table' ELSE 'text' END AS last_kind, CASE WHEN min(amount) % 3 > 0 THEN 'table' ELSE 'text' END AS first_kind, max(style_id) % 2 AS last_columns, min(style_id) % 2 AS first_columns,
  CAST(max(amount) % 5 AS STRING) AS last_header, CAST(min(amount) % 5 AS STRING) AS first_header FROM cells GROUP BY sheet_id, row_no HAVING max(amount) % 7 > 0)"""


@query("j16_table_continuation", "cells", sql=f"""
WITH {_BLOCKS}, n AS (SELECT *, lead(page) OVER w AS np, lead(first_kind) OVER w AS nk, lead(first_columns) OVER w AS nc, lead(first_header) OVER w AS nh FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
c AS (SELECT *, coalesce(last_kind = 'table' AND nk = 'table' AND np = page + 1 AND nc = last_columns, false) AS continues FROM n) SELECT doc_id, page, continues, continues AND coalesce(nh = last_header, false) AS repeats_header FROM c
""")
def _(cells):
    blocks = cells.groupBy(F.col("sheet_id").alias("doc_id"), F.col("row_no").alias("page")).agg(F.max("amount").alias("hi"), F.min("amount").alias("lo"), F.max("style_id").alias("s1"), F.min("style_id").alias("s0")).where("hi % 7 > 0").selectExpr(
        "doc_id", "page", "if(hi % 2 = 0, 'table', 'text') last_kind", "if(lo % 3 > 0, 'table', 'text') first_kind", "s1 % 2 last_columns", "s0 % 2 first_columns", "cast(hi % 5 as string) last_header", "cast(lo % 5 as string) first_header"
    )
    return links.continued_tables(blocks).select("doc_id", "page", "continues", "repeats_header")


@query("u2_joined_rows", "cells", sql="""
WITH r AS (SELECT sheet_id AS table_id, 1 + (row_no - 1) // 4 AS page, (row_no - 1) % 4 AS row_no, CASE WHEN (row_no - 1) % 4 = 0 AND sheet_id % 2 = 0 THEN 'head' ELSE coalesce(value, '') END AS text FROM cells WHERE col_no = 2),
h AS (SELECT table_id, text AS hd FROM r WHERE page = 1 AND row_no = 0), k AS (SELECT r.* FROM r LEFT JOIN h USING (table_id) WHERE page = 1 OR row_no > 0 OR hd IS NULL OR text <> hd)
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY page, row_no) AS INT) AS place, CAST(page AS BIGINT) AS page, text FROM k
""")
def _(cells):
    rows = cells.where("col_no = 2").selectExpr("sheet_id table_id", "cast(1 + floor((row_no - 1) / 4) as bigint) page", "(row_no - 1) % 4 row_no", "case when (row_no - 1) % 4 = 0 and sheet_id % 2 = 0 then 'head' else coalesce(value, '') end text")
    return links.joined_rows(rows)


@query("u5_e32_maximal_texts", "nodes", sql="""
WITH t AS (SELECT doc_id, substring(text, 1, 1 + length(text) % 7) AS text, ord FROM nodes WHERE text <> ''), f AS (SELECT doc_id, text, min(ord) AS ord FROM t GROUP BY doc_id, text)
SELECT doc_id, text, ord FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND length(g.text) > length(f.text) AND contains(g.text, f.text))
""")
def _(nodes):
    return links.maximal_texts(nodes.where("text <> ''").select("doc_id", F.expr("substring(text, 1, 1 + length(text) % 7)").alias("text"), "ord"))


_PATHS = "p AS (SELECT DISTINCT doc_id, CASE WHEN ord % 3 = 0 THEN layer WHEN ord % 3 = 1 THEN layer || ' > ' || kind ELSE layer || ' > ' || kind || ' > ' || editability END AS path FROM nodes)"


def _paths(nodes):
    return nodes.select("doc_id", F.expr("case when ord % 3 = 0 then layer when ord % 3 = 1 then layer || ' > ' || kind else layer || ' > ' || kind || ' > ' || editability end").alias("path"))


@query("u6_maximal_paths", "nodes", sql=f"WITH {_PATHS} SELECT doc_id, path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND starts_with(q.path, p.path || ' > '))")
def _(nodes):
    return links.maximal_paths(_paths(nodes))


@query("t5_path_labels", "nodes", sql=f"WITH {_PATHS}, l AS (SELECT doc_id, list(path ORDER BY path) AS x FROM p GROUP BY doc_id) SELECT doc_id, array_to_string(x[1:3], ', ') || CASE WHEN len(x) > 3 THEN ' (+' || (len(x) - 3) || ')' ELSE '' END AS label FROM l")
def _(nodes):
    return links.path_labels(_paths(nodes))


@query("e34_notes_last", "nodes", sql="SELECT node_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind IN ('Footnote', 'Endnote'), ord, node_id) AS INT) AS place FROM nodes")
def _(nodes):
    return links.notes_last(nodes).select("node_id", "place")


@query("e37_represented_members", "nodes", sql="SELECT node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.doc_id = n.doc_id AND m.kind = 'Image' AND m.ord = n.ord + 1)")
def _(nodes):
    members = nodes.where("kind = 'Image' and ord > 0").select("doc_id", (F.col("ord") - 1).alias("ord")).join(nodes, ["doc_id", "ord"]).select("doc_id", "node_id")
    return links.represented(nodes, members).select("node_id")


@query("e42_unwritten_images", "images", "assets", sql="""
SELECT doc_id, asset_id FROM (SELECT DISTINCT doc_id, asset_id FROM assets) a WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.doc_id = a.doc_id AND i.reference = a.asset_id)
""")
def _(images, assets):
    return assets.select("doc_id", "asset_id").distinct().join(images.select("doc_id", F.col("reference").alias("asset_id")), ["doc_id", "asset_id"], "left_anti")


@query("e47_capability_verdict", "supplier", sql="""
WITH s AS (SELECT s_nationkey AS site, s_name AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'required' ELSE 'optional' END AS tier, CASE WHEN s_acctbal > 8000 THEN 'partial' WHEN s_acctbal < 0 THEN 'unavailable' ELSE 'ready' END AS status,
  'p' || s_suppkey % 4 AS provider, CASE WHEN s_suppkey % 2 = 0 THEN 'p' || s_suppkey % 3 END AS satisfied_by FROM supplier),
j AS (SELECT *, tier = 'optional' AND EXISTS (SELECT 1 FROM s r WHERE r.site = s.site AND r.status = 'ready' AND r.provider = s.satisfied_by) AS stands_in FROM s)
SELECT site, bool_and(tier <> 'required' OR status = 'ready') AS required_ready, coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE tier = 'optional' AND status <> 'ready'), '') AS optional_gaps,
  coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE status <> 'ready' AND NOT stands_in), '') AS strict_failures, CASE WHEN bool_and(tier <> 'required' OR status = 'ready') THEN 0 ELSE 1 END AS exit_code,
  CASE WHEN count(*) FILTER (WHERE status <> 'ready' AND NOT stands_in) = 0 THEN 0 ELSE 1 END AS strict_exit_code FROM j GROUP BY site
""")
def _(supplier):
    rows = supplier.selectExpr(
        "s_nationkey site", "s_name id", "if(s_suppkey % 3 = 0, 'required', 'optional') tier", "case when s_acctbal > 8000 then 'partial' when s_acctbal < 0 then 'unavailable' else 'ready' end status",
        "'p' || s_suppkey % 4 provider", "case when s_suppkey % 2 = 0 then 'p' || s_suppkey % 3 end satisfied_by",
    )
    return corpus.capability_verdict(rows, "site")
