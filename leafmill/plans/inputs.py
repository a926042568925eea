"""Inputs of the registered queries.

The document tables of the engine (nodes, cells, fragments, shapes, ...) are
derived from the star-schema tables by statements that Spark SQL and DuckDB
read alike; ``frame`` gives any of them, or a base table, as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Statements over base tables and inputs above them.
DERIVED: dict[str, str] = {
    # nodes of documents of 25 nodes in partitions of 10
    "nodes": """
        SELECT CAST(floor(o_orderkey / 25) AS BIGINT) AS doc_id, concat('n', CAST(o_orderkey AS STRING)) AS node_id,
               CAST(floor((o_orderkey % 25) / 10) AS INT) AS partition_order, CAST(o_orderkey % 25 AS INT) AS ord,
               CASE WHEN o_orderkey % 7 = 0 THEN 'Heading' WHEN o_custkey % 11 = 1 THEN 'ListItem' WHEN o_custkey % 11 = 2 THEN 'Comment'
                    WHEN o_custkey % 11 = 3 THEN 'Footnote' WHEN o_custkey % 11 = 4 THEN 'SpeakerNotes' WHEN o_custkey % 11 = 5 THEN 'Header'
                    WHEN o_custkey % 11 = 6 THEN 'Image' ELSE 'Paragraph' END AS kind,
               CASE WHEN o_custkey % 13 = 0 THEN 'Hidden' WHEN o_custkey % 13 = 1 THEN 'Furniture' WHEN o_custkey % 13 = 2 THEN 'Derived'
                    WHEN o_custkey % 13 = 3 THEN 'Metadata' ELSE 'Body' END AS layer,
               CASE WHEN o_orderkey % 25 > 0 AND o_custkey % 4 = 0 THEN concat('n', CAST(o_orderkey - 1 - o_custkey % 3 AS STRING)) END AS parent_id,
               CAST(1 + o_custkey % 4 AS INT) AS heading_level,
               CASE WHEN o_custkey % 17 = 0 THEN '' ELSE concat(o_orderpriority, repeat(concat(' ', lower(o_orderstatus), CAST(o_custkey % 10 AS STRING)), CAST(o_custkey % 60 AS INT))) END AS text,
               CASE WHEN o_custkey % 19 = 0 THEN 'AnnotationOnly' ELSE 'EditableInPlace' END AS editability,
               concat('part', CAST(o_orderkey % 3 AS STRING), '.xml') AS part_uri
        FROM orders""",
    # the same documents after an edit: some nodes gone, some changed, some new
    "edited": """
        SELECT doc_id, node_id, kind, layer, editability, part_uri,
               CASE WHEN length(text) % 5 = 0 THEN concat(text, ' edited') ELSE text END AS text
        FROM nodes WHERE ord % 9 <> 4
        UNION ALL
        SELECT doc_id, concat(node_id, '_new') AS node_id, kind, layer, editability, part_uri, text FROM nodes WHERE ord % 11 = 3""",
    # sheets of 10 rows and 6 columns
    "cells": """
        SELECT CAST(floor(o_orderkey / 60) AS BIGINT) AS sheet_id, CAST(floor((o_orderkey % 60) / 6) AS INT) + 1 AS row_no, CAST(o_orderkey % 6 AS INT) + 1 AS col_no,
               CASE WHEN o_custkey % 9 = 0 THEN NULL
                    WHEN o_orderkey % 6 = 0 THEN o_orderpriority
                    WHEN o_orderkey % 6 = 1 THEN CAST(o_custkey AS STRING)
                    WHEN o_orderkey % 6 = 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
                    WHEN o_orderkey % 6 = 3 AND o_custkey % 3 = 0 THEN '-'
                    WHEN o_orderkey % 6 = 3 THEN concat(CAST(o_custkey % 100 AS STRING), '%')
                    WHEN o_orderkey % 6 = 4 THEN NULL
                    ELSE o_orderstatus END AS value,
               CASE WHEN o_custkey % 14 = 0 THEN concat('=SUM(A', CAST(1 + o_custkey % 5 AS STRING), ':B', CAST(2 + o_custkey % 8 AS STRING), ')')
                    WHEN o_custkey % 29 = 0 THEN '=INDIRECT("A1")' WHEN o_custkey % 31 = 0 THEN '=[book.xlsx]S!A1' END AS formula,
               CAST(o_custkey % 6 AS INT) AS style_id, o_custkey % 23 = 0 AS hidden_row, o_custkey % 37 = 0 AS hidden_col,
               CASE WHEN floor(o_orderkey / 60) % 10 = 3 THEN 'hidden' ELSE 'visible' END AS sheet_state,
               CAST(floor(o_totalprice) AS BIGINT) AS amount
        FROM orders""",
    # text fragments of pages of 40 lines
    "fragments": """
        SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS doc_id, CAST(floor((o_orderkey % 400) / 40) AS INT) + 1 AS page, CAST(o_orderkey % 40 AS INT) AS frag_id,
               CAST(40 + (o_custkey % 5) * 90 AS DOUBLE) AS x, CAST(30 + floor((o_orderkey % 40) / 2) * 18 + o_custkey % 3 AS DOUBLE) AS y,
               CAST(40 + o_custkey % 50 AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h,
               CAST(CASE WHEN o_custkey % 20 = 0 THEN 20 WHEN o_custkey % 10 = 1 THEN 13 ELSE 10 END AS DOUBLE) AS font_size,
               CASE WHEN o_custkey % 8 = 0 THEN 'Serif' ELSE 'Sans' END AS font_family, o_custkey % 12 = 0 AS bold,
               CASE WHEN o_orderkey % 40 = 0 THEN 'Annual report' WHEN o_orderkey % 40 = 39 THEN concat('Page ', CAST(floor((o_orderkey % 400) / 40) + 1 AS INT))
                    WHEN o_custkey % 10 = 5 THEN concat(CAST(o_custkey AS STRING), '. item') ELSE concat(o_orderpriority, ' ', o_orderstatus, repeat(' and so on', CAST(o_custkey % 4 AS INT))) END AS text
        FROM orders""",
    # shapes and connectors on canvases of 30 objects, 20 of them shapes
    "shapes": """
        SELECT CAST(floor(c_custkey / 30) AS BIGINT) AS canvas_id, CAST(c_custkey % 30 AS INT) AS shape_id,
               CAST((c_custkey * 37) % 53 * 20 AS DOUBLE) AS x, CAST((c_custkey * 71) % 41 * 15 AS DOUBLE) AS y,
               CAST(30 + c_custkey % 4 * 10 AS DOUBLE) AS w, CAST(20 + c_custkey % 3 * 10 AS DOUBLE) AS h, c_name AS label,
               concat('a', CAST(c_custkey % 17 AS STRING)) AS alias
        FROM customer WHERE c_custkey % 30 < 20""",
    "connectors": """
        SELECT CAST(floor(c_custkey / 30) AS BIGINT) AS canvas_id, CAST(c_custkey % 30 AS INT) AS connector_id,
               CAST((c_custkey * 29) % 53 * 20 AS DOUBLE) AS x1, CAST((c_custkey * 13) % 41 * 15 AS DOUBLE) AS y1,
               CAST((c_custkey * 43) % 53 * 20 AS DOUBLE) AS x2, CAST((c_custkey * 59) % 41 * 15 AS DOUBLE) AS y2,
               concat('a', CAST(c_nationkey % 19 AS STRING)) AS src_alias, concat('a', CAST((c_nationkey * 3) % 23 AS STRING)) AS dst_alias,
               c_acctbal > 0 AS resolved, c_mktsegment AS path_kind
        FROM customer WHERE c_custkey % 30 >= 20""",
    # corpus runs: one report for each file and run
    "runs": """
        SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'current' END AS run, CAST(floor(o_orderkey / 2) AS BIGINT) AS file_id,
               CASE WHEN floor(o_orderkey / 2) % 4 = 0 THEN 'docx' WHEN floor(o_orderkey / 2) % 4 = 1 THEN 'xlsx' WHEN floor(o_orderkey / 2) % 4 = 2 THEN 'pptx' ELSE 'pdf' END AS format,
               o_custkey % 20 = 0 AS failed, o_custkey % 6 = 0 AS has_warning,
               CASE WHEN o_custkey % 15 = 0 THEN NULL ELSE CAST(o_custkey % 101 AS DOUBLE) / 100 END AS retention,
               CASE WHEN o_custkey % 16 = 0 THEN NULL ELSE CAST(o_custkey % 41 AS DOUBLE) / 100 END AS spurious,
               CAST(floor(o_totalprice) AS BIGINT) % 10000 AS elapsed_ms,
               concat('W', CAST(o_custkey % 5 AS STRING)) AS code_a, CASE WHEN o_custkey % 3 = 0 THEN concat('W', CAST(o_custkey % 8 AS STRING)) END AS code_b
        FROM orders""",
    # diagnostics of documents
    "diagnostics": """
        SELECT CAST(floor(event_id / 8) AS BIGINT) AS doc_id, event_id AS diag_id,
               concat(CASE WHEN user_id % 3 = 0 THEN 'OCR' WHEN user_id % 3 = 1 THEN 'PDF' ELSE 'XLSX' END, CAST(user_id % 4 AS STRING)) AS code,
               CASE WHEN event_type = 'error' THEN 'Error' WHEN event_type = 'click' THEN 'Warning' ELSE 'Info' END AS severity,
               concat('message ', CAST(user_id % 5 AS STRING)) AS message, CASE WHEN user_id % 2 = 0 THEN concat('n', CAST(user_id AS STRING)) END AS node_id
        FROM events""",
    # parts of packages, and files found beside them
    "parts": """
        SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS package_id, CAST(p_partkey % 12 AS INT) AS ord, concat('parts/p', CAST(p_partkey % 12 AS STRING), '.md') AS path,
               concat('# ', p_name, repeat(concat(' ', lower(p_type)), p_size)) AS markdown, CAST(floor(p_retailprice) AS BIGINT) % 400 AS target,
               concat('t', CAST(floor((p_partkey % 12) / 4) AS STRING)) AS table_id, p_brand AS section
        FROM part""",
    "files": """
        SELECT package_id, path, CAST(length(markdown) + CASE WHEN ord = 3 THEN 1 ELSE 0 END AS BIGINT) AS bytes,
               sha2(CASE WHEN ord = 5 THEN concat(markdown, '!') ELSE markdown END, 256) AS sha256
        FROM parts WHERE ord <> 7
        UNION ALL SELECT package_id, 'extra.txt' AS path, CAST(1 AS BIGINT) AS bytes, 'x' AS sha256 FROM parts WHERE ord = 0""",
    # images of nodes and assets of documents
    "images": """
        SELECT doc_id, node_id, CASE WHEN ord % 3 = 0 THEN concat('asset', CAST(ord % 4 AS STRING)) WHEN ord % 3 = 1 THEN concat('/word/media/Image', CAST(ord % 6 AS STRING), '.PNG') ELSE concat('Image', CAST(ord % 5 AS STRING), '.png') END AS reference
        FROM nodes WHERE kind = 'Image'""",
    "assets": """
        SELECT doc_id, concat('asset', CAST(ord % 4 AS STRING)) AS asset_id, concat('word/media/image', CAST(ord % 6 AS STRING), '.png') AS part_path
        FROM nodes WHERE ord < 4 OR ord = 7""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    views = {n: frame(spark, sf_dir, n) for n in (*BASE, *DERIVED) if n != name and (f"FROM {n}" in text or f"JOIN {n}" in text)}
    # named parameters of spark.sql() keep the statement free of global views
    for n in views:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {n}\n", f"{word} {{{n}}}\n").replace(f"{word} {n} ", f"{word} {{{n}}} ").replace(f"{word} {n},", f"{word} {{{n}}},")
            if text.endswith(f"{word} {n}"):
                text = text[: -len(n)] + f"{{{n}}}"
    return spark.sql(text, **views)
