"""Queries that write container files from rows and scan them back."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from ..sources import builders, containers
from .registry import query


def _files(df, key: str, build, suffix: str):
    """(path, content): one file for each value of key."""

    def run(k, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"{k[0]}{suffix}"], "content": [build(part)]})

    return df.groupBy(key).applyInPandas(run, "path string, content binary")


@lru_cache(1)
def _bomb() -> bytes:
    """A package that the gate stops, built once in a worker: deflating it takes far longer than all else about a file."""
    return builders.package({"bomb.txt": "0" * 3_000_000})


def _docx(nodes):
    def build(part):
        rows = part.sort_values(["ord", "node_id"])
        return builders.docx([("Heading" if k == "Heading" else "ListItem" if k == "ListItem" else "Paragraph", int(lv), t) for k, lv, t in zip(rows["kind"], rows["heading_level"], rows["text"])])

    return _files(nodes.select("doc_id", "node_id", "ord", "kind", "heading_level", "text"), "doc_id", build, ".docx")


def _xlsx(cells):
    def build(part):
        state = part["sheet_state"].iloc[0]
        rows = [(int(r), int(c), None if v is None else str(v), f) for r, c, v, f in zip(part["row_no"], part["col_no"], part["value"], part["formula"])]
        return builders.xlsx({"Data & more": rows, "Empty": []}, ("Data & more",) if state == "hidden" else ())

    return _files(cells.select("sheet_id", "row_no", "col_no", "value", "formula", "sheet_state"), "sheet_id", build, ".xlsx")


def _pptx(shapes):
    def build(part):
        rows = part.sort_values("shape_id")
        slides = [[(int(i) + 1, "title" if i == 0 else "", int(x), int(y), int(w), int(h), t) for i, x, y, w, h, t in zip(p["shape_id"], p["x"], p["y"], p["w"], p["h"], p["label"])] for _, p in rows.groupby(rows["shape_id"] // 10)]
        return builders.pptx(slides)

    return _files(shapes, "canvas_id", build, ".pptx")


def _pdf(fragments):
    def build(part):
        rows = part.sort_values(["page", "frag_id"])
        return builders.pdf([[(float(x), float(y), float(s), t) for x, y, s, t in zip(p["x"], p["y"], p["font_size"], p["text"])] for _, p in rows.groupby("page")])

    return _files(fragments.select("doc_id", "page", "frag_id", "x", "y", "font_size", "text"), "doc_id", build, ".pdf")


@query("s5_docx_scan", "nodes", sql="""
SELECT concat(CAST(doc_id AS STRING), '.docx') AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, node_id) - 1 AS INT) AS ord, CASE WHEN kind IN ('Heading', 'ListItem') THEN kind ELSE 'Paragraph' END AS kind,
  CASE WHEN kind IN ('Heading', 'ListItem') THEN heading_level ELSE 0 END AS level, text FROM nodes WHERE text <> ''
""")
def _(nodes):
    return containers.read_files(_docx(nodes), "docx").drop("error")


@query("s6_xlsx_scan", "cells", sql="""
SELECT concat(CAST(sheet_id AS STRING), '.xlsx') AS path, 'Data & more' AS sheet, sheet_state AS state, row_no, col_no, value, CASE WHEN formula IS NOT NULL THEN substring(formula, 2) END AS formula FROM cells WHERE value IS NOT NULL OR formula IS NOT NULL
""")
def _(cells):
    return containers.read_files(_xlsx(cells), "xlsx").select("path", "sheet", "state", "row_no", "col_no", "value", "formula")


@query("s7_pptx_scan", "shapes", sql="""
SELECT concat(CAST(canvas_id AS STRING), '.pptx') AS path, CAST(1 + floor(shape_id / 10) AS INT) AS slide, shape_id + 1 AS shape_id, CASE WHEN shape_id = 0 THEN 'title' ELSE '' END AS placeholder, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, label AS text FROM shapes
""")
def _(shapes):
    return containers.read_files(_pptx(shapes), "pptx").drop("error")


@query("s8_pdf_scan", "fragments", sql="""
SELECT concat(CAST(doc_id AS STRING), '.pdf') AS path, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY frag_id) - 1 AS INT) AS frag_id, x, y, font_size, text FROM fragments
""")
def _(fragments):
    return containers.read_files(_pdf(fragments), "pdf").drop("error")


def _mixed(nodes, cells, fragments):
    return _docx(nodes).unionByName(_xlsx(cells)).unionByName(_pdf(fragments)).withColumn("path", F.when(F.col("path").rlike("[05][.]"), F.concat("path", F.lit(".bak"))).otherwise(F.col("path")))


@query("s1_format_detection", "nodes", "cells", "fragments", sql="""
WITH f AS (SELECT DISTINCT concat(CAST(doc_id AS STRING), '.docx') AS p, 'docx' AS format FROM nodes UNION ALL SELECT DISTINCT concat(CAST(sheet_id AS STRING), '.xlsx'), 'xlsx' FROM cells UNION ALL SELECT DISTINCT concat(CAST(doc_id AS STRING), '.pdf'), 'pdf' FROM fragments)
SELECT CASE WHEN regexp_matches(p, '[05][.]') THEN p || '.bak' ELSE p END AS path, format, CASE WHEN regexp_matches(p, '[05][.]') THEN 'extension_mismatch' ELSE '' END AS warnings FROM f
""")
def _(nodes, cells, fragments):
    return containers.formats(_mixed(nodes, cells, fragments))


@query("s2_safety_gate", "parts", sql="""
SELECT concat(CAST(package_id AS STRING), '.zip') AS path, 'path_traversal' AS code, concat('../', path) AS entry FROM parts WHERE ord = 3
UNION ALL SELECT concat(CAST(package_id AS STRING), '.zip'), 'compression_ratio', 'bomb.txt' FROM parts WHERE ord = 5
""")
def _(parts):
    def build(part):
        own = {(f"../{p}" if o == 3 else p): m for p, o, m in zip(part["path"], part["ord"], part["markdown"])}
        return builders.package(own | ({"bomb.txt": "0" * 3_000_000} if (part["ord"] == 5).any() else {}))

    return containers.read_files(_files(parts, "package_id", build, ".zip"), "problems").drop("error")


@query("s10_package_entries", "parts", sql="SELECT concat(CAST(package_id AS STRING), '.zip') AS path, path AS entry, CAST(length(markdown) AS BIGINT) AS bytes, sha256(markdown) AS sha256 FROM parts")
def _(parts):
    def build(part):
        return builders.package(dict(zip(part["path"], part["markdown"])))

    return containers.read_files(_files(parts, "package_id", build, ".zip"), "entries").drop("compressed", "error")


@query("s10_relationships", "shapes", sql="""
SELECT concat(CAST(canvas_id AS STRING), '.pptx') AS path, 'ppt/presentation.xml' AS source, concat('rId', CAST(k AS STRING)) AS id, 'slide' AS type, concat('ppt/slides/slide', CAST(k AS STRING), '.xml') AS target, false AS external FROM (SELECT DISTINCT canvas_id FROM shapes), (VALUES (1), (2)) AS v(k)
""")
def _(shapes):
    return containers.read_files(_pptx(shapes), "relationships").drop("error")


@query("s9_embedded_assets", "parts", sql="SELECT concat(CAST(package_id AS STRING), '.zip') AS path, concat('word/media/i', CAST(ord AS STRING), '.png') AS entry, 'image/png' AS type, CAST(length(markdown) AS BIGINT) AS bytes, sha256(markdown) AS sha256 FROM parts WHERE ord % 2 = 0")
def _(parts):
    def build(part):
        return builders.package({(f"word/media/i{o}.png" if o % 2 == 0 else p): m for o, p, m in zip(part["ord"], part["path"], part["markdown"])})

    return containers.read_files(_files(parts, "package_id", build, ".zip"), "media").drop("error")


@query("s2_unreadable_files", "parts", sql="""
SELECT concat(CAST(package_id AS STRING), '-', CAST(ord AS STRING), '.bin') AS path, CASE WHEN ord % 4 = 0 THEN 'path_traversal' WHEN ord % 4 = 1 THEN 'compression_ratio' ELSE 'BadZipFile' END AS error FROM parts WHERE ord % 4 < 3
""")
def _(parts):
    """Files that the gate stops or nothing can open are rows with their error; the others have none."""

    def build(part):
        return pd.DataFrame({
            "path": [f"{k}-{o}.bin" for k, o in zip(part["package_id"], part["ord"])],
            "content": [
                _bomb() if o % 4 == 1 else m.encode() if o % 4 == 2 else builders.package({"../x.md" if o % 4 == 0 else "a.md": m}) for o, m in zip(part["ord"], part["markdown"])
            ],
        })

    # a small table comes as one partition
    spread = parts.select("package_id", "ord", "markdown").repartition("package_id", "ord")
    files = spread.mapInPandas(lambda it: (build(p) for p in it), "path string, content binary")
    found = containers.failures(containers.read_files(files, "entries"))
    return found.select("path", F.regexp_extract("error", r"(path_traversal|compression_ratio|BadZipFile)", 1).alias("error"))


@query("x1_format_source", "cells", sql="""
SELECT concat(CAST(sheet_id AS STRING), '.xlsx') AS path, sheet_state AS state, row_no, col_no, value FROM cells WHERE value IS NOT NULL
""")
def _(cells):
    """The files in the shared folder, read through the Python data source."""
    import uuid

    from ..sources import adapter
    from ..storage import shared_dir

    spark = cells.sparkSession
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    uri = root if ":/" in root else f"file://{root}"

    def put(parts):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                # a repeated task writes the same bytes again
                with fs.open_output_stream(f"{base}/{path}") as f:
                    f.write(bytes(content))
            yield part[["path"]]

    _xlsx(cells).mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()
    adapter.register(spark)
    found = spark.read.format("leafmill_files").option("kind", "xlsx").load(uri)
    return found.where("value is not null").select("path", "state", "row_no", "col_no", "value")
