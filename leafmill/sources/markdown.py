"""Markdown as rows: lines with fences, blocks, links, control comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_FENCE = r"^ {0,3}(`{3,}|~{3,})"


def lines(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a line: doc_id, line (from 0), raw."""
    return documents.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n")).alias("line", "raw"))


def fenced(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with in_fence (a fence's own lines count) by a fold: a fence closes with its mark, at least as long."""
    mark = F.regexp_extract("raw", _FENCE, 1)
    bare = F.col("raw").rlike(r"^ {0,3}(`{3,}|~{3,})\s*$")
    item = F.struct("line", "raw", mark.alias("mark"), bare.alias("bare"))
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("inside"))

    def fold(acc, x):
        closes = (acc["open"] != "") & x["bare"] & F.startswith(x["mark"], acc["open"])
        opens = (acc["open"] == "") & (x["mark"] != "")
        return F.struct(F.when(closes, "").when(opens, x["mark"]).otherwise(acc["open"]).alias("open"), F.array_append(acc["inside"], (acc["open"] != "") | opens).alias("inside"))

    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = whole.select(key, F.inline(F.arrays_zip(F.col("items").alias("i"), F.aggregate("items", zero, fold)["inside"].alias("in_fence"))))
    return out.select(key, F.col("i.line").alias("line"), F.col("i.raw").alias("raw"), "in_fence")


def classified(rows: DataFrame) -> DataFrame:
    """Lines with their kind and, of headings, level and title."""
    raw = F.col("raw")
    heading = raw.rlike(r"^#{1,6}\s+\S")
    kind = (
        F.when(F.col("in_fence"), "code").when(raw.rlike(r"^\s*$"), "blank").when(heading, "heading").when(raw.rlike(r"^\s*([-*+]|\d+[.)])\s+\S"), "list")
        .when(raw.rlike(r"^\s*\|.*\|\s*$"), "table").when(raw.rlike(r"^\s*>"), "quote").otherwise("paragraph")
    )
    return rows.withColumns({
        "kind": kind, "level": F.when((kind == "heading"), F.length(F.regexp_extract(raw, r"^(#{1,6})", 1))),
        "title": F.when(kind == "heading", F.regexp_extract(raw, r"^#{1,6}\s+(.+?)\s*#*\s*$", 1)),
    })


def blocks(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of a document: runs of lines of one kind; headings stand alone, blank lines part."""
    rows = classified(fenced(lines(documents, text, key), key))
    order = W.partitionBy(key).orderBy("line")
    new = (F.col("kind") != F.lag("kind").over(order)) | (F.col("kind") == "heading")
    step = rows.withColumn("_b", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("kind <> 'blank'")
    out = step.groupBy(key, "_b").agg(F.min("line").alias("first_line"), F.first("kind").alias("kind"), F.min("level").alias("level"), F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("x"))
    return out.select(key, F.row_number().over(W.partitionBy(key).orderBy("first_line")).alias("block"), "kind", "level", "first_line", F.array_join(F.transform("x", lambda i: i["raw"]), "\n").alias("text"))


def links(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Links and images of unfenced lines: label, target, is_image."""
    found = F.regexp_extract_all("raw", F.lit(r"(!?\[[^\]]*\]\([^)\s]*\))"), 1)
    step = rows.select(key, "line", F.posexplode(found).alias("nth", "m"))
    return step.select(key, "line", "nth", F.regexp_extract("m", r"\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("m", r"\]\(([^)\s]*)\)", 1).alias("target"), F.startswith(F.col("m"), F.lit("!")).alias("is_image"))


def controls(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Control comments `<!-- name key="value" ... -->` of unfenced lines, attributes as a map."""
    found = F.regexp_extract_all("raw", F.lit(r"<!--\s*([a-z][a-z:-]*(?:\s+[a-z_-]+=\"[^\"]*\")*)\s*-->"), 1)
    step = rows.select(key, "line", F.explode(found).alias("m"))
    pairs = F.regexp_extract_all("m", F.lit(r"([a-z_-]+=\"[^\"]*\")"), 1)
    entry = lambda p: F.struct(F.regexp_extract(p, r"^([a-z_-]+)=", 1).alias("key"), F.regexp_extract(p, r"=\"([^\"]*)\"", 1).alias("value"))
    return step.select(key, "line", F.regexp_extract("m", r"^([a-z:-]+)", 1).alias("name"), F.map_from_entries(F.transform(pairs, entry)).alias("attributes"))


def without_controls(rows: DataFrame) -> DataFrame:
    """Unfenced lines lose their control comments."""
    return rows.withColumn("raw", F.when(F.col("in_fence"), F.col("raw")).otherwise(F.regexp_replace("raw", r"<!--\s*[a-z][a-z:-]*(?:\s+[a-z_-]+=\"[^\"]*\")*\s*-->", "")))


def outline(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings in order, numbered."""
    return rows.where("kind = 'heading'").select(key, F.row_number().over(W.partitionBy(key).orderBy("line")).alias("no"), "line", "level", "title")
