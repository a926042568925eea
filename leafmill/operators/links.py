"""References between nodes, assets, diagrams and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def image_assets(images: DataFrame, assets: DataFrame) -> DataFrame:
    """The asset of each image: by id, else the one part path that ends like it, else the one file of that name; none if several."""
    name = lambda c: F.element_at(F.split(F.lower(c), "/"), -1)
    want = images.withColumns({"_p": F.regexp_replace(F.lower("reference"), "^/", ""), "_n": name(F.col("reference"))})
    have = assets.withColumns({"_path": F.lower("part_path"), "_name": name(F.col("part_path"))})
    exact = want.join(assets.select("doc_id", F.col("asset_id").alias("reference"), F.col("asset_id").alias("by_id")).distinct(), ["doc_id", "reference"], "left")
    suffixes = have.select("doc_id", "asset_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_path", "/"))), lambda k: F.array_join(F.slice(F.split(F.col("_path"), "/"), k, F.lit(99)), "/"))).alias("_p"))
    one = lambda d, k, out: d.groupBy("doc_id", k).agg(F.when(F.count_distinct("asset_id") == 1, F.min("asset_id")).alias(out))
    both = exact.join(one(suffixes.where(F.instr("_p", "/") > 0), "_p", "by_path"), ["doc_id", "_p"], "left").join(one(have, "_name", "by_name").withColumnRenamed("_name", "_n"), ["doc_id", "_n"], "left")
    return both.select("doc_id", "node_id", "reference", F.coalesce("by_id", "by_path", "by_name").alias("asset_id"))


def attach_ocr(nodes: DataFrame, ocr: DataFrame) -> DataFrame:
    """Nodes and, after its host, a derived node for each recognized text."""
    hosts = nodes.select("doc_id", "node_id", F.col("ord").cast("double").alias("position"), "kind", "layer", "text")
    found = ocr.join(hosts.select("doc_id", "node_id", "position"), ["doc_id", "node_id"])
    new = found.select("doc_id", F.concat("node_id", F.lit("_ocr")).alias("node_id"), (F.col("position") + 0.5).alias("position"), F.lit("ImageText").alias("kind"), F.lit("Derived").alias("layer"), F.col("recognized").alias("text"))
    return hosts.unionByName(new)


def unique_alias(connectors: DataFrame, shapes: DataFrame, end: str) -> DataFrame:
    """The shape that a connector's alias names; no match if two shapes share it."""
    named = shapes.groupBy("canvas_id", "alias").agg(F.when(F.count("*") == 1, F.min("shape_id")).alias(f"{end}_shape"))
    return connectors.join(named.withColumnRenamed("alias", f"{end}_alias"), ["canvas_id", f"{end}_alias"], "left")


def comment_anchors(comments: DataFrame, anchors: DataFrame) -> DataFrame:
    return comments.join(anchors, ["doc_id", "comment_id"], "left")


def visual_accounting(edges: DataFrame) -> DataFrame:
    """Counts of a diagram's edges, and whether resolved and unresolved ones make up all."""
    resolved = F.count_if("resolved")
    return edges.groupBy("canvas_id").agg(F.count("*").alias("recognized"), resolved.alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_distinct("path_kind").alias("paths")).withColumn(
        "consistent", F.col("recognized") == F.col("resolved") + F.col("unresolved")
    )


def disposition_ledger(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items by what became of them; those without a disposition, and those that point to no node."""
    known = nodes.select("canvas_id", F.col("shape_id").alias("target"), F.lit(True).alias("_known")).distinct()
    both = items.join(known, ["canvas_id", "target"], "left")
    n = lambda d: F.count_if(F.col("disposition") == d).alias(d)
    return both.groupBy("canvas_id").agg(n("node"), n("edge"), n("label"), F.count_if(F.col("disposition").isNull()).alias("unaccounted"), F.count_if(F.col("target").isNotNull() & F.col("_known").isNull()).alias("invalid"))


def continued_tables(blocks: DataFrame) -> DataFrame:
    """Pages whose last table goes on with the first one of the next page: same columns, and a repeated or missing header."""
    order = W.partitionBy("doc_id").orderBy("page")
    after = lambda c: F.lead(c).over(order)
    goes_on = (F.col("last_kind") == "table") & (after("first_kind") == "table") & (after("page") == F.col("page") + 1) & (after("first_columns") == F.col("last_columns"))
    return blocks.withColumn("continues", F.coalesce(goes_on, F.lit(False))).withColumn("repeats_header", F.col("continues") & F.coalesce(after("first_header") == F.col("last_header"), F.lit(False)))


def joined_rows(rows: DataFrame) -> DataFrame:
    """Rows of continued tables as one table; a page after the first gives up a header equal to the first page's."""
    first = rows.where("page = 1 and row_no = 0").select("table_id", F.col("text").alias("_header"))
    kept = rows.join(first, "table_id", "left").where("page = 1 or row_no > 0 or _header is null or text <> _header")
    place = F.row_number().over(W.partitionBy("table_id").orderBy("page", "row_no"))
    return kept.select("table_id", place.alias("place"), "page", "text")


def maximal_texts(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that no longer text of their group contains; of equal ones the first."""
    first = texts.groupBy(key, "text").agg(F.min("ord").alias("ord"))
    longer = first.select(F.col(key).alias("_key"), F.col("text").alias("_text"))
    return first.join(longer, (first[key] == longer["_key"]) & (F.length("_text") > F.length("text")) & F.contains(F.col("_text"), F.col("text")), "left_anti")


def maximal_paths(paths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paths that are no proper prefix of another of their group."""
    own = paths.select(key, "path").distinct()
    longer = own.select(F.col(key).alias("_key"), F.col("path").alias("_path"))
    return own.join(longer, (own[key] == longer["_key"]) & F.startswith(F.col("_path"), F.concat(F.col("path"), F.lit(" > "))), "left_anti")


def path_labels(paths: DataFrame, most: int = 3, key: str = "doc_id") -> DataFrame:
    """The first few paths of a group, and how many more there are."""
    rows = paths.groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("p"))
    more = F.when(F.size("p") > most, F.concat(F.lit(" (+"), (F.size("p") - most).cast("string"), F.lit(")"))).otherwise("")
    return rows.select(key, F.concat(F.array_join(F.slice("p", 1, most), ", "), more).alias("label"))


def notes_last(nodes: DataFrame) -> DataFrame:
    """Nodes in reading order, footnotes moved behind the rest."""
    note = F.col("kind").isin("Footnote", "Endnote")
    return nodes.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(note, "ord", "node_id")))


def represented(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes that no valid diagram shows already."""
    return nodes.join(members.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti")
