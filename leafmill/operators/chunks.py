"""Outline context, chunks and sections: ordered folds over the nodes of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def flat_heading(nodes: DataFrame) -> DataFrame:
    """Nodes with the heading in force: every heading replaces the one before, across partitions."""
    order = W.partitionBy("doc_id").orderBy("partition_order", "ord", "node_id").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col("kind") == "Heading", F.col("text"))
    return nodes.withColumn("heading", F.nullif(F.last(mark, ignorenulls=True).over(order), F.lit("")))


def heading_path(nodes: DataFrame) -> DataFrame:
    """Nodes with the stack of headings above them: a heading closes those of its level and deeper; furniture has none.

    The stack is folded over a document's headings alone, whatever their levels; a node takes that of the last heading so far.
    """
    order = W.partitionBy("doc_id").orderBy("ord", "node_id").rowsBetween(W.unboundedPreceding, 0)
    real = (F.col("kind") == "Heading") & (F.trim("text") != "")
    item = F.struct("ord", "node_id", F.col("heading_level").alias("level"), F.trim("text").alias("title"))
    heads = nodes.where(real).groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("heads"))
    one = "array<struct<level:int,title:string>>"
    zero = F.struct(F.array().cast(one).alias("stack"), F.array().cast("array<array<string>>").alias("paths"))

    def fold(acc, x):
        stack = F.array_append(F.filter(acc["stack"], lambda h: h["level"] < x["level"]), F.struct(x["level"].cast("int").alias("level"), x["title"].alias("title")))
        return F.struct(stack.cast(one).alias("stack"), F.array_append(acc["paths"], F.transform(stack, lambda h: h["title"])).alias("paths"))

    paths = heads.select("doc_id", F.posexplode(F.aggregate("heads", zero, fold)["paths"]).alias("_n", "_path")).withColumn("_n", F.col("_n") + 1)
    step = nodes.withColumn("_n", F.sum(real.cast("int")).over(order)).join(paths, ["doc_id", "_n"], "left").drop("_n")
    none = F.array().cast("array<string>")
    return step.withColumn("heading_path", F.when(F.col("layer") == "Furniture", none).otherwise(F.coalesce("_path", none))).drop("_path")


def chunk(nodes: DataFrame, target: int = 4000, furniture: bool = False) -> DataFrame:
    """Greedy chunks of whole nodes: a chunk closes when the next node would take it over target characters.

    Every node adds two characters for the blank line; partitions never share a chunk.
    """
    if target < 128:
        raise ValueError("target must be at least 128")
    held = flat_heading(nodes.where(F.col("layer").isin("Body", "Furniture") if furniture else F.col("layer") == "Body")).where(F.coalesce("text", F.lit("")) != "")
    # the layer filter comes first, so a hidden heading is not carried either
    item = F.struct("ord", "node_id", "text", "layer", "heading")
    rows = held.groupBy("doc_id", "partition_order").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).alias("no"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("nos"))

    def fold(acc, x):
        size = F.length(x["text"]) + 2
        new = (acc["size"] > 0) & (acc["size"] + size > target)
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(no.alias("no"), F.when(new, size).otherwise(acc["size"] + size).alias("size"), F.array_append(acc["nos"], no).alias("nos"))

    packed = rows.select("doc_id", "partition_order", F.inline(F.arrays_zip(F.col("items").alias("x"), F.aggregate("items", zero, fold)["nos"].alias("no"))))
    grouped = packed.groupBy("doc_id", "partition_order", "no").agg(F.array_sort(F.collect_list("x")).alias("x"))
    numbered = W.partitionBy("doc_id").orderBy("partition_order", "no")
    text = F.array_join(F.transform("x", lambda i: i["text"]), "\n\n")
    return grouped.select(
        "doc_id", "partition_order",
        F.concat(F.lit("chk_"), F.col("partition_order").cast("string"), F.lit("_"), F.lpad(F.row_number().over(numbered).cast("string"), 4, "0")).alias("chunk_id"),
        F.array_join(F.transform("x", lambda i: i["node_id"]), ",").alias("node_ids"),
        F.when(F.size(F.array_distinct(F.transform("x", lambda i: i["layer"]))) == 1, F.get("x", F.lit(0))["layer"]).otherwise("Body").alias("layer"),
        F.get("x", F.lit(0))["heading"].alias("heading"),
        text.alias("text"),
        F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long").alias("estimated_tokens"),
    )


def sections(nodes: DataFrame, target: int = 400) -> DataFrame:
    """Section number of every node: a new one at a heading, or past target characters, never right after a heading.

    Runs of list items with one parent, and a node with its parent, stay together.
    """
    order = W.partitionBy("doc_id").orderBy("ord", "node_id")
    place = nodes.withColumn("_i", F.row_number().over(order))
    parents = place.select("doc_id", F.col("node_id").alias("parent_id"), F.col("_i").alias("_pi"))
    joined = place.join(parents, ["doc_id", "parent_id"], "left")
    previous = lambda c: F.lag(c).over(order)
    glued = (F.col("kind") == "ListItem") & (previous("kind") == "ListItem") & previous("parent_id").eqNullSafe(F.col("parent_id"))
    # an interval [parent, child] protects the starts of all nodes in it but its first
    reach = joined.groupBy("doc_id", F.least("_i", F.coalesce("_pi", F.col("_i"))).alias("_a")).agg(F.max(F.greatest("_i", F.coalesce("_pi", F.col("_i")))).alias("_b"))
    step = joined.withColumns({"_glued": F.coalesce(glued, F.lit(False)), "_after": F.coalesce(previous("kind") == "Heading", F.lit(False))})
    step = step.join(reach.withColumnRenamed("_a", "_i"), ["doc_id", "_i"], "left")
    before = W.partitionBy("doc_id").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    step = step.withColumn("_open", ~F.col("_glued") & (F.coalesce(F.max("_b").over(before), F.lit(0)) < F.col("_i")))
    item = F.struct("_i", "node_id", (F.col("_open") & ~F.col("_after")).alias("may"), (F.col("kind") == "Heading").alias("heading"), F.length("text").alias("size"))
    zero = F.struct(F.lit(1).alias("no"), F.lit(0).alias("size"), F.lit(True).alias("first"), F.array().cast("array<int>").alias("nos"))

    def fold(acc, x):
        new = ~acc["first"] & x["may"] & (x["heading"] | (acc["size"] >= target))
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(no.alias("no"), F.when(new, x["size"]).otherwise(acc["size"] + x["size"]).alias("size"), F.lit(False).alias("first"), F.array_append(acc["nos"], no).alias("nos"))

    rows = step.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = rows.select("doc_id", F.inline(F.arrays_zip(F.col("items").alias("x"), F.aggregate("items", zero, fold)["nos"].alias("section"))))
    return out.select("doc_id", F.col("x.node_id").alias("node_id"), F.col("x._i").alias("position"), "section")


def readable(nodes: DataFrame) -> DataFrame:
    """One Markdown text for each document: headings marked, list items dashed, blocks parted by an empty line."""
    mark = (
        F.when(F.col("kind") == "Heading", F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" "), "text"))
        .when(F.col("kind") == "ListItem", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    )
    rows = nodes.where(F.coalesce("text", F.lit("")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", mark.alias("md")))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda i: i["md"]), "\n\n").alias("markdown"))


def projection(nodes: DataFrame) -> DataFrame:
    """Where each node's text lies in its document's text (blocks parted by two characters)."""
    before = W.partitionBy("doc_id").orderBy("ord", "node_id").rowsBetween(W.unboundedPreceding, -1)
    return nodes.withColumns({"start": F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long"), "length": F.length("text")})


def numbered(nodes: DataFrame) -> DataFrame:
    """part-0001 … for the partitions of a document that have nodes, in order."""
    parts = nodes.groupBy("doc_id", "partition_order").agg(F.count("*").alias("n_nodes"))
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("partition_order"))
    return parts.select("doc_id", "partition_order", F.concat(F.lit("part-"), F.lpad(no.cast("string"), 4, "0")).alias("part_id"), "n_nodes")


def round_trip(nodes: DataFrame) -> DataFrame:
    """doc_id, markdown (every node behind a control comment that names it) and map: where in it the text of each node is.

    markdown[start : start + length] is the node's text; an edit is told from the baseline by the comments and the map.
    """
    head = F.concat(F.lit('<!-- block id="'), F.col("node_id"), F.lit('" kind="'), F.col("kind"), F.lit('" -->\n'))
    text = F.coalesce("text", F.lit(""))
    block = F.concat(head, text, F.lit("\n\n"))
    before = F.coalesce(F.sum(F.length(block)).over(W.partitionBy("doc_id").orderBy("ord", "node_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = nodes.select("doc_id", "ord", "node_id", block.alias("block"), (before + F.length(head)).alias("start"), F.length(text).alias("length"))
    found = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "block", "start", "length"))).alias("x"))
    return found.select(
        "doc_id", F.array_join(F.transform("x", lambda i: i["block"]), "").alias("markdown"), F.transform("x", lambda i: F.struct(i["node_id"].alias("node_id"), i["start"].alias("start"), i["length"].alias("length"))).alias("map"),
    )
