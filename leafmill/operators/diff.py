"""Comparing two versions of a node table, and checks of its integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def diff(baseline: DataFrame, edited: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Patch operations by node id: what is missing stays (a warning) unless it is listed for deletion."""
    fields = [c for c in baseline.columns if c in edited.columns and c != "node_id"]
    json = lambda p: F.to_json(F.struct(*[F.col(f"{p}.{c}") for c in sorted(fields)]))
    both = baseline.alias("a").join(edited.alias("b"), F.col("a.node_id") == F.col("b.node_id"), "full_outer")
    node = F.coalesce("a.node_id", "b.node_id")
    layer, editability = F.coalesce("a.layer", "b.layer"), F.coalesce("a.editability", "b.editability")
    derived = (layer == "Derived") | (editability == "AnnotationOnly")
    listed = F.lit(False)
    if deletes is not None:
        both = both.join(deletes.select(F.col("node_id").alias("_del")).distinct(), F.col("a.node_id") == F.col("_del"), "left")
        listed = F.col("_del").isNotNull()
    op = (
        F.when(F.col("b.node_id").isNull(), F.when(listed, "ExplicitDelete").otherwise("MissingNode"))
        .when(F.col("a.node_id").isNull(), F.when(derived, "UpdateDerivedAnnotation").otherwise("InsertNode"))
        .when(json("a") != json("b"), F.when(derived, "UpdateDerivedAnnotation").otherwise("ReplaceContent"))
    )
    after_layer, after_edit = F.coalesce("b.layer", "a.layer"), F.coalesce("b.editability", "a.editability")
    mutates = ~op.isin("UpdateDerivedAnnotation", "MissingNode") & (after_layer != "Derived") & (after_edit != "AnnotationOnly")
    return both.where(op.isNotNull()).select(
        F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), node.alias("node_id"), op.alias("op"), mutates.alias("mutates"), F.coalesce("b.part_uri", "a.part_uri").alias("part_uri")
    )


def dirty_parts(patches: DataFrame) -> DataFrame:
    """Distinct parts that mutating operations touch."""
    return patches.where("mutates and part_uri is not null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("part_uri")), ",").alias("parts"), F.count("*").alias("n_ops"))


def deduplicate_ids(nodes: DataFrame) -> DataFrame:
    """Unique ids: repeats become id__2, id__3 … in order; blank ones node_{partition}_{n}."""
    place = F.row_number().over(W.partitionBy("doc_id", "partition_order").orderBy("ord", "row_id"))
    blank = F.trim(F.coalesce("node_id", F.lit(""))) == ""
    named = nodes.withColumn("node_id", F.when(blank, F.concat_ws("_", F.lit("node"), F.col("partition_order").cast("string"), place.cast("string"))).otherwise(F.col("node_id")))
    n = F.row_number().over(W.partitionBy("doc_id", "node_id").orderBy("partition_order", "ord", "row_id"))
    return named.withColumn("_n", n).withColumn("node_id", F.when(F.col("_n") > 1, F.concat("node_id", F.lit("__"), F.col("_n").cast("string"))).otherwise(F.col("node_id"))).drop("_n")


def graph_problems(nodes: DataFrame) -> DataFrame:
    """Duplicate ids and parents that don't exist, by document."""
    twice = nodes.groupBy("doc_id", "node_id").count().where("count > 1").select("doc_id", "node_id", F.lit("DuplicateId").alias("problem"))
    ids = nodes.select("doc_id", F.col("node_id").alias("parent_id")).distinct()
    dangling = nodes.where("parent_id is not null").join(ids, ["doc_id", "parent_id"], "left_anti").select("doc_id", "node_id", F.lit("DanglingParent").alias("problem"))
    return twice.unionByName(dangling)


def parents(nodes: DataFrame) -> DataFrame:
    """Every node with its parent's kind and text."""
    p = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"), F.col("text").alias("parent_text"))
    return nodes.join(p, ["doc_id", "parent_id"], "left")


def file_integrity(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Problems of a package: missing, unlisted, wrong size (then no hash is compared), wrong hash."""
    a, b = listed.alias("a"), present.alias("b")
    both = a.join(b, ["package_id", "path"], "full_outer")
    problem = (
        F.when(F.col("b.sha256").isNull(), "missing").when(F.col("a.sha256").isNull(), "unlisted")
        .when(F.col("a.bytes") != F.col("b.bytes"), "size").when(F.col("a.sha256") != F.col("b.sha256"), "hash")
    )
    return both.select("package_id", "path", problem.alias("problem")).where("problem is not null")


def fidelity(checks: DataFrame) -> DataFrame:
    """Level of a restored document: identical bytes, same graph, same text, readable, or failed."""
    level = (
        F.when(F.col("failed"), "FX").when(F.col("same_bytes"), "F0").when(F.col("same_graph"), "F1").when(F.col("same_text"), "F2").otherwise("F3")
    )
    return checks.withColumns({"level": level, "success": level.isin("F0", "F1", "F2")})


def unaccounted(fragments: DataFrame, cell_ids: DataFrame, flow_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text in neither a table cell nor the flow, and cell ids that no text has."""
    keys = ["doc_id", "frag_id"]
    lost = fragments.join(cell_ids, keys, "left_anti").join(flow_ids, keys, "left_anti")
    return lost, cell_ids.join(fragments, keys, "left_anti")


def stop_reasons(packages: DataFrame) -> DataFrame:
    """Why a package must not be read without a look: review, sharing, hidden content (unknown counts as hidden under complete)."""
    hidden = (F.col("policy") == "complete") & F.coalesce("has_hidden", F.lit(True))
    reasons = F.array(F.when(F.col("review"), "conversion_review"), F.when(F.col("sharing"), "revision_sharing"), F.when(hidden, "hidden_content"))
    return packages.withColumn("reasons", F.array_join(F.filter(reasons, lambda r: r.isNotNull()), ","))
