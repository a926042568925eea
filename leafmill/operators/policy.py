"""Filters and projections over nodes and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The policies, and the layers and kinds that each leaves out.
POLICIES = ("visible", "complete", "sanitized")
NEVER_LAYERS, NEVER_KINDS = ("Hidden", "Metadata"), ("Comment", "Revision", "SpeakerNotes")
SANITIZED_LAYERS, SANITIZED_KINDS = ("Furniture", "Derived"), ("Header", "Footer", "Footnote", "Endnote", "ImageText", "Annotation")
# What makes a formula dangerous or suspicious.
DANGEROUS, SUSPICIOUS = ("DDE", "WEBSERVICE", "CALL("), ("INDIRECT", "HYPERLINK", "IMPORT")


def included(policy: str = "visible") -> Column:
    """Whether a node (layer, kind) belongs to what a content policy shows."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if policy == "complete":
        return F.lit(True)
    shown = ~F.col("layer").isin(*NEVER_LAYERS) & ~F.col("kind").isin(*NEVER_KINDS)
    if policy == "sanitized":
        shown &= ~F.col("layer").isin(*SANITIZED_LAYERS) & ~F.col("kind").isin(*SANITIZED_KINDS)
    return shown


def apply_policy(nodes: DataFrame, policy: str = "visible") -> DataFrame:
    return nodes.where(included(policy))


def body_only(nodes: DataFrame, furniture: bool = False) -> DataFrame:
    return nodes.where(F.col("layer").isin("Body", "Furniture") if furniture else F.col("layer") == "Body")


def content_text(content: Column) -> Column:
    """Text of a content struct: text, runs joined, table (tabs and line feeds), or a reference's alternative text."""
    table = F.array_join(F.transform(content["rows"], lambda r: F.array_join(r, "\t")), "\n")
    alt = F.when(F.trim(F.coalesce(content["alt_text"], F.lit(""))) != "", content["alt_text"]).otherwise(content["reference"])
    return (
        F.when(content["kind"] == "text", content["text"]).when(content["kind"] == "rich_text", F.array_join(content["runs"], ""))
        .when(content["kind"] == "table", table).when(content["kind"] == "reference", alt).otherwise(F.lit(""))
    )


def select_sheets(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Cells of the named sheets; names compare without case."""
    return cells.join(names.select(F.lower("sheet").alias("_sheet")).distinct(), F.lower(cells["sheet"]) == F.col("_sheet"), "left_semi")


def unknown_sheets(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Requested names that no sheet has."""
    return names.join(cells.select(F.lower("sheet").alias("_sheet")).distinct(), F.lower(names["sheet"]) == F.col("_sheet"), "left_anti")


def cell_layer() -> Column:
    hidden = F.col("hidden_row") | F.col("hidden_col") | (F.col("sheet_state") != "visible")
    return F.when(hidden, "Hidden").otherwise("Body")


def blank_cell() -> Column:
    return (F.coalesce("value", F.lit("")) == "") & (F.coalesce("formula", F.lit("")) == "")


def formula_safety() -> Column:
    f = F.upper(F.coalesce("formula", F.lit("")))

    def has(words) -> Column:
        out = F.lit(False)
        for w in words:
            out |= f.contains(w)
        return out

    return F.when(f.rlike(r"[\[\]]") | has(DANGEROUS), "Dangerous").when(has(SUSPICIOUS), "Suspicious").otherwise("Safe")


def revision_view(runs: DataFrame, view: str = "final") -> DataFrame:
    """Text of each node from its runs (ord, text, inserted, deleted): final, markup or reject."""
    keep = {"final": ~F.col("deleted"), "reject": ~F.col("inserted"), "markup": F.lit(True)}[view]
    shown = F.when(F.col("deleted"), F.concat(F.lit("~~"), "text", F.lit("~~"))).when(F.col("inserted"), F.concat(F.lit("<ins>"), "text", F.lit("</ins>"))).otherwise(F.col("text"))
    piece = F.struct("ord", (shown if view == "markup" else F.col("text")).alias("text"))
    return runs.where(keep).groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"))


def heading_sized(text: Column) -> Column:
    """Short, no end of a sentence, no address."""
    return F.length(text).between(2, 100) & ~text.rlike(r"[.!?。！？]\s*$") & ~text.rlike("https?://")


def needs_ocr_review() -> Column:
    return F.coalesce("confidence", F.lit(0.0)) < 0.8


def furniture_role() -> Column:
    return F.coalesce("role", F.lit("")).isin("footer", "date", "slide_number")


def image_budget(images: DataFrame, each: int = 10 << 20, total: int = 50 << 20) -> DataFrame:
    """Images embedded first come, first served: a rejected one takes nothing from the budget."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "image_id", "bytes")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def fold(acc, x):
        fits = (x["bytes"] <= each) & (acc["used"] + x["bytes"] <= total)
        return F.when(fits, F.struct((acc["used"] + x["bytes"]).alias("used"), F.array_append(acc["kept"], x["image_id"]).alias("kept"))).otherwise(acc)

    return images.groupBy("doc_id").agg(F.aggregate(rows, zero, fold).alias("r")).select("doc_id", F.col("r.used").alias("used"), F.explode_outer("r.kept").alias("image_id"))


def in_range(a1: str) -> Column:
    """Cells inside an A1 range, by row_no and col_no."""
    from ..functions.a1 import box

    top, left, bottom, right = box(a1)
    return F.col("row_no").between(top, bottom) & F.col("col_no").between(left, right)


def select_adapter(probes: DataFrame) -> DataFrame:
    """Best adapter of each document (priority, confidence, id); ambiguous if the runner-up has its priority and nearly its confidence."""
    order = W.partitionBy("doc_id").orderBy(F.desc("priority"), F.desc("confidence"), "provider_id")
    second = lambda c: F.lead(c).over(order)
    close = (second("priority") == F.col("priority")) & (F.col("confidence") - second("confidence") <= 0.05)
    return (
        probes.withColumns({"rank": F.row_number().over(order), "ambiguous": F.coalesce(close, F.lit(False))})
        .where("rank = 1").select("doc_id", "provider_id", "priority", "confidence", "ambiguous")
    )


def allowed_providers(probes: DataFrame, allowlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Probes whose (provider_id, version) is listed, and those whose isn't."""
    return probes.join(allowlist, ["provider_id", "version"], "left_semi"), probes.join(allowlist, ["provider_id", "version"], "left_anti")


def window_text(text: Column, offset: int, most: int) -> tuple[Column, Column]:
    """A window of a text and where the next one starts (null at the end)."""
    return F.substring(text, offset + 1, most), F.when(F.length(text) > offset + most, F.lit(offset + most))
