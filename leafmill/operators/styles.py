"""Styles, numbering, headings and slides: cascades over small dimension tables, and ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import materialize

def style_chain(styles: DataFrame, value: str) -> DataFrame:
    """The value of each style: its own, or that of the nearest style it is based on, however far.

    styles: style_id, based_on and value.  Each round joins the table with itself and doubles the stretch of the chain that
    is known, until nothing is left to follow; styles on a cycle without a value have none.
    """
    out = materialize(styles.select("style_id", F.col("based_on").alias("next"), F.col(value).alias("value")), "styles")
    for _ in range(out.count().bit_length() + 1):
        if out.where("value is null and next is not null").isEmpty():
            break
        base = out.select(F.col("style_id").alias("_id"), F.col("next").alias("_next"), F.col("value").alias("_value"))
        step = out.join(base, out["next"] == base["_id"], "left")
        out = materialize(step.select("style_id", F.when(F.col("value").isNull() & F.col("_value").isNull(), F.col("_next")).alias("next"), F.coalesce("value", "_value").alias("value")), "styles")
    return out.select("style_id", "value")


def hidden_runs(runs: DataFrame, styles: DataFrame) -> DataFrame:
    """Runs that are hidden: their own setting, else that of the character style, the paragraph style, the table style."""
    resolved = style_chain(styles, "vanish")
    out = runs
    for c in ("char_style", "para_style", "table_style"):
        out = out.join(resolved.select(F.col("style_id").alias(c), F.col("value").alias(f"_{c}")), c, "left")
    return out.withColumn("hidden", F.coalesce("vanish", "_char_style", "_para_style", "_table_style", F.lit(False))).drop("_char_style", "_para_style", "_table_style")


def code_blocks(paragraphs: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` monospace paragraphs; blank ones join only inside."""
    order = W.partitionBy("doc_id").orderBy("ord")
    blank = F.trim("text") == ""
    step = paragraphs.withColumns({"_blank": blank, "_n": F.row_number().over(order)})
    step = step.withColumn("_stop", F.sum((~F.col("_blank") & ~F.col("mono")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("mono or _blank")
    inside = step.groupBy("doc_id", "_stop").agg(F.min(F.when(~F.col("_blank"), F.col("ord"))).alias("first_ord"), F.max(F.when(~F.col("_blank"), F.col("ord"))).alias("last_ord"), F.count_if(~F.col("_blank")).alias("n"))
    return inside.where(F.col("n") >= least).select("doc_id", "first_ord", "last_ord", "n")


def list_numbers(items: DataFrame, levels: int = 9) -> DataFrame:
    """Numbers of list items (level 0 to levels - 1; the format has nine): one counts on within its list and level until a shallower item comes between."""
    order = W.partitionBy("doc_id", "num_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    out = items
    for k in range(levels):
        # a block of level k ends at each shallower item
        out = out.withColumn(f"_b{k}", F.sum((F.col("level") < k).cast("int")).over(order))
    counts = [F.sum((F.col("level") == k).cast("int")).over(W.partitionBy("doc_id", "num_id", f"_b{k}").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)) for k in range(levels)]
    out = out.withColumns({f"_c{k}": c for k, c in enumerate(counts)})
    number = F.array_join(F.slice(F.array(*[F.col(f"_c{k}").cast("string") for k in range(levels)]), F.lit(1), F.col("level") + 1), ".")
    return out.withColumn("number", number).drop(*[f"_{p}{k}" for p in "bc" for k in range(levels)])


def first_branch(branches: DataFrame, known: list[str]) -> DataFrame:
    """Of a choice's branches the first whose requirement is known, else the fallback (no requirement)."""
    usable = F.col("requires").isin(known) | F.col("requires").isNull()
    rank = F.row_number().over(W.partitionBy("choice_id").orderBy(F.col("requires").isNull(), "ord"))
    return branches.where(usable).withColumn("_r", rank).where("_r = 1").drop("_r")


def docx_heading(paragraphs: DataFrame) -> DataFrame:
    """Heading level: outline, named style, else inferred (numbering depth, bold and large, title size) with confidence 0.85."""
    t = F.trim("text")
    depth = F.size(F.split(F.regexp_extract(t, r"^(\d+(?:\.\d+){0,5})[.)]?\s", 1), r"\."))
    numbered = t.rlike(r"^\d+(\.\d+){0,5}[.)]?\s") & F.col("bold")
    short = F.length(t).between(2, 100) & ~t.rlike(r"[.!?。！？]\s*$")
    named = F.regexp_extract("style", r"^[Hh]eading\s?([1-9])$", 1)
    inferred = F.when(short & numbered, F.least(depth, F.lit(6))).when(short & (F.col("font_size") >= 16) & (F.col("font_size") >= F.col("body_size") * 1.35), 1).when(short & F.col("bold") & (F.col("font_size") >= F.col("body_size") * 1.2), 2)
    sure = F.coalesce(F.when(F.col("outline").between(0, 8), F.col("outline") + 1), F.when(named != "", named.cast("int")))
    return paragraphs.withColumns({"level": F.coalesce(sure, inferred).cast("int"), "confidence": F.when(sure.isNotNull(), 1.0).when(inferred.isNotNull(), 0.85)})


def inherited(shapes: DataFrame, layouts: DataFrame, masters: DataFrame, value: str) -> DataFrame:
    """A placeholder's setting from the shape, else its layout's, else its master's, by type and level."""
    a = layouts.select("layout_id", "ph_type", "level", F.col(value).alias("_layout"))
    b = masters.select("master_id", "ph_type", "level", F.col(value).alias("_master"))
    both = shapes.join(a, ["layout_id", "ph_type", "level"], "left").join(b, ["master_id", "ph_type", "level"], "left")
    return both.withColumn(value, F.coalesce(value, "_layout", "_master")).drop("_layout", "_master")


def slide_roles(shapes: DataFrame, height: float = 540.0) -> DataFrame:
    """Role of a shape: by placeholder, contents lines with leaders, title-like (high and large), footer by place."""
    leader = F.col("text").rlike(r"(\.{3,}|…|\t)\s*\d+\s*$")
    role = (
        F.when(F.col("ph_type").isin("title", "ctrTitle"), "title").when(F.col("ph_type").isin("ftr", "dt", "sldNum"), "furniture").when(leader, "contents")
        .when((F.col("y") < height * 0.2) & (F.col("font_size") >= 24) & (F.length("text") <= 60), "title").when(F.col("y") > height * 0.9, "furniture").otherwise("body")
    )
    return shapes.withColumn("role", role)


def slide_headings(shapes: DataFrame) -> DataFrame:
    """`Slide n` with its title and hidden mark; slides without text are skipped, numbers stay."""
    text = F.trim(F.coalesce("text", F.lit("")))
    out = shapes.where(text != "").groupBy("doc_id", "slide").agg(F.min_by(F.when(F.col("role") == "title", text), F.when(F.col("role") == "title", F.struct("y", "shape_id"))).alias("title"), F.bool_or("hidden").alias("hidden"))
    return out.select("doc_id", "slide", F.concat(F.lit("## Slide "), F.col("slide").cast("string"), F.when(F.col("title").isNotNull(), F.concat(F.lit(" — "), "title")).otherwise(""), F.when(F.col("hidden"), " (hidden)").otherwise("")).alias("heading"))


def lanes(shapes: DataFrame, lanes_: DataFrame) -> DataFrame:
    """The swimlane whose span holds a shape's middle."""
    both = shapes.join(lanes_, "canvas_id")
    middle = F.col("y") + F.col("h") / 2
    return both.where((middle >= F.col("top")) & (middle < F.col("bottom"))).select("canvas_id", "shape_id", "lane")


def emu_cells(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Row or column of a position: running sums of the sizes before it."""
    before = W.partitionBy("sheet_id").orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    spans = sizes.withColumn("lo", F.coalesce(F.sum("size").over(before), F.lit(0)))
    both = anchors.join(spans.select("sheet_id", "index", "lo", "size"), "sheet_id")
    return both.where("position >= lo and position < lo + size").select("sheet_id", "anchor_id", "index", (F.col("position") - F.col("lo")).alias("offset"))


def comment_places(nodes: DataFrame) -> DataFrame:
    """Comments placed right behind the node they refer to (parent_id); the rest keep their order."""
    host = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("ord").alias("_host"))
    both = nodes.join(host, ["doc_id", "parent_id"], "left")
    anchored = (F.col("kind") == "Comment") & F.col("_host").isNotNull()
    key = F.when(anchored, F.col("_host")).otherwise(F.col("ord"))
    return both.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(key, anchored, "ord", "node_id"))).drop("_host")


def nested_fold(tables: DataFrame) -> DataFrame:
    """Text of the outermost tables with the tables nested in them folded in, however deep.

    tables: table_id, parent_id, ord, text.  Rounds go down from the tables without a host, one level each, then the
    children of each level are joined to their hosts, the deepest first.
    """
    known = tables.select(F.col("table_id").alias("parent_id"))
    levels = [materialize(tables.join(known, "parent_id", "left_anti").select("table_id", "parent_id", "ord", "text"), "tables")]
    while True:
        hosts = levels[-1].select(F.col("table_id").alias("parent_id"))
        below = materialize(tables.join(hosts, "parent_id").select("table_id", "parent_id", "ord", "text"), "tables")
        if below.isEmpty():
            break
        levels.append(below)
    out = levels[-1]
    for level in levels[-2::-1]:
        texts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
        kids = out.groupBy(F.col("parent_id").alias("table_id")).agg(F.array_join(texts, "; ").alias("_in"))
        folded = F.when(F.col("_in").isNotNull(), F.concat("text", F.lit(" ["), "_in", F.lit("]"))).otherwise(F.col("text"))
        out = level.join(kids, "table_id", "left").select("table_id", "parent_id", "ord", folded.alias("text"))
    return out.select("table_id", "text")


def segment_hits(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes that a segment crosses (Liang-Barsky clipping), for routes that run through other nodes."""
    both = segments.join(boxes, "canvas_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def span(d: Column, lo: Column, hi: Column, at: Column) -> tuple[Column, Column]:
        a, b = (lo - at) / F.nullif(d, F.lit(0.0)), (hi - at) / F.nullif(d, F.lit(0.0))
        inside = (at >= lo) & (at <= hi)
        return F.when(d == 0, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(a, b)), F.when(d == 0, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(a, b))

    x0, x1 = span(dx, F.col("x"), F.col("x") + F.col("w"), F.col("x1"))
    y0, y1 = span(dy, F.col("y"), F.col("y") + F.col("h"), F.col("y1"))
    return both.where(F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))).select("canvas_id", "connector_id", "shape_id")


def character_grid(cells: DataFrame, marks: str = "─│┌┐└┘├┤┬┴┼-|+") -> DataFrame:
    """Diagrams drawn with characters: cells that touch (side by side or one below the other) and hold a mark or a label, as islands of rows."""
    drawn = cells.where(F.col("value").isin(*marks) | (F.length("value") > 1)).select("sheet_id", "row_no").distinct()
    order = W.partitionBy("sheet_id").orderBy("row_no")
    island = drawn.withColumn("g", F.col("row_no") - F.row_number().over(order))
    return island.groupBy("sheet_id", "g").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row")).drop("g")


def structure_basis(flags: DataFrame) -> DataFrame:
    """How a document's order and tables were found: from the source, inferred, or in need of comparison."""
    basis = F.when(F.col("needs_comparison"), "needs_comparison").when(F.col("inferred"), "inferred").when(F.col("has_structure"), "source").otherwise("none")
    return flags.withColumn("basis", basis)


def unresolved_elements(items: DataFrame) -> DataFrame:
    """Distinct elements without a resolution, and their review class."""
    kind = F.when(F.col("kind") == "edge", "relation").when(F.col("kind") == "label", "text").otherwise("element")
    return items.where(~F.col("resolved")).groupBy("canvas_id", kind.alias("class")).agg(F.count_distinct("item_id").alias("n"))


def sharing_decision(packages: DataFrame) -> DataFrame:
    """Whether a file may be shared: tracked changes or comments block it unless the policy hides them or the choice was made."""
    traces = (F.col("n_changes") > 0) | (F.col("n_comments") > 0)
    return packages.withColumn("decision", F.when(~traces, "share").when(F.col("policy") == "sanitized", "share").when(F.col("confirmed"), "share_with_traces").otherwise("ask"))


def image_size(content: Column) -> tuple[Column, Column, Column]:
    """Type, width and height from the header of PNG and GIF files."""
    h = F.hex(content)
    number = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    little = lambda at: F.conv(F.concat(F.substring(h, at + 2, 2), F.substring(h, at, 2)), 16, 10).cast("int")
    png, gif = F.startswith(h, F.lit("89504E470D0A1A0A")), F.startswith(h, F.lit("474946383"))
    kind = F.when(png, "png").when(gif, "gif").when(F.startswith(h, F.lit("FFD8FF")), "jpeg")
    return kind, F.when(png, number(33, 8)).when(gif, little(13)), F.when(png, number(41, 8)).when(gif, little(17))


def linear_math(tokens: DataFrame) -> DataFrame:
    """Formula parts (eq_id, ord, kind, a, b) as one line: fractions, powers, indices, roots, plain text."""
    group = lambda c: F.when(F.length(c) > 1, F.concat(F.lit("("), c, F.lit(")"))).otherwise(c)
    a, b = F.col("a"), F.col("b")
    text = (
        F.when(F.col("kind") == "frac", F.concat(group(a), F.lit("/"), group(b))).when(F.col("kind") == "sup", F.concat(a, F.lit("^"), group(b)))
        .when(F.col("kind") == "sub", F.concat(a, F.lit("_"), group(b))).when(F.col("kind") == "rad", F.concat(F.lit("√"), group(a))).otherwise(a)
    )
    rows = tokens.groupBy("eq_id").agg(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))).alias("x"))
    return rows.select("eq_id", F.array_join(F.transform("x", lambda i: i["t"]), "").alias("line"))


def dirty_cells(edits: DataFrame, formulas: DataFrame) -> DataFrame:
    """Parts that a cell edit makes dirty, one row a reason: the sheet, the shared strings for text, the calculation chain where formulas read it."""
    reasons = F.filter(F.array(
        F.struct(F.concat(F.lit("xl/worksheets/sheet"), F.col("sheet_id").cast("string"), F.lit(".xml")).alias("part"), F.lit("cell").alias("reason")),
        F.when(F.col("is_text"), F.struct(F.lit("xl/sharedStrings.xml").alias("part"), F.lit("text").alias("reason"))),
    ), lambda r: r.isNotNull())
    own = edits.select("sheet_id", F.explode(reasons).alias("r")).select("sheet_id", "r.part", "r.reason").distinct()
    chain = formulas.select("sheet_id").distinct().join(edits.select("sheet_id").distinct(), "sheet_id").select("sheet_id", F.lit("xl/calcChain.xml").alias("part"), F.lit("formula").alias("reason"))
    return own.unionByName(chain)


def apply_edits(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes with the text of the edited blocks that name them; locked nodes keep theirs, and the refusal is told."""
    both = nodes.join(blocks.select(F.col("id").alias("node_id"), F.col("text").alias("_new")), "node_id", "left")
    wants = F.col("_new").isNotNull() & (F.col("_new") != F.col("text"))
    allowed = F.col("editability") == "EditableInPlace"
    return both.withColumns({"status": F.when(wants & allowed, "edited").when(wants, "refused").otherwise("kept"), "text": F.when(wants & allowed, F.col("_new")).otherwise(F.col("text"))}).drop("_new")


def changed_sources(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose size or digest differs between two looks at them, or that came or went."""
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, ["package_id", "path"], "full_outer")
    return both.where(~(F.col("a.sha256").eqNullSafe(F.col("b.sha256")) & F.col("a.bytes").eqNullSafe(F.col("b.bytes")))).select("package_id", "path")


def places(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with place, their number in the order of keys over the whole table.

    Ranges of the keys are ranked by themselves; the counts of the ranges before give the rest, so no key is hot as long as
    all keys together tell rows apart.
    """
    ranged = materialize(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # one row for each range
    offsets = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*keys))
    return ranged.join(F.broadcast(offsets), "_range").withColumn("place", (own + F.col("_before")).cast("long")).drop("_range", "_before")
