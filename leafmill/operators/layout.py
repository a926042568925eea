"""Page layout: body size, furniture, bands, lists, reading order, spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# Weights of a connection's distance, ray, angle and corridor, and what a node in between costs.
WEIGHTS, BLOCKED = (0.45, 0.20, 0.15, 0.10), 0.6


def middle(values: Column) -> Column:
    """Element n // 2 of the sorted values: a median that is one of them."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def body_size(fragments: DataFrame, long: int = 20, least: int = 3) -> DataFrame:
    """Font size of a document's long lines, if there are enough of them."""
    lines = fragments.where(F.length("text") >= long)
    return lines.groupBy("doc_id").agg(F.when(F.count("*") >= least, middle(F.collect_list("font_size"))).alias("body_size"), F.count("*").alias("n_lines"))


def body_family(fragments: DataFrame) -> DataFrame:
    """The font family of more than half the characters."""
    by = fragments.groupBy("doc_id", "font_family").agg(F.sum(F.length("text")).alias("chars"))
    return by.groupBy("doc_id").agg(F.max_by("font_family", F.struct("chars", "font_family")).alias("family"), F.max("chars").alias("most"), F.sum("chars").alias("total")).select(
        "doc_id", F.when(F.col("most") * 2 > F.col("total"), F.col("family")).alias("family")
    )


def masked(text: Column) -> Column:
    """Text with every run of digits as one mark, without case or double spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[0-9]+", "#"), r"\s+", " ")


def repeated_furniture(fragments: DataFrame) -> DataFrame:
    """Texts (digits masked) at the top or bottom that at least half the pages repeat."""
    place = F.when(F.col("y") < 60, "top").when(F.col("y") > 340, "bottom")
    pages = fragments.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = fragments.withColumn("place", place).where("place is not null").groupBy("doc_id", "place", masked(F.col("text")).alias("key")).agg(F.count_distinct("page").alias("n"))
    return seen.join(pages, "doc_id").where((F.col("n") >= F.ceil(F.col("pages") / 2)) & (F.col("n") >= 2)).select("doc_id", "place", "key", "n")


def running_forms(fragments: DataFrame) -> DataFrame:
    """Numbered running texts as their first and last form; a bare page number is dropped."""
    key = masked(F.col("text"))
    out = fragments.groupBy("doc_id", key.alias("key")).agg(F.count_distinct("page").alias("n"), F.min_by("text", F.struct("page", "frag_id")).alias("first"), F.max_by("text", F.struct("page", "frag_id")).alias("last"))
    return out.where("n > 1 and instr(key, '#') > 0 and key <> '#'")


def heading_level(fragments: DataFrame) -> DataFrame:
    """Heading level of lines by size against the body's (1.6 and 1.2 times), or bold and short."""
    size = F.col("font_size") / F.col("body_size")
    level = F.when(size >= 1.6, 1).when(size >= 1.2, 2).when(F.col("bold") & (F.length("text") <= 40), 3)
    return fragments.join(body_size(fragments).select("doc_id", "body_size"), "doc_id", "left").withColumn("level", level)


def bands(fragments: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Rows of a page: a new band where the gap to the fragment above exceeds tolerance of the middle height."""
    page = W.partitionBy("doc_id", "page")
    order = page.orderBy("y", "x", "frag_id")
    step = fragments.withColumn("_h", middle(F.collect_list("h").over(page)))
    new = (F.col("y") - F.lag("y").over(order)) > F.col("_h") * tolerance
    return step.withColumn("band", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_h")


def reading_order(fragments: DataFrame) -> DataFrame:
    """Place of each fragment: bands from the top, then from the left."""
    return bands(fragments).withColumn("place", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("band", "x", "frag_id")))


def line_runs(fragments: DataFrame, gap: float = 1.5) -> DataFrame:
    """Fragments of a band joined to runs; a gap over `gap` heights starts a new one."""
    order = W.partitionBy("doc_id", "page", "band").orderBy("x", "frag_id")
    wide = (F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)) > F.col("h") * gap
    step = bands(fragments).withColumn("run", F.sum(F.coalesce(wide, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = step.groupBy("doc_id", "page", "band", "run").agg(F.array_sort(F.collect_list(F.struct("x", "frag_id", "text"))).alias("f"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("x2"))
    return rows.select("doc_id", "page", "band", "run", "x", "x2", F.array_join(F.transform("f", lambda i: i["text"]), " ").alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines joined to paragraphs: one goes on while the line before ends no sentence, has its size, and this one starts no list or indent."""
    order = W.partitionBy("doc_id").orderBy("page", "line")
    before = lambda c: F.lag(c).over(order)
    goes_on = ~F.coalesce(before("text").rlike(r"[.!?。:]\s*$"), F.lit(True)) & (before("font_size") == F.col("font_size")) & ~F.col("text").rlike(r"^\s*(\d+[.)]|[-•*])\s") & (F.col("x") <= before("x") + 10)
    step = lines.withColumn("para", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = step.groupBy("doc_id", "para").agg(F.array_sort(F.collect_list(F.struct("page", "line", "text"))).alias("f"))
    return rows.select("doc_id", "para", F.size("f").alias("n_lines"), F.array_join(F.transform("f", lambda i: i["text"]), " ").alias("text"))


def list_runs(lines: DataFrame) -> DataFrame:
    """Runs of lines that start with a list mark."""
    mark = F.col("text").rlike(r"^\s*(\d+[.)]|[-•*])\s")
    order = W.partitionBy("doc_id", "page").orderBy("line")
    step = lines.withColumns({"item": mark, "_n": F.row_number().over(order)})
    own = step.where("item").withColumn("run", F.col("_n") - F.row_number().over(order))
    return own.groupBy("doc_id", "page", "run").agg(F.min("line").alias("first_line"), F.count("*").alias("n_items"))


def list_levels(items: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Nesting of list items by a stack of indents: deeper than the top opens a level, shallower closes to the nearest."""
    zero = F.struct(F.array().cast("array<double>").alias("stack"), F.array().cast("array<int>").alias("levels"))

    def fold(acc, i):
        kept = F.filter(acc["stack"], lambda x: x <= i["x"] + tolerance)
        near = F.exists(kept, lambda x: F.abs(x - i["x"]) <= tolerance)
        stack = F.when(near, kept).otherwise(F.array_append(kept, i["x"]))
        return F.struct(stack.alias("stack"), F.array_append(acc["levels"], F.size(stack)).alias("levels"))

    rows = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "x"))).alias("items"))
    out = rows.select("doc_id", "page", F.inline(F.arrays_zip(F.col("items").alias("i"), F.aggregate("items", zero, fold)["levels"].alias("level"))))
    return out.select("doc_id", "page", F.col("i.line").alias("line"), "level")


def nearest_shapes(connectors: DataFrame, shapes: DataFrame, cell: float = 100.0, radius: float = 100.0, top: int = 4) -> DataFrame:
    """For each connector's start the nearest shapes within radius: shapes are dealt to the grid cells they may be near."""
    dealt = shapes.select("canvas_id", "shape_id", "x", "y", "w", "h", F.explode(F.sequence(F.floor((F.col("x") - radius) / cell), F.floor((F.col("x") + F.col("w") + radius) / cell))).alias("gx"), F.sequence(F.floor((F.col("y") - radius) / cell), F.floor((F.col("y") + F.col("h") + radius) / cell)).alias("_gy"))
    dealt = dealt.withColumn("gy", F.explode("_gy")).drop("_gy")
    ends = connectors.select("canvas_id", "connector_id", "x1", "y1", F.floor(F.col("x1") / cell).alias("gx"), F.floor(F.col("y1") / cell).alias("gy"))
    both = ends.join(dealt, ["canvas_id", "gx", "gy"])
    dx = F.greatest(F.col("x") - F.col("x1"), F.col("x1") - F.col("x") - F.col("w"), F.lit(0.0))
    dy = F.greatest(F.col("y") - F.col("y1"), F.col("y1") - F.col("y") - F.col("h"), F.lit(0.0))
    near = both.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius)
    rank = F.row_number().over(W.partitionBy("canvas_id", "connector_id").orderBy("d2", "shape_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("canvas_id", "connector_id", "shape_id", "rank", F.round(F.sqrt("d2"), 6).alias("distance"))


def touching(shapes: DataFrame, margin: float = 10.0, cell: float = 60.0) -> DataFrame:
    """Pairs of shapes whose boxes, widened by margin, overlap; by shared grid cells."""
    box = shapes.select("canvas_id", "shape_id", (F.col("x") - margin).alias("l"), (F.col("y") - margin).alias("t"), (F.col("x") + F.col("w") + margin).alias("r"), (F.col("y") + F.col("h") + margin).alias("b"))
    dealt = box.withColumn("gx", F.explode(F.sequence(F.floor(F.col("l") / cell), F.floor(F.col("r") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("t") / cell), F.floor(F.col("b") / cell))))
    a, b = dealt.alias("a"), dealt.alias("b")
    hit = a.join(b, (F.col("a.canvas_id") == F.col("b.canvas_id")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.shape_id") < F.col("b.shape_id")))
    hit = hit.where("a.l <= b.r and b.l <= a.r and a.t <= b.b and b.t <= a.b")
    return hit.select("a.canvas_id", F.col("a.shape_id").alias("a"), F.col("b.shape_id").alias("b")).distinct()


def clusters(shapes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Smallest shape id that a shape's touching pairs lead to; canvases are small, so each is closed by itself."""

    def close(pdf):
        import pandas as pd

        ids = pdf.loc[pdf["b"].isna(), "a"].astype(int).tolist()
        parent = {i: i for i in ids}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pdf.dropna(subset=["b"])[["a", "b"]].astype(int).itertuples(index=False):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        return pd.DataFrame({"canvas_id": pdf["canvas_id"].iloc[0], "shape_id": ids, "cluster": [root(i) for i in ids]})

    rows = shapes.select("canvas_id", F.col("shape_id").cast("double").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(pairs.select("canvas_id", F.col("a").cast("double"), F.col("b").cast("double")))
    return rows.groupBy("canvas_id").applyInPandas(close, "canvas_id long, shape_id int, cluster int")


def scale(shapes: DataFrame) -> DataFrame:
    """Middle of the shapes' smaller sides on each canvas, and the search radius that follows from it and the diagonal."""
    diagonal = F.sqrt(F.pow(F.max(F.col("x") + F.col("w")) - F.min("x"), 2) + F.pow(F.max(F.col("y") + F.col("h")) - F.min("y"), 2))
    out = shapes.groupBy("canvas_id").agg(middle(F.collect_list(F.least("w", "h"))).alias("minor"), diagonal.alias("diagonal"))
    clamp = lambda k, lo, hi: F.round(F.least(F.greatest(F.col("minor") * k, F.col("diagonal") * lo), F.col("diagonal") * hi), 6)
    return out.select("canvas_id", "minor", F.round("diagonal", 6).alias("diagonal"), clamp(0.45, 0.01, 0.06).alias("safe_radius"), clamp(0.80, 0.015, 0.10).alias("balanced_radius"))


def owned_fragments(fragments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Fragments whose middle lies in exactly one box of their page."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    both = fragments.join(boxes, ["doc_id", "page"]).where((cx >= F.col("left_")) & (cx < F.col("right_")) & (cy >= F.col("top")) & (cy < F.col("bottom")))
    n = F.count("*").over(W.partitionBy("doc_id", "page", "frag_id"))
    return both.withColumn("_n", n).where("_n = 1").select("doc_id", "page", "frag_id", "box_id")


def overlap_columns(shapes: DataFrame, columns: DataFrame, share: float = 0.5) -> DataFrame:
    """First and last column that a shape covers by at least share of the column's width."""
    both = shapes.join(columns, "canvas_id")
    overlap = F.least(F.col("x") + F.col("w"), F.col("x2")) - F.greatest("x", "x1")
    hit = both.where(overlap >= (F.col("x2") - F.col("x1")) * share)
    return hit.groupBy("canvas_id", "shape_id").agg(F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def connection_score(distance_: Column, ray: Column, angle: Column, corridor: Column, blocked: Column) -> Column:
    """Weighted mean of the parts (each 0 to 1), less BLOCKED if a node lies between."""
    total = sum((part * weight for part, weight in zip((distance_, ray, angle, corridor), WEIGHTS)), F.lit(0.0)) / sum(WEIGHTS)
    return total - F.when(blocked, BLOCKED).otherwise(0.0)


def confidence_class(score: Column, margin: Column) -> Column:
    return F.when((score >= 0.75) & (margin >= 0.15), "High").when((score >= 0.5) & (margin >= 0.05), "Medium").otherwise("Low")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words joined to lines; no space between confident East Asian words close to each other."""
    order = W.partitionBy("page", "line").orderBy("word")
    cjk = lambda c: c.rlike(r"[぀-ヿ㐀-鿿]")
    gap = F.col("left_") - F.lag(F.col("left_") + F.col("width")).over(order)
    tight = cjk(F.col("text")) & cjk(F.lag("text").over(order)) & (F.least("confidence", F.lag("confidence").over(order)) >= 0.6) & (gap <= F.col("height") * 0.5)
    piece = F.when(F.row_number().over(order) == 1, F.col("text")).when(F.coalesce(tight, F.lit(False)), F.col("text")).otherwise(F.concat(F.lit(" "), "text"))
    step = words.withColumn("piece", piece)
    rows = step.groupBy("page", "line").agg(F.array_sort(F.collect_list(F.struct("word", "piece"))).alias("p"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return rows.select("page", "line", F.array_join(F.transform("p", lambda i: i["piece"]), "").alias("text"), "n", "confidence")


def dash_runs(strokes: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Short strokes on one line with even gaps, joined to a dashed line (three at least)."""
    order = W.partitionBy("canvas_id", "fixed").orderBy("lo")
    gap = F.col("lo") - F.lag("hi").over(order)
    step = strokes.withColumn("gap", gap)
    new = F.abs(F.col("gap") - F.lag("gap").over(order)) > tolerance
    first = F.col("gap").isNull() | (F.col("gap") > 12) | (F.col("gap") < 0)
    step = step.withColumn("run", F.sum((first | F.coalesce(new & F.lag("gap").over(order).between(0, 12), F.lit(False))).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return step.groupBy("canvas_id", "fixed", "run").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n >= 3")


def scripts(fragments: DataFrame) -> DataFrame:
    """Fragments raised or lowered beside a larger one: superscript or subscript."""
    order = W.partitionBy("doc_id", "page", "band").orderBy("x", "frag_id")
    size, base = F.lag("font_size").over(order), F.lag(F.col("y") + F.col("h")).over(order)
    small = (F.col("font_size") <= size * 0.75) & (F.col("x") - F.lag(F.col("x") + F.col("w")).over(order) <= size * 0.3)
    shift = (base - F.col("y") - F.col("h")) / size
    return fragments.withColumn("script", F.when(small & (shift > 0.1), "super").when(small & (shift < -0.1), "sub"))


def separators(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Horizontal rules that no vertical line of their page meets: they part blocks and belong to no table grid."""
    h = lines.where("horizontal").select("doc_id", "page", "line_id", F.col("fixed").alias("_y"), F.col("lo").alias("_a"), F.col("hi").alias("_b"))
    v = lines.where("not horizontal").select("doc_id", "page", "fixed", "lo", "hi")
    meets = (v["doc_id"] == h["doc_id"]) & (v["page"] == h["page"]) & v["fixed"].between(h["_a"] - tolerance, h["_b"] + tolerance) & h["_y"].between(v["lo"] - tolerance, v["hi"] + tolerance)
    return h.join(v.alias("v"), meets, "left_anti").select("doc_id", "page", "line_id")


def marked_up(fragments: DataFrame, annotations: DataFrame, share: float = 0.5) -> DataFrame:
    """Fragments under an annotation's box by at least share of their width, with its kind."""
    both = fragments.join(annotations, ["doc_id", "page"])
    wide = F.least("x2", F.col("x") + F.col("w")) - F.greatest("x1", F.col("x"))
    tall = F.least("y2", F.col("y") + F.col("h")) - F.greatest("y1", F.col("y"))
    hit = both.where((wide >= F.col("w") * share) & (tall > 0))
    return hit.groupBy("doc_id", "page", "frag_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def decoded_codes(codes: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Text of code sequences (text_id, pos, font, code) by their fonts' glyph maps; codes without one count as Latin-1."""
    both = codes.join(glyphs, ["font", "code"], "left")
    piece = F.coalesce("char", F.chr(F.col("code").cast("long")))
    rows = both.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("c")))).alias("x"))
    return rows.select("text_id", F.array_join(F.transform("x", lambda i: i["c"]), "").alias("text"))


def measured(codes: DataFrame, widths: DataFrame, missing: int = 500) -> DataFrame:
    """Width of code sequences at their size, from glyph widths in thousandths."""
    both = codes.join(widths, ["font", "code"], "left")
    return both.groupBy("text_id").agg(F.round(F.sum(F.coalesce("width", F.lit(missing)) * F.col("size")) / 1000, 6).alias("width"))


def page_blocks(regions: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Text, tables and images of a page as one ordered list (each has doc_id, page, y, x, ref)."""
    parts = [d.select("doc_id", "page", "y", "x", "ref", F.lit(k).alias("kind")) for d, k in ((regions, "text"), (tables, "table"), (images, "image"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("y", "x", "kind", "ref")))
