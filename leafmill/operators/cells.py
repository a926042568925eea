"""Spreadsheet cells: lookups, ranges, aggregates, headers, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a bucket of the range joins.
ROWS = 64


def with_style(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """Cells with the columns of their style (Catalyst broadcasts the dimension where it is small)."""
    return cells.join(styles, "style_id", "left")


def range_join(cells: DataFrame, ranges: DataFrame, sheet: str = "sheet_id") -> DataFrame:
    """(cell, range) where the cell's row and column lie in the range; joined by sheet and bucket of rows.

    ranges: sheet, top, left, bottom, right_, and any other columns.
    """
    by_row = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("top") / ROWS), F.floor(F.col("bottom") / ROWS))))
    own = cells.withColumn("_b", F.floor(F.col("row_no") / ROWS))
    return own.join(by_row, [sheet, "_b"]).where("row_no between top and bottom and col_no between left_ and right_").drop("_b")


def declared_table(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells with the first declared table that contains them."""
    hit = range_join(cells, tables).groupBy("sheet_id", "row_no", "col_no").agg(F.min_by("table_name", "declared").alias("table_name"))
    return cells.join(hit, ["sheet_id", "row_no", "col_no"], "left")


def merge_origins(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the extent of the merged range that starts at them."""
    m = merges.select("sheet_id", F.col("top").alias("row_no"), F.col("left_").alias("col_no"), F.col("bottom").alias("merged_to_row"), F.col("right_").alias("merged_to_col"))
    return cells.join(m, ["sheet_id", "row_no", "col_no"], "left")


def formula_areas(cells: DataFrame) -> DataFrame:
    """Areas that formulas read, as ranges; formulas without a readable reference have null bounds."""
    from ..functions.a1 import column_of, row_of

    refs = F.regexp_extract_all("formula", F.lit(r"\$?([A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?)"), 1)
    own = cells.where("formula is not null").withColumn("ref", F.explode_outer(F.when(~F.col("formula").rlike(r"[\[\]]|INDIRECT"), refs)))
    a, b = F.regexp_replace(F.substring_index("ref", ":", 1), r"\$", ""), F.regexp_replace(F.substring_index("ref", ":", -1), r"\$", "")
    return own.select(
        "sheet_id", F.col("row_no").alias("f_row"), F.col("col_no").alias("f_col"), "ref",
        F.least(row_of(a), row_of(b)).alias("top"), F.least(column_of(a), column_of(b)).alias("left_"), F.greatest(row_of(a), row_of(b)).alias("bottom"), F.greatest(column_of(a), column_of(b)).alias("right_"),
    )


def readers(cells: DataFrame, edits: DataFrame, first: int = 5) -> DataFrame:
    """Formulas that directly read an edited cell, or might (no readable reference); how many by sheet, and the first few."""
    areas = formula_areas(cells)
    sure = range_join(edits.select("sheet_id", "row_no", "col_no"), areas.where("top is not null")).select("sheet_id", "f_row", "f_col")
    unsure = areas.where("top is null").join(edits.select("sheet_id").distinct(), "sheet_id", "left_semi").select("sheet_id", "f_row", "f_col")
    found = sure.unionByName(unsure).distinct()
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("f_row", "f_col"))), 1, first), lambda x: F.concat(x["f_row"].cast("string"), F.lit(":"), x["f_col"].cast("string")))
    return found.groupBy("sheet_id").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("first"))


def series_points(cells: DataFrame, series: DataFrame) -> DataFrame:
    """Points of chart series: the cell's value, else the cached one."""
    want = series.select("series_id", "sheet_id", "col_no", "cached", F.explode(F.sequence("top", "bottom")).alias("row_no"))
    values = cells.select("sheet_id", "row_no", "col_no", "value")
    return want.join(values, ["sheet_id", "row_no", "col_no"], "left").select("series_id", "row_no", F.coalesce("value", F.col("cached")).alias("value"))


def numeric(value: Column) -> Column:
    """The number a cell's text is, null if it is none."""
    return F.when(value.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), value.cast("double"))


def spreadsheet_aggregates(cells: DataFrame, *by: str) -> DataFrame:
    """SUM, AVERAGE, MIN, MAX, COUNT, COUNTA and COUNTBLANK of a range: text is skipped, an empty AVERAGE is an error, an empty MIN or MAX zero."""
    n = numeric(F.col("value"))
    count = F.count(n)
    return cells.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0.0)).alias("sum"), F.when(count > 0, F.round(F.avg(n), 6)).alias("average"), F.when(count == 0, "#DIV/0!").alias("error"),
        F.coalesce(F.min(n), F.lit(0.0)).alias("min"), F.coalesce(F.max(n), F.lit(0.0)).alias("max"), count.alias("count"),
        F.count("value").alias("counta"), F.count_if(F.coalesce("value", F.lit("")) == "").alias("countblank"),
    )


def criterion(text: str, value: Column) -> Column:
    """A spreadsheet criterion (operator, number, or text with * ? ~) as a predicate."""
    import re

    op, operand = re.match(r"(<=|>=|<>|=|<|>)?(.*)", text, re.S).groups()
    op = op or "="
    if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)\s*", operand):
        n, want = numeric(value), float(operand)
        test = {"=": n == want, "<>": n != want, "<": n < want, ">": n > want, "<=": n <= want, ">=": n >= want}[op]
        return F.coalesce(test, F.lit(op == "<>"))
    if operand == "":
        blank = F.coalesce(value, F.lit("")) == ""
        return ~blank if op == "<>" else blank
    if op in ("=", "<>"):
        pattern, i = "", 0
        while i < len(operand):
            c = operand[i]
            if c == "~" and i + 1 < len(operand):
                i += 1
                c = re.escape(operand[i])
            else:
                c = {"*": ".*", "?": "."}.get(c) or re.escape(c)
            pattern, i = pattern + c, i + 1
        hit = F.coalesce(value, F.lit("")).rlike(f"(?is)^{pattern}$")
        return ~hit if op == "<>" else hit & value.isNotNull()
    low, want = F.lower(value), operand.lower()
    test = {"<": low < want, ">": low > want, "<=": low <= want, ">=": low >= want}[op]
    return F.coalesce(test & numeric(value).isNull(), F.lit(False))


def count_if(value: Column, text: str) -> Column:
    return F.count_if(criterion(text, value))


def sum_if(value: Column, text: str, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(criterion(text, value), amount)), F.lit(0).cast("long"))


def used_range(cells: DataFrame) -> DataFrame:
    filled = cells.where("coalesce(value, '') <> '' or coalesce(formula, '') <> ''")
    return filled.groupBy("sheet_id").agg(F.min("row_no").alias("top"), F.min("col_no").alias("left_"), F.max("row_no").alias("bottom"), F.max("col_no").alias("right_"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Columns with at least one number whose other filled cells are numbers or a bare dash."""
    v = F.trim(F.coalesce("value", F.lit("")))
    number, dash = v.rlike(r"^[-+]?[\d,]+(\.\d+)?%?$"), v.isin("-", "–", "—")
    return cells.groupBy("sheet_id", "col_no").agg((F.bool_and((v == "") | number | dash) & (F.count_if(number) > 0)).alias("is_numeric"))


def header_rows(cells: DataFrame, words: list[str]) -> DataFrame:
    """Rows that read as headers: half their filled cells header-styled, or at least max(2, half) header words."""
    filled = cells.where("coalesce(value, '') <> ''")
    n, styled, hits = F.count("*"), F.count_if(F.col("style_id") == 0), F.count_if(F.lower("value").isin(words))
    return filled.groupBy("sheet_id", "row_no").agg(((styled * 2 >= n) | (hits >= F.greatest(F.lit(2), F.ceil(n / 2)))).alias("is_header"))


def key_values(cells: DataFrame) -> DataFrame:
    """Rows of exactly a label and a value side by side."""
    filled = cells.where("coalesce(value, '') <> ''")
    row = filled.groupBy("sheet_id", "row_no").agg(F.count("*").alias("n"), F.min_by("value", "col_no").alias("key"), F.max_by("value", "col_no").alias("val"), F.min("col_no").alias("a"), F.max("col_no").alias("b"))
    return row.where((F.col("n") == 2) & (F.col("b") == F.col("a") + 1) & numeric(F.col("key")).isNull()).select("sheet_id", "row_no", "key", "val")


def data_start(cells: DataFrame) -> DataFrame:
    """First of two adjacent rows (from the third to the sixteenth) that both hold numbers."""
    rows = cells.groupBy("sheet_id", "row_no").agg(F.bool_or(numeric(F.col("value")).isNotNull()).alias("number"))
    after = F.lead("number").over(W.partitionBy("sheet_id").orderBy("row_no"))
    return rows.withColumn("pair", F.col("number") & F.coalesce(after, F.lit(False))).where("pair and row_no between 3 and 16").groupBy("sheet_id").agg(F.min("row_no").alias("data_row"))


def center_across(cells: DataFrame) -> DataFrame:
    """A filled cell's span over the blank cells of its style that follow it in its row."""
    blank = F.coalesce("value", F.lit("")) == ""
    order = W.partitionBy("sheet_id", "row_no").orderBy("col_no")
    start = ~blank | (F.col("style_id") != F.coalesce(F.lag("style_id").over(order), F.lit(-1))) | (F.col("col_no") != F.coalesce(F.lag("col_no").over(order), F.lit(-9)) + 1)
    island = cells.withColumn("_g", F.sum(start.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = island.groupBy("sheet_id", "row_no", "_g").agg(F.min("col_no").alias("col_no"), F.max("col_no").alias("last_col"), F.min_by("value", "col_no").alias("value"))
    return out.where("coalesce(value, '') <> '' and last_col > col_no").select("sheet_id", "row_no", "col_no", "last_col")


def regions(cells: DataFrame, gap: int = 2) -> DataFrame:
    """Runs of filled columns in a sheet, split where `gap` blank columns lie between."""
    columns = cells.where("coalesce(value, '') <> ''").select("sheet_id", "col_no").distinct()
    order = W.partitionBy("sheet_id").orderBy("col_no")
    new = (F.col("col_no") - F.lag("col_no").over(order)) > gap
    island = columns.withColumn("region", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("sheet_id", "region").agg(F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"), F.count("*").alias("n_cols"))


def markdown_rows(cells: DataFrame) -> DataFrame:
    """Rows of a sheet as Markdown table lines; columns without any value are dropped."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("value", F.lit("")), r"\|", r"\\|"), "\n", "<br>")
    used = cells.where("coalesce(value, '') <> ''").select("sheet_id", "col_no").distinct()
    kept = cells.join(used, ["sheet_id", "col_no"], "left_semi")
    row = kept.groupBy("sheet_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", text.alias("t")))).alias("x"))
    return row.select("sheet_id", "row_no", F.concat(F.lit("| "), F.array_join(F.transform("x", lambda i: i["t"]), " | "), F.lit(" |")).alias("line"))


def empty_columns(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet_id", "col_no").agg(F.bool_and(F.coalesce("value", F.lit("")) == "").alias("empty")).where("empty").select("sheet_id", "col_no")


def span_grid(table: DataFrame) -> DataFrame:
    """Slots that cells with spans cover: origin cell of each, and whether it continues it."""
    rows, columns = F.explode(F.sequence(F.col("row_no"), F.col("row_no") + F.col("row_span") - 1)), F.explode(F.sequence(F.col("col_no"), F.col("col_no") + F.col("col_span") - 1))
    step = table.where("row_span > 0 and col_span > 0").select("*", rows.alias("slot_row")).select("*", columns.alias("slot_col"))
    continues = (F.col("slot_row") != F.col("row_no")) | (F.col("slot_col") != F.col("col_no"))
    return step.select("sheet_id", "slot_row", "slot_col", F.col("row_no").alias("origin_row"), F.col("col_no").alias("origin_col"), continues.alias("is_continuation"))


def span_problems(table: DataFrame, n_rows: int) -> DataFrame:
    """Bad spans, overlapping slots and spans beyond the last row."""
    bad = table.where("row_span < 1 or col_span < 1").select("sheet_id", "row_no", "col_no", F.lit("bad_span").alias("problem"))
    beyond = table.where(F.col("row_no") + F.col("row_span") - 1 > n_rows).select("sheet_id", "row_no", "col_no", F.lit("beyond_last_row").alias("problem"))
    grid = span_grid(table)
    twice = grid.groupBy("sheet_id", "slot_row", "slot_col").count().where("count > 1").select("sheet_id", F.col("slot_row").alias("row_no"), F.col("slot_col").alias("col_no"), F.lit("overlap").alias("problem"))
    return bad.unionByName(beyond).unionByName(twice)


def row_blocks(rows: DataFrame, target: int) -> DataFrame:
    """Block number of each row of a sheet: a block closes when the next row would take it over target characters."""
    item = F.struct("row_no", F.length("line").alias("size"))
    zero = F.struct(F.lit(0).alias("no"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("nos"))

    def fold(acc, x):
        new = (acc["size"] > 0) & (acc["size"] + x["size"] + 1 > target)
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(no.alias("no"), F.when(new, x["size"] + 1).otherwise(acc["size"] + x["size"] + 1).alias("size"), F.array_append(acc["nos"], no).alias("nos"))

    packed = rows.groupBy("sheet_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = packed.select("sheet_id", F.inline(F.arrays_zip(F.col("items").alias("x"), F.aggregate("items", zero, fold)["nos"].alias("block"))))
    return out.select("sheet_id", F.col("x.row_no").alias("row_no"), "block")


def period_sequence(points: DataFrame) -> DataFrame:
    """Series whose ordinals keep one step other than zero."""
    step = F.lead("ordinal").over(W.partitionBy("series_id").orderBy("pos")) - F.col("ordinal")
    return points.withColumn("step", step).groupBy("series_id").agg(((F.count_distinct("step") == 1) & (F.max("step") != 0)).alias("is_sequence"), F.max("step").alias("step"))


def chart_trend(points: DataFrame) -> DataFrame:
    """First, last, lowest and highest value of a series, and its direction."""
    out = points.where("value is not null").groupBy("series_id").agg(
        F.min_by("value", "pos").alias("first"), F.max_by("value", "pos").alias("last"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")
    ).where("n >= 2")
    return out.withColumn("direction", F.when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat"))


def pie_shares(points: DataFrame) -> DataFrame:
    """Largest and smallest slice; shares only where no value is negative and the sum is positive."""
    total, low = F.sum("value"), F.min("value")
    share = lambda v: F.when((low >= 0) & (total > 0), F.round(v / total, 6))
    return points.groupBy("series_id").agg(
        F.min_by("category", F.struct(-F.col("value"), F.col("category"))).alias("largest"), F.min_by("category", F.struct("value", "category")).alias("smallest"),
        share(F.max("value")).alias("largest_share"), share(F.min("value")).alias("smallest_share"),
    )


def chart_number(text: Column) -> Column:
    """A number as charts show it: parentheses are negative, % divides, currency signs and commas go."""
    plain = F.regexp_replace(text, r"[\s,$€£¥()%]", "")
    n = F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), plain.cast("double"))
    n = F.when(text.rlike(r"^\s*\(.*\)\s*$"), -n).otherwise(n)
    return F.when(text.contains("%"), n / 100).otherwise(n)
