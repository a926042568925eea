"""Queries over spreadsheet cells and chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as ops
from .registry import query

#: Ranges of every sheet, as (top, left, bottom, right, name, declared).
_TABLES = ((2, 1, 5, 3, "first", 1), (4, 2, 9, 6, "second", 2))
_VALUES = ", ".join(f"({t}, {a}, {b}, {r}, '{n}', {d})" for t, a, b, r, n, d in _TABLES)
_NUM = r"CASE WHEN regexp_matches(value, '^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$') THEN CAST(trim(value) AS DOUBLE) END"


def _tables(cells):
    t = cells.sparkSession.createDataFrame(_TABLES, "top int, left_ int, bottom int, right_ int, table_name string, declared int")
    # every sheet declares the same ranges: a few rows for each sheet id
    per_sheet = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, t.columns)]) for r in _TABLES])
    return cells.select("sheet_id").distinct().select("sheet_id", F.inline(per_sheet))


@query("j5_cell_styles", "cells", "nation", sql="SELECT sheet_id, row_no, col_no, n_name AS style_name FROM cells LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 5) ON style_id = n_nationkey")
def _(cells, nation):
    styles = nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("style_id"), F.col("n_name").alias("style_name"))
    return ops.with_style(cells, styles).select("sheet_id", "row_no", "col_no", "style_name")


@query("j6_e16_declared_tables", "cells", sql=f"""
SELECT sheet_id, row_no, col_no, (SELECT min_by(n, d) FROM (VALUES {_VALUES}) AS t(a, b, c, e, n, d) WHERE row_no BETWEEN a AND c AND col_no BETWEEN b AND e) AS table_name FROM cells
""")
def _(cells):
    return ops.declared_table(cells, _tables(cells)).select("sheet_id", "row_no", "col_no", "table_name")


@query("e15_merge_origins", "cells", sql=f"""
SELECT sheet_id, row_no, col_no, c AS merged_to_row, e AS merged_to_col FROM cells LEFT JOIN (VALUES {_VALUES}) AS t(a, b, c, e, n, d) ON row_no = a AND col_no = b
""")
def _(cells):
    return ops.merge_origins(cells, _tables(cells)).select("sheet_id", "row_no", "col_no", "merged_to_row", "merged_to_col")


_AREAS = r"""a AS (SELECT sheet_id, row_no AS f_row, col_no AS f_col, formula, CASE WHEN regexp_matches(formula, '[\[\]]|INDIRECT') THEN NULL ELSE regexp_extract(formula, '([A-Z]+)([0-9]+):([A-Z]+)([0-9]+)', ['a', 'b', 'c', 'd']) END AS m FROM cells WHERE formula IS NOT NULL),
r AS (SELECT sheet_id, f_row, f_col, CAST(m.b AS INT) AS x, CAST(m.d AS INT) AS y, ascii(m.a) - 64 AS u, ascii(m.c) - 64 AS v FROM a)"""


@query("j7_formula_references", "cells", sql=f"""
WITH {_AREAS} SELECT r.sheet_id, f_row, f_col, count(*) AS n_cells, count(c.value) AS n_filled FROM r JOIN cells c ON c.sheet_id = r.sheet_id AND c.row_no BETWEEN least(x, y) AND greatest(x, y) AND c.col_no BETWEEN least(u, v) AND greatest(u, v) GROUP BY ALL
""")
def _(cells):
    hit = ops.range_join(cells, ops.formula_areas(cells).where("top is not null"))
    return hit.groupBy("sheet_id", "f_row", "f_col").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_filled"))


@query("e18_formula_readers", "cells", sql=f"""
WITH {_AREAS}, e AS (SELECT sheet_id, row_no, col_no FROM cells WHERE amount % 10 = 0),
h AS (SELECT DISTINCT r.sheet_id, f_row, f_col FROM r JOIN e ON e.sheet_id = r.sheet_id AND (x IS NULL OR (e.row_no BETWEEN least(x, y) AND greatest(x, y) AND e.col_no BETWEEN least(u, v) AND greatest(u, v))))
SELECT sheet_id, count(*) AS n, array_to_string((list(f_row || ':' || f_col ORDER BY f_row, f_col))[1:5], ',') AS first FROM h GROUP BY sheet_id
""")
def _(cells):
    return ops.readers(cells, cells.where("amount % 10 = 0"))


@query("j8_chart_series", "cells", sql="""
WITH s AS (SELECT DISTINCT sheet_id FROM cells), w AS (SELECT sheet_id * 10 + 3 AS series_id, sheet_id, 3 AS col_no, unnest(generate_series(2, 12)) AS row_no FROM s)
SELECT series_id, CAST(w.row_no AS INT) AS row_no, coalesce(value, 'cached') AS value FROM w LEFT JOIN cells c ON c.sheet_id = w.sheet_id AND c.row_no = w.row_no AND c.col_no = w.col_no
""")
def _(cells):
    series = cells.select("sheet_id").distinct().selectExpr("sheet_id * 10 + 3 series_id", "sheet_id", "3 col_no", "2 top", "12 bottom", "'cached' cached")
    return ops.series_points(cells, series)


@query("a8_spreadsheet_aggregates", "cells", sql=f"""
SELECT sheet_id, col_no, coalesce(sum(x), 0) AS sum, CASE WHEN count(x) > 0 THEN round(avg(x), 6) END AS average, CASE WHEN count(x) = 0 THEN '#DIV/0!' END AS error, coalesce(min(x), 0) AS min, coalesce(max(x), 0) AS max,
  count(x) AS count, count(value) AS counta, count(*) FILTER (WHERE coalesce(value, '') = '') AS countblank FROM (SELECT *, {_NUM} AS x FROM cells) GROUP BY sheet_id, col_no
""")
def _(cells):
    return ops.spreadsheet_aggregates(cells, "sheet_id", "col_no")


@query("a9_countif_sumif", "cells", sql=f"""
SELECT sheet_id, count(*) FILTER (WHERE x > 100000) AS over, count(*) FILTER (WHERE x IS NULL OR x <> 7) AS not_seven, count(*) FILTER (WHERE regexp_matches(value, '(?i)^.-.*e.*$')) AS wild, count(*) FILTER (WHERE coalesce(value, '') = '') AS blank,
  CAST(coalesce(sum(amount) FILTER (WHERE lower(value) = 'f'), 0) AS BIGINT) AS sum_f, CAST(coalesce(sum(amount) FILTER (WHERE x <= 500 AND col_no = 2), 0) AS BIGINT) AS sum_both
FROM (SELECT *, {_NUM} AS x FROM cells) GROUP BY sheet_id
""")
def _(cells):
    v, amount = F.col("value"), F.col("amount")
    both = F.coalesce(F.sum(F.when(ops.criterion("<=500", v) & ops.criterion("=2", F.col("col_no").cast("string")), amount)), F.lit(0).cast("long"))
    return cells.groupBy("sheet_id").agg(
        ops.count_if(v, ">100000").alias("over"), ops.count_if(v, "<>7").alias("not_seven"), ops.count_if(v, "?-*e*").alias("wild"), ops.count_if(v, "").alias("blank"),
        ops.sum_if(v, "F", amount).alias("sum_f"), both.alias("sum_both"),
    )


@query("a10_used_range", "cells", sql="SELECT sheet_id, min(row_no) AS top, min(col_no) AS left_, max(row_no) AS bottom, max(col_no) AS right_ FROM cells WHERE coalesce(value, '') <> '' OR coalesce(formula, '') <> '' GROUP BY sheet_id")
def _(cells):
    return ops.used_range(cells)


@query("a17_numeric_columns", "cells", sql=r"""
SELECT sheet_id, col_no, bool_and(v = '' OR regexp_matches(v, '^[-+]?[\d,]+(\.\d+)?%?$') OR v IN ('-', '–', '—')) AND count(*) FILTER (WHERE regexp_matches(v, '^[-+]?[\d,]+(\.\d+)?%?$')) > 0 AS is_numeric
FROM (SELECT *, trim(coalesce(value, '')) AS v FROM cells) GROUP BY sheet_id, col_no
""")
def _(cells):
    return ops.numeric_columns(cells)


@query("g4_header_rows", "cells", sql="""
SELECT sheet_id, row_no, count(*) FILTER (WHERE style_id = 0) * 2 >= count(*) OR count(*) FILTER (WHERE lower(value) IN ('f', 'o', 'p', '-')) >= greatest(2, ceil(count(*) / 2)) AS is_header
FROM cells WHERE coalesce(value, '') <> '' GROUP BY sheet_id, row_no
""")
def _(cells):
    return ops.header_rows(cells, ["f", "o", "p", "-"])


@query("g5_key_values", "cells", sql=f"""
WITH r AS (SELECT sheet_id, row_no, count(*) AS n, min_by(value, col_no) AS key, max_by(value, col_no) AS val, min(col_no) AS a, max(col_no) AS b FROM (SELECT sheet_id, row_no, col_no, CASE WHEN col_no IN (1, 2, 6) THEN value END AS value FROM cells) WHERE coalesce(value, '') <> '' GROUP BY sheet_id, row_no)
SELECT sheet_id, row_no, key, val FROM r WHERE n = 2 AND b = a + 1 AND ({_NUM.replace('value', 'key')}) IS NULL
""")
def _(cells):
    return ops.key_values(cells.withColumn("value", F.expr("case when col_no in (1, 2, 6) then value end")))


@query("g5_data_start", "cells", sql=f"""
WITH r AS (SELECT sheet_id, row_no, bool_or(({_NUM}) IS NOT NULL) AS number FROM (SELECT sheet_id, row_no, CASE WHEN amount % 3 = 0 THEN value ELSE 'x' END AS value FROM cells) GROUP BY sheet_id, row_no),
p AS (SELECT *, number AND coalesce(lead(number) OVER (PARTITION BY sheet_id ORDER BY row_no), false) AS pair FROM r)
SELECT sheet_id, min(row_no) AS data_row FROM p WHERE pair AND row_no BETWEEN 3 AND 16 GROUP BY sheet_id
""")
def _(cells):
    return ops.data_start(cells.withColumn("value", F.expr("case when amount % 3 = 0 then value else 'x' end")))


@query("e14_center_across", "cells", sql="""
WITH m AS (SELECT *, coalesce(value, '') = '' AS blank, style_id % 2 AS st, lag(style_id % 2) OVER w AS ps, lag(col_no) OVER w AS pc FROM cells WINDOW w AS (PARTITION BY sheet_id, row_no ORDER BY col_no)),
g AS (SELECT *, sum(CASE WHEN NOT blank OR st <> coalesce(ps, -1) OR col_no <> coalesce(pc, -9) + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id, row_no ORDER BY col_no ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT sheet_id, row_no, min(col_no) AS col_no, max(col_no) AS last_col FROM g GROUP BY sheet_id, row_no, g HAVING coalesce(min_by(value, col_no), '') <> '' AND bool_or(NOT blank) AND max(col_no) > min(col_no)
""")
def _(cells):
    return ops.center_across(cells.withColumn("style_id", F.col("style_id") % 2))


@query("w6_table_regions", "cells", sql="""
WITH c AS (SELECT DISTINCT sheet_id, row_no * 3 + col_no * (row_no % 4) AS col_no FROM (SELECT sheet_id, row_no, col_no, CASE WHEN amount % 9 = 0 THEN value END AS value FROM cells) WHERE coalesce(value, '') <> ''),
g AS (SELECT *, sum(CASE WHEN col_no - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY sheet_id ORDER BY col_no ROWS UNBOUNDED PRECEDING) AS region FROM (SELECT *, lag(col_no) OVER (PARTITION BY sheet_id ORDER BY col_no) AS p FROM c))
SELECT sheet_id, CAST(region AS BIGINT) AS region, min(col_no) AS first_col, max(col_no) AS last_col, count(*) AS n_cols FROM g GROUP BY sheet_id, region
""")
def _(cells):
    return ops.regions(cells.withColumn("value", F.expr("case when amount % 9 = 0 then value end")).withColumn("col_no", F.expr("row_no * 3 + col_no * (row_no % 4)")))


_LINES = r"l AS (SELECT sheet_id, row_no, '| ' || string_agg(replace(replace(coalesce(value, ''), '|', '\|'), chr(10), '<br>'), ' | ' ORDER BY col_no) || ' |' AS line FROM cells c WHERE EXISTS (SELECT 1 FROM cells d WHERE d.sheet_id = c.sheet_id AND d.col_no = c.col_no AND coalesce(d.value, '') <> '') GROUP BY sheet_id, row_no)"


@query("g2_markdown_tables", "cells", sql=f"WITH {_LINES} SELECT * FROM l")
def _(cells):
    return ops.markdown_rows(cells)


@query("g3_empty_columns", "cells", sql="SELECT sheet_id, col_no FROM cells GROUP BY sheet_id, col_no HAVING bool_and(coalesce(value, '') = '')")
def _(cells):
    return ops.empty_columns(cells)


@query("g8_row_blocks", "cells", sql=f"""
WITH RECURSIVE {_LINES}, n AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY row_no) AS i FROM l),
f AS (SELECT sheet_id, row_no, i, 0 AS block, length(line) + 1 AS size FROM n WHERE i = 1
  UNION ALL SELECT n.sheet_id, n.row_no, n.i, CASE WHEN f.size + length(n.line) + 1 > 120 THEN f.block + 1 ELSE f.block END, CASE WHEN f.size + length(n.line) + 1 > 120 THEN length(n.line) + 1 ELSE f.size + length(n.line) + 1 END FROM f JOIN n ON n.sheet_id = f.sheet_id AND n.i = f.i + 1)
SELECT sheet_id, row_no, block FROM f
""")
def _(cells):
    return ops.row_blocks(ops.markdown_rows(cells), 120)


def _spans(cells):
    return cells.where("amount % 5 = 0").selectExpr("sheet_id", "row_no", "col_no", "cast(amount % 4 as int) row_span", "cast(1 + amount % 3 as int) col_span")


_SPANS = "s AS (SELECT sheet_id, row_no, col_no, CAST(amount % 4 AS INT) AS row_span, CAST(1 + amount % 3 AS INT) AS col_span FROM cells WHERE amount % 5 = 0), g AS (SELECT *, unnest(generate_series(col_no, col_no + col_span - 1)) AS slot_col FROM (SELECT *, unnest(generate_series(row_no, row_no + row_span - 1)) AS slot_row FROM s WHERE row_span > 0 AND col_span > 0))"


@query("g1_span_grid", "cells", sql=f"WITH {_SPANS} SELECT sheet_id, CAST(slot_row AS INT) AS slot_row, CAST(slot_col AS INT) AS slot_col, row_no AS origin_row, col_no AS origin_col, slot_row <> row_no OR slot_col <> col_no AS is_continuation FROM g")
def _(cells):
    return ops.span_grid(_spans(cells))


@query("g1_span_problems", "cells", sql=f"""
WITH {_SPANS} SELECT sheet_id, row_no, col_no, 'bad_span' AS problem FROM s WHERE row_span < 1
UNION ALL SELECT sheet_id, row_no, col_no, 'beyond_last_row' FROM s WHERE row_no + row_span - 1 > 10
UNION ALL SELECT sheet_id, CAST(slot_row AS INT), CAST(slot_col AS INT), 'overlap' FROM g GROUP BY sheet_id, slot_row, slot_col HAVING count(*) > 1
""")
def _(cells):
    return ops.span_problems(_spans(cells), 10)


def _points(orders):
    return orders.selectExpr("cast(floor(o_orderkey / 7) as bigint) series_id", "cast(o_orderkey % 7 as int) pos", "cast(floor(o_totalprice) as bigint) - 20000 value", "o_orderpriority category", "o_orderkey % 7 * (1 + o_custkey % 2) ordinal")


_POINTS = "p AS (SELECT CAST(floor(o_orderkey / 7) AS BIGINT) AS series_id, CAST(o_orderkey % 7 AS INT) AS pos, CAST(floor(o_totalprice) AS BIGINT) - 20000 AS value, o_orderpriority AS category, o_orderkey % 7 * (1 + o_custkey % 2) AS ordinal FROM orders)"


@query("a11_chart_trend", "orders", sql=f"""
WITH {_POINTS} SELECT series_id, min_by(value, pos) AS first, max_by(value, pos) AS last, min(value) AS low, max(value) AS high, count(*) AS n,
  CASE WHEN max_by(value, pos) > min_by(value, pos) THEN 'up' WHEN max_by(value, pos) < min_by(value, pos) THEN 'down' ELSE 'flat' END AS direction FROM p GROUP BY series_id HAVING count(*) >= 2
""")
def _(orders):
    return ops.chart_trend(_points(orders))


@query("a12_pie_shares", "orders", sql=f"""
WITH {_POINTS} SELECT series_id, first(category ORDER BY value DESC, category) AS largest, first(category ORDER BY value, category) AS smallest,
  CASE WHEN min(value) >= 0 AND sum(value) > 0 THEN round(max(value) / CAST(sum(value) AS DOUBLE), 6) END AS largest_share, CASE WHEN min(value) >= 0 AND sum(value) > 0 THEN round(min(value) / CAST(sum(value) AS DOUBLE), 6) END AS smallest_share FROM p GROUP BY series_id
""")
def _(orders):
    return ops.pie_shares(_points(orders))


@query("w11_period_sequence", "orders", sql=f"""
WITH {_POINTS}, s AS (SELECT series_id, lead(ordinal) OVER (PARTITION BY series_id ORDER BY pos) - ordinal AS step FROM p)
SELECT series_id, count(DISTINCT step) = 1 AND coalesce(max(step) <> 0, false) AS is_sequence, max(step) AS step FROM s GROUP BY series_id
""")
def _(orders):
    out = ops.period_sequence(_points(orders))
    return out.withColumn("is_sequence", F.coalesce("is_sequence", F.lit(False)))


@query("f15_chart_number", "orders", sql=r"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '(' || o_custkey || ')' WHEN 1 THEN '$1,' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') WHEN 2 THEN o_custkey || '%' WHEN 3 THEN o_orderpriority ELSE '  ' || o_custkey || '.5 €' END AS t FROM orders),
n AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(t, '[\s,$€£¥()%]', '', 'g'), '^[+-]?(\d+(\.\d*)?|\.\d+)$') THEN CAST(regexp_replace(t, '[\s,$€£¥()%]', '', 'g') AS DOUBLE) END AS x FROM t)
SELECT o_orderkey, CASE WHEN contains(t, '%') THEN 0.01 ELSE 1 END * CASE WHEN regexp_matches(t, '^\s*\(.*\)\s*$') THEN -x ELSE x END AS number FROM n
""")
def _(orders):
    t = F.expr("case o_orderkey % 5 when 0 then '(' || o_custkey || ')' when 1 then '$1,' || lpad(cast(o_custkey % 1000 as string), 3, '0') when 2 then o_custkey || '%' when 3 then o_orderpriority else '  ' || o_custkey || '.5 €' end")
    held = orders.select("o_orderkey", t.alias("t"))
    return held.select("o_orderkey", ops.chart_number(F.col("t")).alias("number"))
