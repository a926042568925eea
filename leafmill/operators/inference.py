"""Inference inside one page, slide or canvas: tables from lines and shapes, label assignment, connections, sequence diagrams.

Groups are pages and canvases, which are small; each is worked on by itself in
one Arrow group, and search widths are bounds of the method (a diagnostic
column tells when one was hit).
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEAM, MOST_CONNECTORS, EXACT_LABELS, CANDIDATES = 128, 40, 8, 4


def _levels(values, tolerance: float) -> list[float]:
    """Distinct positions: a value within tolerance of the last one joins it."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > tolerance:
            out.append(v)
    return out


def ruled_tables(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Cells of the grid that a page's ruling lines draw (three lines each way at least); a missing inner line merges cells.

    lines: doc_id, page, horizontal, fixed, lo, hi.
    """

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        h, v = part[part["horizontal"]], part[~part["horizontal"]]
        ys, xs = _levels(h["fixed"], tolerance), _levels(v["fixed"], tolerance)
        columns = ["doc_id", "page", "row_no", "col_no", "row_span", "col_span", "x", "y", "w", "h"]
        if len(ys) < 3 or len(xs) < 3:
            return pd.DataFrame(columns=columns)

        def drawn(rows, at, a, b):
            near = rows[(rows["fixed"] - at).abs() <= tolerance]
            return bool(((near["lo"] <= a + tolerance) & (near["hi"] >= b - tolerance)).any())

        taken, out = set(), []
        for r, c in itertools.product(range(len(ys) - 1), range(len(xs) - 1)):
            if (r, c) in taken:
                continue
            wide, tall = 1, 1
            while c + wide < len(xs) - 1 and not drawn(v, xs[c + wide], ys[r], ys[r + 1]):
                wide += 1
            while r + tall < len(ys) - 1 and not drawn(h, ys[r + tall], xs[c], xs[c + wide]):
                tall += 1
            taken.update((r + i, c + j) for i in range(tall) for j in range(wide))
            out.append((*key, r, c, tall, wide, xs[c], ys[r], xs[c + wide] - xs[c], ys[r + tall] - ys[r]))
        return pd.DataFrame(out, columns=columns)

    return lines.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, row_no int, col_no int, row_span int, col_span int, x double, y double, w double, h double")


def aligned_tables(shapes: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """Shapes that stand in a grid (two rows and two columns at least), with their row and column."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        ys, xs = _levels(part["y"], tolerance), _levels(part["x"], tolerance)
        place = lambda levels, v: max(i for i, x in enumerate(levels) if v >= x)
        rows, cols = part["y"].map(lambda v: place(ys, v)), part["x"].map(lambda v: place(xs, v))
        out = part[["canvas_id", "shape_id"]].assign(row_no=rows, col_no=cols)
        while True:  # a row or column of one shape is no part of a grid
            keep = out.groupby("row_no")["shape_id"].transform("count").ge(2) & out.groupby("col_no")["shape_id"].transform("count").ge(2)
            if keep.all():
                return out
            out = out[keep]

    return shapes.groupBy("canvas_id").applyInPandas(run, "canvas_id long, shape_id int, row_no int, col_no int")


def assign_labels(pairs: DataFrame) -> DataFrame:
    """One label for an edge and one edge for a label with the largest total score: exact for few labels, greedy beyond.

    pairs: canvas_id, label_id, edge_id, score; the best CANDIDATES edges of each label count.
    """

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        options = {label: sorted(zip(-g["score"], g["edge_id"]))[:CANDIDATES] for label, g in part.groupby("label_id")}
        labels, best, exact = sorted(options), {}, len(options) <= EXACT_LABELS
        if exact:
            top = (float("-inf"), {})

            def search(i: int, used: frozenset, total: float, chosen: dict) -> None:
                nonlocal top
                if i == len(labels):
                    if total > top[0] + 1e-12:
                        top = (total, dict(chosen))
                    return
                for minus, edge in options[labels[i]]:
                    if edge not in used:
                        search(i + 1, used | {edge}, total - minus, chosen | {labels[i]: edge})
                search(i + 1, used, total, chosen)

            search(0, frozenset(), 0.0, {})
            best = top[1]
        else:
            used: set = set()
            for minus, label, edge in sorted((m, label, e) for label, o in options.items() for m, e in o):
                if label not in best and edge not in used:
                    best[label] = edge
                    used.add(edge)
        return pd.DataFrame([(key[0], label, edge, exact) for label, edge in best.items()], columns=["canvas_id", "label_id", "edge_id", "exact"])

    return pairs.groupBy("canvas_id").applyInPandas(run, "canvas_id long, label_id int, edge_id int, exact boolean")


def solve_connections(candidates: DataFrame) -> DataFrame:
    """Joint choice of an end shape for every connector by a beam search; two connectors with the same ends cost.

    candidates: canvas_id, connector_id, src, dst, score.  margin: best total less the second best that chooses otherwise.
    """

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        options = {c: sorted(zip(-g["score"], g["src"], g["dst"]))[:CANDIDATES] for c, g in part.groupby("connector_id")}
        order, bounded = sorted(options), len(options) > MOST_CONNECTORS
        beams = [(0.0, ())]
        for c in order:
            grown = [(total + minus + (0.25 if (s, d) in chosen else 0.0), (*chosen, (s, d))) for total, chosen in beams for minus, s, d in options[c]]
            beams = sorted(grown)[:BEAM]
        best = beams[0]
        rows = []
        for i, c in enumerate(order):
            other = next((t for t, chosen in beams if chosen[i] != best[1][i]), None)
            rows.append((key[0], c, *best[1][i], None if other is None else round(other - best[0], 6), bounded))
        return pd.DataFrame(rows, columns=["canvas_id", "connector_id", "src", "dst", "margin", "bounded"])

    return candidates.groupBy("canvas_id").applyInPandas(run, "canvas_id long, connector_id int, src int, dst int, margin double, bounded boolean")


def sequence_diagrams(shapes: DataFrame, lines: DataFrame) -> DataFrame:
    """Messages of sequence diagrams: heads in the top row, lifelines below them, arrows from lifeline to lifeline in order.

    shapes: canvas_id, shape_id, x, y, w, h, label; lines: canvas_id, line_id, x1, y1, x2, y2, dashed.
    """
    both = shapes.select("canvas_id", F.lit("shape").alias("what"), F.col("shape_id").alias("id"), "x", "y", "w", "h", "label", F.lit(False).alias("dashed")).unionByName(
        lines.select("canvas_id", F.lit("line").alias("what"), F.col("line_id").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), F.lit("").alias("label"), "dashed")
    )

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        columns = ["canvas_id", "place", "source", "target", "is_reply"]
        boxes, strokes = part[part["what"] == "shape"], part[part["what"] == "line"]
        if boxes.empty or strokes.empty:
            return pd.DataFrame(columns=columns)
        top = boxes["y"].min()
        heads = boxes[boxes["y"] <= top + boxes["h"].max()].sort_values("x")
        vertical = strokes[(strokes["w"].abs() <= 2) & (strokes["h"].abs() > 20)]
        lives = []
        for head in heads.itertuples():
            middle = head.x + head.w / 2
            own = vertical[(vertical["x"] - middle).abs() <= head.w / 2]
            if not own.empty:
                lives.append((float(own["x"].iloc[0]), head.label))
        out = []
        for m in strokes[(strokes["h"].abs() <= 4) & (strokes["w"].abs() > 10)].sort_values(["y", "id"]).itertuples():
            near = lambda x: min(lives, key=lambda v: (abs(v[0] - x), v[1])) if lives else None
            a, b = near(m.x), near(m.x + m.w)
            if a and b and a != b and abs(a[0] - m.x) <= 12 and abs(b[0] - m.x - m.w) <= 12:
                out.append((key[0], len(out) + 1, a[1], b[1], bool(m.dashed)))
        return pd.DataFrame(out, columns=columns)

    return both.groupBy("canvas_id").applyInPandas(run, "canvas_id long, place int, source string, target string, is_reply boolean")


def column_order(fragments: DataFrame, gutter: float = 30.0) -> DataFrame:
    """Reading order of a page with columns: a vertical gap of `gutter` that no fragment crosses parts columns, each read from the top."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        spans = sorted(zip(part["x"], part["x"] + part["w"]))
        cuts, right = [], spans[0][1]
        for a, b in spans[1:]:
            if a - right >= gutter:
                cuts.append((a + right) / 2)
            right = max(right, b)
        column = part["x"].map(lambda x: sum(x >= c for c in cuts))
        out = part.assign(column=column).sort_values(["column", "y", "x", "frag_id"])
        return out.assign(place=range(1, len(out) + 1))[["doc_id", "page", "frag_id", "column", "place"]]

    return fragments.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, frag_id int, column int, place int")


def drawn_lines(fragments: DataFrame, strokes: DataFrame) -> DataFrame:
    """Strokes drawn over text: through its middle (strike) or under it (underline), along 60 % of its width at least.

    strokes: doc_id, page, y, x1, x2; they meet the fragments of their page in bands of 20 units.
    """
    band = lambda y: F.floor(y / 20)
    text = fragments.withColumn("_b", F.explode(F.sequence(band(F.col("y")), band(F.col("y") + F.col("h") + 3))))
    line = strokes.select("doc_id", "page", F.col("y").alias("_y"), "x1", "x2", band(F.col("y")).alias("_b"))
    both = text.join(line, ["doc_id", "page", "_b"])
    cover = F.least("x2", F.col("x") + F.col("w")) - F.greatest("x1", F.col("x"))
    at = (F.col("_y") - F.col("y")) / F.col("h")
    kind = F.when(at.between(0.35, 0.65), "strike").when(at.between(0.85, 1.2), "underline")
    hit = both.where((cover >= F.col("w") * 0.6) & kind.isNotNull())
    return hit.groupBy("doc_id", "page", "frag_id").agg(F.min(kind).alias("decoration"))


def mermaid(edges: DataFrame) -> DataFrame:
    """Flowchart text of each diagram from its edges (canvas_id, src, dst, label), in order."""
    line = F.concat(F.lit("  n"), "src", F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" -->|"), F.regexp_replace("label", r"[|\"]", "'"), F.lit("| n"))).otherwise(F.lit(" --> n")), "dst")
    rows = edges.groupBy("canvas_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", line.alias("line")))).alias("x"))
    return rows.select("canvas_id", F.concat(F.lit("flowchart TD\n"), F.array_join(F.transform("x", lambda i: i["line"]), "\n")).alias("mermaid"))


def capped(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first rows of each group, and how many more there were (an output budget)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by)
    step = rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "omitted": F.greatest(F.count("*").over(w) - most, F.lit(0))})
    return step.where(F.col("place") <= most)
