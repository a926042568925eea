"""Search in the lines of package parts."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def needle_of(query: str) -> str:
    plain = re.sub(r"\\([!\"#$%&'()*+,\-./:;<=>?@\[\]\\^_`{|}~])", r"\1", query)
    return unicodedata.normalize("NFKC", html.unescape(plain)).upper()


def search(lines: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """Lines (key, line, raw) that match, with the heading in force; text that a line break cuts counts at its first line.

    A query with spaces matches any amount of white space; one without also
    matches text that white space interrupts.
    """
    if not query.strip():
        raise ValueError("empty query")
    needle = needle_of(query)
    loose = bool(re.search(r"\s", needle))
    squeezed = re.sub(r"\s+", " ", needle)
    rows = lines.withColumns({
        "_s": T.searchable(F.col("raw")), "_p": T.compatible(T.decoded(T.unescape_markdown(F.col("raw")))),
        "_title": F.nullif(F.regexp_extract("raw", r"^#{1,6}\s+(.+?)\s*#*\s*$", 1), F.lit("")),
    })
    fits = (lambda c: F.contains(T.spaced(c), F.lit(squeezed))) if loose else (lambda c: F.contains(T.compact(c), F.lit(needle)))
    rows = rows.withColumn("_hit", F.contains("_p", F.lit(needle)) | F.contains("_s", F.lit(needle)) | fits(F.col("_s")))
    order = W.partitionBy(key).orderBy("line")
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    full = F.length(F.trim("_s")) > 0
    state = F.struct(F.col("line").alias("line"), F.col("_s").alias("s"), F.col("_hit").alias("hit"), F.col("raw").alias("raw"))
    above = F.last(F.when(full, state), ignorenulls=True).over(so_far) if loose else F.lag(F.when(full, state)).over(order)
    carried = F.last(F.when(F.col("line") > 0, T.unescape_markdown(F.col("_title"))), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"_above": above, "_heading": carried})
    cut = ~F.col("_hit") & F.col("_above").isNotNull() & ~F.col("_above.hit") & full & fits(F.concat_ws(" " if loose else "", F.col("_above.s"), F.col("_s")))
    direct = rows.where("_hit").select(key, (F.col("line") + 1).alias("line"), "raw", F.coalesce(T.unescape_markdown(F.col("_title")), F.col("_heading")).alias("heading"))
    broken = rows.where(cut).select(key, (F.col("_above.line") + 1).alias("line"), F.col("_above.raw").alias("raw"), F.col("_heading").alias("heading"))
    return direct.unionByName(broken)
