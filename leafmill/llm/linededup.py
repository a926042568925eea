"""Site-relative line deduplication.

Pages are grouped by host; a line's ratio is the share of the host's pages
that hold it.  Lines above the ratio are boilerplate of that host and are
dropped from all its pages, whatever is left of a page; a page of nothing else
ends empty.  Rows of one host with the same text are copies of one page and
count once, in the line's pages and in the host's total, so copies alone make
no boilerplate.  A line that a single page holds has no frequency among pages
and stays.  Lines compare without white space at their ends; blank lines are
never counted or dropped.

A null host is a host of its own, the empty name; null texts are empty pages;
other columns pass through, whatever their names.  Hot hosts don't matter for
counting, which groups by (host, text) and (host, line) with map-side sums.
The drop lists go to the documents by broadcast up to BROADCAST_LINES lines,
beyond that by a join on (host, salt).  A host has at most (mean lines per
page) / ratio boilerplate lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialize, text_of

#: On sf0.1 no line's share lies between 0.047 and 0.086: below are chance and passages, above are lines of the site.
MAX_RATIO, MIN_PAGES = 0.06, 1
#: Boilerplate lines of all hosts that may be broadcast (about 50 MB), and parts of a host beyond that.
BROADCAST_LINES, SALTS = 1_000_000, 1000
#: Lists that a host's drop list is gathered from.
PIECES = 16


def key(line: Column) -> Column:
    """96 bits of a line without white space at its ends."""
    bare = F.regexp_replace(line, f"^{SPACE}|{SPACE}$", "")
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("x"), F.hash(bare).alias("y")))


def keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), key)


def boilerplate(docs: DataFrame, host: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, drop (the keys of its boilerplate lines) and n (how many they are); hosts of fewer than min_pages pages have none."""
    text = text_of(docs)
    own = docs.select(
        F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"),
        F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("y")).alias("page"),
        F.array_distinct(F.filter(keys(text), lambda k: k.isNotNull())).alias("keys"),
    )
    pages = own.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    # the null key of each page counts the pages of the host
    lines = pages.select("host", F.explode(F.array_append("keys", F.lit(None))).alias("key"))
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n"))
    totals = counts.where("key is null and n >= %d" % min_pages).select("host", F.col("n").alias("pages"))
    often = counts.where("key is not null and n > 1").join(totals, "host").where(F.col("n") > F.col("pages") * max_ratio)
    # in two steps, so that no task gathers a hot host's lines one by one
    pieces = often.groupBy("host", F.pmod("key.x", F.lit(PIECES)).alias("piece")).agg(F.collect_list("key").alias("drop"))
    return pieces.groupBy("host").agg(F.flatten(F.collect_list("drop")).alias("drop")).withColumn("n", F.size("drop"))


def drop_lines(
    docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, names: tuple[str, str] = ("n_lines", "n_dropped"), broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """docs with text rewritten, and how many lines it had and lost (columns of these names are replaced)."""
    found = materialize(boilerplate(docs, host, max_ratio, min_pages), "boilerplate")
    at, salt, drop, kept = fresh(docs.columns, "_host", "_salt", "_drop", "_kept")
    step, on = docs.withColumn(at, F.coalesce(docs[host].cast("string"), F.lit(""))), [at]
    lists = found.select(F.col("host").alias(at), F.col("drop").alias(drop))
    if (found.agg(F.sum("n")).first()[0] or 0) <= broadcast_lines:
        lists = F.broadcast(lists)
    else:
        # a row's salt depends on all its columns: only equal rows meet
        hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
        step, on = step.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")), [at, salt]
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    # array_contains is null for blank lines
    left = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop), key(x)), F.lit(False)))
    step = step.join(lists, on, "left").withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(left))
    text = F.when(F.col("text").isNull(), None).otherwise(F.array_join(kept, "\n"))
    return step.select(
        *[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns if c.lower() not in {n.lower() for n in names}],
        F.size(lines).cast("long").alias(names[0]),
        (F.size(lines) - F.size(kept)).cast("long").alias(names[1]),
    )


def dedup(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The same rows and columns, boilerplate lines removed; n_chars follows where there is one."""
    names = tuple(fresh(docs.columns, "_n_lines", "_n_dropped"))
    step = drop_lines(docs, host, max_ratio, min_pages, names)
    if "n_chars" in docs.columns:
        step = step.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return step.select(*[F.col(f"`{c}`") for c in docs.columns])
