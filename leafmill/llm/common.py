"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir  # noqa: F401  (the operators import them from here)

#: One or more of the six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that a task has freed back to the system, so that idle workers stay small (glibc; elsewhere nothing happens)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many `_` appended as keep it apart from those taken (Spark compares without case) and from one another."""
    seen, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def lookup(rows: DataFrame, found: DataFrame, key: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """rows joined with found (one row for each key; weight is how many rows have it, total how many there are), without a hot task.

    Keys of more than total / parts rows, which are fewer than `parts`, are broadcast; the rows of all others are shuffled.
    Tables of under 100 rows a part are small enough to join plainly.
    """
    if total < 100 * parts:
        return rows.join(found.drop(weight), key)
    heavy = F.col(weight) * parts > total
    hot = F.broadcast(found.where(heavy).drop(weight))
    light = rows.join(F.broadcast(found.where(heavy).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(light.join(found.where(~heavy).drop(weight), key))


#: Rows of a few numbers that may be broadcast (some 60 MB).
FEW = 1_000_000


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """rows (a materialized table) for a join: broadcast if they are at most `most`, else shuffled."""
    return F.broadcast(rows) if rows.count() <= most else rows


def let(value: Column, body) -> Column:
    """Bind value once inside a higher-order expression (a lambda would evaluate it for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_of(docs: DataFrame) -> Column:
    """The text column, empty where null."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))
