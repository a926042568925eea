"""Spreadsheet addresses: columns as letters, A1 references as numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def box(a1: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of a range such as B2:D9; one cell is a range of its own."""
    ends = [re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)", p.strip()) for p in a1.split(":")]
    if len(ends) not in (1, 2) or not all(ends):
        raise ValueError(f"not an A1 range: {a1!r}")
    rows, columns = [int(m[2]) for m in ends], [column_number(m[1]) for m in ends]
    return min(rows), min(columns), max(rows), max(columns)


def row_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"(\d+)", 1).cast("int")


def column_of(ref: Column) -> Column:
    """Column number of an A1 reference (base 26)."""
    letters = F.split(F.upper(F.regexp_extract(ref, r"([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def letters(number: Column) -> Column:
    """Letters of a column number up to 18,278."""
    n = number - 1
    small = F.chr((n % 26 + 65).cast("long"))
    two = F.concat(F.chr((F.floor(n / 26) - 1 + 65).cast("long")), small)
    m = n - 702
    three = F.concat(F.chr((F.floor(m / 676) + 65).cast("long")), F.chr((F.floor(m / 26) % 26 + 65).cast("long")), F.chr((m % 26 + 65).cast("long")))
    return F.when(n < 26, small).when(n < 702, two).otherwise(three)
