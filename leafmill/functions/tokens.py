"""Token estimates and content tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column, multiplier: float = 1.0) -> Column:
    """Heuristic number of model tokens.

    Runs of digits count one for three digits, a cell delimiter or a separator
    right after a digit one each, other ASCII characters a quarter, the rest
    seven eighths; every share is rounded up.
    """
    t = F.coalesce(text, F.lit(""))
    size = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    runs = F.aggregate(F.regexp_extract_all(t, F.lit("([0-9]+)"), 1), F.lit(0), lambda a, x: a + F.floor((F.length(x) + 2) / 3).cast("int"))
    digits = size("[^0-9]")
    delimiters = size(r"[^|]")
    separators = F.length(t) - F.length(F.regexp_replace(t, r"(?<=[0-9])[,.]", ""))
    other = size(r"[\x00-\x7F]")
    ascii_ = F.length(t) - digits - delimiters - separators - other
    estimate = F.floor((ascii_ + 3) / 4) + runs + delimiters + separators + F.floor((other * 7 + 7) / 8)
    return (estimate if multiplier == 1 else F.ceil(estimate * multiplier)).cast("long")


# What is no content of a Markdown text.
_FRONT_MATTER = r"\A---\r?\n(?s:.*?)\r?\n---\r?\n"
_COMMENT = r"(?s)<!--.*?-->"
_FENCE_LINE = r"(?m)^```[^\n]*$"
_LINK_TARGET = r"\]\([^)]*\)"


def strip_markdown(text: Column) -> Column:
    """Drop front matter, comments, fence lines and link targets."""
    t = F.regexp_replace(text, _FRONT_MATTER, "")
    t = F.regexp_replace(t, _COMMENT, " ")
    t = F.regexp_replace(t, _FENCE_LINE, "")
    return F.regexp_replace(t, _LINK_TARGET, "]")


#: Scripts whose characters pair up into bigrams.
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]"


def content_tokens(text: Column) -> Column:
    """Lower-case words, digit runs, and bigrams of East Asian runs."""
    runs = F.regexp_extract_all(text, F.lit(rf"({CJK}+|[0-9]+|[\p{{L}}&&[^{CJK[1:-1]}]]+)"), 1)

    def pieces(x):
        bigrams = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))
        return F.when(x.rlike(f"^{CJK}") & (F.length(x) > 1), bigrams).otherwise(F.array(F.lower(x)))

    return F.flatten(F.transform(runs, pieces))
