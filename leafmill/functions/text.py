"""Text functions: escapes, normal forms for search, path checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The patterns that decide what search sees.
_ESCAPES = r"\\([!\"#$%&'()*+,\-./:;<=>?@\[\]\\^_`{|}~])"
_MARKUP = r"(?<!\\)(?:</?(?:u|ins|del|sub|sup)>|\*\*|~~)"
_BREAKS = r"(?i)(?:<br\s*/?>|\s)+"


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    import html

    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t).upper(), na_action="ignore")


def decoded(text: Column) -> Column:
    """Character references decoded; only texts that have an ampersand leave the JVM."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def compatible(text: Column) -> Column:
    """Compatibility normal form, upper case; only texts beyond ASCII leave the JVM."""
    wide = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_compatible(F.when(wide, text)), F.upper(text))


def unescape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPES, "$1")


def escape_markdown(text: Column) -> Column:
    """Characters with a meaning in Markdown behind a backslash."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def escape_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r?\n", "<br>")


def searchable(line: Column) -> Column:
    """A line as search sees it: inline markup and escapes gone, references decoded, compatibility form, upper case."""
    return compatible(decoded(unescape_markdown(F.regexp_replace(line, _MARKUP, ""))))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, _BREAKS, "")


def spaced(text: Column) -> Column:
    return F.regexp_replace(text, _BREAKS, " ")


def node_id(*parts: Column) -> Column:
    """n_ and 16 characters (base 32, lower case) of the SHA-256 of the parts joined by line feeds."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 5 * k + 1, 5), 16, 2), 20, "0") for k in range(4)])
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz234567")
    digits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.substr(alphabet, F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.concat(F.lit("n_"), F.array_join(digits, ""))


def cell_id(sheet: Column, ref: Column) -> Column:
    return F.concat(F.lit("n_"), F.substring(F.sha2(F.concat_ws("!", sheet, ref), 256), 1, 16))


def unsafe_path(path: Column) -> Column:
    """Absolute paths, drive letters, backslashes and steps out of the folder."""
    return path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") | (path == "")


def encoded_path(path: Column) -> Column:
    """Percent-encoded for a Markdown link; slashes stay."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def line_style(dashes: Column) -> Column:
    """solid, dotted, dashed or dash-dot by the lengths of a dash array."""
    shortest, longest = F.array_min(dashes), F.array_max(dashes)
    return F.when(F.size(dashes) == 0, "solid").when(longest <= 1.5, "dotted").when((F.size(dashes) >= 4) & (shortest * 2 < longest), "dash_dot").otherwise("dashed")
