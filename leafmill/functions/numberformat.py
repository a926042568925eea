"""Spreadsheet number formats rendered as text."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Built-in formats by number.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm", 37: "#,##0 ;(#,##0)", 45: "mm:ss", 46: "[h]:mm:ss", 49: "@",
}
_PIECE = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|\[([^\]]*)\]|(General)|(AM/PM|A/P|am/pm)|(y+|d+|h+|s+(?:\.0+)?|m+)|([0#?.,%]+(?:[eE][+-]?0+)?)|(.)', re.S)
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def sections(code: str) -> list[str]:
    """Sections of a format, split at semicolons outside quotes and brackets."""
    out, quoted, bracket, i = [""], False, False, 0
    while i < len(code):
        c = code[i]
        if c == "\\" and i + 1 < len(code):
            out[-1] += code[i : i + 2]
            i += 2
            continue
        quoted ^= c == '"'
        bracket = (bracket or c == "[") and c != "]" if not quoted else bracket
        if c == ";" and not quoted and not bracket:
            out.append("")
        else:
            out[-1] += c
        i += 1
    return out


def condition(section: str):
    m = re.match(r"\[(<=|>=|<>|=|<|>)(-?\d+\.?\d*)\]", section)
    if not m:
        return None
    op, n = m[1], float(m[2])
    return {"<": lambda v: v < n, ">": lambda v: v > n, "<=": lambda v: v <= n, ">=": lambda v: v >= n, "=": lambda v: v == n, "<>": lambda v: v != n}[op]


def choose(code: str, v: float) -> tuple[str, float]:
    """The section for a number, and the number it shows (a section for negatives drops the sign)."""
    parts = sections(code)
    rules = [condition(p) for p in parts[:2]]
    if any(rules):
        for p, rule in zip(parts, rules):
            if rule and rule(v):
                return p, v
        return parts[-1] if len(parts) > 1 else parts[0], v
    if v < 0 and len(parts) > 1:
        return parts[1], -v
    if v == 0 and len(parts) > 2:
        return parts[2], v
    return parts[0], v


def general(v: float) -> str:
    if v == int(v) and abs(v) < 1e11:
        return str(int(v))
    text = f"{v:.10g}"
    return re.sub(r"e([+-])0*(\d)", r"E\1\2", text) if "e" in text else text


def fixed(v: float, places: int) -> str:
    return format(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f")


def digits(v: float, pattern: str) -> str:
    """A number by a placeholder pattern: 0 # ? with grouping, percent, scaling commas, exponent."""
    m = re.fullmatch(r"([0#?.,%]+)(?:([eE])([+-]?)(0+))?", pattern)
    body, percent = m[1].replace("%", ""), m[1].count("%")
    v *= 100**percent
    scale = len(body) - len(body.rstrip(","))
    body = body.rstrip(",")
    v /= 1000**scale
    whole, _, decimals = body.partition(".")
    if m[2]:
        power = 0 if v == 0 else math.floor(math.log10(abs(v)))
        mantissa = fixed(v / 10**power, len(decimals))
        if abs(float(mantissa)) >= 10:
            power, mantissa = power + 1, fixed(v / 10 ** (power + 1), len(decimals))
        sign = "-" if power < 0 else "+" if m[3] == "+" else ""
        return f"{mantissa}E{sign}{abs(power):0{len(m[4])}d}" + "%" * percent
    text = fixed(abs(v), len(decimals))
    a, _, b = text.partition(".")
    least = whole.replace(",", "").count("0")
    a = a.lstrip("0").rjust(least, "0")
    if "," in whole:
        a = re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", a)
    while b and decimals[len(b) - 1] == "#" and b[-1] == "0":
        b = b[:-1]
    sign = "-" if v < 0 and re.search(r"[1-9]", text) else ""
    return sign + a + (f".{b}" if b else "." if "." in body and not decimals else "") + "%" * percent


def fraction(v: float, section: str) -> str | None:
    m = re.search(r"(#+ )?([?#0]+)/([?#0]+|\d+)", section)
    if not m or "/" not in section:
        return None
    sign, v = ("-" if v < 0 else ""), abs(v)
    whole = int(v) if m[1] else 0
    rest = v - whole
    if m[3].isdigit() and m[3].strip("0"):
        f = (round(rest * int(m[3])), int(m[3]))
    else:
        g = Fraction(rest).limit_denominator(10 ** len(m[3]) - 1)
        f = (g.numerator, g.denominator)
    if m[1] and f[0] == f[1]:
        whole, f = whole + 1, (0, f[1])
    if m[1] and f[0] == 0:
        return f"{sign}{whole}"
    return f"{sign}{f'{whole} ' if whole else ''}{f[0]}/{f[1]}"


def dated(section: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", section)
    return bool(re.search(r"[ymdhs]", bare, re.I)) and "General" not in bare or bool(re.search(r"\[(h+|m+|s+)\]", section, re.I))


def render(raw: float | None, code: str, system_1904: bool = False) -> str:
    """The text that a number shows under a format."""
    if raw is None or raw != raw:
        return ""
    section, v = choose(code or "General", raw)
    if dated(section):
        return moment(v, section, system_1904)
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", section)
    f = fraction(v, plain)
    if f is not None:
        return f
    out, used = [], False
    for m in _PIECE.finditer(section):
        quoted, escaped, pad, _, bracket, gen, _, letters, pattern, other = m.groups()
        if quoted is not None or escaped is not None:
            out.append(quoted if quoted is not None else escaped)
        elif pad is not None:
            out.append(" ")
        elif bracket is not None:
            if bracket.startswith("$"):
                out.append(bracket[1:].partition("-")[0])
        elif gen:
            out.append(general(v))
        elif pattern and re.search("[0#?]", pattern):
            if not used:
                out.append(digits(v, pattern))
            used = True
        elif other == "@":
            out.append(general(v))
        else:
            out.append(pattern or letters or other or "")
    return "".join(out)


def moment(v: float, section: str, system_1904: bool = False) -> str:
    """A serial date or time; [h], [m] and [s] count on."""
    if v < 0:
        return "#" * 8
    day, seconds = divmod(round(v * 86400), 86400)
    fictitious = day == 60 and not system_1904
    base = datetime(1904, 1, 1) if system_1904 else datetime(1899, 12, 31) if day < 60 else datetime(1899, 12, 30)
    at = base + timedelta(days=28 + 31 if fictitious else day, seconds=seconds)
    d = 29 if fictitious else at.day
    half = bool(re.search(r"AM/PM|A/P", section, re.I))
    out, pieces = [], list(_PIECE.finditer(section))
    for k, m in enumerate(pieces):
        quoted, escaped, pad, _, bracket, _, noon, letters, pattern, other = m.groups()
        if quoted is not None or escaped is not None:
            out.append(quoted if quoted is not None else escaped)
        elif pad is not None:
            out.append(" ")
        elif bracket is not None:
            total = {"h": day * 24 + seconds // 3600, "m": day * 1440 + seconds // 60, "s": day * 86400 + seconds}.get(bracket[:1].lower())
            if total is not None and set(bracket.lower()) <= set("hms"):
                out.append(f"{total:0{len(bracket)}d}")
        elif noon:
            mark = "AM" if at.hour < 12 else "PM"
            out.append(mark if noon.upper() == "AM/PM" else mark[0])
        elif letters:
            c, n = letters[0].lower(), len(letters)
            near = [x for x in ((pieces[j][8] or pieces[j][5] or "") for j in list(range(k - 1, -1, -1))) if x]
            after = [x for x in ((pieces[j][8] or pieces[j][5] or "") for j in range(k + 1, len(pieces))) if x]
            minute = c == "m" and n <= 2 and (near and near[0][0].lower() == "h" or after and after[0][0].lower() == "s")
            if c == "y":
                out.append(f"{at.year:04d}" if n > 2 else f"{at.year % 100:02d}")
            elif minute:
                out.append(f"{at.minute:0{n}d}")
            elif c == "m":
                out.append({1: str(at.month), 2: f"{at.month:02d}", 3: _MONTHS[at.month - 1][:3], 5: _MONTHS[at.month - 1][0]}.get(n, _MONTHS[at.month - 1]))
            elif c == "d":
                out.append({1: str(d), 2: f"{d:02d}", 3: _DAYS[at.weekday()][:3]}.get(n, _DAYS[at.weekday()]))
            elif c == "h":
                hour = (at.hour + 11) % 12 + 1 if half else at.hour
                out.append(f"{hour:0{min(n, 2)}d}")
            else:
                out.append(f"{at.second:0{min(len(letters.partition('.')[0]), 2)}d}")
        else:
            out.append(pattern or other or "")
    return "".join(out)


@F.pandas_udf(StringType())
def _rendered(raw: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([render(None if v is None else float(v), c) for v, c in zip(raw, code)], dtype=object)


def formatted(raw: Column, code: Column) -> Column:
    """Numbers under number formats (Arrow batches)."""
    return _rendered(raw.cast("double"), code)


def simple(raw: Column, places: int, grouped: bool = True) -> Column:
    """Fixed places on the JVM side, for the formats that are no more than that."""
    text = F.format_number(raw, places)
    return text if grouped else F.replace(text, F.lit(","), F.lit(""))
