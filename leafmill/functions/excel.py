"""Spreadsheet expressions compiled to Columns.

A value is a struct (kind, num, text): blank, number, text, boolean, error or
unknown.  Unknown poisons whatever uses it and is never a SQL null.  Names in
an expression are columns of the row (see ``compile_expression``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|\"((?:[^\"]|\"\")*)\"|([A-Za-z_][A-Za-z0-9_.]*)|(<=|>=|<>|[-+*/^&%=<>(),]))")
#: Deeper expressions are refused.
MAX_DEPTH = 64


def value(kind: str, num: Column | None = None, text: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), (num if num is not None else F.lit(None)).cast("double").alias("num"), (text if text is not None else F.lit(None)).cast("string").alias("text"),
    )


def error(code: str) -> Column:
    return value("error", text=F.lit(code))


def from_cell(text: Column) -> Column:
    """The value of a cell's text."""
    number = text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", value("blank")).when(number, value("number", text.cast("double"))).when(F.upper(text).isin("TRUE", "FALSE"), value("boolean", (F.upper(text) == "TRUE").cast("int")))
        .when(text.rlike(r"^#(N/A|DIV/0!|VALUE!|REF!|NAME\?|NUM!|NULL!)$"), value("error", text=text)).otherwise(value("text", text=text))
    )


def to_number(v: Column) -> Column:
    """Number of a value: booleans and number-like text count, blanks are zero, other text is an error."""
    like = v["text"].rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$")
    return (
        F.when(v["kind"].isin("error", "unknown"), v).when(v["kind"] == "blank", value("number", F.lit(0.0))).when(v["kind"].isin("number", "boolean"), value("number", v["num"]))
        .when(like, value("number", v["text"].cast("double"))).otherwise(error("#VALUE!"))
    )


def to_text(v: Column) -> Column:
    """Text of a value; whole numbers have no decimal point."""
    n = v["num"]
    shown = F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string"))
    return F.when(v["kind"] == "blank", "").when(v["kind"] == "number", shown).when(v["kind"] == "boolean", F.when(n != 0, "TRUE").otherwise("FALSE")).otherwise(v["text"])


def to_bool(v: Column) -> Column:
    t = F.upper(v["text"])
    return (
        F.when(v["kind"].isin("error", "unknown"), v).when(v["kind"] == "text", F.when(t == "TRUE", value("boolean", F.lit(1))).when(t == "FALSE", value("boolean", F.lit(0))).otherwise(error("#VALUE!")))
        .otherwise(value("boolean", (F.coalesce(v["num"], F.lit(0.0)) != 0).cast("int")))
    )


def let(v: Column, body) -> Column:
    """Evaluate v once."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


def bind(values: list[Column], body) -> Column:
    """body over values, each evaluated once however often body names it (nested expressions would double at every level)."""
    return let(F.array(*values), lambda a: body([F.get(a, F.lit(i)) for i in range(len(values))]))


def spread(values: list[Column], body) -> Column:
    """body over values; the first unknown or error among them wins."""
    if not values:
        return body([])
    packed = F.array(*values)

    def use(a):
        bad = F.get(F.filter(a, lambda x: x["kind"].isin("unknown", "error")), F.lit(0))
        return F.coalesce(bad, body([F.get(a, F.lit(i)) for i in range(len(values))]))

    return let(packed, use)


def numeric(values: list[Column], body) -> Column:
    return bind(values, lambda v: spread([to_number(x) for x in v], lambda n: body([x["num"] for x in n])))


def number(n: Column) -> Column:
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")), error("#NUM!")).otherwise(value("number", n))


def rank(v: Column) -> Column:
    return F.when(v["kind"] == "text", 1).when(v["kind"] == "boolean", 2).otherwise(0)


def compare(a: Column, b: Column, op: str) -> Column:
    """Numbers and blanks before text before booleans; a blank takes the other side's type; text without case."""
    def by(x, y):
        ra, rb = F.when(x["kind"] == "blank", rank(y)).otherwise(rank(x)), F.when(y["kind"] == "blank", rank(x)).otherwise(rank(y))
        na, nb = F.coalesce(x["num"], F.lit(0.0)), F.coalesce(y["num"], F.lit(0.0))
        ta, tb = F.lower(F.coalesce(x["text"], F.lit(""))), F.lower(F.coalesce(y["text"], F.lit("")))
        sign = F.when(ra != rb, F.signum(ra - rb)).when(ra == 1, F.when(ta < tb, -1).when(ta > tb, 1).otherwise(0)).otherwise(F.signum(na - nb))
        test = {"=": sign == 0, "<>": sign != 0, "<": sign < 0, ">": sign > 0, "<=": sign <= 0, ">=": sign >= 0}[op]
        return value("boolean", test.cast("int"))

    return spread([a, b], lambda v: by(*v))


def excel_round(n: Column, digits: Column, mode: str) -> Column:
    scale = F.pow(F.lit(10.0), F.when(digits < 0, F.ceil(digits)).otherwise(F.floor(digits)))
    scaled = F.abs(n) * scale
    # halves go away from zero; a hair is allowed for the binary fraction
    whole = {"ROUND": F.floor(scaled + 0.5 + 1e-9), "ROUNDUP": F.ceil(scaled - 1e-9), "ROUNDDOWN": F.floor(scaled + 1e-9)}[mode]
    return F.signum(n) * whole / scale


def serial_date(n: Column) -> Column:
    """The day of a serial number in the 1900 system (day 60 is the fictitious 29 February 1900)."""
    day = F.floor(n).cast("int")
    return F.date_add(F.when(day < 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30")).cast("date"), day)


def date_part(n: Column, part: str) -> Column:
    ok, odd = (n >= 0) & (n < 2958466), F.floor(n) == 60
    d = serial_date(n)
    fixed = {"YEAR": (F.year(d), 1900), "MONTH": (F.month(d), 2), "DAY": (F.dayofmonth(d), 29)}[part]
    zero = {"YEAR": 1900, "MONTH": 1, "DAY": 0}[part]
    return F.when(~ok, error("#NUM!")).otherwise(value("number", F.when(F.floor(n) == 0, zero).when(odd, fixed[1]).otherwise(fixed[0])))


def _functions() -> dict:
    """name: (least, most arguments, how)."""
    num = lambda f: lambda a: numeric(a, lambda n: number(f(*n)))
    kind = lambda *k: lambda a: let(a[0], lambda v: F.when(v["kind"] == "unknown", v).otherwise(value("boolean", v["kind"].isin(*k).cast("int"))))

    def logic(f):
        return lambda a: bind(a, lambda v: spread([to_bool(x) for x in v], lambda b: value("boolean", f([x["num"] != 0 for x in b]).cast("int"))))

    def text(f):
        return lambda a: spread(a, lambda v: value("text", text=f(to_text(v[0]), *[to_number(x)["num"] for x in v[1:]])))

    def all_of(c):
        out = c[0]
        for x in c[1:]:
            out &= x
        return out

    def any_of(c):
        out = c[0]
        for x in c[1:]:
            out |= x
        return out

    def odd(c):
        out = c[0].cast("int")
        for x in c[1:]:
            out = out + x.cast("int")
        return out % 2 == 1

    def choose(a):
        rest = a[2] if len(a) > 2 else value("boolean", F.lit(0))
        return let(let(a[0], to_bool), lambda c: F.when(c["kind"].isin("error", "unknown"), c).when(c["num"] != 0, a[1]).otherwise(rest))

    def find(fold):
        def at(a):
            start = a[2] if len(a) > 2 else value("number", F.lit(1.0))
            def place(v):
                needle, hay = to_text(v[0]), to_text(v[1])
                if fold:
                    needle, hay = F.lower(needle), F.lower(hay)
                return F.call_function("locate", needle, hay, to_number(v[2])["num"].cast("int"))
            return spread([a[0], a[1], start], lambda v: let(place(v), lambda p: F.when(p > 0, value("number", p)).otherwise(error("#VALUE!"))))
        return at

    left = lambda t, n=None: F.substr(t, F.lit(1), (n if n is not None else F.lit(1)).cast("int"))
    right = lambda t, n=None: F.when((n if n is not None else F.lit(1)) >= F.length(t), t).otherwise(F.substr(t, (F.length(t) - (n if n is not None else F.lit(1)) + 1).cast("int"), (n if n is not None else F.lit(1)).cast("int")))
    return {
        "IF": (2, 3, choose), "IFERROR": (2, 2, lambda a: let(a[0], lambda v: F.when(v["kind"] == "error", a[1]).otherwise(v))),
        "IFNA": (2, 2, lambda a: let(a[0], lambda v: F.when((v["kind"] == "error") & (v["text"] == "#N/A"), a[1]).otherwise(v))),
        "AND": (1, 99, logic(all_of)), "OR": (1, 99, logic(any_of)), "XOR": (1, 99, logic(odd)), "NOT": (1, 1, logic(lambda c: ~c[0])),
        "TRUE": (0, 0, lambda a: value("boolean", F.lit(1))), "FALSE": (0, 0, lambda a: value("boolean", F.lit(0))),
        "ISNUMBER": (1, 1, kind("number")), "ISTEXT": (1, 1, kind("text")), "ISNONTEXT": (1, 1, kind("blank", "number", "boolean", "error")), "ISBLANK": (1, 1, kind("blank")), "ISLOGICAL": (1, 1, kind("boolean")),
        "ISERROR": (1, 1, kind("error")),
        "ISNA": (1, 1, lambda a: let(a[0], lambda v: F.when(v["kind"] == "unknown", v).otherwise(value("boolean", F.coalesce((v["kind"] == "error") & (v["text"] == "#N/A"), F.lit(False)).cast("int"))))),
        "ISERR": (1, 1, lambda a: let(a[0], lambda v: F.when(v["kind"] == "unknown", v).otherwise(value("boolean", F.coalesce((v["kind"] == "error") & (v["text"] != "#N/A"), F.lit(False)).cast("int"))))),
        "N": (1, 1, lambda a: let(a[0], lambda v: F.when(v["kind"].isin("error", "unknown"), v).when(v["kind"].isin("number", "boolean"), value("number", v["num"])).otherwise(value("number", F.lit(0.0))))),
        "VALUE": (1, 1, lambda a: let(a[0], to_number)),
        "ABS": (1, 1, num(F.abs)), "INT": (1, 1, num(F.floor)), "SIGN": (1, 1, num(F.signum)), "TRUNC": (1, 1, num(lambda n: F.signum(n) * F.floor(F.abs(n)))),
        "MOD": (2, 2, lambda a: numeric(a, lambda n: F.when(n[1] == 0, error("#DIV/0!")).otherwise(number(n[0] - n[1] * F.floor(n[0] / F.nullif(n[1], F.lit(0.0))))))),
        **{m: (2, 2, (lambda m: num(lambda n, d: excel_round(n, d, m)))(m)) for m in ("ROUND", "ROUNDUP", "ROUNDDOWN")},
        "LEN": (1, 1, lambda a: spread(a, lambda v: value("number", F.length(to_text(v[0]))))), "LOWER": (1, 1, text(F.lower)), "UPPER": (1, 1, text(F.upper)),
        "TRIM": (1, 1, text(lambda t: F.regexp_replace(F.trim(t), " +", " "))), "LEFT": (1, 2, text(left)), "RIGHT": (1, 2, text(right)),
        "MID": (3, 3, text(lambda t, i, n: F.substr(t, i.cast("int"), n.cast("int")))), "FIND": (2, 3, find(False)), "SEARCH": (2, 3, find(True)),
        "EXACT": (2, 2, lambda a: spread(a, lambda v: value("boolean", (to_text(v[0]) == to_text(v[1])).cast("int")))),
        **{p: (1, 1, (lambda p: lambda a: spread([let(a[0], to_number)], lambda n: date_part(n[0]["num"], p)))(p)) for p in ("YEAR", "MONTH", "DAY")},
        "WEEKDAY": (1, 2, lambda a: numeric(a if len(a) > 1 else [a[0], value("number", F.lit(1.0))], lambda n: F.when(n[1] == 1, number((F.floor(n[0]) + 6) % 7 + 1)).when(n[1] == 2, number((F.floor(n[0]) + 5) % 7 + 1)).when(n[1] == 3, number((F.floor(n[0]) + 5) % 7)).otherwise(error("#NUM!")))),
        "DATE": (3, 3, lambda a: numeric(a, lambda n: number(F.datediff(F.add_months(F.make_date(F.when(n[0] < 1900, n[0] + 1900).otherwise(n[0]).cast("int"), F.lit(1), F.lit(1)), (n[1] - 1).cast("int")), F.lit("1899-12-30").cast("date")) + n[2] - 1))),
    }


class _Parser:
    def __init__(self, text: str, names: dict[str, Column]):
        self.tokens, at = [], 0
        text = text.removeprefix("=")
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at, self.names, self.depth, self.functions = 0, names, 0, _functions()

    def peek(self) -> str | None:
        return self.tokens[self.at][3] if self.at < len(self.tokens) else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops:
            self.at += 1
            return self.tokens[self.at - 1][3]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise ValueError(f"expected {op!r}")

    def comparison(self) -> Column:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ValueError("expression too deep")
        left = self.joined()
        while op := self.take("=", "<>", "<", ">", "<=", ">="):
            left = compare(left, self.joined(), op)
        self.depth -= 1
        return left

    def joined(self) -> Column:
        left = self.sum()
        while self.take("&"):
            left = spread([left, self.sum()], lambda v: value("text", text=F.concat(to_text(v[0]), to_text(v[1]))))
        return left

    def sum(self) -> Column:
        left = self.product()
        while op := self.take("+", "-"):
            left = numeric([left, self.product()], (lambda op: lambda n: number(n[0] + n[1] if op == "+" else n[0] - n[1]))(op))
        return left

    def product(self) -> Column:
        left = self.power()
        while op := self.take("*", "/"):
            right = self.power()
            if op == "*":
                left = numeric([left, right], lambda n: number(n[0] * n[1]))
            else:
                left = numeric([left, right], lambda n: F.when(n[1] == 0, error("#DIV/0!")).otherwise(number(n[0] / F.nullif(n[1], F.lit(0.0)))))
        return left

    def power(self) -> Column:
        left = self.signed()
        while self.take("^"):  # left-associative, and looser than a sign
            left = numeric([left, self.signed()], lambda n: number(F.pow(n[0], n[1])))
        return left

    def signed(self) -> Column:
        if self.take("-"):
            return numeric([self.signed()], lambda n: number(-n[0]))
        if self.take("+"):
            return self.signed()
        out = self.atom()
        while self.take("%"):
            out = numeric([out], lambda n: number(n[0] / 100))
        return out

    def atom(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError("unexpected end")
        num, text, name, op = self.tokens[self.at]
        self.at += 1
        if num is not None:
            return value("number", F.lit(float(num)))
        if text is not None:
            return value("text", text=F.lit(text.replace('""', '"')))
        if op == "(":
            out = self.comparison()
            self.need(")")
            return out
        if name is None:
            raise ValueError(f"unexpected {op!r}")
        if self.take("("):
            arguments = []
            if not self.take(")"):
                arguments.append(self.comparison())
                while self.take(","):
                    arguments.append(self.comparison())
                self.need(")")
            if name.upper() not in self.functions:
                return value("unknown")
            least, most, how = self.functions[name.upper()]
            if not least <= len(arguments) <= most:
                return error("#VALUE!")
            return how(arguments)
        if name.upper() in ("TRUE", "FALSE"):
            return value("boolean", F.lit(int(name.upper() == "TRUE")))
        # a name that isn't given is unknown, not an error
        return self.names.get(name, value("unknown"))


def compile_expression(text: str, names: dict[str, Column]) -> Column:
    """The value struct of an expression; names are value structs (see ``from_cell``)."""
    parser = _Parser(text, names)
    out = parser.comparison()
    if parser.at < len(parser.tokens):
        raise ValueError("trailing text in expression")
    return out


def first_match(rules: list[tuple[int, Column, Column, bool]]) -> Column:
    """Conditional formats by priority: (priority, condition value, outcome, stop).  A rule that can't be decided stops with null."""
    out = F.lit(None)
    for _, condition, outcome, _stop in sorted(rules, key=lambda r: r[0], reverse=True):
        b = to_bool(condition)
        out = F.when(b["kind"].isin("unknown", "error"), F.lit(None)).when(b["num"] != 0, outcome).otherwise(out)
    return out
