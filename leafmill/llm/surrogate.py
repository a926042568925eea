"""PII: detected entities receive keyed surrogates of the same type and format.

Detection: e-mail addresses, phone numbers, payment cards (Luhn), IBANs (mod
97), IPv4 addresses, social-security numbers, assigned secrets, and names of
persons: after a title or led by a known given name, and names of any kind by
their shape (two or three capitalized words) and context (after a label such
as "Author:" or a salutation, before or after a verb that persons go with,
and beside another name).  A surname found once is found wherever it stands
alone in the same text.

Surrogates depend on (key, kind, normal form, attempt) alone, so a mention
gets the same surrogate in every document (coreference).  Numbers, addresses
and secrets go through a keyed permutation of the strings of their format
(Feistel network with cycle walking): lengths, character classes, separators,
country codes, check digits, address ranges and capitals stay, and distinct
entities stay distinct.  Given names map to names of the same gender and
script (those of unknown gender are spelled); surnames are spelled from syllables of their script with its gender endings.
Parts of a name are replaced one by one, so "Mr Berg" still fits "Jan Berg".

Collision checks run over the distinct entities of the whole corpus: an entity
whose surrogate equals its own original, another entity's surrogate, or (for
names) any original takes its next attempt until none is left (an error after
MAX_ATTEMPTS); only those exceptions are joined back to the documents, by text.

Null and empty texts pass unchanged; an empty table gives an empty one.
Repeated rows are rewritten alike, and extra columns of any name pass through.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

KEY = "leafmill"
MAX_ATTEMPTS = 1000

#: Titles by gender (None: it tells nothing).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "M.", "Señor", "Sr", "Sir", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "г-жа", "госпожа"),
    None: ("Dr", "Prof", "Professor", "доктор"),
}
#: Given names by (script, gender).
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Hans Karl Jürgen Stefan Pierre Jean Louis Carlos Juan Miguel Pedro".split(),
    ("latin", "f"): "Mary Anna Linda Susan Sarah Karen Laura Emily Julia Ursula Sabine Monika Claire Sophie Camille Marie Carmen Lucía Elena Isabel".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
_SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvw" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
}
_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_TITLE = {title: gender for gender, titles in TITLES.items() for title in titles}
#: First word of every title and given name; each match of _PERSON begins with one that stands between non-word characters.
_LEADS = {re.match(r"\w+", lead)[0] for lead in [*_GENDER, *_TITLE]}
_WORD = re.compile(r"\w+")

_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_LOWER = "a-zß-öø-ÿа-яё"
_NAME = rf"[{_UPPER}][{_LOWER}]+(?:-[{_UPPER}][{_LOWER}]+)?"
_PERSON = re.compile(
    rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(map(re.escape, _TITLE), key=len, reverse=True))})\.? (?:(?P<own>{'|'.join(sorted(_GENDER))})(?!\w) ?)?(?P<rest>{_NAME}(?: {_NAME})?)?"
    rf"|(?P<given>{'|'.join(sorted(_GENDER))}) (?P<surname>{_NAME}(?: {_NAME})?))"
)
_FULL = rf"{_NAME} {_NAME}(?: {_NAME})?"
#: Labels and salutations before a name, verbs after one, verbs before one.
_LABELS = "Name Author Contact Signed Customer Patient Employee Manager Sender Recipient Autor Kontakt Kunde Patientin Nom Auteur Client Nombre Cliente Имя Автор Клиент".split()
_SALUTES = "Dear Hello Hi Liebe Lieber Cher Chère Querido Querida Estimado Estimada Дорогой Дорогая".split()
_DOES = (
    "met said wrote told asked called lives lived works worked signed married emailed phoned joined replied visited thanked invited schrieb sagte traf wohnt arbeitet antwortete "
    "écrit habite travaille répondit dijo escribió vive trabaja respondió сказал сказала написал написала живёт работает"
).split()
_TAKES = "met told asked called married emailed phoned visited thanked invited traf fragte rencontra llamó".split()
_SHAPE = re.compile(
    rf"(?<!\w)(?:(?:(?:{'|'.join(_LABELS)}):|(?:{'|'.join(_SALUTES)}))[ \t]+(?P<labelled>{_FULL})(?!\w)"
    rf"|(?P<subject>{_FULL}) (?:{'|'.join(_DOES)})(?!\w)|(?:{'|'.join(_TAKES)}) (?P<object>{_FULL})(?!\w))"
)
_BESIDE = re.compile(rf"(?:,|,? (?:and|und|et|y|и)) ({_FULL})(?!\w)")
_HINTS = {*_LABELS, *_SALUTES, *_DOES, *_TAKES}
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i)\b(?:token|api[_-]?key|secret|passw(?:or)?d|auth)\b[\"']?\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_\-]{16,})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBER = re.compile(
    rf"(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w.])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w.])\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,4}(?!\.?\d)|(?<![\w.])\+\d{1,3}(?:\.\d{2,4}){2,4}(?!\.?\d)"
    r"|(?<![\w.])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.])(?:\d[ -]?){12,18}\d(?!\d))"
)
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IBAN_HINT = re.compile(r"[A-Z]{2}\d\d ?[A-Z0-9]")
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return -total % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


# -------------------------------------------------------------------- detection


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", name) else "latin"


def given_kind(name: str) -> str:
    """given:script:gender; gender n where it isn't known."""
    script, gender = _GENDER.get(name, (script_of(name), "n"))
    return f"given:{script}:{gender}"


def parts_of(at: int, name: str, led: bool) -> list[tuple[int, int, str, str]]:
    """Spans of the words of a name; led: the first is a given name (or a title, which stays)."""
    out = []
    for k, part in enumerate(name.split(" ")):
        first = led and not k
        if not (first and part in _TITLE):
            out.append((at, at + len(part), given_kind(part) if first else f"surname:{script_of(part)}", part))
        at += len(part) + 1
    return out


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, kind, normal form) in order, none overlapping; the earlier kind in this list wins."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    digits = _DIGIT.search(text)
    if digits or "=" in text or ":" in text:
        found += [(m.start("value"), m.end("value"), "secret", m["value"]) for m in _SECRET.finditer(text)]
    if digits:
        if _IBAN_HINT.search(text):
            for m in _IBAN.finditer(text):
                plain = m[0].replace(" ", "")
                if 15 <= len(plain) <= 34 and mod97(plain) == 1:
                    found.append((m.start(), m.end(), "iban", plain))
        at = digits.start() and max(0, digits.start() - 2)
        while m := _NUMBER.search(text, at):
            kind, found_, at = m.lastgroup, m[0], m.end()
            if kind == "phone":
                # a number that follows isn't part of it: at most 15 digits
                while sum(map(str.isdigit, found_)) > 15 and (shorter := re.match(r"(.*\d)[ .-]\d+\Z", found_)):
                    found_ = shorter[1]
                at = m.start() + len(found_)
            plain = re.sub(r"\D", "", found_)
            if kind == "ip":
                found.append((m.start(), at, kind, found_))
            elif kind == "phone" and 7 <= len(plain) <= 15:
                found.append((m.start(), at, kind, ("+" if found_[0] == "+" else "") + plain))
            elif kind == "ssn" or kind == "card" and luhn(plain[:-1]) == int(plain[-1]):
                found.append((m.start(), at, kind, plain))
    words = set(_WORD.findall(text))
    people: list[tuple[int, int, str, str]] = []
    if not _LEADS.isdisjoint(words):
        for m in _PERSON.finditer(text):
            given, rest = ("own", "rest") if m["title"] else ("given", "surname")
            if m[given]:
                people.append((m.start(given), m.end(given), given_kind(m[given]), m[given]))
            if m[rest]:
                people += parts_of(m.start(rest), m[rest], False)
    if not _HINTS.isdisjoint(words):
        at = 0
        while m := _SHAPE.search(text, at):
            name = m["labelled"] or m["subject"] or m["object"]
            start = m.start(m.lastgroup)
            people += parts_of(start, name, True)
            at = start + len(name)
            while beside := _BESIDE.match(text, at):
                people += parts_of(beside.start(1), beside[1], True)
                at = beside.end()
    if people:
        found += people
        alone = sorted({n for _, _, kind, n in people if kind.startswith("surname") and len(n) > 3} & words)
        if alone:
            found += [(m.start(), m.end(), f"surname:{script_of(m[0])}", m[0]) for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, alone))})(?!\w)", text)]
    out, end = [], 0
    for span in sorted(found, key=lambda s: (s[0], -s[1])):
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


# ------------------------------------------------------------------- surrogates


def prf(key: str, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key.encode()[:64], digest_size=32).digest(), "big")


def permute(value: int, size: int, key: str, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in range(8):
            a, b = b, a ^ (prf(key, tweak, size, r, b) & mask)
        value = a << half | b
        if value < size:
            return value


def reformat(text: str, key: str, tweak: str, hexadecimal: bool = False) -> str:
    """Permute the strings that have the character classes of text."""
    lower_hex = string.digits + "abcdef"
    sets = [
        lower_hex if hexadecimal and c in lower_hex else string.digits if c in string.digits
        else string.ascii_lowercase if c in string.ascii_lowercase else string.ascii_uppercase if c in string.ascii_uppercase else c
        for c in text
    ]
    value, size = 0, 1
    for c, s in zip(text, sets):
        value, size = value * len(s) + s.index(c), size * len(s)
    value = permute(value, size, key, f"{tweak}|{''.join('x' if len(s) == 16 else s[0] for s in sets)}")
    out = []
    for s in reversed(sets):
        value, r = divmod(value, len(s))
        out.append(s[r])
    return "".join(reversed(out))


def spelled(kind: str, name: str, key: str, attempt: int) -> str:
    """A surname of the same script; hyphens, and in Cyrillic the gender ending, stay."""
    script = kind.split(":")[1]
    table = _SYLLABLES[script]
    out = []
    for i, part in enumerate(name.split("-")):
        n = prf(key, kind, part, i, attempt)
        word = "".join(table[(n >> (16 * j)) % len(table)] for j in range(3 + attempt // 8))
        if script == "cyrillic":
            word += "ова" if part.endswith(("ова", "ева", "ина", "ая")) else "ов"
        else:
            word += "nrslt"[(n >> 200) % 5]
        out.append(word.capitalize())
    return "-".join(out)


def surrogate(kind: str, norm: str, key: str = KEY, attempt: int = 0) -> str:
    """The surrogate of a normal form, itself in normal form."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        keep = 2 if labels[-2:-1] == ["example"] else 1
        return f"{reformat(local, key, tweak)}@" + ".".join([reformat(x, key, f"domain|{attempt}") for x in labels[:-keep]] + labels[-keep:])
    if kind == "secret":
        return reformat(norm, key, tweak, hexadecimal=not set(norm) - set(string.digits + "abcdef"))
    if kind == "ip":
        a, b, c, d = map(int, norm.split("."))
        if 1 <= a <= 223:
            v = permute((((a - 1) * 256 + b) * 256 + c) * 256 + d, 223 << 24, key, tweak)
            a = (v >> 24) + 1
        else:
            v = permute((b * 256 + c) * 256 + d, 1 << 24, key, f"{tweak}|{a}")
        return f"{a}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}"
    if kind == "card":
        body = norm[0] + reformat(norm[1:-1], key, f"{tweak}|{norm[0]}")
        return body + str(luhn(body))
    if kind == "iban":
        body = reformat(norm[4:], key, f"{tweak}|{norm[:2]}")
        return f"{norm[:2]}{98 - mod97(norm[:2] + '00' + body):02d}{body}"
    if kind == "phone":
        keep = 0 if norm[0] != "+" else 2 if norm[1] in "17" else 3
        return norm[:keep] + reformat(norm[keep:], key, f"{tweak}|{norm[:keep]}")
    if kind == "ssn":
        return reformat(norm, key, tweak)
    if kind.startswith("given:") and not kind.endswith(":n"):
        _, script, gender = kind.split(":")
        names = GIVEN[(script, gender)]
        # a rotation of a keyed order: no name maps to itself, and no two to one
        order = sorted(range(len(names)), key=lambda i: prf(key, kind, names[i]))
        at = order.index(names.index(norm))
        return names[order[(at + 1 + attempt) % len(names)]]
    return spelled(kind, norm, key, attempt)


def written(kind: str, found: str, new: str) -> str:
    """new (a normal form) in the format of the mention found."""
    if kind in ("card", "phone", "ssn", "iban"):
        plain = iter(new.lstrip("+") if kind == "phone" else new)
        return "".join(next(plain) if c.isalnum() else c for c in found)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(found, new))
    return new


def rewrite(text: str, key: str = KEY, attempts: dict[tuple[str, str], int] | None = None, memory: dict | None = None) -> tuple[str, list[tuple[str, str]]]:
    """The text with surrogates, and its entities in order."""
    spans = detect(text)
    if not spans:
        return text, []
    memory = {} if memory is None else memory
    out, last = [], 0
    for a, b, kind, norm in spans:
        n = (attempts or {}).get((kind, norm), 0)
        new = memory.get((kind, norm, n))
        if new is None:
            if len(memory) > 200_000:
                memory.clear()
            new = memory[(kind, norm, n)] = surrogate(kind, norm, key, n)
        out += [text[last:a], written(kind, text[a:b], new)]
        last = b
    return "".join([*out, text[last:]]), [(k, n) for _, _, k, n in spans]


# ----------------------------------------------------------------------- corpus


def text_key(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string"))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (hash of the text, kind, norm) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, kind, norm)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for kind, norm in dict.fromkeys((k, n) for _, _, k, n in detect(text or ""))
            ]
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["key", "kind", "norm"])

    return docs.select(text_key(docs).alias("key"), docs["text"].cast("string")).mapInArrow(run, "key long, kind string, norm string")


def exceptions(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate collides."""

    @F.pandas_udf("string")
    def proposed(kind, norm, attempt):
        import pandas as pd

        return pd.Series([surrogate(k, n, key, int(a)) for k, n, a in zip(kind, norm, attempt)], dtype=object)

    spelled_out = F.col("kind").startswith("surname") | F.col("kind").endswith(":n")
    plain = materialize(mentions.select("kind", "norm").distinct(), "entities")
    table = plain.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        table = materialize(table.select("kind", "norm", "attempt", proposed("kind", "norm", "attempt").alias("new")), "surrogates")
        # of the entities that share a surrogate, the settled one (or else the first) keeps it
        shared = table.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("keeps")).where("n > 1")
        taken = table.where(spelled_out).select("kind", "new").join(plain.where(spelled_out).select("kind", F.col("norm").alias("new")), ["kind", "new"], "left_semi").distinct()
        judged = table.join(shared.select("kind", "new", F.col("keeps.norm").alias("keeps")), ["kind", "new"], "left")
        judged = judged.join(taken.withColumn("taken", F.lit(True)), ["kind", "new"], "left")
        clash = (F.col("new") == F.col("norm")) | F.coalesce(F.col("keeps") != F.col("norm"), F.lit(False)) | F.coalesce("taken", F.lit(False))
        judged = materialize(judged.select("kind", "norm", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")), "judged")
        if judged.where("clash").isEmpty():
            return judged.where("attempt > 0").select("kind", "norm", "attempt")
        table = judged.drop("clash")
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def pseudonymize(docs: DataFrame, key: str = KEY, kinds: str = "_kinds") -> DataFrame:
    """docs with text rewritten, and the kind of every mention in order (a column `kinds` is replaced)."""
    mentions = materialize(entities(docs), "mentions")
    odd = exceptions(mentions, key)
    mark, list_, new = fresh([*docs.columns, kinds], "_hash", "_odd", "_new")
    own = docs.withColumn(mark, text_key(docs))
    if odd.isEmpty():
        own = own.withColumn(list_, F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        by_text = mentions.join(odd, ["kind", "norm"]).groupBy("key").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias(list_))
        own = own.join(by_text.withColumnRenamed("key", mark), mark, "left")

    @F.pandas_udf("text string, kinds array<string>")
    def replaced(text, odd):
        import pandas as pd

        memory: dict = {}
        out = [
            (t, []) if t is None else rewrite(t, key, {(x["kind"], x["norm"]): x["attempt"] for x in (o if o is not None else [])}, memory)
            for t, o in zip(text, odd)
        ]
        return pd.DataFrame({"text": [t for t, _ in out], "kinds": [[k for k, _ in e] for _, e in out]})

    done = own.withColumn(new, replaced(F.col("text").cast("string"), F.col(list_)))
    return done.select(*[(F.col(f"{new}.text") if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns if c.lower() != kinds.lower()], F.col(f"{new}.kinds").alias(kinds))
