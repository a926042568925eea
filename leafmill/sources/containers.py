"""Container files: detection, safety gate, entries, and the contents of Office packages and simple PDFs.

Files come as rows (path, content) such as ``spark.read.format("binaryFile")``
gives; one file is one row, and every function here is one Arrow pass.  A file
that can't be read, or that the safety gate stops, yields one row with the
error and nothing else, never a failed job.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: The part that tells each package format, and its usual extensions.
PACKAGES = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
EXTENSIONS = {"docx": (".docx", ".docm"), "xlsx": (".xlsx", ".xlsm"), "pptx": (".pptx", ".pptm"), "pdf": (".pdf",)}
MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 10_000, 256 << 20, 1 << 30, 200

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def detect(path: str, content: bytes) -> tuple[str, str]:
    """(format, warnings) by content; the extension only warns."""
    found, warnings = "unknown", []
    if content[:5] == b"%PDF-":
        found = "pdf"
    elif content[:4] == b"PK\x03\x04":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
            found = next((f for part, f in PACKAGES.items() if part in names), "zip")
            if any(n.endswith("vbaProject.bin") for n in names):
                warnings.append("macros")
        except zipfile.BadZipFile:
            warnings.append("broken_zip")
    extension = posixpath.splitext(path.lower())[1]
    if found in EXTENSIONS and extension not in EXTENSIONS[found]:
        warnings.append("extension_mismatch")
    return found, ",".join(warnings)


def problems(content: bytes) -> list[tuple[str, str]]:
    """(code, entry) of what makes a package unsafe to open."""
    try:
        entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return [("broken_zip", "")]
    out = [("too_many_entries", str(len(entries)))] if len(entries) > MAX_ENTRIES else []
    if sum(e.file_size for e in entries) > MAX_TOTAL:
        out.append(("total_size", ""))
    for e in entries:
        name = e.filename.replace("\\", "/")
        if name.startswith("/") or ".." in name.split("/") or re.match(r"[A-Za-z]:", name):
            out.append(("path_traversal", e.filename))
        if e.file_size > MAX_ENTRY:
            out.append(("entry_size", e.filename))
        if e.file_size > MAX_RATIO * max(1, e.compress_size):
            out.append(("compression_ratio", e.filename))
    return out


def entries(content: bytes) -> list[tuple[str, int, int, str]]:
    z = zipfile.ZipFile(io.BytesIO(content))
    return [(e.filename, e.file_size, e.compress_size, hashlib.sha256(z.read(e)).hexdigest()) for e in z.infolist()]


def relationships(content: bytes) -> list[tuple[str, str, str, str, bool]]:
    """(source part, id, type, target part, external) of every relationship."""
    z, out = zipfile.ZipFile(io.BytesIO(content)), []
    for name in z.namelist():
        folder, base = posixpath.split(name)
        if posixpath.basename(folder) != "_rels" or not base.endswith(".rels"):
            continue
        owner = posixpath.join(posixpath.dirname(folder), base[:-5])
        for r in parse(z.read(name)).iter(f"{_REL}Relationship"):
            target, external = r.get("Target", ""), r.get("TargetMode") == "External"
            if not external:
                target = posixpath.normpath(posixpath.join(posixpath.dirname(owner), target)) if not target.startswith("/") else target[1:]
            out.append((owner, r.get("Id", ""), r.get("Type", "").rsplit("/", 1)[-1], target, external))
    return out


def media(content: bytes) -> list[tuple[str, str, int, str]]:
    """(path, type, bytes, sha256) of embedded pictures and other media."""
    types = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".emf": "image/emf", ".wmf": "image/wmf"}
    return [(n, types.get(posixpath.splitext(n.lower())[1], "application/octet-stream"), size, sha) for n, size, _, sha in entries(content) if "/media/" in n]


def parse(xml: bytes) -> ElementTree.Element:
    """Parse a part; document types and entities are refused."""
    if b"<!DOCTYPE" in xml[:4096] or b"<!ENTITY" in xml:
        raise ValueError("document type declarations are not allowed")
    return ElementTree.fromstring(xml)


# ------------------------------------------------------------------------- DOCX


def _runs(p: ElementTree.Element, view: str) -> str:
    out = []

    def walk(e: ElementTree.Element, deleted: bool) -> None:
        for c in e:
            if c.tag == f"{_W}del":
                if view != "final":
                    walk(c, True)
            elif c.tag == f"{_W}ins":
                if view != "reject":
                    walk(c, deleted)
            elif c.tag == f"{_W}r":
                properties = c.find(f"{_W}rPr")
                if properties is not None and properties.find(f"{_W}vanish") is not None:
                    continue
                for t in c:
                    if t.tag in (f"{_W}t", f"{_W}delText"):
                        out.append(t.text or "")
                    elif t.tag == f"{_W}tab":
                        out.append("\t")
                    elif t.tag == f"{_W}br":
                        out.append("\n")
            elif c.tag == f"{_M}t":
                out.append(c.text or "")
            elif c.tag not in (f"{_W}pPr", f"{_W}tbl", f"{_W}txbxContent", f"{_MC}AlternateContent"):
                walk(c, deleted)

    walk(p, False)
    return "".join(out)


def docx_nodes(content: bytes, view: str = "final") -> list[tuple[int, str, int, str]]:
    """(ord, kind, level, text) of a document's paragraphs, headings, list items and tables, notes and comments last."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    based, outline = {}, {}
    if "word/styles.xml" in names:
        for s in parse(z.read("word/styles.xml")).iter(f"{_W}style"):
            key = s.get(f"{_W}styleId")
            parent, level = s.find(f"{_W}basedOn"), s.find(f"{_W}pPr/{_W}outlineLvl")
            named = re.match(r"heading (\d)", (s.find(f"{_W}name").get(f"{_W}val", "") if s.find(f"{_W}name") is not None else "").lower())
            based[key] = parent.get(f"{_W}val") if parent is not None else None
            if level is not None:
                outline[key] = int(level.get(f"{_W}val")) + 1
            elif named:
                outline[key] = int(named[1])

    def level_of(style: str | None) -> int:
        seen = set()
        while style and style not in seen:
            if style in outline:
                return outline[style]
            m = re.fullmatch(r"Heading([1-9])", style)
            if m:
                return int(m[1])
            seen.add(style)
            style = based.get(style)
        return 0

    out: list[tuple[int, str, int, str]] = []

    def add(kind: str, level: int, text: str) -> None:
        if text:
            out.append((len(out), kind, level, text))

    def table_text(table: ElementTree.Element) -> str:
        return "\n".join("\t".join(cell_text(c) for c in r.findall(f"{_W}tc")) for r in table.findall(f"{_W}tr"))

    def cell_text(cell: ElementTree.Element) -> str:
        """Paragraphs of a cell, and the tables nested in it in brackets."""
        parts = []
        for e in cell:
            if e.tag == f"{_W}p":
                parts.append(_runs(e, view))
            elif e.tag == f"{_W}tbl":
                parts.append(f"[{table_text(e)}]")
            elif e.tag == f"{_W}sdt" and e.find(f"{_W}sdtContent") is not None:
                parts.append(cell_text(e.find(f"{_W}sdtContent")))
        return "\n".join(t for t in parts if t)

    def boxes(p: ElementTree.Element) -> None:
        """Text boxes anchored in a paragraph follow it; of alternate contents the first choice counts."""
        for e in p:
            if e.tag == f"{_MC}AlternateContent":
                first = e.find(f"{_MC}Choice")
                boxes(first if first is not None else e)
            elif e.tag == f"{_W}txbxContent":
                walk(e)
            else:
                boxes(e)

    def walk(body: ElementTree.Element) -> None:
        for e in body:
            if e.tag == f"{_W}p":
                style = e.find(f"{_W}pPr/{_W}pStyle")
                level = level_of(style.get(f"{_W}val") if style is not None else None)
                number = e.find(f"{_W}pPr/{_W}numPr")
                depth = number.find(f"{_W}ilvl") if number is not None else None
                if level:
                    add("Heading", level, _runs(e, view))
                elif number is not None:
                    add("ListItem", int(depth.get(f"{_W}val")) if depth is not None else 0, _runs(e, view))
                else:
                    add("Paragraph", 0, _runs(e, view))
                boxes(e)
            elif e.tag == f"{_W}tbl":
                add("Table", 0, table_text(e))
            elif e.tag == f"{_W}sdt":
                content_ = e.find(f"{_W}sdtContent")
                if content_ is not None:
                    walk(content_)

    walk(parse(z.read("word/document.xml")).find(f"{_W}body"))
    for part, tag, kind in (("footnotes", "footnote", "Footnote"), ("endnotes", "endnote", "Endnote"), ("comments", "comment", "Comment")):
        if f"word/{part}.xml" in names:
            for note in parse(z.read(f"word/{part}.xml")).findall(f"{_W}{tag}"):
                if note.get(f"{_W}type") not in ("separator", "continuationSeparator"):
                    add(kind, 0, "\n".join(t for t in (_runs(p, view) for p in note.iter(f"{_W}p")) if t))
    return out


# ------------------------------------------------------------------------- XLSX


_ROW, _CELL, _VALUE, _FORMULA, _INLINE, _COLUMN, _MERGE, _TEXT, _RUN = (f"{_S}{x}" for x in ("row", "c", "v", "f", "is", "col", "mergeCell", "t", "r"))
_REF = re.compile(r"([A-Z]+)(\d+)")


@lru_cache(20_000)
def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    m = _REF.match(ref)
    return int(m[2]), _column(m[1])


def _plain(item: ElementTree.Element) -> str:
    """Text of a string item: its own and that of its runs, without phonetic readings."""
    out = []
    for e in item:
        if e.tag == _TEXT:
            out.append(e.text or "")
        elif e.tag == _RUN:
            out += [t.text or "" for t in e if t.tag == _TEXT]
    return "".join(out)


#: A cell reference outside of quotes, and what is quoted.
_REFERENCE = re.compile(r"\"[^\"]*\"|'[^']*'|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)([1-9]\d*)(?![\w(.!])")


def letters_of(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shifted(formula: str, rows: int, columns: int) -> str:
    """A formula moved by rows and columns: references without a dollar sign move along, those off the sheet are errors."""

    def move(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        column, row = _place(m[2] + "1")[1] + (0 if m[1] else columns), int(m[4]) + (0 if m[3] else rows)
        return "#REF!" if column < 1 or row < 1 else f"{m[1]}{letters_of(column)}{m[3]}{row}"

    return _REFERENCE.sub(move, formula)


def xlsx_cells(content: bytes) -> list[tuple]:
    """(sheet, state, row, col, value, type, formula, style, hidden_row, hidden_col, merged_to_row, merged_to_col) of filled cells.

    Rows and cells without a reference follow the one before; a shared formula is moved to each cell that has it.
    """
    z = zipfile.ZipFile(io.BytesIO(content))
    strings = []
    if "xl/sharedStrings.xml" in z.namelist():
        strings = [_plain(si) for si in parse(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    targets = {(o, i): t for o, i, _, t, _ in relationships(content)}
    out = []
    for sheet in parse(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        part = targets.get(("xl/workbook.xml", sheet.get(f"{_R}id")))
        if part not in z.namelist():
            continue
        merged, hidden_columns, rows, shared = {}, [], [], {}
        with z.open(part) as f:
            row = 0
            for _, e in ElementTree.iterparse(f):
                tag = e.tag
                if tag == _ROW:
                    row, column, hidden_row = int(e.get("r") or row + 1), 0, e.get("hidden") in ("1", "true")
                    for cell in e:
                        if cell.tag != _CELL:
                            continue
                        ref, kind = cell.get("r"), cell.get("t", "n")
                        at = _place(ref) if ref else (row, column + 1)
                        column, raw, formula = at[1], None, None
                        for child in cell:
                            if child.tag == _VALUE:
                                raw = child.text or ""
                            elif child.tag == _INLINE:
                                raw = _plain(child)
                            elif child.tag == _FORMULA:
                                formula, number = child.text or "", child.get("si")
                                if child.get("t") == "shared":
                                    if formula:
                                        shared[number] = (at, formula)
                                    elif number in shared:
                                        (r0, c0), first = shared[number]
                                        formula = shifted(first, at[0] - r0, at[1] - c0)
                        if kind == "s" and raw is not None:
                            raw = strings[int(raw)]
                        elif kind == "b":
                            raw = "TRUE" if raw == "1" else "FALSE"
                        if raw is not None or formula is not None:
                            rows.append((*at, raw, kind, formula, int(cell.get("s", 0)), hidden_row))
                    e.clear()
                elif tag == _COLUMN and e.get("hidden") in ("1", "true"):
                    hidden_columns.append((int(e.get("min")), int(e.get("max"))))
                elif tag == _MERGE:
                    a, _, b = e.get("ref").partition(":")
                    merged[_place(a)] = _place(b or a)
        for r, c, raw, kind, formula, style, hidden in rows:
            end = merged.get((r, c), (None, None))
            out.append((sheet.get("name"), sheet.get("state", "visible"), r, c, raw, kind, formula, style, hidden, any(a <= c <= b for a, b in hidden_columns), *end))
    return out


# ------------------------------------------------------------------------- PPTX


def pptx_shapes(content: bytes) -> list[tuple[int, int, str, int, int, int, int, str]]:
    """(slide, shape id, placeholder, x, y, w, h, text) with group offsets applied; notes have the placeholder "notes"."""
    z = zipfile.ZipFile(io.BytesIO(content))
    links = relationships(content)
    target = {(o, i): t for o, i, _, t, _ in links}
    out = []

    def walk(tree, slide, scale, note):
        ax, ay, bx, by = scale
        for e in tree:
            if e.tag == f"{_P}grpSp":
                f = e.find(f"{_P}grpSpPr/{_A}xfrm")
                inner = scale
                if f is not None and f.find(f"{_A}chExt") is not None:
                    off, ext, ch, chx = (f.find(f"{_A}{n}") for n in ("off", "ext", "chOff", "chExt"))
                    kx, ky = int(ext.get("cx")) / max(1, int(chx.get("cx"))), int(ext.get("cy")) / max(1, int(chx.get("cy")))
                    inner = (ax * kx, ay * ky, ax * (int(off.get("x")) - kx * int(ch.get("x"))) + bx, ay * (int(off.get("y")) - ky * int(ch.get("y"))) + by)
                walk(e, slide, inner, note)
            elif e.tag == f"{_P}sp":
                f = e.find(f"{_P}spPr/{_A}xfrm")
                x = y = w = h = 0
                if f is not None:
                    x, y = int(f.find(f"{_A}off").get("x")), int(f.find(f"{_A}off").get("y"))
                    w, h = int(f.find(f"{_A}ext").get("cx")), int(f.find(f"{_A}ext").get("cy"))
                ph = e.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                kind = "notes" if note else ph.get("type", "body") if ph is not None else ""
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in e.iter(f"{_A}p"))
                if note and ph is not None and ph.get("type") != "body":
                    continue
                out.append((slide, int(e.find(f"{_P}nvSpPr/{_P}cNvPr").get("id")), kind, round(ax * x + bx), round(ay * y + by), round(ax * w), round(ay * h), text))

    one = (1.0, 1.0, 0.0, 0.0)
    for n, s in enumerate(parse(z.read("ppt/presentation.xml")).iter(f"{_P}sldId"), 1):
        part = target.get(("ppt/presentation.xml", s.get(f"{_R}id")))
        walk(parse(z.read(part)).find(f"{_P}cSld/{_P}spTree"), n, one, False)
        for o, _, kind, t, _ in links:
            if o == part and kind == "notesSlide":
                walk(parse(z.read(t)).find(f"{_P}cSld/{_P}spTree"), n, one, True)
    return out


# -------------------------------------------------------------------------- PDF

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_SHOW = re.compile(
    rb"\((?P<text>(?:\\.|[^\\()])*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|/(?P<name>[^\s/<>\[\](){}%]+)|(?P<open>\[)|(?P<close>\])|(?P<op>[A-Za-z'\"*]+)", re.S
)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> bytes:
    """The bytes of a literal string."""
    return re.sub(rb"\\(\r\n|[0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPED.get(m[1], m[1]), raw, flags=re.S)


def _hex(raw: bytes) -> bytes:
    digits = b"".join(raw.split()).decode()
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


def _inflate(data: bytes) -> bytes:
    """Inflated to MAX_ENTRY bytes at most; more is an error, a cut stream gives what it has."""
    d = zlib.decompressobj()
    out = d.decompress(data, MAX_ENTRY)
    if d.unconsumed_tail:
        raise ValueError("a stream is too large")
    return out


def _stream(body: bytes) -> bytes:
    m, size = re.search(rb"stream\r?\n", body), re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body)
    if not m:
        return b""
    end = m.end() + int(size[1]) if size else body.rfind(b"endstream")
    data = body[m.end() : end]
    return _inflate(data) if b"/FlateDecode" in body[: m.start()] else data


def _objects(content: bytes) -> dict[int, bytes]:
    """Bodies of all objects by number, those in object streams included; later ones replace earlier ones."""
    out = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body[:500]):
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            data = _stream(body)
            heads = [int(x) for x in data[:first].split()[: 2 * n]]
            starts = heads[1::2] + [len(data) - first]
            for number, a, b in zip(heads[::2], starts, starts[1:]):
                out.setdefault(number, data[first + a : first + b])
    return out


def _unicode_map(cmap: bytes) -> tuple[dict[int, str], int]:
    """Texts by code, and bytes of a code, of a ToUnicode stream."""
    out: dict[int, str] = {}
    text = lambda h: _hex(h).decode("utf-16-be", "replace")
    width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, to, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            if several:
                for k, one in enumerate(re.findall(rb"<([0-9A-Fa-f\s]*)>", several)):
                    out[int(lo, 16) + k] = text(one)
            else:
                first = text(to)
                for code in range(int(lo, 16), min(int(hi, 16), int(lo, 16) + 0xFFFF) + 1):
                    out[code] = first[:-1] + chr(min(0x10FFFF, ord(first[-1]) + code - int(lo, 16))) if first else ""
    return out, len(width[1]) // 2 if width else 1


def _times(a: list[float], b: list[float]) -> list[float]:
    """The matrix that applies a, then b."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def pdf_fragments(content: bytes) -> list[tuple[int, int, float, float, float, str]]:
    """(page, fragment, x, y, font size, text) of text shows: plain or deflated streams, object streams, forms.

    Codes become text by the font's ToUnicode map, else one byte is one character.  Invisible text (mode 3) is skipped; y
    grows downwards from the page's top.  Encrypted files are an error.
    """
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise ValueError("the file is encrypted")
    objects = _objects(content)
    fonts: dict[int, tuple[dict[int, str], int]] = {}

    def entry(body: bytes, name: bytes) -> bytes:
        """A dictionary or reference behind a name, references followed."""
        m = re.search(rb"/" + name + rb"\s*(?:(\d+)\s+\d+\s+R|(<<))", body)
        if not m:
            return b""
        if m[1]:
            return objects.get(int(m[1]), b"")
        depth, at = 0, m.start(2)
        for k in re.finditer(rb"<<|>>", body[at:]):
            depth += 1 if k[0] == b"<<" else -1
            if not depth:
                return body[at : at + k.end()]
        return body[at:]

    def font(resources: bytes, name: str) -> tuple[dict[int, str], int]:
        m = re.search(rb"/" + re.escape(name.encode("latin-1")) + rb"\s+(\d+)\s+\d+\s+R", entry(resources, b"Font"))
        number = int(m[1]) if m else -1
        if number not in fonts:
            body = objects.get(number, b"")
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)
            found, width = _unicode_map(_stream(objects.get(int(to[1]), b""))) if to else ({}, 1)
            fonts[number] = (found, 2 if re.search(rb"/Subtype\s*/Type0\b", body) else width)
        return fonts[number]

    def kids(number: int, box, resources, seen):
        body = objects.get(number, b"")
        if number in seen:
            return
        seen.add(number)
        own = re.search(rb"/MediaBox\s*\[\s*([-\d.\s]+)\]", body)
        box, resources = [float(x) for x in own[1].split()] if own else box, entry(body, b"Resources") or resources
        if re.search(rb"/Type\s*/Pages\b", body):
            found = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            for k in re.findall(rb"(\d+)\s+\d+\s+R", found[1] if found else b""):
                yield from kids(int(k), box, resources, seen)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body, box, resources

    root = re.search(rb"/Type\s*/Catalog\b.*?/Pages\s+(\d+)\s+\d+\s+R|/Pages\s+(\d+)\s+\d+\s+R.*?/Type\s*/Catalog\b", b" ".join(objects.values()), re.S)
    if not root:
        raise ValueError("no page tree")
    out: list[tuple[int, int, float, float, float, str]] = []
    for page, (body, box, resources) in enumerate(kids(int(root[1] or root[2]), [0.0, 0.0, 612.0, 792.0], b"", set()), 1):
        found = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body, re.S)
        data = b"\n".join(_stream(objects.get(int(k), b"")) for k in re.findall(rb"(\d+)\s+\d+\s+R", (found[1] or found[2]) if found else b""))
        first = len(out)

        def shows(data: bytes, resources: bytes, ctm: list[float], open_forms: frozenset) -> None:
            """The text shows of a content stream, in order."""
            stack, array, size, mode, leading = [], None, 0.0, 0, 0.0
            line, saved, used = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [], ({}, 1)

            def text_of(raw: bytes) -> str:
                table, width = used
                if not table:
                    return raw.decode("utf-16-be", "replace")[1:] if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
                return "".join(table.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))

            def show(text: str) -> None:
                if text and mode != 3:
                    at = _times(line, ctm)
                    out.append((page, len(out) - first, at[4], box[3] - at[5], round(size * (at[3] or 1.0), 3), text))

            def move(x: float, y: float) -> None:
                line[4], line[5] = line[4] + x * line[0] + y * line[2], line[5] + x * line[1] + y * line[3]

            for t in _SHOW.finditer(data):
                if t["op"] is None:
                    if t["open"]:
                        array = []
                    elif t["close"]:
                        stack.append(array or [])
                        array = None
                    else:
                        v = _literal(t["text"]) if t["text"] is not None else _hex(t["hex"]) if t["hex"] is not None else float(t["number"]) if t["number"] is not None else t["name"].decode("latin-1")
                        (stack if array is None else array).append(v)
                    continue
                op = t["op"]
                try:
                    if op == b"BT":
                        line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
                    elif op == b"q":
                        saved.append((ctm, size, mode, leading, used))
                    elif op == b"Q":
                        ctm, size, mode, leading, used = saved.pop()
                    elif op == b"cm":
                        ctm = _times(stack[-6:], ctm)
                    elif op == b"Tf":
                        size, used = stack[-1], font(resources, stack[-2])
                    elif op == b"Tr":
                        mode = int(stack[-1])
                    elif op == b"TL":
                        leading = stack[-1]
                    elif op in (b"Td", b"TD"):
                        leading = -stack[-1] if op == b"TD" else leading
                        move(stack[-2], stack[-1])
                    elif op == b"Tm":
                        line = list(stack[-6:])
                    elif op == b"T*":
                        move(0, -leading)
                    elif op == b"Tj":
                        show(text_of(stack[-1]))
                    elif op in (b"'", b'"'):
                        move(0, -leading)
                        show(text_of(stack[-1]))
                    elif op == b"TJ":
                        show("".join(text_of(x) if isinstance(x, bytes) else " " if x < -200 else "" for x in stack[-1]))
                    elif op == b"Do":
                        m = re.search(rb"/" + re.escape(stack[-1].encode("latin-1")) + rb"\s+(\d+)\s+\d+\s+R", entry(resources, b"XObject"))
                        form = objects.get(int(m[1]), b"") if m and int(m[1]) not in open_forms else b""
                        if re.search(rb"/Subtype\s*/Form\b", form):
                            place = re.search(rb"/Matrix\s*\[\s*([-\d.\s]+)\]", form)
                            inner = _times([float(x) for x in place[1].split()], ctm) if place else ctm
                            shows(_stream(form), entry(form, b"Resources") or resources, inner, open_forms | {int(m[1])})
                except (IndexError, TypeError, AttributeError):
                    pass
                stack = []

        shows(data, resources, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], frozenset())
    return out


# ------------------------------------------------------------------- DataFrames


#: Rows collected before they are passed on.
ROWS = 20_000


def scan(files: DataFrame, read: Callable[[bytes], list[tuple]], schema: str, gate: bool = True) -> DataFrame:
    """path, the rows that read gives of each content, and error: a file that fails, or that the gate stops, is one row with its error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def one(content: bytes) -> list[tuple]:
        stopped = problems(content) if gate and content[:4] == b"PK\x03\x04" else []
        if stopped:
            raise ValueError(f"{stopped[0][0]} {stopped[0][1]}".strip())
        return read(content)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"]):
                try:
                    out += [(path, *row, None) for row in one(bytes(content))]
                except Exception as e:  # noqa: BLE001  a broken file is a row of its own
                    out.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=["path", *names, "error"], dtype=object)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["path", *names, "error"], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}, error string")


def failures(rows: DataFrame) -> DataFrame:
    """path and message of the files that a scan could not read."""
    return rows.where("error is not null").select("path", "error")


def formats(files: DataFrame) -> DataFrame:
    def run(parts):
        for part in parts:
            found = [detect(p, bytes(c)) for p, c in zip(part["path"], part["content"])]
            yield pd.DataFrame({"path": part["path"], "format": [f for f, _ in found], "warnings": [w for _, w in found]})

    return files.select("path", "content").mapInPandas(run, "path string, format string, warnings string")


SCANS = {
    "docx": (docx_nodes, "ord int, kind string, level int, text string"),
    "xlsx": (xlsx_cells, "sheet string, state string, row_no int, col_no int, value string, cell_type string, formula string, style_id int, hidden_row boolean, hidden_col boolean, merged_to_row int, merged_to_col int"),
    "pptx": (pptx_shapes, "slide int, shape_id int, placeholder string, x long, y long, w long, h long, text string"),
    "pdf": (pdf_fragments, "page int, frag_id int, x double, y double, font_size double, text string"),
    "entries": (entries, "entry string, bytes long, compressed long, sha256 string"),
    "relationships": (relationships, "source string, id string, type string, target string, external boolean"),
    "media": (media, "entry string, type string, bytes long, sha256 string"),
    "problems": (problems, "code string, entry string"),
}


def read_files(files: DataFrame, kind: str) -> DataFrame:
    """One of SCANS over files (path, content)."""
    read, schema = SCANS[kind]
    return scan(files, read, schema, gate=kind != "problems")
