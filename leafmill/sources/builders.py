"""Small Office packages and PDFs written from rows: sinks of the engine, and inputs of its scans' tests."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict[str, str | bytes]) -> bytes:
    """A ZIP with fixed times, so equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


#: Characters that XML can't hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _t(text: str) -> str:
    lines = _UNFIT.sub(" ", text).split("\n")
    return "<w:br/>".join(f'<w:t xml:space="preserve">{escape(line)}</w:t>' for line in lines)


def docx(nodes: list[tuple[str, int, str]]) -> bytes:
    """A document of (kind, level, text)."""
    body = []
    for kind, level, text in nodes:
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if kind == "Heading" else f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr></w:pPr>' if kind == "ListItem" else ""
        if kind == "Table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r>{_t(c)}</w:r></w:p></w:tc>" for c in r.split("\t")) + "</w:tr>" for r in text.split("\n"))
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            body.append(f"<w:p>{style}<w:r>{_t(text)}</w:r></w:p>")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return package({
        "_rels/.rels": f'{_HEAD}<Relationships {_RELS}><Relationship Id="rId1" Type="{_TYPE}/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f"{_HEAD}<w:document {w}><w:body>{''.join(body)}</w:body></w:document>",
    })


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def xlsx(sheets: dict[str, list[tuple[int, int, str | None, str | None]]], hidden: tuple[str, ...] = ()) -> bytes:
    """Sheets of (row, column, value, formula); numbers are stored as such, other text inline."""
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', f'xmlns:r="{_TYPE}"'
    parts, names, links = {}, [], []
    for i, (name, cells) in enumerate(sheets.items(), 1):
        rows: dict[int, list[str]] = {}
        for row, col, value, formula in sorted(cells, key=lambda c: c[:2]):
            f = f"<f>{escape(formula.removeprefix('='))}</f>" if formula else ""
            v = "" if value is None else f"<is><t>{escape(value)}</t></is>"
            kind = ' t="inlineStr"' if value is not None else ""
            rows.setdefault(row, []).append(f'<c r="{letters(col)}{row}"{kind}>{f}{v}</c>')
        body = "".join(f'<row r="{k}">{"".join(v)}</row>' for k, v in sorted(rows.items()))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"{_HEAD}<worksheet {s}><sheetData>{body}</sheetData></worksheet>"
        state = ' state="hidden"' if name in hidden else ""
        names.append(f'<sheet name={quoteattr(name)} sheetId="{i}"{state} r:id="rId{i}"/>')
        links.append(f'<Relationship Id="rId{i}" Type="{_TYPE}/worksheet" Target="worksheets/sheet{i}.xml"/>')
    return package({
        "_rels/.rels": f'{_HEAD}<Relationships {_RELS}><Relationship Id="rId1" Type="{_TYPE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f"{_HEAD}<workbook {s} {r}><sheets>{''.join(names)}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f"{_HEAD}<Relationships {_RELS}>{''.join(links)}</Relationships>", **parts,
    })


def pptx(slides: list[list[tuple[int, str, int, int, int, int, str]]]) -> bytes:
    """Slides of (shape id, placeholder, x, y, w, h, text)."""
    ns = f'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="{_TYPE}"'
    parts, ids, links = {}, [], []
    for i, shapes in enumerate(slides, 1):
        body = "".join(
            f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="s{k}"/><p:cNvSpPr/><p:nvPr>{f"<p:ph type={quoteattr(ph)}/>" if ph else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm></p:spPr>'
            f"<p:txBody>{''.join(f'<a:p><a:r><a:t>{escape(line)}</a:t></a:r></a:p>' for line in text.split(chr(10)))}</p:txBody></p:sp>"
            for k, ph, x, y, w, h, text in shapes
        )
        parts[f"ppt/slides/slide{i}.xml"] = f"{_HEAD}<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
        ids.append(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>')
        links.append(f'<Relationship Id="rId{i}" Type="{_TYPE}/slide" Target="slides/slide{i}.xml"/>')
    return package({
        "ppt/presentation.xml": f"{_HEAD}<p:presentation {ns}><p:sldIdLst>{''.join(ids)}</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": f"{_HEAD}<Relationships {_RELS}>{''.join(links)}</Relationships>", **parts,
    })


def pdf(pages: list[list[tuple[float, float, float, str]]], height: float = 792.0) -> bytes:
    """Pages of (x, y from the top, size, text), Latin-1."""
    import zlib

    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for rows in pages:
        show = []
        for x, y, size, text in rows:
            raw = text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            show.append(b"BT /F1 %g Tf 1 0 0 1 %g %g Tm (%b) Tj ET" % (size, x, height - y, raw))
        data = zlib.compress(b"\n".join(show))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(data), data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /MediaBox [0 0 612 %g] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(objects), height))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%b] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"
