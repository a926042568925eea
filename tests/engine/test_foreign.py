"""Container files as other writers lay them out, as literal parts."""

import io
import zipfile
import zlib

import pytest

from leafmill.plans import files
from leafmill.sources import adapter
from leafmill.sources import containers as c

S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(rows, strings=""):
    return package({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="rId7" Type="t/worksheet" Target="worksheets/first.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}>{strings}</sst>",
        "xl/worksheets/first.xml": f"<worksheet {S}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref='A1:B2'/></mergeCells></worksheet>",
    })


def cells(content):
    return [(r, k, v, f) for _, _, r, k, v, _, f, *_ in c.xlsx_cells(content)]


def test_phonetic_readings_are_no_text():
    strings = "<si><r><t>東</t></r><r><t>京</t></r><rPh sb='0' eb='2'><t>トウキョウ</t></rPh></si><si><t>plain</t></si>"
    assert cells(workbook("<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row>", strings)) == [(1, 1, "東京", None), (1, 2, "plain", None)]


def test_shared_formulas_move():
    rows = (
        "<row r='2'><c r='B2'><f t='shared' si='0' ref='B2:C3'>A2*$D$1+SUM(A$1:A2)&amp;\"A2\"+'A2'!A2</f><v>1</v></c><c r='C2'><f t='shared' si='0'/><v>2</v></c></row>"
        "<row r='3'><c r='B3'><f t='shared' si='0'/><v>3</v></c></row>"
    )
    assert [f for *_, f in cells(workbook(rows))] == ["A2*$D$1+SUM(A$1:A2)&\"A2\"+'A2'!A2", "B2*$D$1+SUM(B$1:B2)&\"A2\"+'A2'!B2", "A3*$D$1+SUM(A$1:A3)&\"A2\"+'A2'!A3"]
    assert c.shifted("A1+LOG10(B2)+Z1", -1, 0) == "#REF!+LOG10(B1)+#REF!" and c.shifted("Z9", 1, 1) == "AA10"


def test_cells_without_references():
    assert cells(workbook("<row><c><v>1</v></c><c><v>2</v></c></row><row><c r='D2'><v>3</v></c><c><v>4</v></c></row>")) == [(1, 1, "1", None), (1, 2, "2", None), (2, 4, "3", None), (2, 5, "4", None)]


def test_text_boxes_and_nested_tables():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    box = f"<w:r><mc:AlternateContent><mc:Choice><w:drawing><w:txbxContent>{p('in the box')}</w:txbxContent></w:drawing></mc:Choice><mc:Fallback><w:pict><w:txbxContent>{p('in the box')}</w:txbxContent></w:pict></mc:Fallback></mc:AlternateContent></w:r>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>"
    body = f"<w:document {W} xmlns:mc='http://schemas.openxmlformats.org/markup-compatibility/2006' xmlns:m='http://schemas.openxmlformats.org/officeDocument/2006/math'><w:body><w:p><w:r><w:t>before</w:t></w:r>{box}</w:p>{table}<w:p><m:oMath><m:r><m:t>x+1</m:t></m:r></m:oMath></w:p></w:body></w:document>"
    assert [(k, t) for _, k, _, t in c.docx_nodes(package({"word/document.xml": body}))] == [("Paragraph", "before"), ("Paragraph", "in the box"), ("Table", "a\n[x\ty]\nb\tc"), ("Paragraph", "x+1")]


def pdf(objects, packed=()):
    """A file with some objects in an object stream."""
    out = b"%PDF-1.5\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    if packed:
        heads, data = b"", b""
        for n, body in packed:
            heads += b"%d %d " % (n, len(data))
            data += body + b" "
        z = zlib.compress(heads + data)
        out += b"90 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(packed), len(heads), len(z), z)
    return out + b"%%EOF"


def stream(data, more=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


def test_compressed_objects_and_unicode_maps():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <6771> <0004> <4EAC> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange 1 beginbfrange <0020> <0021> [<0066006C> <00E9>] endbfrange"
    content = pdf(
        {5: stream(b"BT /F1 12 Tf 1 0 0 1 10 90 Tm <00030004> Tj 0 -20 Td [<0010> -50 <00110012> -300 <0020>] TJ <0021> Tj ET q 1 0 0 1 5 5 cm /X1 Do Q"), 7: stream(cmap),
         8: stream(b"BT /F2 10 Tf 10 10 Td (plain \\(one\\)) Tj ET", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Resources << /Font << /F2 9 0 R >> >>")},
        [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >>"),
         (3, b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 6 0 R >> /XObject << /X1 8 0 R >> >> >>"), (6, b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"), (9, b"<< /Type /Font /Subtype /Type1 >>")],
    )
    assert c.pdf_fragments(content) == [(1, 0, 10, 10, 12, "東京"), (1, 1, 10, 30, 12, "ABC fl"), (1, 2, 10, 30, 12, "é"), (1, 3, 115, 85, 10, "plain (one)")]
    with pytest.raises(ValueError):
        c.pdf_fragments(b"%PDF-1.5\ntrailer << /Encrypt 4 0 R >>")


def test_bombs_and_broken_files_are_rows(spark):
    bomb = pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(bytes(300 << 20), 9) + b"\nendstream"})
    files = [("bomb.pdf", bomb), ("none.pdf", b"%PDF-1.4"), ("good.pdf", pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: stream(b"BT /F 9 Tf (x) Tj ET")}))]
    rows = {r["path"]: r for r in c.read_files(spark.createDataFrame(files, "path string, content binary"), "pdf").collect()}
    assert rows["good.pdf"]["text"] == "x" and rows["good.pdf"]["error"] is None
    assert "too large" in rows["bomb.pdf"]["error"] and "page tree" in rows["none.pdf"]["error"]
    sheets = [("bad.xlsx", b"no zip"), ("bomb.xlsx", package({"xl/workbook.xml": "0" * 5_000_000}))]
    rows = {r["path"]: r["error"] for r in c.read_files(spark.createDataFrame(sheets, "path string, content binary"), "xlsx").collect()}
    assert "BadZipFile" in rows["bad.xlsx"] and "compression_ratio" in rows["bomb.xlsx"]


def test_the_bomb_is_built_once():
    assert files._bomb() is files._bomb() and c.problems(files._bomb()) == [("compression_ratio", "bomb.txt")]


def test_small_files_share_a_task(spark, tmp_path):
    small = [(f"f{i}", 1000) for i in range(adapter.FILES + 20)]
    assert [len(x) for x in adapter.packed(small)] == [adapter.FILES, 20] and adapter.packed([]) == []
    assert adapter.packed([("a", 1), ("b", adapter.BYTES + 1), ("c", adapter.BYTES), ("d", 0)]) == [["a"], ["b"], ["c", "d"]]
    for i in range(30):
        (tmp_path / f"{i}.xlsx").write_bytes(workbook(f"<row r='1'><c r='A1'><v>{i}</v></c></row>"))
    adapter.register(spark)
    found = spark.read.format("leafmill_files").option("kind", "xlsx").load(str(tmp_path))
    assert sorted((r["path"], r["value"]) for r in found.collect()) == sorted((f"{i}.xlsx", str(i)) for i in range(30))
    assert found.rdd.getNumPartitions() == 1
