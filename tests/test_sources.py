import datetime as dt
import io
import os
import random
import re
import struct
import zipfile
import zlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.operators.export import ExportPlan, first_headers, pick, with_sheet_name
from quillet.operators.rules import Validation
from quillet.plans import documents
from quillet.plans.documents import stress_rows
from quillet.sources import archive, compound, docx, docx_writer, encryption, envelope, images, package, xlsx, xlsx_writer
from quillet.sources.xlsx_writer import CellStyle, Commented, Formula, Link, Options, Sheet, Styled, WorkbookWriter

PNG = bytes.fromhex("89504e470d0a1a0a0000000d494844520000000a000000140802000000aabbccdd000000097048597300000ec400000ec401952b0e1b") + b"\0\0\0\0IEND\0\0\0\0"


def book(*sheets, options=None, **more):
    out = io.BytesIO()
    w = WorkbookWriter(out, options)
    for sheet, rows in sheets:
        w.add_sheet(sheet)
        w.write_rows(rows)
    for k, v in more.items():
        w.define_name(k, v)
    w.close()
    return out.getvalue()


def cells(data, index=0, **options):
    return {(r, c): (k, v) for r, c, k, v, _ in xlsx.Workbook(data, **options).cells(index)}


def test_cell_types_round_trip():
    day, time = dt.date(2026, 1, 15), dt.datetime(2026, 1, 15, 14, 30, 45)
    rows = [["a", 42, 1234567890123, 123.45, True, False, None, day, time, dt.timedelta(hours=36.5), "  edge ", "a", "x\x01y", 2**53, float("nan")]]
    for inline in (False, True):
        got = cells(book(("S", rows), options=Options(inline_strings=inline)))
        assert got == {
            (1, 1): ("string", "a"), (1, 2): ("number", 42.0), (1, 3): ("number", 1234567890123.0), (1, 4): ("number", 123.45), (1, 5): ("bool", True), (1, 6): ("bool", False),
            (1, 8): ("date", dt.datetime(2026, 1, 15)), (1, 9): ("date", time), (1, 10): ("date", dt.datetime(1899, 12, 31, 12, 30)), (1, 11): ("string", "  edge "), (1, 12): ("string", "a"), (1, 13): ("string", "xy"), (1, 14): ("number", float(2**53)), (1, 15): ("string", "nan"),
        }
    assert cells(book(("S", [[day]])), auto_dates=False) == {(1, 1): ("number", 46037.0)}
    assert cells(book(("S", [[Styled(day, CellStyle(format="0.00"))]]))) == {(1, 1): ("number", 46037.0)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.booleans(), st.integers(-(2**50), 2**50), st.floats(allow_nan=False, allow_infinity=False), st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="￾￿"), min_size=1, max_size=20)), max_size=6), max_size=6))
def test_any_values_round_trip(rows):
    got = cells(book(("S", rows)))
    want = {(i, j): v for i, r in enumerate(rows, 1) for j, v in enumerate(r, 1) if v is not None}
    assert {k: v for k, (_, v) in got.items()} == want


def test_features_are_in_the_schema_order():
    s = Sheet("Data", {1: 20}, freeze_rows=1, freeze_columns=1, merges=["A5:B5"], auto_filter="A1:B3", validations=[("A2", Validation.list('say "x"', "b")), ("B2", Validation.whole_number(1, 5)), ("C2", Validation.list_from_range("Other!$A$1:$A$3"))], header_footer={"header_center": "Top", "footer_right": "&P"})
    s.protect("pw", sort=True)
    s.color_scale("B2:B3", ("FF0000", "FFFFFF", "00FF00"))
    s.data_bar("B2:B3", "0000FF")
    s.cell_is("B2:B3", "between", 1, 5)
    data = book((s, [["h", Link("http://x.y/?a=1&b=2", "go", "tip")], [Commented("v", "a note", "me"), Formula("=SUM(B1:B2)")], [Styled("s", CellStyle(bold=True, fill="#aabbcc", border="thin"))]]), ("Other", [["q"]]), TaxRate="0.18")
    w = xlsx.Workbook(data)
    xml = w.package.read("xl/worksheets/sheet1.xml").decode()
    order = ["<sheetViews>", "<cols>", "<sheetData>", "<sheetProtection", "<autoFilter", "<mergeCells", "<conditionalFormatting", "<dataValidations", "<hyperlinks>", "<headerFooter>", "<legacyDrawing"]
    assert [xml.index(x) for x in order] == sorted(xml.index(x) for x in order)
    assert w.defined_names == {"TaxRate": "0.18"} and [n for n, _ in w.sheets] == ["Data", "Other"]
    assert {f for *_, f in w.cells(0) if f} == {"SUM(B1:B2)"}
    assert "a note" in w.package.read("xl/comments1.xml").decode()
    assert w.sheet("other") == 1 and w.sheet(2) == 1
    for bad in (0, 3, "nope"):
        with pytest.raises(ValueError):
            w.sheet(bad)


@pytest.mark.parametrize("name", ["", "x" * 32, "a/b", "'a", "a'", "[x]"])
def test_sheet_names(name):
    with pytest.raises(ValueError):
        book((name, []))


def test_no_sheets_two_of_a_name_and_bad_colors():
    for bad in (lambda: book(), lambda: book(("A", []), ("a", [])), lambda: xlsx_writer.hex_color("##aabbcc"), lambda: book(("A", []), **{"1x": "2"})):
        with pytest.raises(ValueError):
            bad()


def foreign(sheet_xml, shared="", styles="", target="worksheets/sheet1.xml", pr=""):
    """A workbook as another program may write it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="x"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="r"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="x"><Relationship Id="a" Type="http://o/officeDocument" Target="/xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="r">{pr}<sheets><sheet name="One" r:id="s1"/><sheet name="Chart" r:id="c1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="x"><Relationship Id="s1" Type="http://o/worksheet" Target="{target}"/><Relationship Id="c1" Type="http://o/chartsheet" Target="x.xml"/><Relationship Id="t" Type="http://o/sharedStrings" Target="sharedStrings.xml"/><Relationship Id="y" Type="http://o/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{sheet_xml}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="m">{shared}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="m">{styles}</styleSheet>')
    return out.getvalue()


def test_foreign_workbooks():
    sst = "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t>b</t><rPh><t>x</t></rPh></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy"/><numFmt numFmtId="165" formatCode="[White]0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    xml = '<row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>99</v></c></row><row><c><f>1+1</f><v>2</v></c><c t="str"><f>x</f><v>s</v></c><c t="e"><v>#N/A</v></c><c t="d"><v>2024-02-03T04:05:06</v></c><c t="d"><v>soon</v></c><c t="b"><v>true</v></c></row><row r="9"><c r="a9" s="1"><v>1.5</v></c><c s="2"><v>1.5</v></c><c r="!!"><v>1</v></c><c s="1"><v>1e300</v></c><c><v>abc</v></c></row>'
    for target in ("worksheets/sheet1.xml", "/xl/worksheets/sheet1.xml", "../xl/worksheets/sheet1.xml"):
        data = foreign(xml, sst, styles, target)
        assert [n for n, _ in xlsx.Workbook(data).sheets] == ["One"]
        assert cells(data) == {
            (2, 2): ("string", "rich"), (2, 3): ("string", "b"), (2, 4): ("string", "99"),
            (3, 1): ("number", 2.0), (3, 2): ("string", "s"), (3, 3): ("error", "#N/A"), (3, 4): ("date", dt.datetime(2024, 2, 3, 4, 5, 6)), (3, 5): ("string", "soon"), (3, 6): ("bool", False),
            (9, 1): ("date", dt.datetime(1899, 12, 31, 12)), (9, 2): ("number", 1.5), (9, 3): ("number", 1e300), (9, 4): ("string", "abc"),
        }
    assert cells(foreign('<row><c s="1"><v>0</v></c></row>', styles=styles, pr='<workbookPr date1904="1"/>')) == {(1, 1): ("date", dt.datetime(1904, 1, 1))}


def test_part_cap():
    data = book(("S", [["x" * 100_000]]))
    with pytest.raises(package.LimitError):
        cells(data, max_part_bytes=50_000)


def test_wide_typed_and_sheets(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    with open(path, "wb") as f:
        f.write(book(("Main", [["Id", "Name", None, "name", 7], [1, "x", "gap", "second", 5], [2.5, None, None, None, None], ["bad", "y", True, None, dt.date(2024, 1, 2)]]), ("Empty", [["only", "headers"]])))
    rows = xlsx.read_typed(spark, path, "NAME STRING, id INT, missing DOUBLE").collect()
    assert [tuple(r) for r in rows] == [("x", 1, None), (None, 2, None), ("y", None, None)]
    sheets = xlsx.read_sheets(spark, path)
    assert sheets["Main"].columns == ["Id", "Name", "Column3", "Column4", "Column5"] and sheets["Main"].count() == 3
    assert sheets["Empty"].columns == ["only", "headers"] and sheets["Empty"].count() == 0
    assert spark.read.format("xlsx").option("mode", "wide").option("header", "false").schema("a STRING, b STRING").load(path).count() == 4
    files = spark.read.format("binaryFile").load(path)
    assert xlsx.read_binary(files).count() == spark.read.format("xlsx").load(path).count() > 10
    split = spark.read.format("xlsx").option("splitSheets", "true").load(path)
    assert split.rdd.getNumPartitions() == 2 and split.count() == xlsx.read_binary(files).count()
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("xlsx").option("sheet", "nope").load(path).collect()


def test_stress_rows(spark, tmp_path):
    path = str(tmp_path / "s.xlsx")
    with open(path, "wb") as f:
        w = WorkbookWriter(f)
        w.add_sheet("S")
        w.write_rows([["Id", "Name", "Score", "Date", "IsActive", "Category"]])
        w.write_rows(stress_rows(3000))
        w.close()
    r = xlsx.read_typed(spark, path, "Id BIGINT, IsActive BOOLEAN, Date DATE").agg(F.count("Id"), F.sum("Id"), F.count_if("IsActive"), F.max("Date")).collect()[0]
    assert tuple(r) == (3000, 4501500, 1500, dt.date(2025, 6, 22))


def test_export_plan_and_multi_sheet(spark, tmp_path):
    df = spark.createDataFrame([("P1", "Ann", dt.datetime(1980, 5, 6), 12.5, "secret"), ("P2", None, None, None, None)], "id string, full string, dob timestamp_ntz, balance double, notes string")
    plan = ExportPlan(as_table="Medium").column("id", header="Patient ID", width=12).column("full", header="Name").column("balance", format="#,##0.00", order=-1).ignore("notes")
    path = str(tmp_path / "p.xlsx")
    assert xlsx_writer.write_workbook(path, {"Patients": df, "Raw": df}, plans={"Patients": plan}) == {"Patients": 2, "Raw": 2}
    w = xlsx.Workbook(open(path, "rb").read())
    assert [v for r, _, _, v, _ in w.cells(0) if r == 1] == ["balance", "Patient ID", "Name", "dob"]
    assert any(n.startswith("xl/tables/") for n in w.package.names)
    with pytest.raises(ValueError):
        plan.column("nope").resolved(df)
    assert with_sheet_name({"a": df.select("id"), "b": df.select("full")}).count() == 4
    assert pick(df, "ID", 1, "none", 99).collect()[0][0:4] == ("P1", "Ann", None, None)
    assert first_headers(["A", "", "a", None, "B"]) == {"a": 0, "b": 4}


def test_encrypted_workbooks(spark, tmp_path):
    path = str(tmp_path / "e.xlsx")
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    xlsx_writer.write_workbook(path, df, options=Options(password="pw"))
    data = open(path, "rb").read()
    assert encryption.is_encrypted(data) and cells(data, password="pw")[2, 2] == ("string", "x")
    for wrong in (None, "", "PW"):
        with pytest.raises(encryption.PasswordError):
            cells(data, password=wrong)
    streams = compound.read_streams(data)
    body = bytearray(streams["EncryptedPackage"])
    body[100] ^= 1
    with pytest.raises(encryption.PasswordError, match="tampered"):
        encryption.decrypt(compound.write_streams(streams | {"EncryptedPackage": bytes(body)}), "pw")


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.text("abcXY", min_size=1, max_size=8), st.binary(max_size=9000), max_size=6))
def test_compound_files(streams):
    assert compound.read_streams(compound.write_streams({"d/" + k: v for k, v in streams.items()} | {"top": b"1"})) == {"d/" + k: v for k, v in streams.items()} | {"top": b"1"}


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 4095, 4096, 4097, 10_000])
def test_encryption_sizes(size):
    data = random.Random(42).randbytes(size)
    assert encryption.decrypt(encryption.encrypt(data, "pässwörd", spins=5), "pässwörd") == data


def test_broken_compound_files():
    good = compound.write_streams({"a": b"x" * 5000})
    for bad in (b"", good[:100], good[:700], b"PK" + good[2:]):
        with pytest.raises((ValueError, struct.error)):
            compound.read_streams(bad)


def test_documents_round_trip(spark, tmp_path):
    d = docx_writer.Document()
    d.add_heading("Title & <tag>", 2)
    d.add_paragraph("line\nbreak\ttab  ", bold=True).hyperlink("site", "http://x.y/?a&b").page_number()
    d.add_bullet("one")
    d.add_numbered("two")
    t = d.add_table(3).header_row("a", "b", "c")
    t.add_row("1").add_row(("wide", 2), docx_writer.Paragraph([docx_writer.Run("p")]))
    d.add_page_break()
    d.add_paragraph("pic: ").image(docx_writer.Picture(PNG, alt="logo", floating=(10, 20)))
    d.header("top")
    d.footer("first", "first")
    d.protect("pw")
    data = d.to_bytes()
    r = docx.DocumentReader(data)
    assert [(h, s, x) for h, s, x in r.paragraphs()][:4] == [("body", "Heading2", "Title & <tag>"), ("body", None, "line\nbreak\ttab  site1"), ("body", "ListParagraph", "one"), ("body", "ListParagraph", "two")]
    assert {h for h, *_ in r.paragraphs()} == {"body", "header", "footer"}
    assert [g for _, g in r.tables()] == [[["a", "b", "c"], ["1", "", ""], ["wide", "p"]]]
    assert r.text().endswith("top\nfirst") and "a\nb\nc\n1\n\n" in r.text()
    assert "top" not in docx.DocumentReader(data, headers_and_footers=False).text() and "top" not in d.text()
    (p,) = r.images()
    assert p["content"] == PNG and p["placement"] == "floating" and p["anchor_h"] == "Page" and p["alt"] == "logo" and p["anchor_text"] == "pic: "
    again = docx_writer.Document.load(data)
    blocks = list(docx.DocumentReader(again.to_bytes()).blocks())
    # a table's spans are reduced to text: its rows are filled up
    assert blocks == [{**b, "rows": b["rows"] and [row + [""] * (3 - len(row)) for row in b["rows"]]} for b in r.blocks()]
    assert [x["content"] for x in docx.DocumentReader(again.to_bytes()).images()] == [PNG]
    assert [b["list"] for b in blocks if b["kind"] == "paragraph"][:4] == [None, None, "bullet", "number"]
    assert docx.DocumentReader(d.to_bytes("pw"), password="pw").text() == r.text()
    d.save(str(tmp_path / "a.docx"))
    docx.register(spark)
    for mode in docx.SCHEMAS:
        assert spark.read.format("docx").option("mode", mode).load(str(tmp_path)).count() > 0


def test_nested_tables_and_image_places():
    inner = '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    d = docx_writer.Document()
    d.add_paragraph("before")
    d.add_table(2).add_row("x", docx_writer.Paragraph([docx_writer.Run(picture=docx_writer.Picture(PNG))]))
    data = d.to_bytes()
    (p,) = docx.DocumentReader(data).images()
    assert (p["table"], p["row"], p["col"], p["anchor_text"], p["width_pt"]) == (0, 0, 1, "x", pytest.approx(7.5, abs=0.05))
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as y:
        for n in z.namelist():
            y.writestr(n, z.read(n).replace(b"<w:tc><w:tcPr></w:tcPr><w:p><w:r><w:t xml:space=\"preserve\">x</w:t></w:r></w:p></w:tc>", f"<w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p>{inner}</w:tc>".encode()))
    assert [g for _, g in docx.DocumentReader(out.getvalue()).tables()] == [[["x\nin", ""]]]


def test_templates():
    d = docx_writer.Document()
    p = d.add_paragraph("Dear {{Na")
    p.text("me}}, ", bold=True).text("{{Missing}} {{A}}{{Logo}}!")
    d.header("{{Name}}")
    d.add_image(docx_writer.Picture(PNG, 30, 40, alt="{{Photo}}"))
    new = PNG.replace(b"IEND", b"IENE")
    out = docx_writer.fill_template(d.to_bytes(), {"A": "{{B}}", "B": "b\nc", "Name": "Ann & Bob"}, {"Logo": docx_writer.Picture(new, 10, 10), "Photo": docx_writer.Picture(new)}, new_password="pw")
    r = docx.DocumentReader(out, password="pw")
    texts = [x for _, _, x in r.paragraphs()]
    assert texts[0] == "Dear Ann & Bob, {{Missing}} b\nc!" and texts[-1] == "Ann & Bob"
    pictures = list(r.images())
    assert [x["content"] for x in pictures] == [new, new] and [(x["width_pt"], x["height_pt"]) for x in pictures] == [(10, 10), (30, 40)]
    twice = docx_writer.fill_template(docx_writer.fill_template(d.to_bytes(), {}, {"Logo": docx_writer.Picture(PNG)}), {}, {"Photo": docx_writer.Picture(new)})
    assert sorted(x["content"] for x in docx.DocumentReader(twice).images()) == sorted([PNG, new])


def test_save_images(spark, tmp_path):
    df = spark.createDataFrame([(0, "a.png", bytearray(b"1")), (1, "a.png", bytearray(b"2")), (2, "A.png", bytearray(b"3"))], "ord int, name string, content binary")
    docx_writer.save_images(df, str(tmp_path / "out"))
    assert {f: open(tmp_path / "out" / f, "rb").read() for f in os.listdir(tmp_path / "out")} == {"a.png": b"1", "a_1.png": b"2", "A_2.png": b"3"}


def test_image_headers():
    assert images.inspect(PNG)[:3] == ("image/png", 10, 20) and images.inspect(PNG)[3] == pytest.approx(96.012)
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\1\0\x48\0\x48\0\0\xff\xc0\0\x11\x08\0\x14\0\x0a\3"
    assert images.inspect(jpeg) == ("image/jpeg", 10, 20, 72.0, 72.0)
    assert images.inspect(b"GIF89a\x0a\0\x14\0")[:3] == ("image/gif", 10, 20)
    assert images.inspect(b"BM" + bytes(16) + struct.pack("<ii", 10, -20) + bytes(12) + struct.pack("<ii", 3937, 3937))[:3] == ("image/bmp", 10, 20)
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 10) + struct.pack("<HHII", 257, 4, 1, 20)
    assert images.inspect(tiff)[:3] == ("image/tiff", 10, 20)
    assert images.inspect(PNG[:18])[1:3] == (0, 0) and images.inspect(b"")[0] is None


def test_archives(spark, tmp_path):
    src, z, out = tmp_path / "src", str(tmp_path / "a.zip"), str(tmp_path / "out")
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("hello")
    (src / "sub" / "b.bin").write_bytes(bytes(5_000_000))
    assert archive.zip_folder(str(src), z) == 2
    assert archive.find_entry(z, "sub/b.bin") and not archive.find_entry(z, "SUB/b.bin")
    assert sorted(os.path.relpath(p, out) for p in archive.extract(z, out)) == ["a.txt", "sub/b.bin"]
    rows = archive.list_entries(spark, z).collect()
    assert {(r.name, r.size) for r in rows} == {("a.txt", 5), ("sub/b.bin", 5_000_000)}
    assert spark.read.format("zip").option("content", "true").load(z).where("name = 'a.txt'").collect()[0].content == b"hello"
    for limits in (archive.Limits(max_entries=1), archive.Limits(max_entry_bytes=1000), archive.Limits(max_total_bytes=1000)):
        with pytest.raises(package.LimitError):
            archive.extract(z, str(tmp_path / "no"), limits)
    with pytest.raises(Exception, match="more than"):
        spark.read.format("zip").option("content", "true").option("maxEntryBytes", "10").load(z).collect()
    archive.zip_files([str(src / "a.txt"), str(src / "sub" / "b.bin")], str(tmp_path / "flat.zip"))
    assert [e.filename for e in archive.entries(str(tmp_path / "flat.zip"))] == ["a.txt", "b.bin"]


@pytest.mark.parametrize("name", ["../x", "/x", "C:\\x", "a/../../x", "", " "])
def test_unsafe_names(tmp_path, name):
    with pytest.raises(ValueError):
        archive.check_name(name)
    z = str(tmp_path / "e.zip")
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("ok", "1")
    with pytest.raises(ValueError), archive.ArchiveWriter(z) as w:
        w.add_text(name, "evil")
    assert [e.filename for e in archive.entries(z)] == ["ok"] and len(os.listdir(tmp_path)) == 1


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 99), st.one_of(st.none(), st.text(max_size=200)), st.text(max_size=40))
def test_envelopes(document, copies, paper, pages):
    s = envelope.Settings(copies=copies, paper_name=paper, pages=pages)
    data = envelope.pack(s, document)
    assert envelope.unpack(data) == (s, document)
    assert data[:4] == b"CVPR" and struct.unpack_from("<I", data, 6)[0] == zlib.crc32(data[14:])
    for k in range(0, len(data), 7):
        with pytest.raises(ValueError):
            envelope.unpack(data[:k])


def test_damaged_envelopes():
    data = bytearray(envelope.pack(envelope.Settings(), b"x"))
    data[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        envelope.unpack(bytes(data))
    with pytest.raises(ValueError, match="version"):
        envelope.unpack(b"CVPR\x09" + bytes(data[5:]))


def columns_as_cells(w, index=0):
    return [(int(c.row[i]), int(c.col[i]), xlsx.KINDS[c.kind[i]], c.value(i), c.formula[i].as_py()) for c in w.columns(index) for i in range(len(c))]


def test_columns_are_the_cells(monkeypatch):
    """The scan in columns gives what the XML parser gives, in whatever form the sheet is."""
    monkeypatch.setattr(xlsx.sheet_scan, "PIECE", 300)
    rng = random.Random(3)
    values = [None, 1, -2.5, 1e300, True, False, "", "a", " edge ", "<&>\"'", "ünï", "two\nlines", dt.date(2024, 2, 29), dt.datetime(2020, 1, 1, 12, 30, 15), dt.timedelta(hours=36.5), Formula("SUM(A1:A2)"), 12345678901234567890]
    rows = [[rng.choice(values) for _ in range(rng.randrange(1, 8))] for _ in range(300)]
    for inline in (True, False):
        data = book(("S", rows), options=Options(inline_strings=inline))
        for auto in (True, False):
            w = xlsx.Workbook(data, auto_dates=auto)
            raw = w.package.read(w.sheets[0][1])
            want = list(w.cells(0))
            assert columns_as_cells(w) == want and len(want) > 500
            # from any piece on that isn't in plain form the parser takes over
            for change in (lambda x: x.replace(b'<c r="B', b'<c  r="B'), lambda x: x.replace(b'<row r="150">', b'<!-- x --><row r="150">'), lambda x: x.replace(b"</sheetData>", b"<row><c><v>7</v></c></row></sheetData>"), lambda x: x.replace(b"<v>", b"<v><![CDATA[").replace(b"</v>", b"]]></v>"), lambda x: x.replace(b'<row r="200"', b'<row r="100"'), lambda x: x.replace(b"&lt;", b"&#60;"), lambda x: x.replace(b"&quot;", b"&#x22;")):
                monkeypatch.setattr(w.package, "read", lambda name, x=change(raw): x)
                assert columns_as_cells(w) == list(w.cells(0))
            monkeypatch.undo()
            monkeypatch.setattr(xlsx.sheet_scan, "PIECE", 300)
    dates = book(("S", [[dt.date(1900, 1, 1)], [dt.datetime(9999, 12, 31)], [dt.date(2024, 5, 5)]]))
    assert columns_as_cells(xlsx.Workbook(dates)) == list(xlsx.Workbook(dates).cells(0))


POOLS = {
    "i": ([None, 0, -5, 2**63 - 1], pa.int64()),
    "b": ([True, False, None], pa.bool_()),
    "f": ([1.5, None, 0.1 + 0.2, 1e300, -0.0, 1e16, 123456789.123, 5e-324, 10.0], pa.float64()),
    "n": ([1.5, None, float("nan"), float("inf"), -float("inf")], pa.float64()),
    "d": ([Decimal("1.10"), None, Decimal("-3.25")], pa.decimal128(12, 2)),
    "D": ([dt.date(2020, 1, 1), None, dt.date(1, 1, 1), dt.date(9999, 12, 31)], pa.date32()),
    "T": ([dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 3, 4, 5, 678901), None], pa.timestamp("us")),
    "s": (["a", "", None, " x", "x ", "a&b", "<", ">", "\xa0x", "x\u2003", "é", "aé", "x\x07y", "l1\nl2", "\t", "x\n", "\ufffe", "m\uffffn"], pa.string()),
    "z": ([None], pa.string()),
}


def test_batches_are_written_like_rows():
    rng = random.Random(5)
    for inline in (True, False):
        for n in (0, 1, 300):
            batch = pa.RecordBatch.from_pydict({k: pa.array([rng.choice(v) for _ in range(n)], t) for k, (v, t) in POOLS.items()})
            out = io.BytesIO()
            w = WorkbookWriter(out, Options(inline_strings=inline))
            w.add_sheet("S")
            assert w.write_batch(batch.slice(0, n // 3)) + w.write_batch(batch.slice(n // 3)) == n
            w.close()
            want = book(("S", list(zip(*[c.to_pylist() for c in batch.columns]))), options=Options(inline_strings=inline))
            assert repr(cells(out.getvalue())) == repr(cells(want))
            assert repr(columns_as_cells(xlsx.Workbook(out.getvalue()))) == repr(list(xlsx.Workbook(want).cells(0)))
    parts = [pa.RecordBatch.from_pydict({"a": list(range(k))}) for k in (3, 4, 1, 9, 2)]
    assert [b["a"].to_pylist() for b in xlsx_writer._gathered(parts, 8)] == [[0, 1, 2, 0, 1, 2, 3, 0], list(range(9)), [0, 1]]
    assert len(list(xlsx_writer._gathered(parts, 99, 1))) == 5 and not list(xlsx_writer._gathered([]))


def test_plain_tables_pass_without_work_by_cell(monkeypatch):
    """Columns of common types are written and read whole: no Python call, expression match or XML element for each cell."""
    n = 1000
    batch = pa.RecordBatch.from_pydict({"i": list(range(n)), "f": [k / 7 for k in range(n)], "s": [f"t{k % 9}" for k in range(n)], "T": [dt.datetime(2020, 1, 1 + k % 28) for k in range(n)], "b": [k % 2 == 0 for k in range(n)]})
    for name in ("_text", "_cell"):
        monkeypatch.setattr(WorkbookWriter, name, None)
    for inline in (True, False):
        out = io.BytesIO()
        w = WorkbookWriter(out, Options(inline_strings=inline))
        w.add_sheet("S")
        w.write_batch(batch)
        w.close()
        with monkeypatch.context() as m:
            m.setattr(xlsx.sheet_scan, "_TOKEN", None)
            m.setattr(xlsx.Workbook, "cells", lambda *a: iter(()))
            got = columns_as_cells(xlsx.Workbook(out.getvalue()))
        assert [v for _, _, _, v, _ in got] == [v for r in zip(*[c.to_pylist() for c in batch.columns]) for v in r]


def piece_cells(f, raw):
    x = f(raw)
    every = np.arange(len(x.row))
    has = np.flatnonzero(x.has)
    return [x.row.tolist(), x.col.tolist(), [x.kinds[k] for k in x.kind], x.style.tolist(), x.has.tolist(), x.in_place.tolist(), x.value(has).to_pylist(), x.text(x.has | x.in_place).to_pylist(), x.text(every % 2 == 0).to_pylist() if (x.has | x.in_place).all() else None, x.formula.to_pylist()]


def test_tags_are_taken_as_the_expression_takes_them(monkeypatch):
    """Whatever bytes are changed: a piece that the scan of tags accepts is one that the expression accepts, with the same cells."""
    rng = random.Random(6)
    rows = "".join(f'<row r="{r}" spans="1:4"><c r="A{r}"><v>{r}.5</v></c><c r="B{r}" s="1" t="s"><v>{r % 3}</v></c><c r="AC{r}" s="2"/><c r="XFD{r}" t="inlineStr"><is><t xml:space="preserve"> é{r}</t></is></c><c r="AD{r}" t="inlineStr"><is><t></t></is></c><c r="AE{r}"><f>A1&lt;2</f><v>1</v></c><c r="AF{r}"></c></row>' for r in (1, 2, 30, 999_999)).encode()
    scan, good = xlsx.sheet_scan, 0
    assert piece_cells(scan._by_tags, rows) == piece_cells(scan._by_tokens, rows)
    for _ in range(3000):
        x = bytearray(rows)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(x) - 2)
            x[k : k + rng.randrange(0, 3)] = rng.choice([b"", b"<", b">", b"/", b'"', b" ", *[b"7", b"Z"] * 8, b"v", b"t", b"</v>", b"<v>", b"<c>", b"</row>", b"/>", b"\xff"])
        try:
            got = piece_cells(scan._by_tags, bytes(x))
        except ValueError:
            continue
        good += 1
        assert got == piece_cells(scan._by_tokens, bytes(x)), bytes(x)
    assert good > 200
    with pytest.raises(ValueError):
        scan._by_tags(rows.replace(b"<v>1<", b"<v>>1<"))
    # such a piece goes to the expression, not to the parser
    w = xlsx.Workbook(book(("S", [["a>b", 1], ["x", 2.5], [">", True]]), options=Options(inline_strings=True)))
    want, raw = list(w.cells(0)), w.package.read(w.sheets[0][1]).replace(b"&gt;", b">")
    monkeypatch.setattr(w.package, "read", lambda name: raw)
    monkeypatch.setattr(w, "cells", lambda *a: iter(()))
    assert b"a>b" in raw and columns_as_cells(w) == want


def test_typed_columns_like_single_values(spark, tmp_path):
    """Each type, from columns of one kind and of several, as convert() has it."""
    rng = random.Random(4)
    pools = [[1.5, 2.5, -0.5, 3, 1e12, 2.675, 1.005, 123456.785], ["a", "5", "2.5", "true", "2024-01-02", ""], [True, False], [dt.datetime(2020, 1, 1, 6), dt.date(1999, 12, 31)], [1, "x", None, True, dt.date(2020, 2, 2), 7.25]]
    rows = [[rng.choice(p) for p in pools] for _ in range(200)]
    path = str(tmp_path / "t.xlsx")
    with open(path, "wb") as f:
        f.write(book(("S", [list("abcde"), *rows])))
    cells = {(r, c): (k, v) for r, c, k, v, _ in xlsx.Workbook(open(path, "rb").read()).cells(0)}
    for kind in ("STRING", "DOUBLE", "BIGINT", "INT", "SMALLINT", "BOOLEAN", "DATE", "TIMESTAMP_NTZ", "DECIMAL(12,2)"):
        df = xlsx.read_typed(spark, path, ", ".join(f"{n} {kind}" for n in "abcde"))
        got = [tuple(r) for r in df.collect()]
        want = []
        for r in range(2, 202):
            out = [xlsx.convert(*cells[r, c], df.schema[c - 1].dataType) if (r, c) in cells else None for c in range(1, 6)]
            want.append(tuple(None if kind.startswith("DEC") and v is not None and abs(v) >= 10**10 else v for v in out))
        assert got == want, kind


def test_a_task_rolls_over_to_the_next_workbook(spark, tmp_path):
    xlsx.register(spark)
    out = str(tmp_path / "many")
    spark.range(1_048_577).coalesce(1).write.format("xlsx").mode("append").save(out)
    assert len(xlsx._files(out)) == 2 and not [f for f in os.listdir(out) if f.startswith(".")]
    assert tuple(xlsx.read_typed(spark, out, "id BIGINT").selectExpr("count(*)", "sum(id)", "max(id)").first()) == (1_048_577, 1_048_576 * 1_048_577 // 2, 1_048_576)
    few = str(tmp_path / "few")
    spark.range(10).coalesce(1).write.format("xlsx").option("maxRowsPerFile", 4).mode("append").save(few)
    assert len(xlsx._files(few)) == 3 and xlsx.read_typed(spark, few, "id BIGINT").count() == 10
    spark.range(8).coalesce(1).write.format("xlsx").option("maxRowsPerFile", 4).mode("overwrite").save(few)
    assert len(xlsx._files(few)) == 2 and xlsx.read_typed(spark, few, "id BIGINT").count() == 8
    assert xlsx_writer.balanced(spark.range(100), 30).rdd.getNumPartitions() == 4


def test_rolled_over_rows_are_many_tasks(spark, tmp_path, monkeypatch):
    """Neither one task for all rows nor a task for each small workbook."""
    spark.range(150_000).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "id / 4 as o_totalprice").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = tmp_path / "out"
    out.mkdir()
    monkeypatch.setattr(documents, "scratch", lambda s, tag: str(out))
    df = documents.xlsx_rolled_over(spark, str(tmp_path))
    written = xlsx._files(str(out))
    assert 150 <= len(written) <= 153
    assert 3 <= df.rdd.getNumPartitions() <= 8
    assert tuple(df.selectExpr("count(*)", "count(distinct o_orderkey)", "sum(o_orderkey)", "sum(price)").first()) == (150_000, 150_000, 149_999 * 75_000, 149_999 * 75_000 / 4)
    packed = xlsx._packed(written)
    assert [p for x in packed for p in x] == written and all(sum(map(os.path.getsize, x)) <= xlsx.PACK_BYTES for x in packed)
    monkeypatch.setattr(xlsx, "PACK_BYTES", 1)
    assert xlsx._packed(written) == [[p] for p in written]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    xlsx.register(spark)
    out = str(tmp_path / "bad")
    spark.range(3).coalesce(1).write.format("xlsx").mode("append").save(out)
    before = sorted(os.listdir(out))
    bad = spark.range(5000).coalesce(1).selectExpr("if(id = 4500, raise_error('no'), id) as id")
    with pytest.raises(Exception):
        bad.write.format("xlsx").option("password", "pw").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == before
    path = str(tmp_path / "one.xlsx")
    with pytest.raises(Exception):
        xlsx_writer.write_workbook(path, bad, options=Options(password="pw"))
    assert not [f for f in os.listdir(tmp_path) if f.endswith((".xlsx", ".tmp"))]


def test_encrypted_cells(spark, tmp_path):
    path = str(tmp_path / "c.xlsx")
    model = spark.createDataFrame([("S", 2, 3, "x", None), ("S", 4, 1, None, "1+1")], "sheet string, row int, col int, value string, formula string")
    xlsx_writer.write_cells(path, model, options=Options(password="pw"))
    data = open(path, "rb").read()
    assert data[:2] != b"PK" and cells(data, password="pw") == {(2, 3): ("string", "x"), (4, 1): ("blank", None)}


def test_styles_and_formats_of_columns_reach_the_file(spark, tmp_path):
    plan = ExportPlan().column("a", style="bold fill:FFEE00", width=20).column("b", format="0.00", style="italic").column("c", style="color:FF0000 size:12")
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    one, many = str(tmp_path / "one.xlsx"), str(tmp_path / "many")
    xlsx_writer.write_workbook(one, df, plans=plan)
    xlsx.register(spark)
    plan.project(df).coalesce(1).write.format("xlsx").mode("append").save(many)
    for path in (one, xlsx._files(many)[0]):
        z = zipfile.ZipFile(path)
        styles, sheet = z.read("xl/styles.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
        assert 'rgb="FFFFEE00"' in styles and 'rgb="FFFF0000"' in styles and '<sz val="12"/>' in styles and "<i/>" in styles and 'numFmtId="2"' in styles and 'width="20"' in sheet
        ids = [int(re.search(rf'<c r="{c}2" s="(\d+)"', sheet)[1]) for c in "ABC"]
        assert len(set(ids)) == 3 and all(ids)
    assert xlsx.read_typed(spark, many, "a INT, b DOUBLE, c STRING").collect()[0] == (1, 2.5, "x")
    for bad in ("bolder", "bold:1", "fill", "size:x"):
        with pytest.raises(ValueError):
            CellStyle.of(bad)
