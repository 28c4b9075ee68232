"""Text of zipped XML documents: what is read from each kind, and what is refused."""

import io
import zipfile

import pytest

from basalt.sources import office

LONG = "words enough for a text that is not scant at all, whatever it says"


def container(parts, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.mark.parametrize("kind", office.KINDS)
@pytest.mark.parametrize("text", ["", "one line", f"{LONG}\n\nlast < & > \" ' é 日 😀\r x\ttab ", "\n\n", "a\tb\n\tc"])
def test_what_is_written_is_read(kind, text):
    got, status = office.text_of(kind, office.packed(kind, text))
    assert got == (f"## Sheet1\n{text}" if kind == "xlsx" else text)
    assert status == ("ok" if LONG in text else "scant")


def test_word_processor_paragraphs_tabs_breaks_and_cells():
    body = (
        "<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r><w:r><w:br/><w:t xml:space='preserve'> three</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:delText>gone</w:delText><w:t>other</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    )
    content = container({"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document xmlns:w='w'><w:body>{body}</w:body></w:document>"})
    assert office.text_of("docx", content)[0] == "one\ttwo\n three\ncell\nother\n"


def test_sheets_shared_strings_and_empty_cells():
    shared = "<sst><si><t>first</t></si><si><r><t>rich</t></r><r><t> text</t></r></si></sst>"
    one = "<worksheet><sheetData><row><c r='A1' t='s'><v>1</v></c><c r='C1'><v>3.5</v></c></row><row/><row><c r='B3' t='s'><v>0</v></c><c r='AA3' t='s'><v>99</v></c></row></sheetData></worksheet>"
    two = "<worksheet><sheetData><row><c><f>1+1</f><v>2</v></c><c t='b'><v>1</v></c></row></sheetData></worksheet>"
    book = f"<workbook xmlns:r='{office.RELATION}'><sheets><sheet name='Zwei' sheetId='7' r:id='rId2'/><sheet r:id='rId1' name='Eins' sheetId='3'/></sheets></workbook>"
    parts = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": office._relations("worksheets/sheet1.xml", "/xl/worksheets/other.xml"), "xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": one, "xl/worksheets/other.xml": two}
    text = office.text_of("xlsx", container(parts))[0]
    assert text.split("\n\n## ")[0] == "## Zwei\n2\t1"
    assert text.split("## Eins\n")[1] == "rich text\t\t3.5\n\n\tfirst" + "\t" * 25


def test_slides_in_the_order_of_the_presentation():
    slide = lambda t: f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>"
    show = f"<p:presentation xmlns:p='p' xmlns:r='{office.RELATION}'><p:sldIdLst><p:sldId r:id='rId2' id='256'/><p:sldId id='257' r:id='rId1'/></p:sldIdLst></p:presentation>"
    parts = {"ppt/presentation.xml": show, "ppt/_rels/presentation.xml.rels": office._relations("slides/slide1.xml", "slides/slide2.xml"), "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two")}
    assert office.text_of("pptx", container(parts))[0] == "two\n\none"
    del parts["ppt/_rels/presentation.xml.rels"]
    assert office.text_of("pptx", container(parts))[0] == "one\n\ntwo"


def refused():
    good = office.packed("docx", LONG)
    bomb = container({"word/document.xml": "<w:document xmlns:w='w'>" + " " * (40 << 20) + "</w:document>"})
    locked = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[good.index(mark) + at] |= 1
    dtd = container({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'aaaa'>]><x>&a;</x>"})
    return [
        ("docx", b"no archive", "damaged"), ("docx", b"", "damaged"), ("docx", good[: len(good) // 2], "damaged"), ("docx", good[:40] + b"\xff" * 20 + good[60:], "damaged"), ("xlsx", good, "damaged"),
        ("docx", container({"word/document.xml": "<open>"}), "damaged"), ("docx", dtd, "damaged"), ("docx", bomb, "too large"), ("docx", bytes(locked), "encrypted"), ("doc", good, "unknown kind"),
    ]


@pytest.mark.parametrize("kind, content, status", refused())
def test_refused_files_have_a_status(kind, content, status):
    assert office.text_of(kind, content) == (None, status)


def test_files_of_a_folder(spark, tmp_path):
    root = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"a/{i}.{k}", f"{LONG} {i}") for i, k in enumerate(("docx", "xlsx", "PPTX"))] + [("a/none.docx", None)], "path string, text string")
    assert office.write(rows, root) == 4
    (tmp_path / "files" / "bad.docx").write_bytes(b"bad")
    (tmp_path / "files" / "large.docx").write_bytes(b"x" * 100_000)
    (tmp_path / "files" / "x.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"], r["status"]) for r in office.extracted(office.read(spark, root), most_bytes=90_000).collect()}
    assert got == {
        "0.docx": ("docx", f"{LONG} 0", "ok"), "1.xlsx": ("xlsx", f"## Sheet1\n{LONG} 1", "ok"), "2.PPTX": ("pptx", f"{LONG} 2", "ok"), "none.docx": ("docx", "", "scant"),
        "bad.docx": ("docx", None, "damaged"), "large.docx": ("docx", None, "too large"), "x.pdf": ("pdf", None, "unknown kind"),
    }
    null = spark.createDataFrame([("n.docx", 5, None), (None, None, None)], "path string, length long, content binary")
    assert sorted((str(r["path"]), r["status"]) for r in office.extracted(null).collect()) == [("None", "unknown kind"), ("n.docx", "damaged")]
    assert office.extracted(null.limit(0)).count() == 0


def test_many_files_are_listed_by_tasks_and_read_in_few(spark, tmp_path):
    root = str(tmp_path / "files")
    rows = spark.range(300).selectExpr("concat(id % 7, '/', id % 3, '/', id, '.docx') as path", f"concat('{LONG} ', id) as text")
    assert office.write(rows, root) == 300
    (tmp_path / "files" / "large.docx").write_bytes(b"x" * 100_000)
    (tmp_path / "files" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "files" / "_hidden.docx").write_bytes(b"x")
    for start in (root, f"file://{root}/"):
        found = office.listed(spark, start)
        assert {(r["path"].split("/files/")[1], r["length"]) for r in found.collect()} == {(r["path"].split("/files/")[1], r["length"]) for r in office.read(spark, root).collect()}
        got = office.extracted(found, most_bytes=90_000)
        assert got.rdd.getNumPartitions() <= 16  # Spark's own reader plans a part for each 32 files, twice
        told = {r["path"].rsplit("/", 1)[1]: (r["text"], r["status"]) for r in got.collect()}
        assert told == {f"{i}.docx": (f"{LONG} {i}", "ok") for i in range(300)} | {"large.docx": (None, "too large"), "x.pdf": (None, "unknown kind")}
    assert office.extracted(office.listed(spark, str(tmp_path / "none"))).count() == 0
