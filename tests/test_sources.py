import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, parsers


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def test_docx_paragraphs_then_tables():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("First") + "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in ("a", " ", "b")) + "</w:tr></w:tbl>" + p(" ") + p("Second")
    content = archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    assert list(parsers.Registry().parse("x.docx", content)) == [("First\n\nSecond\n\na | b", None)]


def test_pptx_slides_and_notes():
    shape = lambda t, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda body: f"<p:sld {P}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    content = archive({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{TYPE}slide" Target="slides/slide7.xml"/><Relationship Id="r2" Type="{TYPE}slide" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide7.xml": slide(shape("Title") + shape("Point")),
        "ppt/slides/slide2.xml": slide("<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>y</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"),
        "ppt/slides/_rels/slide7.xml.rels": f'<Relationships {REL}><Relationship Id="n" Type="{TYPE}notesSlide" Target="../notesSlides/notes1.xml"/></Relationships>',
        "ppt/notesSlides/notes1.xml": f"<p:notes {P}><p:cSld><p:spTree>" + shape("7", '<p:ph type="sldNum"/>') + shape("Say this", '<p:ph type="body"/>') + "</p:spTree></p:cSld></p:notes>",
    })
    assert list(parsers.Registry().parse("x.pptx", content)) == [("Title\n\nPoint\n\n[Speaker notes]\nSay this", 1), ("x | y", 2)]


def test_xlsx_sheets():
    content = archive({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Q1" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{TYPE}worksheet" Target="/xl/worksheets/s1.xml"/><Relationship Id="r2" Type="{TYPE}worksheet" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>",
        "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>1.5</v></c><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="AA2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    })
    assert list(parsers.Registry().parse("x.xlsm", content)) == [("[Sheet: Q1]\nname | value\nx | 1.5 | 2", None)]


def test_xlsx_dates_and_numbers():
    formats = '<numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="yyyy&quot;d&quot;"/><numFmt numFmtId="172" formatCode="0.0&quot; days&quot;"/></numFmts>'
    ids = (0, 14, 22, 170, 171, 172, 18)
    cells = [(45292, 1), (45292.75, 2), (1.5, 3), (60.0, 4), ("1E-3", 5), ("0.10000000000000001", 0), (12, 0), ("12.0", 0), (0.25, 6), (59, 1)]
    row = "".join(f'<c r="{chr(65 + k)}1" s="{s}"><v>{v}</v></c>' for k, (v, s) in enumerate(cells))
    parts = {
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="D" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{TYPE}worksheet" Target="worksheets/s1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {S}>{formats}<cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in ids) + "</cellXfs></styleSheet>",
        "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row>{row}<c r="Z1" t="d"><v>2024-02-03</v></c><c r="AB1" t="e"><v>#N/A</v></c></row></sheetData></worksheet>',
    }
    want = ["2024-01-01 00:00:00", "2024-01-01 18:00:00", "1 day, 12:00:00", "1900-02-28 00:00:00", "0.001", "0.1", "12", "12.0", "06:00:00", "1900-02-28 00:00:00", "2024-02-03 00:00:00", "#N/A"]
    assert list(parsers.Registry().parse("x.xlsx", archive(parts))) == [("[Sheet: D]\n" + " | ".join(want), None)]
    parts["xl/workbook.xml"] = f'<workbook {S}><workbookPr date1904="1"/><sheets><sheet name="D" sheetId="1" r:id="r1"/></sheets></workbook>'
    assert "2028-01-02 00:00:00" in list(parsers.Registry().parse("x.xlsx", archive(parts)))[0][0]


def test_pptx_paragraphs_groups_and_broken_notes():
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    shape = f"<p:sp><p:txBody>{para('One')}{para(' ')}{para('Two')}</p:txBody></p:sp>"
    content = archive({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{TYPE}slide" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f"<p:sld {P}><p:cSld><p:spTree>{shape}<p:grpSp>{shape}</p:grpSp>{shape}</p:spTree></p:cSld></p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": f'<Relationships {REL}><Relationship Id="n" Type="{TYPE}notesSlide" Target="../notesSlides/notes1.xml"/></Relationships>',
        "ppt/notesSlides/notes1.xml": "<broken",
    })
    assert list(parsers.Registry().parse("x.pptx", content)) == [("One\nTwo\n\nOne\nTwo", 1)]


def test_pdf_takes_the_better_of_text_and_ocr(spark, tmp_path):
    long = "word " * 20
    for name in ("x.pdf", "y.PNG", "z.png", "t.txt"):
        (tmp_path / name).write_bytes(b"some text")
    lines = [([], "yes", "0.9"), ([], "no", 0.1), ([], "odd", None), "bad", ([], "edge", 0.5)]
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("x.pdf", "y.PNG", "t.txt")], "path string")
    got = lambda r: sorted((x["path"].rsplit("/", 1)[-1], x["page"], x["text"], x["error"]) for x in files.parse_files(paths, r).collect())
    full = parsers.Registry(pdf_pages=lambda c: [long, "few", "", "ab"], ocr_page=lambda c, k: {0: 1 / 0 if k == 9 else "", 1: "many more letters", 2: "", 3: "x"}[k], ocr=lambda c: lines)
    assert got(full) == sorted([("x.pdf", 1, long.strip(), None), ("x.pdf", 2, "many more letters", None), ("x.pdf", 4, "ab", None), ("y.PNG", None, "yes\nedge", None), ("t.txt", None, "some text", None)], key=lambda r: (r[0], r[1] or 0))
    broken = parsers.Registry(pdf_pages=lambda c: [long, "few"], ocr_page=lambda c, k: 1 / 0)
    assert [r for r in got(broken) if r[0] == "x.pdf"] == [("x.pdf", 1, long.strip(), None), ("x.pdf", 2, "few", None)]
    assert [r for r in got(parsers.Registry(pdf_pages=lambda c: ["", "a"])) if r[0] != "t.txt"] == [("x.pdf", 2, "a", None)]


def test_readers_that_are_not_there():
    with pytest.warns(UserWarning, match="a.png is skipped"):
        assert list(parsers.Registry().parse("a.png", b"")) == []
    with pytest.warns(UserWarning, match="a.xls is skipped"):
        assert list(parsers.Registry(xls_sheets=None).parse("a.xls", b"")) == []
    assert list(parsers.Registry(xls_sheets=lambda c: [("S", [["a", 1.0], ["", " "]])]).parse("a.xls", b"")) == [("[Sheet: S]\na | 1.0", None)]
    with pytest.raises(ValueError):
        parsers.Registry().parse("a.exe", b"")
    assert parsers.raster_scale(612, 792) == 200 / 72 and parsers.raster_scale(4000, 100) == 1.0


def test_folder_to_blocks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"a.txt": b"one\r\ntwo\xff", ".hidden.md": b"kept", "_x.TXT": b"", "sub/bad.docx": b"no zip", "old.doc": b"x", "c.bin": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    listing = files.list_folder(spark, str(tmp_path))
    names = lambda df: [r["path"].rsplit("/", 1)[-1] for r in df.collect()]
    assert sorted(names(files.supported(listing))) == [".hidden.md", "_x.TXT", "a.txt", "bad.docx"]
    assert names(files.legacy(listing)) == ["old.doc"]
    blocks = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in files.parse_files(files.supported(listing)).collect()}
    assert blocks["a.txt"] == ("one\ntwo�", None) and blocks[".hidden.md"][0] == "kept" and "_x.TXT" not in blocks and blocks["bad.docx"][1].startswith("BadZipFile")
    native = files.text_blocks(spark.createDataFrame([("a", b" one\r\ntwo\xff\n"), ("b", b" \n")], "path string, content binary")).collect()
    assert [tuple(r) for r in native] == [("a", 0, "one\ntwo�", None)]
    import hashlib

    assert {r["sha1"] for r in files.with_hashes(listing.where(F.col("path").endswith("a.txt"))).collect()} == {hashlib.sha1(b"one\r\ntwo\xff").hexdigest()}


def test_deep_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    import os

    for k in range(40):
        d = tmp_path / f"a{k % 5}" / f"b{k % 3}" / f"c{k}" / "d" / ".e"
        d.mkdir(parents=True)
        (d / f"{k}.txt").write_text("x" * k)
        (d.parent.parent / "_y.md").write_text("y")
    (tmp_path / "top.txt").write_text("t")
    os.symlink(tmp_path / "a0", tmp_path / "a1" / "link")
    os.symlink(tmp_path / "none", tmp_path / "broken.txt")
    want = sorted((os.path.join(b, n), os.stat(os.path.join(b, n)).st_size) for b, _, names in os.walk(tmp_path) for n in names if os.path.exists(os.path.join(b, n)))
    assert len(want) == 81
    for units in (1, 4, 256):
        monkeypatch.setattr(files, "UNITS", units)
        got = files.list_folder(spark, str(tmp_path)).collect()
        assert sorted((r["path"], r["size"]) for r in got) == want and all(r["mtime"] > 1e9 for r in got)
    (tmp_path / "empty").mkdir()
    assert files.list_folder(spark, str(tmp_path / "empty")).count() == 0


def test_pages_are_recognised_as_rows(spark):
    from tessera.sources import ocr

    def engine():
        def run(content):
            if content == b"bad":
                raise ValueError
            return [([], content.decode(), 0.9), ([], "faint", 0.1)]

        return run

    pages = spark.createDataFrame([("f", 1, b"recognised words", "ab"), ("f", 2, b"bad", ""), ("f", 3, None, None)], "path string, page int, image binary, layer string")
    out = ocr.recognise(pages, engine, tasks=2).withColumn("text", ocr.better_text(F.col("layer"), F.col("recognised"))).orderBy("page").collect()
    assert [(r["recognised"], r["text"]) for r in out] == [("recognised words", "recognised words"), (None, ""), (None, "")]
