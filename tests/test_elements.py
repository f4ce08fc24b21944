"""Elements of office files and web pages: files made here, against what was put into them."""

import zipfile

import pytest

from lodestone.sources import elements as L

W = 'xmlns:w="urn:w"'
REL = 'xmlns="urn:rel"'


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def paragraph(text, style="", listed=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if listed else "")
    runs = "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in text.split("|"))
    return f"<w:p><w:pPr>{props}</w:pPr>{runs}</w:p>"


def table(rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


@pytest.fixture()
def files(tmp_path):
    inner = table([[paragraph("deep")]])
    body = paragraph("Top|ic", "Heading1") + paragraph("Some &amp; text\n  here") + paragraph("item", listed=True) + paragraph("") + table([[paragraph("a") + paragraph("b"), paragraph("")], [inner + paragraph("after"), paragraph("d")]]) + paragraph("end", "Heading 2")
    zipped(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    sheet = '<sheetData><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>3.5</v></c></row><row><c t="inlineStr"><is><t>in</t><t>line</t></is></c><c t="b"><v>1</v></c><c/></row></sheetData>'
    zipped(
        tmp_path / "b.xlsx",
        {
            "xl/workbook.xml": f'<workbook {REL} xmlns:r="urn:r"><sheets><sheet name="Two" sheetId="2" r:id="x2"/><sheet name="One" sheetId="1" r:id="x1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="x1" Target="/xl/worksheets/s1.xml"/><Relationship Id="x2" Target="worksheets/s2.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {REL}><si><t>no</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>",
            "xl/worksheets/s1.xml": f'<worksheet {REL}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
            "xl/worksheets/s2.xml": f"<worksheet {REL}>{sheet}</worksheet>",
        },
    )
    slide = lambda t, p: f'<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:nvPr/><p:txBody><a:p><a:r><a:t>{p}</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'
    zipped(
        tmp_path / "sub.pptx",
        {
            "ppt/presentation.xml": '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst><p:sldId id="256" r:id="s9"/><p:sldId id="257" r:id="s1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="s1" Target="slides/slide1.xml"/><Relationship Id="s9" Target="slides/slide9.xml"/></Relationships>',
            "ppt/slides/slide1.xml": slide("Last", "one"),
            "ppt/slides/slide9.xml": slide("First", "nine"),
        },
    )
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "empty.xlsx").write_bytes(b"")
    (tmp_path / ".hidden.docx").write_bytes(b"")
    zipped(tmp_path / "other.pptx", {"mimetype": "x"})
    zipped(tmp_path / "cut.docx", {"word/document.xml": f"<w:document {W}><w:body>{paragraph('kept')}<w:p><w:r>"})
    return tmp_path


def rows_of(found, name):
    rows = [r for r in found if r["path"].endswith(name)]
    return [(r["kind"], r["level"], r["part"], r["table_no"], r["row_no"], r["cell_no"], r["text"]) for r in sorted(rows, key=lambda r: r["place"]) if r["error"] is None]


def test_office(spark, files):
    found = L.read_office(spark, [str(files)]).collect()
    n = None
    assert rows_of(found, "a.docx") == [
        ("heading", 1, "document", n, n, n, "Topic"),
        ("paragraph", n, "document", n, n, n, "Some & text here"),
        ("list_item", n, "document", n, n, n, "item"),
        ("cell", n, "document", 1, 1, 1, "a b"),
        ("cell", n, "document", 2, 1, 1, "deep"),
        ("cell", n, "document", 1, 2, 1, "after"),
        ("cell", n, "document", 1, 2, 2, "d"),
        ("heading", 2, "document", n, n, n, "end"),
    ]
    assert rows_of(found, "b.xlsx") == [
        ("cell", n, "Two", 1, 2, 1, "rich text"),
        ("cell", n, "Two", 1, 2, 28, "3.5"),
        ("cell", n, "Two", 1, 3, 1, "inline"),
        ("cell", n, "Two", 1, 3, 2, "TRUE"),
        ("cell", n, "One", 2, 1, 1, "7"),
    ]
    assert [(r[0], r[2], r[6]) for r in rows_of(found, "sub.pptx")] == [("title", "slide 1", "First"), ("paragraph", "slide 1", "nine"), ("title", "slide 2", "Last"), ("paragraph", "slide 2", "one")]
    errors = {r["path"].rpartition("/")[2]: r["error"] for r in found if r["error"]}
    assert set(errors) == {"broken.docx", "other.pptx", "cut.docx"}
    assert rows_of(found, "cut.docx")[0][6] == "kept"


def test_empty_content(spark):
    found = L.elements_of(spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")).collect()
    assert [(r["place"], r["kind"], r["error"] is not None) for r in found] == [(0, None, True)] * 2


def test_texts(spark, files):
    texts = {r["path"].rpartition("/")[2]: r["content"] for r in L.texts_of(L.read_office(spark, [str(files)])).collect()}
    assert texts["b.xlsx"] == "rich text\t3.5\ninline\tTRUE\n7"
    assert texts["a.docx"] == "# Topic\nSome & text here\n- item\na b\ndeep\nafter\td\n## end"
    assert "broken.docx" not in texts


def test_html(spark):
    html = """<html><head><title>A &amp; B</title><style>p{}</style></head><body>lead<H2 class="x">Head <b>bold</b></H2>
    <p>one<br>two<p>three</p>tail<table><tr><th>k</th><th></th></tr><tr><td>1</td><td><i>2</i></td></tr></table><script>var t="</p>";</script><ul><li>x<li>y</ul><!-- <p>no</p> --><pre> c  d </pre><picture>z</picture>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain"), (5, "<table><tr><td>a</table><table><tr><td>b")], "id int, html string")
    found = L.html_elements(pages, "id", "html").orderBy("id", "place").collect()
    n = None
    assert [tuple(r)[2:] for r in found if r["id"] == 1] == [
        ("title", n, n, n, n, "A & B"),
        ("text", n, n, n, n, "lead"),
        ("heading", 2, n, n, n, "Head bold"),
        ("paragraph", n, n, n, n, "one two"),
        ("paragraph", n, n, n, n, "three"),
        ("text", n, n, n, n, "tail"),
        ("cell", n, 1, 1, 1, "k"),
        ("cell", n, 1, 2, 1, "1"),
        ("cell", n, 1, 2, 2, "2"),
        ("list_item", n, n, n, n, "x"),
        ("list_item", n, n, n, n, "y"),
        ("code", n, n, n, n, "c d"),
        ("text", n, n, n, n, "z"),
    ]
    assert [r["place"] for r in found if r["id"] == 1] == list(range(13))
    assert [tuple(r) for r in found if r["id"] in (2, 3, 4)] == [(4, 0, "text", n, n, n, n, "plain")]
    assert [(r["table_no"], r["row_no"], r["cell_no"], r["text"]) for r in found if r["id"] == 5] == [(1, 1, 1, "a"), (2, 1, 1, "b")]
