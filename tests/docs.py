"""Small documents of each format, made in memory."""

import io
import zipfile

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 20


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{}</dc:title></cp:coreProperties>'
RELS = '<Relationships xmlns="r">{}</Relationships>'


def rel(id, kind, target, external=False):
    return f'<Relationship Id="{id}" Type="http://x/{kind}" Target="{target}"{" TargetMode=" + chr(34) + "External" + chr(34) if external else ""}/>'


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
    p = lambda text, style="", more="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    pic = lambda rid, attr, name: f'<w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" name="{name}"/><a:blip r:{attr}="{rid}"/></wp:inline></w:drawing></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Overview", "H1") + p("Some text.") + pic("r1", "embed", "Picture 3") + p("A caption", "Cap") + p("Detail", "H2") + f"<w:tbl><w:tr>{cell('a|b')}{cell('')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("Deep", "", '<w:outlineLvl w:val="2"/>') + pic("r2", "link", "Chart")
    style = lambda id, name: f'<w:style w:styleId="{id}"><w:name w:val="{name}"/></w:style>'
    return zipped({
        "word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "docProps/core.xml": CORE.format("Quarterly Memo"), "word/media/i.png": PNG,
        "word/styles.xml": f"<w:styles {w}>{style('H1', 'heading 1')}{style('H2', 'heading 2')}{style('Cap', 'caption')}</w:styles>",
        "word/_rels/document.xml.rels": RELS.format(rel("r1", "image", "media/i.png") + rel("r2", "image", "http://x/y.png", True)),
    })


def pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sp = lambda y, lines, kind="": f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>' + "".join(f'<a:p><a:pPr lvl="{lv}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for lv, t in lines) + "</p:txBody></p:sp>"
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="2" name="Picture 2" descr="Sales photo"/></p:nvPicPr><p:blipFill><a:blip r:embed="r1"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="5"/></a:xfrm></p:spPr></p:pic>'
    slide = lambda body: f"<p:sld {ns}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="s1"/><p:sldId id="2" r:id="s2"/></p:sldIdLst></p:presentation>', "docProps/core.xml": CORE.format("Launch Deck"),
        "ppt/_rels/presentation.xml.rels": RELS.format(rel("s1", "slide", "slides/a.xml") + rel("s2", "slide", "slides/b.xml")),
        "ppt/slides/a.xml": slide(sp(9, [(0, "one"), (1, "two")]) + pic + sp(0, [(0, "The Title")], "title")), "ppt/slides/b.xml": slide(sp(0, [(0, "alone")])),
        "ppt/slides/_rels/a.xml.rels": RELS.format(rel("r1", "image", "../media/p.jpg") + rel("n", "notesSlide", "../notes/n.xml")), "ppt/media/p.jpg": PNG,
        "ppt/notes/n.xml": f"<p:notes {ns}><p:cSld><p:spTree>{sp(0, [(0, 'say this')], 'body')}</p:spTree></p:cSld></p:notes>",
    })


def epub():
    html = lambda body: f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{body}</body></html>'
    return zipped({
        "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>',
        "OEBPS/c.opf": '<package xmlns="o" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>The Book</dc:title></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/><item id="i" href="img/x.png" media-type="image/png"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "OEBPS/nav.xhtml": html('<nav><ol><li><a href="t/b.xhtml#s">A Titled Chapter</a></li></ol></nav>'), "OEBPS/img/x.png": PNG,
        "OEBPS/t/a.xhtml": html('<h1>First</h1><p>Hello.</p><figure><img src="../img/x.png" alt="alt text"/><figcaption>cap</figcaption></figure>'), "OEBPS/t/b.xhtml": html('<p>No heading.</p><img src="gone.png"/>'),
    })


def odt():
    ns = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in {"office": "office", "text": "text", "draw": "drawing", "table": "table", "svg": "svg-compatible"}.items()) + ' xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    frame = lambda href, inner="": f'<draw:frame draw:name="Frame A"><draw:image xlink:href="{href}"/>{inner}</draw:frame>'
    cell = lambda t, n=1: f'<table:table-cell table:number-columns-repeated="{n}"><text:p>{t}</text:p></table:table-cell>'
    body = f'<text:h text:outline-level="1">Top</text:h><text:p>a<text:tab/>b {frame("Pictures/p.png", "<svg:desc>said</svg:desc>")}</text:p><text:list><text:list-item><text:p>item</text:p></text:list-item></text:list><table:table><table:table-row>{cell("x")}{cell("", 900)}</table:table-row><table:table-row>{cell("1", 2)}</table:table-row></table:table><text:p>{frame("Pictures/none.png")}</text:p>'
    return zipped({"content.xml": f"<office:document-content {ns}><office:body><office:text>{body}</office:text></office:body></office:document-content>", "meta.xml": f"<office:document-meta {ns}><office:meta><dc:title>Open Doc</dc:title></office:meta></office:document-meta>", "Pictures/p.png": PNG})


def pdf():
    text = b"BT /F1 24 Tf 72 700 Td (Introduction) Tj ET BT /F1 11 Tf 72 650 Td (Body text that is a good deal longer than it) Tj ET q 200 0 0 150 72 400 cm /I1 Do Q BT /F1 9 Tf 72 380 Td (Figure 1: the plot) Tj ET"
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /XObject << /I1 5 0 R >> >> >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(text), text), b"<< /Subtype /Image /Width 200 /Height 150 /Filter /DCTDecode /Length 3 >>\nstream\nabc\nendstream", b"<< /Title (Annual Review) >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1))


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return zipped({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": RELS.format(rel("r1", "worksheet", "worksheets/s.xml")), "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>", "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'})


RTF = rb"{\rtf1{\fonttbl{\f0 Arial;}}First \b bold\b0  text.\par caf\u233?\'e9 {\pict 0102}end\par \u-10179?\u-8704?\par}"
HTML = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b> <a href='u'>three</a>.</p><ul><li>x</li><li>y</li></ul><h2>Next</h2><img src='pic.png' alt='local'><img src='http://r/x.png'><img src='no.png'><img src='../out.png'><img></body></html>"
MD = "# Title\n\n![a](pic.png)\n\n## Two\n\n```\n# comment ![b](pic.png)\n```\n![c](https://x/y.png)\n![d](none.png \"t\")\n"


def report(empty=False):
    """A PDF of four pages with an outline, a logo on the good three, an icon, a JPEG with a caption, plain samples, and a last page that is broken."""
    import zlib

    line = lambda size, x, y, t: b"BT /F1 %d Tf %d %d Td (%s) Tj ET " % (size, x, y, t)
    logo = b"q 80 0 0 30 500 750 cm /L Do Q "
    pages = [
        line(24, 72, 700, b"Introduction") + line(11, 72, 650, b"Body text of the first page that goes on in a sec-") + line(11, 72, 637, b"ond line.") + b"q 8 0 0 8 72 600 cm /K Do Q q 200 0 0 150 72 400 cm /J Do Q " + line(9, 72, 380, b"Figure 1: the plot") + logo,
        line(11, 72, 700, b"Method") + line(11, 72, 650, b"Page two has text.") + b"q 200 0 0 150 72 400 cm /S Do Q " + logo,
        line(11, 72, 700, b"Page three has text.") + logo,
    ]
    pages = [b"", b"", b""] if empty else pages
    stream = lambda head, data: b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(data), data)
    image = lambda w, h, more, data: stream(b"/Subtype /Image /Width %d /Height %d %s" % (w, h, more), data)
    plain = b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode"
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 20 0 R >>",
        2: b"<< /Type /Pages /Kids [%s] /Count 4 >>" % b" ".join(b"%d 0 R" % n for n in (3, 4, 5, 6)[: 3 if empty else 4]),
        **{3 + i: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents %d 0 R /Resources << /XObject << /L 11 0 R /K 12 0 R /J 13 0 R /S 14 0 R >> >> >>" % (7 + i) for i in range(4)},
        **{7 + i: stream(b"/Filter /FlateDecode", zlib.compress(p)) for i, p in enumerate(pages)},
        10: stream(b"/Filter /FlateDecode", b"broken"),
        11: image(80, 30, plain, zlib.compress(bytes(80 * 30 * 3))),
        12: image(8, 8, plain, zlib.compress(bytes(8 * 8 * 3))),
        13: image(200, 150, b"/Filter /DCTDecode", b"jpeg"),
        14: image(200, 150, plain, zlib.compress(bytes(range(250)) * 360)),
        20: b"<< /First 21 0 R >>",
        21: b"<< /Title (Introduction) /Parent 20 0 R /Next 23 0 R /First 22 0 R >>",
        22: b"<< /Title (Method) /Parent 21 0 R >>",
        23: b"<< /Title (Conclusion) /Parent 20 0 R >>",
    }
    if not empty:
        parts[30] = b"<< /Title (Annual Review 2026) >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in parts.items())
