"""Small files made from columns, so that the readers can be queried over any table: a title, a heading, a text and a table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_ODF = " ".join(f'xmlns:{n}="urn:oasis:names:tc:opendocument:xmlns:{n}:1.0"' for n in ("office", "text", "table"))


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(heading: str, text: str, cells: list[str]) -> bytes:
    para = lambda t, style="": f"<w:p><w:pPr><w:pStyle w:val='{style}'/></w:pPr><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    row = "<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in cells) + "</w:tr>"
    return _zipped({"word/document.xml": f"<w:document {_W}><w:body>{para(heading, 'Heading 1')}{para(text)}<w:tbl>{row}{row}</w:tbl></w:body></w:document>"})


def pptx(heading: str, text: str, cells: list[str]) -> bytes:
    shape = lambda t, kind="": f"<p:sp><p:nvSpPr><p:cNvPr id='2' name='x'/><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = f"<p:sld {_P}><p:cSld><p:spTree>{shape(heading, '<p:ph type="title"/>')}{shape(text)}</p:spTree></p:cSld></p:sld>"
    rels = f"<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='r1' Type='{_R}/slide' Target='slides/slide1.xml'/></Relationships>"
    return _zipped({"ppt/presentation.xml": f"<p:presentation {_P}><p:sldIdLst><p:sldId id='256' r:id='r1'/></p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide1.xml": slide})


def odt(heading: str, text: str, cells: list[str]) -> bytes:
    row = "<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>" for c in cells) + "</table:table-row>"
    body = f"<text:h text:outline-level='1'>{escape(heading)}</text:h><text:p>{escape(text)}</text:p><table:table>{row}{row}</table:table>"
    return _zipped({"content.xml": f"<office:document-content {_ODF}><office:body><office:text>{body}</office:text></office:body></office:document-content>"})


def epub(heading: str, text: str, cells: list[str]) -> bytes:
    page = f"<html xmlns='http://www.w3.org/1999/xhtml'><head><title>t</title></head><body><h1>{escape(heading)}</h1><p>{escape(text)}</p></body></html>"
    box = "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='c.opf'/></rootfiles></container>"
    opf = "<package xmlns='http://www.idpf.org/2007/opf'><metadata/><manifest><item id='a' href='a.xhtml' media-type='application/xhtml+xml'/></manifest><spine><itemref idref='a'/></spine></package>"
    return _zipped({"META-INF/container.xml": box, "c.opf": opf, "a.xhtml": page})


def rtf(heading: str, text: str, cells: list[str]) -> bytes:
    said = lambda t: "".join(c if c.isascii() and c not in "\\{}" else f"\\{c}" if c in "\\{}" else "".join(f"\\u{int.from_bytes(c.encode('utf-16-le')[i : i + 2], 'little')}?" for i in range(0, len(c.encode("utf-16-le")), 2)) for c in t)
    return ("{\\rtf1{\\fonttbl x;}" + said(heading) + "\\par " + said(text) + "\\par " + said(" ".join(cells)) + "}").encode("ascii")


def pdf(heading: str, text: str, cells: list[str]) -> bytes:
    said = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252", "replace")
    page = b"BT /F1 24 Tf 72 700 Td (%s) Tj ET BT /F1 11 Tf 72 650 Td (%s) Tj ET" % (said(heading), said(text))
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(page), page)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1))


KINDS = {"docx": docx, "pptx": pptx, "odt": odt, "epub": epub, "rtf": rtf, "pdf": pdf}


def files(rows: DataFrame, kind: str) -> DataFrame:
    """rows (path, heading, body, cells) to files (path, length, content) of a kind."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [KINDS[kind](r.heading, r.body, list(r.cells)) for r in b.itertuples()]
            yield pd.DataFrame({"path": b["path"], "length": [len(m) for m in made], "content": made})

    return rows.select("path", "heading", "body", "cells").mapInPandas(each, "path string, length long, content binary")
