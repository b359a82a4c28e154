"""PDF text, sizes and image places with the standard library: unencrypted files, plain or Flate streams, simple fonts.

The reader only reports what stands where; headings, captions, furniture and order are found by the layout operators.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from quire.functions import text as T
from quire.operators import layout
from quire.operators.blocks import numbered_images

ITEMS = "path string, page_count int, title string, page int, pos int, kind string, text string, size double, x0 double, y0 double, xref long, width int, height int, ext string, data binary, error string"
#: Lines of one size at most so many times it apart are of one paragraph.
PARAGRAPH_GAP = 1.6
#: A frame that leaves a Python worker has so many rows, or bytes of text and images, at most (one row may have more).
FRAME_ROWS, FRAME_BYTES = 4096, 1 << 23
SCANNED = "no extractable text found — this may be a scanned PDF (no OCR is performed)"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_PIECE = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPE.get(m[1], b"" if m[1][:1] in b"\r\n" else m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


class File:
    def __init__(self, content: bytes):
        if not content.lstrip().startswith(b"%PDF"):
            raise ValueError("could not open PDF: no header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("PDF is password protected")
        self.objects = {int(n): body for n, body in _OBJECT.findall(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
        if not self.objects:
            raise ValueError("could not open PDF: no objects")

    def _unpack(self, body: bytes) -> None:
        n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
        data = self.stream(body)
        heads = [int(x) for x in data[:first].split()[: 2 * n]]
        for i in range(n):
            end = first + heads[2 * i + 3] if i + 1 < n else len(data)
            self.objects.setdefault(heads[2 * i], data[first + heads[2 * i + 1] : end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        data = m[1] if m else b""
        return zlib.decompressobj().decompress(data) if b"/FlateDecode" in body[: m.start() if m else 0] else data

    def refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []

        def walk(n: int, seen: frozenset) -> None:
            body = self.objects.get(n, b"")
            if n in seen:
                return
            if re.search(rb"/Type\s*/Pages\b", body):
                for kid in self.refs(body, b"Kids"):
                    walk(kid, seen | {n})
            elif body:
                out.append(body)

        for n in self.refs(root, b"Pages"):
            walk(n, frozenset())
        return out

    def title(self) -> str:
        m = next((m for b in self.objects.values() if (m := re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f]*>)", b)) and b"/Dest" not in b and b"/Parent" not in b), None)
        return _string(m[1]).strip() if m else ""

    def outline(self) -> Iterator[tuple[int, str]]:
        """(level, title) of the outline's entries, in order."""
        one = lambda body, key: next(iter(self.refs(body, key)), None)
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        todo, seen = [(one(self.objects.get(one(root, b"Outlines"), b""), b"First"), 1)], set()
        while todo:
            n, level = todo.pop()
            if n is None or n in seen:
                continue
            seen.add(n)
            body = self.objects.get(n, b"")
            todo += [(one(body, b"Next"), level), (one(body, b"First"), level + 1)]
            if m := re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", body):
                yield level, _string(m[1]).strip()

    def image(self, n: int) -> tuple[str, bytes | None]:
        """Suffix and bytes of an image: JPEG as it is stored, plain samples of eight bits as PNG; other kinds have no bytes."""
        body = self.objects.get(n, b"")
        stream = _STREAM.search(body)
        head = body[: stream.start()] if stream else body
        number = lambda key: int(m[1]) if (m := re.search(rb"/" + key + rb"\s+(\d+)", head)) else 0
        if stream and b"/DCTDecode" in head:
            return ".jpg", stream[1]
        channels = {b"DeviceRGB": 3, b"DeviceGray": 1}.get(m[1] if (m := re.search(rb"/ColorSpace\s*/(\w+)", head)) else b"")
        if not stream or not channels or number(b"BitsPerComponent") != 8 or number(b"Predictor") > 1:
            return ".png", None
        w, h, raw = number(b"Width"), number(b"Height"), self.stream(body)
        if len(raw) < w * h * channels:
            return ".png", None
        rows = b"".join(b"\0" + raw[i * w * channels : (i + 1) * w * channels] for i in range(h))
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        shape = struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)
        return ".png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", shape) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    def images(self, page: bytes) -> dict[bytes, int]:
        for n in [None, *self.refs(page, b"Resources")]:
            body = page if n is None else self.objects.get(n, b"")
            m = re.search(rb"/XObject\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", body, re.S)
            if m:
                return {k: int(v) for k, v in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", m[1] or self.objects.get(int(m[2]), b""))}
        return {}


def page_items(file: File, page: bytes) -> Iterator[dict]:
    """Text lines and images of a page; y0 is counted from the top."""
    box = re.search(rb"/MediaBox\s*\[\s*[\d.-]+\s+[\d.-]+\s+[\d.]+\s+([\d.]+)", page)
    top, images = float(box[1]) if box else 792.0, file.images(page)
    data = b"\n".join(file.stream(file.objects.get(n, b"")) for n in file.refs(page, b"Contents"))
    args: list = []
    size, x, y, lx, ly, lead, scale, shift = 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, (0.0, 0.0)
    saved: list = []
    drawn = 0.0  # height of what is drawn next
    for m in _PIECE.finditer(data):
        t = m[0]
        if t[:1] in b"(<" or t in (b"[", b"]") or t[:1] == b"/":
            args.append(t)
            continue
        if re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            args.append(float(t))
            continue
        n = [a for a in args if isinstance(a, float)]
        if t == b"BT":
            x = y = lx = ly = 0.0
            scale = 1.0
        elif t == b"Tf" and n:
            size = n[-1]
        elif t == b"TL" and n:
            lead = n[-1]
        elif t in (b"Td", b"TD") and len(n) >= 2:
            lx, ly = lx + n[-2] * scale, ly + n[-1] * scale
            x, y, lead = lx, ly, -n[-1] if t == b"TD" else lead
        elif t == b"Tm" and len(n) >= 6:
            scale = abs(n[-3]) or 1.0
            lx, ly = n[-2], n[-1]
            x, y = lx, ly
        elif t in (b"T*", b"'", b'"'):
            ly -= lead * scale
            x, y = lx, ly
        elif t == b"q":
            saved.append(shift)
        elif t == b"Q" and saved:
            shift = saved.pop()
        elif t == b"cm" and len(n) >= 6:
            shift, drawn = (shift[0] + n[-2], shift[1] + n[-1]), abs(n[-3])
        elif t == b"Do" and args and isinstance(args[-1], bytes) and args[-1][1:] in images:
            ref = images[args[-1][1:]]
            body = file.objects.get(ref, b"")
            w, h = (int(k[1]) if (k := re.search(rb"/" + key + rb"\s+(\d+)", body)) else 0 for key in (b"Width", b"Height"))
            ext, bits = file.image(ref)
            yield {"kind": "image", "text": None, "size": None, "x0": shift[0], "y0": top - shift[1] - drawn, "xref": ref, "width": w, "height": h, "ext": ext, "data": bits}
        if t in (b"Tj", b"TJ", b"'", b'"'):
            text = "".join(_string(a) if isinstance(a, bytes) and a[:1] in b"(<" else " " if isinstance(a, float) and a < -200 and t == b"TJ" else "" for a in args)
            if text.strip():
                yield {"kind": "text", "text": text, "size": round(size * scale, 1), "x0": x + shift[0], "y0": top - y - shift[1], "xref": 0, "width": 0, "height": 0, "ext": None, "data": None}
        args = []


def _file_rows(path: str, content: bytes) -> list[dict]:
    """Rows of one file; if it cannot be read, one row with the error."""
    try:
        file = File(content)
        pages, title = file.pages(), file.title()
        of = {"path": path, "page_count": len(pages), "title": title, "error": None}
        rows = [{**of, "page": -1, "pos": -1, "kind": "file"}]
        rows += [{**of, "page": -1, "pos": k, "kind": "outline", "text": t, "width": level} for k, (level, t) in enumerate(file.outline())]
        for n, page in enumerate(pages):
            try:
                rows += [{**of, "page": n, "pos": k, **i} for k, i in enumerate(page_items(file, page))]
            except Exception as e:  # noqa: BLE001 - nor is one bad page the end of its file
                rows.append({**of, "page": n, "pos": -1, "kind": "note", "text": f"page {n + 1} could not be read: {e or type(e).__name__}"})
        return rows
    except Exception as e:  # noqa: BLE001 - one bad file is data
        return [{"path": path, "error": str(e) or type(e).__name__}]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of many small files in one frame, whose making costs more than the reading of such a file."""
    names = [c.split()[0] for c in ITEMS.split(", ")]
    rows, held = [], 0
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            for row in _file_rows(path, bytes(content)):
                rows.append(row)
                held += len(row.get("text") or "") + len(row.get("data") or b"")
                if len(rows) >= FRAME_ROWS or held >= FRAME_BYTES:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names, dtype=object)


def items(files: DataFrame) -> DataFrame:
    """files (path, content) to a row for each file, outline entry (kind outline, its level in width), line of text, image, and note of a bad page."""
    return files.select("path", "content").mapInPandas(_rows, ITEMS)


def blocks(found: DataFrame, min_pixels: int = layout.MIN_PIXELS) -> DataFrame:
    """Page items to doc_id, page, at, pos, kind, text, level, caption, xref, size, y0: headings by outline or font size, captions on their images."""
    rows = found.filter(F.col("error").isNull()).withColumn("doc_id", F.col("path"))
    spans = rows.filter("kind = 'text'").select("doc_id", "page", F.col("pos").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), "text", "size")
    pages = rows.filter("kind = 'file'").select("doc_id", "page_count")
    bodies = layout.body_sizes(spans)
    drawn = rows.filter(F.col("kind").isin("text", "image")).select("doc_id", "page", "pos", "kind", "text", "size", "x0", "y0", "xref", "width", "height")
    kept = layout.captioned(layout.reading_order(layout.content_items(drawn, pages, min_pixels)))
    toc = layout.toc_levels(rows.filter("kind = 'outline'").select("doc_id", "pos", F.col("text").alias("title"), F.col("width").alias("level")))
    return layout.classified(kept, bodies, layout.heading_sizes(spans, bodies), toc).select("doc_id", "page", "at", "pos", "kind", "text", "level", "caption", "xref", "size", "y0")


def paragraphs(made: DataFrame) -> DataFrame:
    """Blocks with lines of text close to each other in one, joined as the lines of a paragraph are: doc_id, page, at, kind, text, level, caption, pos."""
    w = Window.partitionBy("doc_id", "page").orderBy("at")
    plain = (F.col("kind") == "text") & (F.col("level") == 0)
    gap = F.col("y0") - F.lag("y0").over(w)
    goes_on = plain & F.coalesce(F.lag(plain).over(w), F.lit(False)) & (F.lag("size").over(w) == F.col("size")) & (gap >= 0) & (gap <= F.col("size") * PARAGRAPH_GAP)
    rows = made.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_par", F.sum("_new").over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    one = lambda c: F.first(c).alias(c)
    return rows.groupBy("doc_id", "page", "_par").agg(F.min("at").alias("at"), one("kind"), one("level"), one("caption"), F.min("pos").alias("pos"), T.joined_lines(lines).alias("text")).drop("_par")


def documents(files: DataFrame, schema: str, min_pixels: int = layout.MIN_PIXELS) -> DataFrame:
    """files (path, content) to rows of readers.SCHEMA: titles, headings, paragraphs, and images with captions where they stood.

    Files are parsed once; their items are kept (on disk where memory ends) for the layout's passes over them.
    """
    found = items(files).persist(StorageLevel.MEMORY_AND_DISK)
    titled = found.filter("kind = 'file' or error is not null").select("path", "error", F.coalesce(F.nullif(F.trim("title"), F.lit("")), T.title_from_path(F.col("path"))).alias("title"))
    titled = titled.withColumn("slug", T.slugify(F.col("title"), T.slugify(T.stem(F.col("path")))))
    made = paragraphs(blocks(found, min_pixels))
    order = Window.partitionBy("doc_id").orderBy("page", "at")
    placed = made.withColumn("n", F.row_number().over(order) - 1)
    drawn = placed.filter("kind = 'image'").join(titled.select(F.col("path").alias("doc_id"), "slug"), "doc_id")
    numbered = numbered_images(drawn.select("doc_id", "slug", "page", F.col("pos").alias("item"), "caption", F.col("n").alias("pos"), T.page_locator(F.col("page") + 1).alias("locator")))
    bits = found.filter("kind = 'image'").select(F.col("path").alias("doc_id"), "page", F.col("pos").alias("item"), "ext", "data")
    images = numbered.join(bits, ["doc_id", "page", "item"]).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    reason = F.when(F.col("data").isNull(), "image could not be decoded").otherwise("")
    image = F.struct("place", "id", "ext", "caption", reason.alias("reason"), F.lit(None).cast("string").alias("link"), "data")
    pictures = images.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(image)), lambda i: i.dropFields("place")).alias("images"))
    rows = placed.join(images.select("doc_id", F.col("pos").alias("n"), "place"), ["doc_id", "n"], "left")
    kind = F.when(F.col("level") > 0, "heading").otherwise(F.col("kind"))
    block = F.struct(F.col("n").alias("pos"), kind.alias("kind"), F.when(F.col("kind") == "text", F.col("text")).otherwise("").alias("text"), F.col("level").alias("level"), F.lit("").alias("lang"), F.col("place").alias("image"))
    bodies = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    bad = found.filter("kind = 'note'").groupBy(F.col("path").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("bad"))
    out = titled.withColumnRenamed("path", "doc_id")
    for part in (bodies, pictures, bad):
        out = out.join(part, "doc_id", "left")
    empty = F.coalesce(~F.exists("blocks", lambda b: b["kind"] != "image"), F.lit(True)) & F.col("error").isNull()
    notes = F.concat(F.coalesce(F.transform("bad", lambda n: n["text"]), F.array().cast("array<string>")), F.when(empty, F.array(F.lit(SCANNED))).otherwise(F.array().cast("array<string>")))
    of = {"path": F.col("doc_id"), "has_h1": F.lit(False), "notes": notes}
    kinds = {f.name: f.dataType for f in T_.StructType.fromDDL(schema).fields}
    of |= {c: F.coalesce(F.col(c), F.array().cast(kinds[c].simpleString())) for c in ("blocks", "images")}
    return out.select(*((of[c] if c in of else F.col(c)).cast(k).alias(c) for c, k in kinds.items()))
