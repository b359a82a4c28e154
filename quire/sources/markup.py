"""HTML to Markdown with image positions, on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

#: In raw Markdown, image n stands as this until its final form is known.
TOKEN = "\ue000{}\ue001"

NOISE = frozenset(("script", "style", "noscript", "iframe", "svg", "head", "title"))
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form header hr html main nav ol p pre section summary table tbody tfoot thead tr ul".split())
LEVELS = {f"h{n}": n for n in range(1, 7)}


class Writer(HTMLParser):
    """Collects Markdown; image(caption, src, heading number) answers the token's number."""

    def __init__(self, image: Callable[[str, str, int], int]):
        super().__init__(convert_charrefs=True)
        self.image = image
        self.out: list[str] = []
        self.headings, self.has_h1, self.first_heading = 0, False, ""
        self.noise = 0
        self.lists: list[list] = []
        self.links: list[str] = []
        self.pre = 0
        self.heading_at: tuple[int, int] | None = None
        self.figures: list[dict] = []
        self.cells: list[list[str]] | None = None
        self.cell_at = 0

    def gap(self, text: str = "\n\n") -> None:
        self.out.append(text)

    def handle_starttag(self, tag: str, attributes: list) -> None:
        a = {k: v or "" for k, v in attributes}
        if tag in NOISE:
            self.noise += 1
        if self.noise:
            return
        if tag == "body":
            return
        if tag in LEVELS:
            self.headings += 1
            self.has_h1 |= tag == "h1"
            self.gap()
            self.heading_at = (LEVELS[tag], len(self.out))
        elif tag == "img":
            caption = a.get("alt", "").strip()
            n = self.image(caption, (a.get("src") or a.get("data-src") or "").strip(), self.headings)
            self.out.append(TOKEN.format(n))
            if not caption and self.figures:
                self.figures[-1]["images"].append(n)
        elif tag == "figure":
            self.gap()
            self.figures.append({"images": [], "caption": None})
        elif tag == "figcaption":
            self.gap()
            if self.figures and self.figures[-1]["caption"] is None:
                self.figures[-1]["from"] = len(self.out)
        elif tag in ("ul", "ol"):
            self.gap("\n" if self.lists else "\n\n")
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "- "
            if self.lists:
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "
            self.gap("\n" + "  " * depth + mark)
        elif tag == "a":
            self.links.append(a.get("href", ""))
            self.out.append("[")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.gap("\n\n```\n")
        elif tag == "br":
            self.gap("  \n")
        elif tag == "hr":
            self.gap("\n\n---\n\n")
        elif tag == "table":
            self.gap()
            self.cells = []
        elif tag == "tr" and self.cells is not None:
            self.cells.append([])
        elif tag in ("td", "th") and self.cells is not None:
            self.cell_at = len(self.out)
            if not self.cells:
                self.cells.append([])
        elif tag == "blockquote":
            self.gap("\n\n> ")
        elif tag in BLOCK:
            self.gap()

    def handle_endtag(self, tag: str) -> None:
        if tag in NOISE:
            self.noise = max(0, self.noise - 1)
            return
        if self.noise:
            return
        if tag in LEVELS and self.heading_at:
            level, at = self.heading_at
            text = " ".join("".join(self.out[at:]).split())
            self.out[at:] = ["#" * level + " " + text, "\n\n"] if text else []
            plain = re.sub("\ue000\\d+\ue001", "", text).strip()
            self.first_heading = self.first_heading or plain
            self.heading_at = None
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.gap("\n" if self.lists else "\n\n")
        elif tag == "a":
            href = self.links.pop() if self.links else ""
            self.out.append(f"]({href})")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.gap("\n```\n\n")
        elif tag == "figcaption" and self.figures and self.figures[-1].get("from") is not None and self.figures[-1]["caption"] is None:
            self.figures[-1]["caption"] = " ".join("".join(self.out[self.figures[-1]["from"] :]).split())
            self.gap()
        elif tag == "figure" and self.figures:
            figure = self.figures.pop()
            for n in figure["images"]:
                self.captioned(n, figure["caption"] or "")
            self.gap()
        elif tag in ("td", "th") and self.cells:
            self.cells[-1].append(" ".join("".join(self.out[self.cell_at :]).split()))
            del self.out[self.cell_at :]
        elif tag == "table" and self.cells is not None:
            self.gap("\n\n" + table(self.cells) + "\n\n")
            self.cells = None
        elif tag in BLOCK:
            self.gap()

    captions: dict[int, str]

    def captioned(self, n: int, caption: str) -> None:
        self.__dict__.setdefault("captions", {})[n] = caption

    def handle_data(self, data: str) -> None:
        if not self.noise:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        text = re.sub(r"[ \t]+\n", "\n", "".join(self.out).replace("  \n", "\ue002")).replace("\ue002", "  \n")
        text = re.sub(r"\n[ \t]+(?=\S)(?![-\d])", "\n", text)
        return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(html: str, image: Callable[[str, str, int], int]) -> Writer:
    writer = Writer(image)
    writer.feed(html)
    writer.close()
    return writer


def cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ").strip()


def table(rows: list[list[str]]) -> str:
    """A pipe table: rows without text go, short rows are filled, blank headers are named."""
    rows = [[cell(c) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    head, *rest = [r + [""] * (width - len(r)) for r in rows]
    head = [c or f"col{n}" for n, c in enumerate(head, 1)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *rest])
