"""Main text of web pages by a maximum-scoring subsequence.

A page is a run of blocks. Words score positive and tags negative, with weights by kind (tag name, word in a link or
not) taken from labelled pages; one linear scan finds the contiguous blocks of greatest sum. Where a page marks its
article by elements, blocks in them count as positive and others as negative. What lies inside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments is never text, wherever it stands. Such zones are elements of
that kind, or of a class, id or role that says so as a whole word (beside words such as box or list only). Elements are parsed with the
end tags that HTML implies, and one that is never closed by its own ends with its first block. Forms and marked wrappers that hold the
article, or nearly all of a page, are no zones.

Labelled pages are those that mark their article by an element: at most `sample` of them, of smallest hash, give the
weights. Defined cases: null and empty html give empty text; pages cut off in the middle keep what came before;
an unclosed menu or advert ends where an article begins; white space is what Python's str.split takes for it; <br> is white
space; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000

# Names of HTML elements, and class words that mark what is not the article.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a b br em i img span strong".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog head noscript template iframe svg canvas object select button datalist map audio video".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs consent cookie cookies dialog footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
#: Parts of a compound name that do not change what the word beside them says.
NEUTRAL = frozenset("area article articles aside bar block body bottom box button buttons card cards center container content entry form global group inline inner item items left link links list main mobile outer page panel post posts primary reader right row secondary section site slot stories story top unit user users wrap wrapper zone 1 2 3".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ARTICLE = frozenset("article main".split())
#: Elements that may lack an end tag, with the elements whose start ends them and the ones that hold them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
BARRIERS = frozenset("td th table caption".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|title|xmp)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|$)|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^a-z0-9]+")


def _marks(attributes: str) -> set[str]:
    """Words of class and id that stand alone or beside neutral words only, and role:<role>."""
    found: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            found.add(f"role:{value.strip()}")
            continue
        for token in value.split():
            parts = {x for x in _PART.split(token) if x}
            if parts <= CLASSES | COMMENTS | NEUTRAL:
                found |= parts - NEUTRAL
    return found


class Element:
    """An element of a page. kind: '' or why it may be no text (comments, element, form, class). Places count the page's events:
    first and until are its own, body where its opening text or first block ends, article where an article begins in it;
    what stands in it before gone is no text."""

    __slots__ = ("name", "up", "kind", "words", "first", "body", "until", "ended", "article", "heading", "gone", "inside")

    def __init__(self, name: str, up: Element | None, kind: str, at: int):
        self.name, self.up, self.kind, self.first = name, up, kind, at
        self.words = self.body = self.until = self.ended = self.article = self.heading = self.gone = 0
        self.inside = name in ARTICLE or up is not None and up.inside


def _kind(name: str, attributes: str, up: Element) -> str:
    marks = _marks(attributes) if "=" in attributes else set()
    if marks & COMMENTS and name not in ("html", "body", "main"):
        # an article or heading is no comment for a word on whether it takes any
        return "comments"
    if name in ("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"):
        return ""
    if name in OUTSIDE:
        return "" if name == "header" and up.inside else "form" if name == "form" else "element"
    if up.inside:
        marks = marks - {"header"}  # of the article itself
    return "class" if marks & CLASSES or any(m.startswith("role:") and m[5:] in ROLES for m in marks) else ""


def parsed(html: str) -> tuple[list[tuple[str, str, Element]], list[Element]]:
    """(what, value, element) in page order, and the elements: what is text, open, close or void; value a text or a name."""
    root = Element("", None, "", 0)
    events: list[tuple[str, str, Element]] = []
    every, stack = [root], [root]
    held: dict[str, int] = {}

    def pop(own: bool) -> None:
        x = stack.pop()
        held[x.name] -= 1
        x.until, x.ended = len(events), own
        events.append(("close", x.name, x))
        if x.name in BLOCKS and not stack[-1].body:
            stack[-1].body = len(events)
        stack[-1].words += x.words

    def close(name: str, stop: frozenset | set, own: bool) -> None:
        """Ends the innermost open element of the name, if none of stop stands between."""
        if not held.get(name):
            return
        i = len(stack) - 1
        while stack[i].name != name:
            if stack[i].name in stop:
                return
            i -= 1
        while len(stack) > i + 1:
            pop(False)
        pop(own)

    for m in _TOKEN.finditer(html):
        whole, name = m.group(0), (m.group(3) or "").lower()
        if not name:
            if m.group(1) is None and not (whole[0] == "<" and len(whole) > 1):
                events.append(("text", whole, stack[-1]))
                stack[-1].words += len(whole.split())
            continue
        if m.group(2) == "/":
            close(name, BLOCKS if name not in BLOCKS else BARRIERS - {name}, True)
            continue
        if name in BLOCKS:
            close("p", BLOCKS - {"p"}, False)
            if name == "body":
                close("head", frozenset(), False)
            for ends in IMPLIED.get(name, ((), ()))[0]:
                close(ends, IMPLIED[name][1], True)
            if not stack[-1].body and stack[-1].words:
                stack[-1].body = len(events)  # its opening text ends here
        if name in VOID or m.group(4).endswith("/"):
            events.append(("void", name, stack[-1]))
            continue
        x = Element(name, stack[-1], _kind(name, m.group(4), stack[-1]), len(events))
        events.append(("open", name, x))
        every.append(x)
        stack.append(x)
        held[name] = held.get(name, 0) + 1
    while len(stack) > 1:
        pop(False)
    root.until = len(events)
    return events, every


def _decide(every: list[Element]) -> None:
    """Sets gone. A form or a marked wrapper that holds nearly all words of the page is transparent; an element without an end
    tag of its own ends with its opening text or first block, and one in which the page's only articles stand where they begin."""
    total = every[0].words
    articles = [x for x in every if x.name in ARTICLE and x.kind != "comments" and x.words]
    for x in articles:
        above = x.up
        while above is not None and not above.article:
            above.article, above = x.first, above.up
    for x in every:
        above = x.up if x.name == "h1" else None
        while above is not None and not above.heading:
            above.heading, above = 1, above.up
    for x in every:
        if not x.kind:
            continue
        x.gone, share = x.until, x.words / max(1, total)
        if x.article and (not x.ended or all(x.first < y.first < x.until for y in articles)):
            x.gone = x.article
        elif not x.ended and x.name not in IMPLIED and x.name != "p":
            x.gone = min(x.until, x.body or x.until)
        elif x.kind == "form" and share >= 0.5 or x.kind in ("form", "class") and share >= (0.7 if x.heading else 0.9):
            x.gone = 0


def blocks(html: str) -> list[tuple[str, dict[str, int], bool]]:
    """(text, number of tokens by kind, whether in the article element) of each block, in page order."""
    events, every = parsed(html)
    _decide(every)
    out: list[tuple[str, dict[str, int], bool]] = []
    text: list[str] = []
    kinds: dict[str, int] = {}
    link = main = hidden = 0  # up to the place hidden all is dropped

    def close() -> None:
        nonlocal kinds
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            kind = "word-link" if link else "word"
            kinds[kind] = kinds.get(kind, 0) + words.count(" ") + 1
        if words or kinds:
            out.append((words, kinds, main > 0))
        kinds = {}

    for at, (what, value, x) in enumerate(events):
        if what == "open" and x.gone > max(at, hidden):
            if value in BLOCKS:
                close()
            hidden = x.gone + (x.gone == x.until)
        if at < hidden:
            continue
        if what == "text":
            text.append(value)
            continue
        if value in BLOCKS:
            close()
        elif value == "br":
            text.append(" ")
        if what != "void" and value in ARTICLE and x.kind != "comments":
            main = max(0, main + (1 if what == "open" else -1))
        if what != "void" and value == "a":
            link = int(what == "open")
        kind = value if value in BLOCKS or value in INLINE else "other"
        kinds[kind] = kinds.get(kind, 0) + 1
    close()
    return out


def weight(kind: str, inside: float, outside: float) -> float:
    """Log odds of the article, kept above 0 for words and below 0 for tags."""
    odds = math.log((inside + 1) / (outside + 1))
    return min(3.0, max(0.1, odds)) if kind.startswith("word") else max(-3.0, min(-0.001, odds))


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last-but-one place of the run of greatest sum, the longest of the first such; (0, 0) if none is above 0."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and start == at[0] and at[1]):
            best, at = total, (start, i + 1)
    return at


def main_text(html: str | None, weights: dict[str, float]) -> str:
    found = blocks(html or "")
    marked = any(inside and words for words, _, inside in found)
    scores = []
    for words, kinds, inside in found:
        s = sum(n * weights.get(k, 1.0 if k.startswith("word") else -0.5) for k, n in kinds.items())
        scores.append(s if not marked else max(s, 0.01) if inside else min(s, -0.01))
    if marked:  # what stands between two articles does not part them
        places = [i for i, (words, _, inside) in enumerate(found) if inside and words]
        scores = [s if inside or not places[0] < i < places[-1] else 0.0 for i, (s, (_, _, inside)) in enumerate(zip(scores, found))]
    a, b = best_run(scores)
    return "\n".join(words for words, _, inside in found[a:b] if words and (inside or not marked))


def learn(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights by kind of token, from at most `sample` pages that mark their article."""

    def each(batches):
        inside: dict[str, int] = {}
        outside: dict[str, int] = {}
        for b in batches:
            for html in b.column("html").to_pylist():
                found = blocks(html or "")
                if not any(main and words for words, _, main in found):
                    continue  # its article element is no article, such as a reader's comment
                for _, kinds, main in found:
                    into = inside if main else outside
                    for k, n in kinds.items():
                        into[k] = into.get(k, 0) + n
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_pydict({"kind": names, "i": [inside.get(k, 0) for k in names], "o": [outside.get(k, 0) for k in names]}, schema=pa.schema([("kind", pa.string()), ("i", pa.int64()), ("o", pa.int64())]))

    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)\\b")).select("html", F.xxhash64("html").alias("h"))
    # only hashes are ordered; equal pages are one, so that copies do not fill the sample
    cut = marked.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    picked = marked.filter(F.col("h") <= F.lit(cut)).dropDuplicates(["h"]) if cut is not None else marked.limit(0)
    rows = picked.mapInArrow(each, "kind string, i long, o long").groupBy("kind").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect()  # kinds are a fixed list
    return {r.kind: weight(r.kind, r.i, r.o) for r in rows}


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars: a row for each page."""
    w = learn(pages) if weights is None else weights
    types = dict(pages.dtypes)

    def each(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(x, w) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(each, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
