"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and patterns that outputs depend on.
MAX_SLUG = 60
MAX_CAPTION = 200
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*(`{3,}|~{3,})"
CAPTION_START = r"(?i)^\s*(fig(ure)?|table|image|chart|exhibit|plate|diagram|scheme)\b"
IMAGE_LINK = r"!\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
REASONING_MODEL = r"(?i)^(o\d|gpt-5|gpt-6)"
EFFORTS = {"low": "low", "medium": "medium", "high": "high", "xhigh": "high", "max": "high"}
NO_LOCATOR = "x00"
#: White space as Unicode has it, inside a character class.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeezed(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def slug_of_ascii(c: Column, fallback: str | Column = "document") -> Column:
    """Slug of a text that is ASCII already (see folded)."""
    s = F.regexp_replace(c, r"[^\w\s-]", "")
    s = F.regexp_replace(F.lower(stripped(s)), r"[\s_]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, MAX_SLUG), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), fallback if isinstance(fallback, Column) else F.lit(fallback))


def _decomposed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


def folded(c: Column) -> Column:
    """Compatibility decomposition, without what is not ASCII: the one function without a built-in counterpart."""
    return F.pandas_udf(_decomposed, "string")(c)


def slugify(c: Column, fallback: str | Column = "document") -> Column:
    return slug_of_ascii(folded(c), fallback)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def title_from_path(path: Column) -> Column:
    """File stem with - and _ as spaces; the file name where that leaves nothing."""
    return F.coalesce(F.nullif(squeezed(F.regexp_replace(stem(path), "[_-]+", " ")), F.lit("")), file_name(path))


def page_locator(n: Column) -> Column:
    return F.format_string("p%03d", n)


def slide_locator(n: Column) -> Column:
    return F.format_string("s%02d", n)


def chapter_locator(n: Column) -> Column:
    return F.format_string("ch%02d", n)


def heading_locator(n: Column) -> Column:
    return F.format_string("h%02d", n)


def image_id(slug: Column, locator: Column, number: Column) -> Column:
    return F.concat_ws("-", slug, locator, F.format_string("img%02d", number))


def clean_caption(c: Column) -> Column:
    s = F.translate(squeezed(F.coalesce(c, F.lit(""))), "[]", "")
    return F.when(F.length(s) > MAX_CAPTION, F.concat(F.rtrim(F.substring(s, 1, MAX_CAPTION - 1)), F.lit("…"))).otherwise(s)


def image_markdown(id: Column, ext: Column, caption: Column, extracted: Column, reason: Column) -> Column:
    """Link of an extracted image, placeholder of another."""
    cap = clean_caption(caption)
    said = F.when(cap == "", "").otherwise(F.concat(F.lit(": "), cap))
    why = F.coalesce(F.nullif(reason, F.lit("")), F.lit("image not extracted"))
    return F.when(extracted, F.concat(F.lit("!["), id, said, F.lit("](images/"), id, ext, F.lit(")"))).otherwise(F.concat(F.lit("*["), id, F.lit(" — "), why, said, F.lit("]*")))


def block_markdown(kind: Column, text: Column, level: Column, lang: Column, image: Column) -> Column:
    """Markdown of one block; a code fence is one backtick longer than any run in the code."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    code = F.concat(fence, F.coalesce(lang, F.lit("")), F.lit("\n"), text, F.lit("\n"), fence)
    heading = F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level))), F.lit(" "), stripped(text))
    return F.when(kind == "heading", heading).when(kind == "image", image).when(kind == "code", code).otherwise(text)


def human_size(n: Column, top: str = "GB") -> Column:
    """Bytes with a unit: whole bytes, one decimal above; nothing larger than `top`."""
    units = ["B", "KB", "MB", "GB"][: ["B", "KB", "MB", "GB"].index(top) + 1]
    # half to even at a tie, which format_string alone rounds up
    out = F.format_string("%.1f " + units[-1], F.bround(n / F.lit(float(1024 ** (len(units) - 1))), 1))
    for i in reversed(range(1, len(units) - 1)):
        out = F.when(n < 1024 ** (i + 1), F.format_string(f"%.1f {units[i]}", F.bround(n / F.lit(float(1024**i)), 1))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def truncated(c: Column, most: int | Column) -> Column:
    """The text where it has at most `most` words, else that many of them and an ellipsis."""
    words = F.regexp_extract_all(c, F.lit(f"([^{SPACE}]+)"), 1)
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when(F.size(words) <= most, c).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), most), " "), F.lit(" …")))


def leading_words(c: Column, most: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit(f"([^{SPACE}]+)"), 1), F.lit(1), most), " ")


def target_words(words: Column, ratio: float = 0.10, least_ratio: float = 0.05, most_ratio: float = 0.15, least: int = 150) -> Column:
    r = min(max(ratio, least_ratio), most_ratio)
    return F.greatest(F.lit(least).cast("long"), (words * F.lit(float(r))).cast("long"))


def section_text(title: Column, level: Column, body: Column) -> Column:
    headed = stripped(F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), title, F.lit("\n\n"), body))
    return F.when(title == "", body).otherwise(headed)


def table_cell(c: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\r\n|\r|\n", " "))


def normalized(c: Column) -> Column:
    return F.lower(squeezed(c))


def joined_lines(lines: Column) -> Column:
    """Lines in one; a line that ends with a single hyphen joins the next without a space and without it."""
    clean = F.filter(F.transform(lines, stripped), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        broken = acc.endswith("-") & ~acc.endswith("--")
        return F.when(acc == "", line).when(broken, F.concat(acc.substr(F.lit(1), F.length(acc) - 1), line)).otherwise(F.concat_ws(" ", acc, line))

    return F.aggregate(clean, F.lit(""), step)


def is_reasoning_model(c: Column) -> Column:
    return F.trim(c).rlike(REASONING_MODEL)


def effort(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EFFORTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), F.lit("medium"))


def odf_level(c: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(6), c.try_cast("int"))), F.lit(1))


def href_key(c: Column) -> Column:
    """Path of a link: no fragment, percent-decoded, no leading or trailing slash, . and .. resolved."""
    raw = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), r"\+", "%2B")
    parts = F.split(F.regexp_replace(F.try_url_decode(raw), "^/+|/+$", ""), "/")

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when((p == "") | (p == "."), acc).when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, p))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def usage_line(calls: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return F.concat(calls.cast("string"), F.lit(" request(s), "), F.format_number(tokens_in, 0), F.lit(" input + "), F.format_number(tokens_out, 0), F.lit(" output tokens"))
