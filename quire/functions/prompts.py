"""Request texts. What a summarizer is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAPTER_SYSTEM = "You summarize ONE SECTION of a longer document, from its own text alone. Keep names, numbers, dates, findings and defined terms. Begin with substance. Cite image anchors such as [report-p012-img01] in square brackets. Output only the summary."
SINGLE_SYSTEM = "You summarize a document. Keep names, numbers, dates, findings and defined terms. Begin with substance. Cite image anchors such as [report-p012-img01] in square brackets. Output only the summary."
OVERVIEW_SYSTEM = "You write the opening overview of a summary, from the summaries of its sections: what the document is, what it covers and what matters most in it. Do not list the sections. Output only the overview."

# The parts of a request.
POSITION = "This is section %d of %d of a document."
HEADING = 'Its heading is: "%s"'
PREVIOUS = "For continuity only, here is your summary of the PREVIOUS section. Do not summarize it again and do not repeat its content:\n\n<previous_summary>\n%s\n</previous_summary>"
SECTION = "Summarize the section below in approximately %d words.\n\n<section>\n%s\n</section>"
DOCUMENT = "Summarize the document below in approximately %d words.\n\n<document>\n%s\n</document>"
OVERVIEW = 'Document title: "%s"\n\nWrite an overview of approximately %d words, based on these section summaries.\n\n<section_summaries>\n%s\n</section_summaries>'


def single_user(text: Column, target: Column) -> Column:
    return F.format_string(DOCUMENT, target, text)


def chapter_user(title: Column, text: Column, target: Column, position: Column, total: Column, previous: Column) -> Column:
    return F.concat_ws(
        "\n\n",
        F.format_string(POSITION, position, total),
        F.when(title != "", F.format_string(HEADING, title)),
        F.when(previous != "", F.format_string(PREVIOUS, previous)),
        F.format_string(SECTION, target, text),
    )


def overview_user(title: Column, joined: Column, target: int) -> Column:
    return F.format_string(OVERVIEW, title, F.lit(target), joined)


def user_text(mode: str, title: str, text: str, target: int, position: int, total: int, previous: str) -> str:
    """The request of a section, for summarizers that run in Python."""
    if mode == "single":
        return DOCUMENT % (target, text)
    parts = [POSITION % (position, total), HEADING % title if title else "", PREVIOUS % previous if previous else "", SECTION % (target, text)]
    return "\n\n".join(p for p in parts if p)
