"""Wikitext and html to prose, as a chain of regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement) in order, as Java regular expressions.  Steps marked * stand for a
# wikitext parser: comments, templates, file links, links, external links, emphasis, headings.
STEPS = (
    (r"(?is)<ref[^>]*?/>|<ref[^>]*?>.*?</ref>", " "),
    (r"(?s)\{\|.*?\|\}", " "),
    (r"(?s)<!--.*?-->", ""),  # *
    (r"\{\{[^{}]*\}\}", ""),  # *
    (r"\{\{[^{}]*\}\}", ""),  # * and again for each level that templates are nested
    (r"\{\{[^{}]*\}\}", ""),  # *
    (r"\{\{[^{}]*\}\}", ""),  # *
    (r"\{\{[^{}]*\}\}", ""),  # *
    (r"\{\{[^{}]*\}\}", ""),  # *
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"),  # *
    (r"\[https?://[^\s\]]+\s*([^\]]*)\]", "$1"),  # *
    (r"'{2,}", ""),  # *
    (r"(?md)^=+\s*(.*?)\s*=+\s*$", "$1"),  # *
    (r"<[^>]+>", " "),
    (r"(?imd)^(?:\s*(?:thumb|thumbnail|mini|left|right|center|centre|none|upright|border|frameless|frame|\d+\s*x?\s*\d*\s*px)\s*\|)+", ""),
    (r"(?md)^[\s|!{}*#:;=-]+$", ""),
    (r"[ \t ]+", " "),
    (r"\s+([,;.!?])", "$1"),
    (r"\n{3,}", "\n\n"),
)


def clean(text: Column) -> Column:
    for pattern, replacement in STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return F.regexp_replace(text, r"^\s+|\s+$", "")
