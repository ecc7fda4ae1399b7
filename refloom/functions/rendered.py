"""Rendered citations and bibliography entries (HTML of one work each) put together, and names of files and styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.citations import ENTITIES
from refloom.functions.identifiers import is_plausible_slug
from refloom.functions.names import fold_letters
from refloom.functions.rendering import filled

# What is shown until a citation is rendered, and what counts as a year in a rendered citation.
PLACEHOLDER = "(citation)"
YEARISH = r"(?i)\b\d{4}[a-z]?\b|\bn\.\s?d\.|\bin press\b|\bforthcoming\b"


def plain(html: Column) -> Column:
    """Text of a fragment: without tags, with character references decoded, trimmed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", "")
    for a, b in ENTITIES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def sort_key(text: Column) -> Column:
    """Accents folded, what is left beyond ASCII dropped, lower case."""
    return F.lower(F.regexp_replace(fold_letters(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]", ""))


def without_parens(html: Column) -> Column:
    """The fragment without its text's outer parentheses, tags left as they are; null if the text has none."""
    text = plain(html)
    opened = F.regexp_replace(html, r"^((?:\s*<[^>]+>)*\s*[^<(]*)\(", "$1")
    closed = F.regexp_replace(opened, r"\)([^)<]*(?:<[^>]+>[^)<]*)*)$", "$1")
    return F.when(text.startswith("(") & text.endswith(")"), closed)


def year_part(text: Column) -> Column:
    """The part of an author-date item after its last comma (or its last word) if it looks like a year."""
    tail = F.trim(F.regexp_extract(text, r"([^,]*)$", 1))
    last = F.when(F.contains(text, F.lit(",")), tail).otherwise(F.regexp_extract(F.trim(text), r"(\S*)$", 1))
    return F.when(last.rlike(YEARISH), last)


def grouped_citation(items: Column) -> Column:
    """ARRAY<(html, year_only)> of single author-date citations -> one in a pair of parentheses, in order of an
    accent-folded key; null if any is missing, has no parentheses, or neither letters nor a year (a numeric style's)."""

    def read(x: Column) -> Column:
        inner = without_parens(x["html"])
        text = plain(inner)
        year = year_part(text)
        fit = inner.isNotNull() & text.rlike(r"\p{L}") & text.rlike(YEARISH) & (~x["year_only"] | year.isNotNull())
        return F.struct(sort_key(F.when(x["year_only"], year).otherwise(text)).alias("k"), F.when(fit, F.when(x["year_only"], year).otherwise(inner)).alias("h"))

    def joined(rows: Column) -> Column:
        ordered = F.transform(F.array_sort(F.transform(rows, lambda r, i: F.struct(r["k"].alias("k"), i.alias("i"), r["h"].alias("h")))), lambda r: r["h"])
        return F.when((F.size(rows) > 0) & ~F.exists(rows, lambda r: r["h"].isNull()), F.concat(F.lit("("), F.array_join(ordered, "; "), F.lit(")")))

    return F.element_at(F.transform(F.array(F.transform(items, read)), joined), 1)


def shown_citation(items: Column) -> Column:
    """The grouped citation, or the placeholder where there is none."""
    return F.coalesce(grouped_citation(items), F.lit(PLACEHOLDER))


def clean_entry(html: Column) -> Column:
    """A bibliography entry without the divisions around it, its number joined to its text by a space."""
    body = F.coalesce(filled(F.regexp_extract(html, r'(?s)<div[^>]*class="csl-entry"[^>]*>(.*)</div>', 1)), html, F.lit(""))
    joined = F.regexp_replace(body, r'</div>\s*<div[^>]*class="csl-right-inline"[^>]*>', " ")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"</?div\b[^>]*>", ""), r"\s*\n\s*", " "))


def ordered_entries(entries: Column) -> Column:
    """Clean entries, empty ones left out: as they came if all are numbered, else by an accent-folded key."""
    clean = F.filter(F.transform(entries, clean_entry), lambda e: plain(e) != "")

    def arranged(rows: Column) -> Column:
        by_key = F.array_sort(F.transform(rows, lambda e, i: F.struct(sort_key(plain(e)).alias("k"), i.alias("i"), e.alias("e"))))
        return F.when(F.forall(rows, lambda e: plain(e).rlike(r"^\s*[\[(]?\d")), rows).otherwise(F.transform(by_key, lambda x: x["e"]))

    return F.element_at(F.transform(F.array(clean), arranged), 1)


def is_valid_style(style: Column, known: Column, exists: Column) -> Column:
    """A known style, or a plausible name that nobody found missing (``exists`` is null where it couldn't be asked)."""
    return F.coalesce(known, F.lit(False)) | (is_plausible_slug(style) & F.coalesce(exists, F.lit(True)))


def style_note(style: Column, known: Column, exists: Column) -> Column:
    """A warning for a style that is accepted without being known; null for others."""
    unknown = ~F.coalesce(known, F.lit(False)) & is_plausible_slug(style)
    return F.when(unknown & exists.isNull(), F.concat(F.lit("unverified style: "), style)).when(unknown & exists, F.concat(F.lit("style outside the catalogue: "), style))


def first_filled(*values: Column) -> Column:
    """The first of several names of a field that holds something."""
    return F.coalesce(*map(filled, values))


def item_year(date: Column) -> Column:
    """The first four digits in a row that no digit follows or precedes unbroken: a date's year, or null."""
    return filled(F.regexp_extract(date, r"(?:^|\D)(\d{4})(?:\D|$)", 1))


def item_data(key: Column, kind: Column, title: Column, year: Column, journal: Column, doi: Column) -> Column:
    """A minimal CSL item as JSON text, fields in this order, empty ones left out."""
    at = lambda name, x: F.when(filled(x).isNotNull(), F.concat(F.lit(f',"{name}":'), F.to_json(F.array(filled(x))).substr(F.lit(2), F.length(F.to_json(F.array(filled(x)))) - 2)))
    digits = F.left(year, F.lit(4))
    issued = F.when(filled(year).isNotNull(), F.concat(F.lit(',"issued":{"date-parts":['), F.when(digits.rlike(r"^\d+$"), F.concat(F.lit("["), digits.try_cast("int").cast("string"), F.lit("]"))).otherwise(""), F.lit("]}")))
    quoted = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    head = F.concat(F.lit('{"id":'), quoted(key), F.lit(',"type":'), quoted(F.coalesce(filled(kind), F.lit("article-journal"))), F.lit(',"title":'), quoted(F.coalesce(F.trim(title), F.lit(""))))
    return F.concat(head, F.coalesce(issued, F.lit("")), F.coalesce(at("container-title", journal), F.lit("")), F.coalesce(at("DOI", doi), F.lit("")), F.lit("}"))
