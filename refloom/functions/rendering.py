"""Rendering of references and in-text markers; dates, years, numeric markers and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms of a notice's date (single letters also take padded numbers).
DATE_FORMS = ("yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "M/d/yyyy H:m", "M/d/yyyy")
ET_AL_AFTER = 6


def filled(x: Column) -> Column:
    """Null for blank."""
    return F.nullif(F.trim(x), F.lit(""))


def parse_notice_date(raw: Column) -> Column:
    bare = F.regexp_replace(F.trim(raw), "Z$", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(p)) for p in DATE_FORMS))


def year_in(raw: Column) -> Column:
    """The first four digits in a row, else the text itself, else null."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"\d{4}", 0), F.lit("")), filled(raw))


def year_run(raw: Column) -> Column:
    """The first four digits in a row, else null: what has no year shows none."""
    return F.nullif(F.regexp_extract(raw, r"\d{4}", 0), F.lit(""))


def year_of_century(raw: Column) -> Column:
    """The first number of four digits, no more, that begins with 19 or 20, else null."""
    return F.nullif(F.regexp_extract(raw, r"(?<!\d)(?:19|20)\d{2}(?!\d)", 0), F.lit(""))


def year_of_issue(issued: Column) -> Column:
    """The year of a work's JSON date: of its parts (a number in any spelling, else as it is), else its raw text, else null."""
    first = filled(F.get_json_object(issued, "$.date-parts[0][0]"))
    return F.coalesce(first.try_cast("int").cast("string"), first, filled(F.get_json_object(issued, "$.raw")))


def ensure_period(x: Column) -> Column:
    return F.when(x.rlike(r"[.?!]$"), x).otherwise(F.concat(x, F.lit(".")))


def join_authors(authors: Column, et_al_after: int = ET_AL_AFTER) -> Column:
    names = F.filter(authors, lambda a: F.trim(a) != "")
    listed = F.array_join(F.slice(names, 1, et_al_after), ", ")
    return F.when(F.size(names) > et_al_after, F.concat(listed, F.lit(", et al"))).otherwise(listed)


def volume_issue_pages(volume: Column, issue: Column, pages: Column) -> Column:
    v = F.concat(F.coalesce(filled(volume), F.lit("")), F.coalesce(F.concat(F.lit("("), filled(issue), F.lit(")")), F.lit("")))
    return F.concat(v, F.coalesce(F.concat(F.when(v != "", F.lit(":")).otherwise(F.lit("")), filled(pages)), F.lit("")))


def vancouver(authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, pmid: Column, doi: Column, et_al_after: int = ET_AL_AFTER) -> Column:
    """Authors. Title. Journal. Year;Volume(Issue):Pages. doi: ... PMID: ..."""
    where = filled(volume_issue_pages(volume, issue, pages))
    dated = F.nullif(F.concat_ws(";", filled(year), where), F.lit(""))
    return F.concat_ws(" ", ensure_period(filled(join_authors(authors, et_al_after))), ensure_period(filled(title)), ensure_period(filled(journal)), ensure_period(dated), F.concat(F.lit("doi: "), filled(doi), F.lit(".")), F.concat(F.lit("PMID: "), filled(pmid), F.lit(".")))


def surname(author: Column) -> Column:
    """'Family II' without the initials."""
    return F.regexp_replace(F.trim(author), r"\s+[A-Z]{1,4}$", "")


def marker_author_year(authors: Column, year: Column) -> Column:
    """(A, y), (A & B, y), (A et al., y); Anon without authors; the year only if there is one."""
    names = F.filter(authors, lambda a: F.trim(a) != "")
    first, second = surname(F.get(names, 0)), surname(F.get(names, 1))
    who = F.when(F.size(names) == 0, F.lit("Anon")).when(F.size(names) == 1, first).when(F.size(names) == 2, F.concat(first, F.lit(" & "), second)).otherwise(F.concat(first, F.lit(" et al.")))
    return F.concat(F.lit("("), F.concat_ws(", ", who, filled(year)), F.lit(")"))


def marker_numbers(marker: Column, widest: int = 100) -> Column:
    """Numbers of a marker such as [3,5-7]; a range that runs backwards or too far gives its ends only."""
    parts = F.filter(F.split(F.regexp_replace(marker, r"[^0-9,\-–]", ""), ","), lambda p: p.rlike(r"\d"))

    def numbers(p: Column) -> Column:
        ends = F.transform(F.filter(F.split(p, "[-–]"), lambda x: x != ""), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("int"))
        lo, hi = F.get(ends, 0), F.get(ends, 1)
        return F.when(hi.isNull(), F.array(lo)).when((hi >= lo) & (hi - lo <= widest), F.sequence(lo, hi)).otherwise(F.array(lo, hi))

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def chars_without_spaces(text: Column) -> Column:
    return F.length(F.translate(text, " \n\t", ""))


def author_year(authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, doi: Column) -> Column:
    """Authors (Year). Title. Journal, Volume(Issue):Pages. doi: ..."""
    who = F.coalesce(filled(join_authors(authors)), F.lit("Anon"))
    head = F.concat(F.concat_ws(" ", who, F.concat(F.lit("("), filled(year), F.lit(")"))), F.lit("."))
    where = F.concat_ws(", ", F.regexp_replace(filled(journal), r"\.$", ""), filled(volume_issue_pages(volume, issue, pages)))
    return F.concat_ws(" ", head, ensure_period(filled(title)), ensure_period(F.nullif(where, F.lit(""))), F.concat(F.lit("doi: "), filled(doi), F.lit(".")))


def format_reference(style: Column, authors: Column, title: Column, journal: Column, year: Column, volume: Column, issue: Column, pages: Column, pmid: Column, doi: Column, journal_style: Column | None = None, et_al: dict[str, int] | None = None) -> Column:
    """A reference in the style that its row names: vancouver or author_year; another one is an error. ``et_al`` has how many authors
    a journal's style lists in vancouver before et al."""
    fields = (title, journal, year, volume, issue, pages)
    plain = vancouver(authors, *fields, pmid, doi)
    listed = plain
    for name, n in (et_al or {}).items():
        if journal_style is not None:
            listed = F.when(journal_style == name, vancouver(authors, *fields, pmid, doi, n)).otherwise(listed)
    unknown = F.raise_error(F.concat(F.lit("unknown style: "), F.coalesce(style, F.lit("null")))).cast("string")
    return F.when(style == "vancouver", listed).when(style == "author_year", author_year(authors, *fields, doi)).otherwise(unknown)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def cache_key(url: Column, accept: Column) -> Column:
    """Key of a cached response: the request without credentials, hashed."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?i)([?&])api_key=[^&#]*&?", "$1"), r"[?&](?=#|$)", "")
    return F.sha2(F.concat(F.lit("GET\n"), bare, F.lit("\n"), accept), 256)


def excerpt(text: Column, n: int = 140) -> Column:
    """White space folded, at most n characters, with an ellipsis where something was cut."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(x) > n, F.concat(F.substr(x, F.lit(1), F.lit(n)), F.lit("…"))).otherwise(x)


def heading_number(text: Column) -> Column:
    """Numbers of a heading such as 2.1.3; a bare number over 99 is no heading's."""
    raw = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)[.)]?(?:\s|$)", 1)
    parts = F.transform(F.split(raw, r"\."), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int"))
    return F.when((raw != "") & ~((F.size(parts) == 1) & (F.coalesce(F.get(parts, 0), F.lit(100)) > 99)), parts)
