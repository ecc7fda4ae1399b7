"""What a line of a manuscript looks like: statistics, labels, headings, captions, citations, reference entries, placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.rendering import filled

# The shapes themselves.
P_VALUE = r"(?i)\bp\s*[<>=≤≥]\s*0?\.\d+|\bp[-–\s]*values?\b"
EFFECT_SIZE = (
    r"(?i)\b95\s*%\s*CI\b|\beffect\s+size\b|\bCohen\b|\b(?:OR|HR|RR)\b\s*(?:=|\bof\b|:)\s*\d|\bOR\s*=|\bHR\s*=|(?<![\p{L}\p{N}_])β\s*=|\br\s*=\s*[-.\d]|\beta\s+squared\b|\bhedges\b"
    r"|\b(?:odds|hazard|risk)\s+ratio\b|\bconfidence\s+interval\b"
)
DISPERSION = r"(?i)\bSD\b|\bstandard\s+deviation\b|\bSEM\b|\bstandard\s+error\b|\bCI\b|\bconfidence\s+interval\b"
SIGNIFICANCE = r"(?i)\*\s*p|\bp\s*[<>=≤≥]|\bp\s*-\s*value|\bsignifican"
FIGURE_LABEL = r"(?i)\b(?:Figure|Fig\.?)\s+(\d+)\b(?:\.|\s|$)"
TABLE_LABEL = r"(?i)\bTable\s+(\d+)\b(?:\.|\s|$)"
CAPTION = r"(?i)^\s*(?:supp(?:lementary|l|\.)?\s+)?(?:table|fig(?:ure|\.|s)?|scheme|appendix)\s+s?\d"
YEAR = r"\b(?:19|20)\d{2}\b"
CITED_ID = r"(?i)PMC\d+|PMID:\s*\d+|doi\.org/|10\.\d{4,9}/"
ID_TOKEN = r"(?i)https?://\S+|(?:doi\.org/)?10\.\d{4,9}/\S+|PMC\d+|PMID:\s*\d+"
ENUMERATED = r"^\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|\(?\d+\)?[.)]|\d+[.)])\s+\S"
ENUMERATOR = r"^\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|\(?\d+\)?[.)]|\d+[.)])\s+"
NUMBERING = r"^\s*(\[\d+\]|\(?\d+\)\.?|\d+\.)\s+"
PARTICLE = r"(?:(?:van|von|de|der|den|del|della|di|da|das|dos|du|la|le|lo|el|al|bin|ibn|mac|mc|st|ter|ten)\s+){0,3}"
SURNAME = r"[A-Z][A-Za-z'’\-]+"
INITIALS = r"[A-Z](?:\.?\s*[A-Z]){0,3}\.?"
NOT_A_REFERENCE = r"(?i)^\s*(?:Adapted\s+from|Reprinted\s+from|Modified\s+from|Figure\s+\d|Fig\.\s*\d|Table\s+\d)"
NUMBERS_ONLY = r"^\d+(?:\s*[,\-–]\s*\d+)*$"
LARGEST_NUMBER = 999
PLACEHOLDER = r"(?i)^\s*(?:CITE|CITATION|REF|REF\?|CITE\?)\s*$|\b(?:cites?|references?|citations?|refs?|todo|et\s+al)\b|\bref\.?\s*\d|\?"
ORGANISATION = (
    r"(?i)\b(?:Group|Committee|Society|Association|Collaborat\w+|Consortium|Network|Panel|Initiative|Organi[sz]ation|Investigators|Trialists|Task\s+Force|Working\s+Group|Study\s+Group"
    r"|Foundation|Institute|Council|Federation|College|WHO|EASL|AHA|ACC|ESC|NICE|AASLD)\b"
)
DISALLOWED = {"pmid": r"(?i)\bPMID\b|PMID:\s*\d+", "pmcid": r"(?i)\bPMCID\b|PMCID:\s*PMC?\d+", "accession": r"(?i)\baccession\b"}
ACCESSED, DATE_OR_URL = r"(?i)\bAccessed\b", r"(?i)\b(?:19|20)\d{2}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b|https?://"
SECTION_WORD = (
    r"(?:Methods|Results|Background|Conclusions?|Discussion|Funding|Introduction|Materials|Acknowledge?ments?|Data\s+Availability|Abstract"
    r"|Significance|Summary|Limitations?|Objectives?|Aims?|Hypothes[ei]s|Disclosures?|Author\s+Information|Author\s+Contributions?|Additional\s+Information|Supporting\s+Information"
    r"|Competing\s+(?:Financial\s+)?Interests?|Conflicts?\s+of\s+Interest|Online\s+Methods|Extended\s+Data|Correspondence|Footnotes?|Endnotes?)"
)
CAPITALISED, ACRONYM = r"[A-Z][A-Za-z&'\-]*", r"[A-Z][A-Z&'\-]+"
LONG_ENOUGH = 40

_BYLINE = rf"^{PARTICLE}{SURNAME}\s+{INITIALS}\s*(?:,|and\b|&)"
ORGANISED = rf"(?:{CAPITALISED}\s+){{0,5}}{ACRONYM}(?:\s+{CAPITALISED}){{0,5}}\s*\.|{CAPITALISED}(?:\s+{CAPITALISED}){{1,5}}\s*\."
_ONE_AUTHOR = rf"^(?:{PARTICLE}{SURNAME}\s+{INITIALS}\.|(?!{SECTION_WORD}[.\s])(?:{ORGANISED}))"
_LISTED = rf"^{PARTICLE}{SURNAME}(?:\s+{INITIALS})?(?:\s*,|\s+and\b|\s+&)"


def is_heading_style(style: Column) -> Column:
    x = F.lower(style)
    return F.coalesce(x.startswith("heading") | x.startswith("title"), F.lit(False))


def is_heading_shape(text: Column) -> Column:
    """A line of one to eight words without a full stop at its end."""
    t = F.trim(text)
    return (t != "") & (F.size(F.split(t, r"\s+")) <= 8) & ~t.endswith(".")


def is_caption(text: Column) -> Column:
    return F.coalesce(text.rlike(CAPTION), F.lit(False))


def is_citation_line(text: Column) -> Column:
    """An identifier; or a byline of several authors and a year; or, in a long line, one author's or an organisation's and a year."""
    t = F.trim(text)
    return t.rlike(CITED_ID) | (t.rlike(YEAR) & (t.rlike(_BYLINE) | ((F.length(t) >= LONG_ENOUGH) & t.rlike(_ONE_AUTHOR))))


def has_reference_signal(text: Column) -> Column:
    """A byline, or a year that isn't part of an identifier."""
    t = F.trim(text)
    return t.rlike(_BYLINE) | t.rlike(_ONE_AUTHOR) | F.regexp_replace(t, ID_TOKEN, " ").rlike(YEAR)


def is_reference_entry(text: Column) -> Column:
    """A citation line, numbered or not, with a byline or a year of its own."""
    bare = F.regexp_replace(text, ENUMERATOR, "")
    numbered = text.rlike(ENUMERATED) & is_citation_line(bare)
    return F.when(numbered, has_reference_signal(bare)).otherwise(is_citation_line(text) & has_reference_signal(text))


def is_reference_shaped(text: Column) -> Column:
    """With a year, no caption or adaptation note, and numbered or, in a long line, led by authors."""
    t = F.trim(text)
    return ~t.rlike(NOT_A_REFERENCE) & t.rlike(YEAR) & (t.rlike(ENUMERATED) | ((F.length(t) > LONG_ENOUGH) & (t.rlike(_LISTED) | t.rlike(_ONE_AUTHOR))))


def numbering(text: Column) -> Column:
    return filled(F.regexp_extract(text, NUMBERING, 1))


def is_numeric_citation(inner: Column) -> Column:
    """Numbers from 1 to 999 in lists and ranges."""
    t = F.trim(inner)
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.when(F.length(x) > 9, 0).otherwise(x.try_cast("int")))
    return t.rlike(NUMBERS_ONLY) & F.forall(numbers, lambda n: n.between(1, LARGEST_NUMBER))


def is_placeholder(inner: Column) -> Column:
    return inner.rlike(PLACEHOLDER) | inner.rlike(YEAR)


def is_corporate(family: Column, given: Column) -> Column:
    """An organisation: nothing at all, braces, or a word of organisations without a given name or a comma."""
    fam, giv = F.coalesce(F.trim(family), F.lit("")), F.coalesce(F.trim(given), F.lit(""))
    both = F.trim(F.concat_ws(" ", fam, giv))
    return (both == "") | both.rlike(r"[{}]") | (both.rlike(ORGANISATION) & ((giv == "") | ~F.contains(both, F.lit(","))))


def disallowed_fields(text: Column) -> Column:
    """Which fields an entry carries that a style may forbid."""
    found = [F.when(text.rlike(p), F.lit(k)) for k, p in DISALLOWED.items()] + [F.when(text.rlike(ACCESSED) & text.rlike(DATE_OR_URL), F.lit("url_accessed"))]
    return F.array_compact(F.array(*found))


def diverges(text: Column, year: Column, family: Column) -> Column:
    """The match's year isn't among the text's years, or its first author isn't in a text long enough to name one."""
    years = F.regexp_extract_all(text, F.lit(f"({YEAR})"), F.lit(1))
    by_year = filled(year).isNotNull() & (F.size(years) > 0) & ~F.array_contains(years, year)
    by_author = filled(family).isNotNull() & (F.length(text) > 25) & ~F.contains(F.lower(text), F.lower(F.trim(family)))
    return F.coalesce(by_year, F.lit(False)) | F.coalesce(by_author, F.lit(False))


def surname_in_text(text: Column, family: Column, given: Column) -> Column:
    """The surname as a whole word; one of fewer than three letters only next to the initials."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    fam = F.trim(family)
    initials = F.transform(F.regexp_extract_all(F.coalesce(given, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), lambda g: F.substr(g, F.lit(1), F.lit(1)))
    alone = F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), quoted(fam), F.lit(r"\b")))
    beside = F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), quoted(fam), F.lit(r"\s*,?\s*"), F.array_join(initials, r"[.\-\s]*"), F.lit(r"\b")))
    return F.coalesce((fam != "") & F.when(F.length(fam) >= 3, alone).otherwise((F.size(initials) > 0) & beside), F.lit(False))


def bibliographic_query(text: Column) -> Column:
    """Without "et al", runs of dotted or hyphenated initials set apart."""
    bare = F.regexp_replace(text, r"(?i),?\s*\bet\s+al\.?\s*,?", " ")
    apart = F.regexp_replace(bare, r"\b([A-Z])[.\-](?=[A-Z]\b)", "$1 ")
    return F.trim(F.regexp_replace(apart, r"\s{2,}", " "))


def rough_title(line: Column) -> Column:
    """The longest clause after the first, the earliest of equals, if it has twelve characters; at most 200 of them."""
    bare = F.trim(F.regexp_replace(line, r"^\s*(?:\[\d+\]|\(?\d+\)?[.)])\s*", ""))
    clauses = F.filter(F.transform(F.split(bare, r"\.\s+"), lambda c: F.trim(c)), lambda c: c != "")
    rest = F.slice(clauses, F.lit(2), F.greatest(F.size(clauses) - 1, F.lit(0)))
    best = F.aggregate(rest, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    return F.when(F.length(best) >= 12, F.substr(best, F.lit(1), F.lit(200)))


def word_tokens(text: Column) -> Column:
    """Words with the white space after them (before them, for the first), so that joining gives the text again."""
    return F.when(F.trim(text) == "", F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))).otherwise(F.regexp_extract_all(text, F.lit(r"(^\s*\S+\s*|\S+\s*)"), F.lit(1)))


def changed_span(old: Column, new: Column) -> Column:
    """(removed, added): the one span that differs, between the longest common start and end; null if nothing does."""
    shared = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, i, F.lit(1)) != ""), i).otherwise(n)
    )
    start = shared(old, new)
    cut = lambda x, p, q: F.substr(x, p + 1, F.greatest(F.length(x) - p - q, F.lit(0)))
    tails = F.struct(F.substr(old, start + 1, F.length(old)).alias("o"), F.substr(new, start + 1, F.length(new)).alias("n"))
    span = F.transform(F.array(tails), lambda t: F.transform(F.array(shared(F.reverse(t["o"]), F.reverse(t["n"]))), lambda e: F.struct(cut(t["o"], F.lit(0), e).alias("removed"), cut(t["n"], F.lit(0), e).alias("added"))))
    return F.when(old != new, F.get(F.flatten(span), 0))


# Words that may follow a number of a list without making it a quantity.
_GOES_ON = r"(?:and|to|through|or|figs?|figures?|tables?|panels?)"
_LIST = rf"\d+(?:\s*(?:,\s*and\b|,|\band\b|\bor\b|\bto\b|\bthrough\b|[-–])\s*\d+(?!\d)(?!\s*(?!{_GOES_ON}\b)[A-Za-z]))*"
WIDEST = 1000


def _listed_numbers(text: Column, lead: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(rf"(?i)\b{lead}\s+(?!S\d)({_LIST})"), F.lit(1))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        n = F.regexp_extract(piece, r"(\d+)$", 1).try_cast("int")
        reach = piece.rlike(r"(?i)^\s*(?:to|through|[-–])") & (F.abs(n - s["last"]) <= WIDEST)
        return F.struct(n.alias("last"), F.concat(s["out"], F.when(reach, F.sequence(F.least(s["last"], n), F.greatest(s["last"], n))).otherwise(F.array(n))).alias("out"))

    expand = lambda run: F.aggregate(F.regexp_extract_all(run, F.lit(r"([^\d]*\d+)"), F.lit(1)), start, step, lambda s: s["out"])
    return F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.transform(runs, expand)))))


def figure_numbers(text: Column) -> Column:
    """Numbers of figures that a text refers to, sorted: lists and ranges expanded up to the first number that counts something else.

    A range over more than WIDEST numbers gives its ends.
    """
    return _listed_numbers(text, r"Fig(?:s|ures?)?\.?")


def table_numbers(text: Column) -> Column:
    """As figure_numbers, for tables."""
    return _listed_numbers(text, "Tables?")
