"""What markers in a text and payloads of citation fields cite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.names import compact_surname
from refloom.functions.rendering import filled, marker_numbers

# Years with a letter, names, words that open a dated aside, value switches of Word's citation field.
UPPER = r"[A-Z[À-ɏ&&\p{Lu}]]"
NAME = rf"(?:(?:Ó|Ní|Nic|Mac)\s+)?{UPPER}(?:\p{{L}}|['’\-])+"
ITEM_YEARS = r"(?<!\d)(?:1[6-9]|20)\d{2}(?!\d)(?:[a-z](?![A-Za-z])(?:,\s*[a-z](?=\s*(?:[,;]|$)))*)?"
ENTRY_YEAR = r"(?<!\d)((?:1[6-9]|20)\d{2})(?!\d)([a-z](?![A-Za-z]))?"
CONNECTIVE = r"\s+(?:and|&)\s+|\s*&\s*"
NO_SURNAME = (
    r"(?:In|Since|From|Until|Till|Through|Before|After|During|By|As|Of|At|On|For|Circa|Ca|Around|About|Mid|Late|Early|Spring|Summer|Autumn|Fall|Winter"
    r"|Year|Years|Fiscal|FY|Table|Tables|Figure|Figures|Fig|Appendix|Supplement)\b"
)
LIST_NUMBER = r"^\s*(?:\[\d+\]|\(?\d+\)?[.)])\s*"
PMID_LABEL = r"(?i)\bPMID\s*:?\s*(\d{1,9})\b"
VALUE_SWITCHES = (r"\l", r"\p", r"\v", r"\f", r"\s", r"\m")
LIBRARY_URI = r"zotero\.org/(groups|users)/(\d+)/items/"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&amp;": "&"}

_ITEM = "struct<surname:string,year:string,suffix:string>"


def _dated_parts(chunk: Column) -> Column:
    """The pieces of a group's part, joined up to the piece that brings a year; a part without any year is one piece."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, piece: Column) -> Column:
        joined = F.concat_ws(" and ", s["open"], piece)
        closes = piece.rlike(ITEM_YEARS)
        return F.struct(F.when(~closes, joined).alias("open"), F.when(closes, F.array_append(s["done"], joined)).otherwise(s["done"]).alias("done"))

    def finish(s: Column) -> Column:
        return F.when((F.size(s["done"]) == 0) & s["open"].isNotNull(), F.array(s["open"])).otherwise(s["done"])

    return F.aggregate(F.split(chunk, CONNECTIVE), start, step, finish)


def author_year_items(text: Column) -> Column:
    """ARRAY<(surname, year, suffix)> of the works that an author-year marker cites, as printed.

    Parts end at a semicolon, and at "and" or "&" only between dated pieces; each year is a work of its own, letters after a
    year count each; a part of years only takes the surname before it ("" if there is none). A dated part's name counts
    whatever it is; a name without a year is an undated work unless the word is one that opens an aside.
    """
    parts = F.flatten(F.transform(F.split(F.translate(text, "()", "  "), ";"), _dated_parts))

    def read(part: Column) -> Column:
        years = F.flatten(F.transform(F.regexp_extract_all(part, F.lit(f"({ITEM_YEARS})"), F.lit(1)), _year_letters))
        name = filled(F.regexp_replace(F.regexp_extract(part, NAME, 0), r"\s+", " "))
        return F.struct(name.alias("name"), years.alias("years"))

    def step(s: Column, p: Column) -> Column:
        none = F.array(F.struct(F.lit("").alias("year"), F.lit("").alias("suffix")))
        who = F.when(p["name"].isNotNull(), p["name"]).otherwise(F.coalesce(F.get(s, F.size(s) - 1)["surname"], F.lit("")))
        counts = (F.size(p["years"]) > 0) | (p["name"].isNotNull() & ~p["name"].rlike(f"^{NO_SURNAME}"))
        new = F.transform(F.when(F.size(p["years"]) > 0, p["years"]).otherwise(none), lambda y: F.struct(who.alias("surname"), y["year"].alias("year"), y["suffix"].alias("suffix")))
        return F.when(counts, F.concat(s, new)).otherwise(s)

    return F.aggregate(F.transform(parts, read), F.array().cast(f"array<{_ITEM}>"), step)


def _year_letters(found: Column) -> Column:
    letters = F.regexp_extract_all(F.substr(found, F.lit(5)), F.lit("([a-z])"), F.lit(1))
    return F.transform(F.when(F.size(letters) > 0, letters).otherwise(F.array(F.lit(""))), lambda x: F.struct(F.substr(found, F.lit(1), F.lit(4)).alias("year"), x.alias("suffix")))


def first_author_keys(entry: Column) -> Column:
    """Compact surname keys of a list entry's first author, with and without its particles; empty without a leading name."""
    bare = F.regexp_replace(entry, LIST_NUMBER, "")
    shape = rf"^\s*((?:[a-z]{{1,4}}\s+){{0,3}})({NAME})"
    particles, name = F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2)
    return F.array_distinct(F.filter(F.array(compact_surname(F.concat(particles, name)), compact_surname(name)), lambda k: k != ""))


def entry_years(entry: Column) -> Column:
    """ARRAY<(year, suffix)>, distinct, of the years in a list entry; the suffix is "" without a letter."""
    years, letters = (F.regexp_extract_all(entry, F.lit(ENTRY_YEAR), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.transform(F.arrays_zip(years.alias("y"), letters.alias("s")), lambda z: F.struct(z["y"].alias("year"), F.coalesce(z["s"], F.lit("")).alias("suffix"))))


def marker_item_count(text: Column, kind: Column) -> Column:
    """How many works a marker cites; an author-year marker at least one."""
    return F.when(kind == "numeric", F.size(marker_numbers(text))).otherwise(F.greatest(F.lit(1), F.size(author_year_items(text))))


def payload_pmid(pmid: Column, extra: Column, note: Column) -> Column:
    """Digits of a cited item's PMID field, else those after a PMID label in extra, then note."""
    label = lambda x: filled(F.regexp_extract(x, PMID_LABEL, 1))
    return F.coalesce(filled(F.regexp_replace(pmid, r"\D", "")), label(extra), label(note))


def pmid_list(values: Column) -> Column:
    """Those of an array that are digits only, trimmed, in order, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+$")))


def author_names(authors: Column) -> Column:
    """ARRAY<(family, given, literal)> -> "Family II" of persons and the literal of groups; nameless entries go."""

    def name(a: Column) -> Column:
        words = F.filter(F.split(F.coalesce(F.trim(a["given"]), F.lit("")), r"\s+"), lambda w: w != "")
        initials = F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))
        return F.when(filled(F.trim(a["family"])).isNotNull(), F.trim(F.concat_ws(" ", F.trim(a["family"]), initials))).otherwise(filled(F.trim(a["literal"])))

    return F.array_compact(F.transform(authors, name))


def _plain(x: Column) -> Column:
    out = F.regexp_replace(x, r"<[^>]*>", "")
    for a, b in ENTITIES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def endnote_items(instruction: Column) -> Column:
    """ARRAY<(title, year, doi, authors)> of the records inside an EN.CITE instruction, also where its markup is escaped.

    Marks of style inside a field are dropped, their text stays. An unfinished record is none.
    """
    escaped = instruction
    for a, b in ENTITIES.items():
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    xml = F.when(F.lower(instruction).contains("<endnote>"), instruction).when(F.lower(escaped).contains("<endnote>"), escaped)
    records = F.regexp_extract_all(xml, F.lit(r"(?s)<record>(.*?)</record>"), F.lit(1))
    one = lambda r, tag, within="": filled(_plain(F.regexp_extract(r, rf"(?s){within}<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)))

    def read(r: Column) -> Column:
        authors = F.regexp_extract_all(F.regexp_extract(r, r"(?s)<authors>(.*?)</authors>", 1), F.lit(r"(?s)<author(?:\s[^>]*)?>(.*?)</author>"), F.lit(1))
        doi = filled(F.regexp_extract(F.coalesce(one(r, "electronic-resource-num"), F.lit("")), r"(10\.\d{4,9}/[^\s\"<>']+)", 1))
        return F.struct(one(r, "title", "<titles>.*?").alias("title"), one(r, "year", "<dates>.*?").alias("year"), F.lower(doi).alias("doi"), F.filter(F.transform(authors, _plain), lambda a: a != "").alias("authors"))

    return F.coalesce(F.transform(records, read), F.array().cast("array<struct<title:string,year:string,doi:string,authors:array<string>>>"))


def word_tag(instruction: Column) -> Column:
    """The source's tag of Word's CITATION field: the first word that is neither a switch nor a value switch's value."""
    words = F.filter(F.split(F.trim(F.regexp_extract(instruction, r"\bCITATION\b(.*)", 1)), r"\s+"), lambda w: w != "")
    values = F.array(*map(F.lit, VALUE_SWITCHES))
    taken = lambda i: (i > 0) & F.array_contains(values, F.lower(F.get(words, i - 1)))
    return F.get(F.filter(words, lambda w, i: ~w.startswith("\\") & ~F.coalesce(taken(i), F.lit(False))), 0)


def uri_library(uri: Column) -> Column:
    """groups:<id> or users:<id> of an item's address; null for other addresses."""
    kind = filled(F.regexp_extract(uri, LIBRARY_URI, 1))
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(":"), F.regexp_extract(uri, LIBRARY_URI, 2)))


def field_kind(instruction: Column) -> Column:
    """The word after ADDIN, else the first word."""
    words = F.filter(F.split(F.trim(instruction), r"\s+"), lambda w: w != "")
    return F.when(F.get(words, 0) == "ADDIN", F.get(words, 1)).otherwise(F.get(words, 0))


def record_query(doi: Column, pmid: Column, authors: Column, title: Column, journal: Column, year: Column) -> Column:
    """A record as text to resolve: identifiers first, at most three authors."""
    named = filled(F.array_join(F.slice(authors, 1, 3), ", "))
    return F.concat_ws(". ", filled(doi), F.concat(F.lit("PMID: "), filled(pmid)), named, filled(title), filled(journal), filled(year))


def superscript_spans(text: Column, raised: Column, lowered: Column, taken: Column) -> Column:
    """ARRAY<(start, stop)> of numeric citations set as superscripts, from 0, half-open.

    ``raised`` are the text's maximal superscript stretches, ``lowered`` the subscript ones, ``taken`` the bracketed markers
    found before, each ARRAY<(start, stop)>. Exponents after digits, subscripts or tokens of one or two letters are none;
    nor is what begins a paragraph, runs on into a letter or digit, or meets a taken span. A paragraph in which at least two
    and at least half of what is left follow capitalised words lists affiliations: none of it counts.
    """
    part = lambda a, b: F.substr(text, a + 1, b - a)

    def trimmed(x: Column) -> Column:
        inner = part(x["start"], x["stop"])
        ahead = F.length(inner) - F.length(F.regexp_replace(inner, r"^\s+", ""))
        behind = F.length(inner) - F.length(F.regexp_replace(inner, r"[\s,.;:]+$", ""))
        return F.struct((x["start"] + ahead).alias("start"), (x["stop"] - behind).alias("stop"))

    def described(x: Column) -> Column:
        before = F.regexp_replace(part(F.lit(0), x["start"]), r"[   ]+$", "")
        word = F.regexp_extract(before, r"(\p{L}+)$", 1)
        numbers = F.transform(F.regexp_extract_all(part(x["start"], x["stop"]), F.lit(r"(\d+)"), F.lit(1)), lambda n: F.coalesce(n.try_cast("int"), F.lit(0)))
        ok = (x["start"] < x["stop"]) & part(x["start"], x["stop"]).rlike(r"^\d+(?:\s*[,\-–]\s*\d+)*$") & F.forall(numbers, lambda n: n.between(1, 999))
        ok = ok & ~F.exists(taken, lambda t: (x["start"] < t["stop"]) & (t["start"] < x["stop"])) & ~part(x["stop"], x["stop"] + 1).rlike(r"[\p{L}\p{N}]")
        low = F.exists(lowered, lambda t: (t["start"] <= F.length(before) - 1) & (F.length(before) - 1 < t["stop"]))
        ok = ok & (before != "") & ~before.rlike(r"\p{N}$") & ~low & ~F.length(word).isin(1, 2)
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), ok.alias("ok"), word.rlike(r"^\p{Lu}").alias("capital"))

    found = F.filter(F.transform(F.transform(raised, trimmed), described), lambda x: x["ok"])

    def without_bylines(f: Column) -> Column:
        capitals = F.size(F.filter(f, lambda x: x["capital"]))
        spans = F.transform(f, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
        return F.when((capitals >= 2) & (2 * capitals >= F.size(f)), F.slice(spans, 1, 0)).otherwise(spans)

    return F.element_at(F.transform(F.array(found), without_bylines), 1)


def all_markers(numeric: Column, raised: Column) -> Column:
    """Bracketed and superscript markers in one array, in the order of the text."""
    return F.array_sort(F.concat(numeric, raised))
