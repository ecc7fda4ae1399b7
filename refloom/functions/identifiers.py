"""Identifiers as Column expressions: DOI, PMID, PMCID, arXiv, ISBN, ORCID."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an identifier.
DOI = r"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\d{4,9}/[^\s\"<>']+)"
PMID = r"(?i)(?:PubMed\s+PMID|PMID)\s*:?\s*(\d+)"
PMCID = r"(?i)PMC\d+"
ARXIV = r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"
ISBN = r"(?i)ISBN[-: ]*([\dX][\d\- X]{8,17})"
ORCID = r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]"
PREPRINT_PREFIXES = ("10.1101/", "10.21203/", "10.2139/")


def _last(x: Column) -> Column:
    return F.right(x, F.lit(1))


def _count(x: Column, char: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(char), F.lit("")))


def normalise_doi(raw: Column) -> Column:
    """Trimmed, without resolver address, lower-cased; trailing ``.,;:`` peeled, a closing bracket only if it has no partner.

    Balance depends on what is left, so characters are peeled one at a time, a fold over as many steps as there are.
    """
    bare = F.lower(F.regexp_replace(F.trim(raw), r"(?i)^https?://(?:dx\.)?doi\.org/", ""))

    def peel(x: Column, _: Column) -> Column:
        loose = (_last(x).isin(".", ",", ";", ":")) | ((_last(x) == ")") & (_count(x, ")") > _count(x, "("))) | ((_last(x) == "]") & (_count(x, "]") > _count(x, "[")))
        return F.when(loose, F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)

    def clean(x: Column) -> Column:
        tail = F.length(F.regexp_extract(x, r"[.,;:)\]]*$", 0))
        return F.when(tail == 0, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), tail)), x, peel))

    return F.element_at(F.transform(F.array(bare), clean), 1)  # bound once, used several times


def first_seen(values: Column, key=lambda x: F.lower(x)) -> Column:
    """Array without later elements of an equal key; the first surface form stays."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def extract_dois(text: Column) -> Column:
    """DOIs of a text in order; trailing ``.,);:]`` go whether balanced or not; case-insensitively distinct."""
    return first_seen(F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,);:\]]+$", "")))


def extract_pmids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PMID), F.lit(1)))


def extract_pmcids(text: Column) -> Column:
    return first_seen(F.regexp_extract_all(text, F.lit(PMCID), F.lit(0)))


def none_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def normalise_pmcid(raw: Column) -> Column:
    """PMC and digits, version dropped; null if it isn't one."""
    digits = none_if_empty(F.regexp_extract(F.upper(F.trim(raw)), r"^(?:PMC)?(\d+)", 1))
    return F.concat(F.lit("PMC"), digits)


def extract_arxiv(text: Column) -> Column:
    return none_if_empty(F.regexp_extract(text, ARXIV, 1))


def extract_isbn(text: Column) -> Column:
    """The first ISBN with 10 or 13 digits."""
    bare = F.upper(F.regexp_replace(F.regexp_extract(text, ISBN, 1), r"[^0-9Xx]", ""))
    return F.when(F.length(bare).isin(10, 13), bare)


def normalise_orcid(raw: Column) -> Column:
    return none_if_empty(F.regexp_extract(F.upper(raw), ORCID, 0))


def is_preprint(text: Column) -> Column:
    """All DOIs of the text are of preprint servers; without a DOI, an arXiv number."""
    dois = extract_dois(text)
    server = F.forall(dois, lambda d: F.lower(d).startswith(PREPRINT_PREFIXES[0]) | F.lower(d).startswith(PREPRINT_PREFIXES[1]) | F.lower(d).startswith(PREPRINT_PREFIXES[2]))
    return F.when(F.size(dois) > 0, server).otherwise(F.coalesce(text.rlike(ARXIV), F.lit(False)))


def pmid_in(text: Column) -> Column:
    """A PMID: bare digits or a prefixed number; else null."""
    return F.coalesce(none_if_empty(F.regexp_extract(text, PMID, 1)), F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text)))


def identifier_kind(raw: Column) -> Column:
    """What a user's identifier is: pmid (digits, prefixed or not), key (eight capitals and digits), doi, or null; in this order."""
    x = F.trim(raw)
    return F.when(pmid_in(x).isNotNull(), "pmid").when(x.rlike(r"^[A-Z0-9]{8}$"), "key").when(normalise_doi(x).rlike(r"^10\.\d{4,9}/\S+$"), "doi")


def is_plausible_slug(x: Column) -> Column:
    """Lower-case words joined by hyphens, at least three characters, with a letter and a word of at least three characters."""
    return x.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length(x) >= 3) & x.rlike("[a-z]") & F.exists(F.split(x, "-"), lambda w: F.length(w) >= 3)
