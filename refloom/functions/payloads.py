"""Fields of service payloads (JSON, XML) as Column expressions. A malformed payload gives nulls, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.identifiers import is_preprint
from refloom.functions.rendering import filled

_DATE = "STRUCT<`date-parts`: ARRAY<ARRAY<STRING>>>"
#: A registry's record of a work.
WORK = (
    "DOI STRING, title ARRAY<STRING>, author ARRAY<STRUCT<family: STRING, given: STRING, name: STRING>>, `container-title` ARRAY<STRING>, type STRING, score DOUBLE, "
    f"`published-print` {_DATE}, `published-online` {_DATE}, issued {_DATE}, relation MAP<STRING, ARRAY<STRUCT<`id-type`: STRING, id: STRING>>>, "
    "`alternative-id` ARRAY<STRING>, link ARRAY<STRUCT<URL: STRING>>"
)
#: Citation metrics of an article; authors are a list of structures or a text.
METRICS = "pmid STRING, relative_citation_ratio STRING, nih_percentile STRING, citation_count STRING, year STRING, authors STRING"
#: A researcher's works.
PROFILE = (
    "group ARRAY<STRUCT<`work-summary`: ARRAY<STRUCT<title: STRUCT<title: STRUCT<value: STRING>>, `publication-date`: STRUCT<year: STRUCT<value: STRING>>, "
    "`external-ids`: STRUCT<`external-id`: ARRAY<STRUCT<`external-id-type`: STRING, `external-id-value`: STRING>>>>>>>"
)
#: Where a work is openly readable.
OPEN_ACCESS = "best_oa_location STRUCT<url_for_pdf: STRING, url: STRING>, oa_locations ARRAY<STRUCT<url_for_pdf: STRING>>"

# Relations that lead from a work to its preprint, and from a preprint to what was published; kinds of posted work; waits in seconds.
TO_PREPRINT = ("has-preprint", "is-preprint-of", "is-identical-to", "is-version-of", "has-version")
TO_PUBLISHED = ("is-preprint-of", "is-version-of", "has-version")
POSTED = "posted-content"
WAIT, LONGEST_WAIT = 1.0, 3.0


def parsed(payload: Column, schema: str) -> Column:
    return F.from_json(payload, schema)


def read(payload: Column, schema: str, fields: Callable[[Column], Column]) -> Column:
    """Fields of a payload that is parsed once, however many of its parts they use."""
    return F.get(F.transform(F.array(parsed(payload, schema)), fields), 0)


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit(""))


def work_authors(work: Column) -> Column:
    """Authors in place as (family, given, literal); a group has only its name."""
    group = lambda a: (_blank(a["family"]) == "") & (_blank(a["given"]) == "") & (_blank(a["name"]) != "")
    one = lambda a: F.struct(
        F.when(~group(a), _blank(a["family"])).alias("family"), F.when(~group(a), _blank(a["given"])).alias("given"), F.when(group(a), _blank(a["name"])).alias("literal")
    )
    return F.coalesce(F.transform(F.filter(work["author"], lambda a: a.isNotNull()), one), F.array().cast("array<struct<family:string,given:string,literal:string>>"))


def work_year(work: Column) -> Column:
    """Of print, else of online publication, else of issue."""
    first = (F.get(F.get(work[k]["date-parts"], 0), 0) for k in ("published-print", "published-online", "issued"))
    return F.coalesce(*(F.when(~y.isin("", "0"), y) for y in first))


def work_fields(work: Column) -> Column:
    """doi, title, authors, year, journal, type, score, preprint of a registry's record."""
    doi, kind = filled(work["DOI"]), filled(work["type"])
    return F.struct(
        doi.alias("doi"), F.trim(F.get(work["title"], 0)).alias("title"), work_authors(work).alias("authors"), work_year(work).alias("year"), F.trim(F.get(work["container-title"], 0)).alias("journal"),
        kind.alias("type"), work["score"].alias("score"), (is_preprint(F.coalesce(doi, F.lit(""))) | F.coalesce(kind == POSTED, F.lit(False))).alias("preprint"),
    )


def _related(work: Column, kinds: tuple[str, ...]) -> Column:
    """Related identifiers in the order of the kinds."""
    none = F.array().cast("array<struct<`id-type`:string,id:string>>")
    return F.flatten(F.array(*(F.coalesce(F.try_element_at(work["relation"], F.lit(k)), none) for k in kinds)))


def published_doi(work: Column) -> Column:
    """The DOI under which a preprint was published: the first related one that isn't a preprint's itself."""
    fit = F.filter(_related(work, TO_PUBLISHED), lambda r: (r["id-type"] == "doi") & (_blank(r["id"]) != "") & ~is_preprint(r["id"]))
    return F.trim(F.get(fit, 0)["id"])


def arxiv_pdf(work: Column) -> Column:
    """Address of the arXiv file that a record names by relation, alternative id or link, in this order."""
    number = r"(\d{4}\.\d{4,5}(?:v\d+)?)"

    def related(r: Column) -> Column:
        return F.when((r["id-type"] == "arxiv") & (r["id"] != ""), r["id"]).when(r["id-type"] == "doi", filled(F.regexp_extract(r["id"], rf"(?i)arXiv\.{number}", 1)))

    by_relation = F.get(F.filter(F.transform(_related(work, TO_PREPRINT), related), lambda x: x.isNotNull()), 0)
    by_id = F.get(F.filter(work["alternative-id"], lambda x: x.rlike(r"^\d{4}\.\d{4,5}")), 0)
    by_link = F.get(F.filter(F.transform(work["link"], lambda x: filled(F.regexp_extract(x["URL"], rf"arxiv\.org/(?:abs|pdf)/{number}", 1))), lambda x: x.isNotNull()), 0)
    return F.concat(F.lit("https://arxiv.org/pdf/"), F.coalesce(by_relation, by_id, by_link), F.lit(".pdf"))


def open_pdf(record: Column) -> Column:
    """The best location's file, else any location's, else the best landing page."""
    others = F.filter(F.transform(record["oa_locations"], lambda x: F.nullif(x["url_for_pdf"], F.lit(""))), lambda x: x.isNotNull())
    best = record["best_oa_location"]
    return F.coalesce(F.nullif(best["url_for_pdf"], F.lit("")), F.get(others, 0), F.nullif(best["url"], F.lit("")))


def metric_fields(record: Column) -> Column:
    """pmid, rcr, citation_count, nih_percentile, year, authors (full names); what is absent stays null and is no zero."""
    raw = record["authors"]
    listed = F.transform(F.from_json(raw, "ARRAY<STRUCT<lastName: STRING, firstName: STRING, fullName: STRING>>"), lambda a: F.trim(a["fullName"]))
    plain = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    whole = lambda x: F.coalesce(x.try_cast("int"), F.floor(x.try_cast("double")).cast("int"))
    return F.struct(
        filled(record["pmid"]).alias("pmid"), record["relative_citation_ratio"].try_cast("double").alias("rcr"), whole(record["citation_count"]).alias("citation_count"),
        record["nih_percentile"].try_cast("double").alias("nih_percentile"), whole(record["year"]).alias("year"), F.when(F.ltrim(raw).startswith("["), listed).otherwise(plain).alias("authors"),
    )


def profile_works(record: Column) -> Column:
    """A researcher's works as (title, doi, pmid, pmcid, year, citation): each group's preferred version, the first id of each kind; wholly empty ones go."""

    def one(s: Column) -> Column:
        ids = F.coalesce(s["external-ids"]["external-id"], F.array().cast("array<struct<`external-id-type`:string,`external-id-value`:string>>"))
        pick = lambda kind: F.coalesce(F.trim(F.get(F.filter(ids, lambda e: (F.lower(e["external-id-type"]) == kind) & (_blank(e["external-id-value"]) != "")), 0)["external-id-value"]), F.lit(""))
        title, year = F.coalesce(s["title"]["title"]["value"], F.lit("")), F.coalesce(s["publication-date"]["year"]["value"], F.lit(""))
        cited = F.when((title != "") & (year != ""), F.concat(title, F.lit(" ("), year, F.lit(")"))).otherwise(title)
        return F.struct(title.alias("title"), pick("doi").alias("doi"), pick("pmid").alias("pmid"), pick("pmc").alias("pmcid"), year.alias("year"), cited.alias("citation"))

    preferred = F.filter(F.transform(record["group"], lambda g: F.get(g["work-summary"], 0)), lambda s: s.isNotNull())
    return F.filter(F.transform(preferred, one), lambda w: F.concat(w["title"], w["doi"], w["pmid"], w["pmcid"]) != "")


def article_fields(xml: Column) -> Column:
    """pmid, title, abstract, journal, year, authors, doi of an article's XML; abstract parts carry their labels, a group its name."""
    at = lambda path: F.xpath_string(xml, F.lit(path))
    all_ = lambda path: F.xpath(xml, F.lit(path))
    n = F.xpath_int(xml, F.lit("count(//Abstract/AbstractText)"))
    texts = F.from_xml(xml, "MedlineCitation STRUCT<Article: STRUCT<Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_VALUE: STRING, _Label: STRING>>>, AuthorList: STRUCT<Author: ARRAY<STRUCT<CollectiveName: STRING, LastName: STRING, Initials: STRING, ForeName: STRING>>>>>")
    article = texts["MedlineCitation"]["Article"]
    parts = F.transform(F.filter(article["Abstract"]["AbstractText"], lambda a: _blank(a["_VALUE"]) != ""), lambda a: F.concat_ws(": ", filled(a["_Label"]), F.trim(a["_VALUE"])))
    person = lambda a: F.when(filled(a["LastName"]).isNotNull(), F.concat_ws(" ", filled(a["LastName"]), F.coalesce(filled(a["Initials"]), filled(a["ForeName"]))))
    names = F.filter(F.transform(article["AuthorList"]["Author"], lambda a: F.coalesce(filled(a["CollectiveName"]), person(a))), lambda x: x.isNotNull())
    return F.struct(
        F.coalesce(filled(at("//MedlineCitation/PMID")), filled(at("//PMID"))).alias("pmid"), F.trim(at("//Article/ArticleTitle")).alias("title"),
        F.when(n > 0, F.array_join(parts, " ")).otherwise(F.lit("")).alias("abstract"), F.coalesce(filled(at("//Journal/Title")), filled(at("//Journal/ISOAbbreviation")), F.lit("")).alias("journal"),
        F.coalesce(filled(at("//PubDate/Year")), filled(F.regexp_extract(at("//PubDate/MedlineDate"), r"\d{4}", 0)), F.lit("")).alias("year"), names.alias("authors"),
        F.coalesce(F.get(all_("//ArticleIdList/ArticleId[@IdType='doi']/text()"), 0), F.get(all_("//ELocationID[@EIdType='doi']/text()"), 0), F.lit("")).alias("doi"),
    )


def retry_wait(header: Column) -> Column:
    """Seconds that a Retry-After header asks for, within bounds; the usual wait if it says nothing usable."""
    asked = F.trim(header).try_cast("double")
    return F.when(asked.isNull() | (asked < 0), F.lit(WAIT)).otherwise(F.least(asked, F.lit(LONGEST_WAIT)))


def is_public_address(url: Column) -> Column:
    """http(s) with a host that may be public: a name with a dot, or a literal address outside the ranges kept for private,
    loopback, link-local, shared, documentation, multicast and other reserved use.

    IPv4 addresses count only as four decimal numbers without leading zeros; other spellings of numbers (one integer, octal,
    hexadecimal) and local names are refused. IPv6 literals stand in brackets; those that carry an IPv4 address are refused.
    Names aren't resolved; that is for whoever connects.
    """
    bracketed = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/@?#]*@)?\[([^\]/?#]*)\](?::\d*)?(?:[/?#]|$)", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/@?#]*@)?([^\[\]/:?#@]+)(?::\d*)?(?:[/?#]|$)", 1)), r"\.$", "")
    part = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int")
    a, b, c = part(1), part(2), part(3)
    kept = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    kept = kept | ((a == 192) & ((b == 168) | ((b == 0) & c.isin(0, 2)) | ((b == 88) & (c == 99)))) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    decimal = host.rlike(r"^(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}$") & (F.greatest(a, b, c, part(4)) <= 255)
    numeric = host.rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)$")
    name = host.rlike(r"^[^.\s]+(?:\.[^.\s]+)+$") & ~host.rlike(r"(?:^|\.)(?:localhost|local|internal|localdomain|home\.arpa)$")
    v6 = bracketed.rlike(r"^[23][0-9a-f]{3}:[0-9a-f:]*$") & ~bracketed.rlike(r"^(?:2001:0{0,3}db8:|2001:(?:0{1,4})?:|2002:|3fff:)")
    return F.when(bracketed != "", v6).when(numeric, decimal & ~F.coalesce(kept, F.lit(False))).otherwise(name)
