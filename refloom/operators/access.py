"""Where works can be read openly: the first source that has a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import payloads
from refloom.functions.identifiers import none_if_empty, normalise_doi
from refloom.functions.rendering import filled
from refloom.operators.services import pmcids_of

# Addresses of files.
ARXIV_FILE = "https://arxiv.org/pdf/{}.pdf"
ARCHIVE_FILE = "https://pmc.ncbi.nlm.nih.gov/articles/{}/pdf/"


def _address(form: str, x: Column) -> Column:
    before, after = form.split("{}")
    return F.concat(F.lit(before), x, F.lit(after))


def _by_doi(answers: DataFrame, name: str, url: Column) -> DataFrame:
    """_doi and the address an answer gives; of several answers of a DOI the smallest address counts."""
    read = answers.select(none_if_empty(normalise_doi(F.col("doi"))).alias("_doi"), filled(url).alias(name))
    return read.where(F.col("_doi").isNotNull() & F.col(name).isNotNull()).groupBy("_doi").agg(F.min(name).alias(name))


def open_files(works: DataFrame, locations: DataFrame, registry: DataFrame, graph: DataFrame, ids: DataFrame) -> DataFrame:
    """works(work, doi, pmid, arxiv) -> work, source, url: the first of

    arxiv (the work's own number), locations (an index of open copies: its best file, any file, its landing page), registry (an
    arXiv number in the registry's record), graph (the file that a citation graph names), archive (the file under the PMCID that
    ids(pmcid, pmid, doi) have for its DOI, else for its PMID).

    locations, registry and graph are (doi, payload). Malformed payloads and works without any source give nulls. Answers are
    unique by DOI before they meet the works, so works that share a DOI add no rows to each other.
    """
    keyed = works.select("work", none_if_empty(normalise_doi(F.col("doi"))).alias("_doi"), filled(F.col("pmid")).alias("_pmid"), filled(F.col("arxiv")).alias("_arxiv"))
    place = payloads.read(F.col("payload"), payloads.OPEN_ACCESS, payloads.open_pdf)
    record = payloads.read(F.col("payload"), payloads.WORK, payloads.arxiv_pdf)
    met = keyed
    for answers, name, url in ((locations, "locations", place), (registry, "registry", record), (graph, "graph", F.get_json_object("payload", "$.openAccessPdf.url"))):
        met = met.join(_by_doi(answers, name, url), "_doi", "left")
    for kind in ("_doi", "_pmid"):
        found = pmcids_of(met.where(F.col(kind).isNotNull()).select(F.col(kind).alias("id")).distinct(), ids).where("pmcid is not null")
        met = met.join(found.select(F.col("id").alias(kind), F.col("pmcid").alias(f"_by{kind}")), kind, "left")
    urls = {"arxiv": _address(ARXIV_FILE, F.col("_arxiv")), "locations": F.col("locations"), "registry": F.col("registry"), "graph": F.col("graph"), "archive": _address(ARCHIVE_FILE, F.coalesce("_by_doi", "_by_pmid"))}
    source = F.coalesce(*(F.when(u.isNotNull(), F.lit(n)) for n, u in urls.items()))
    return met.select("work", source.alias("source"), F.coalesce(*urls.values()).alias("url"))
