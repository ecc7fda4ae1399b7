"""Readers of library exports and notice feeds. Files are read by Spark; lines are decoded as UTF-8, else as Windows-1252."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.identifiers import none_if_empty, pmid_in

# Which tags and elements hold what.
AUTHOR_TAGS = ("AU", "A1", "A2", "A3")
TITLE_TAGS = ("TI", "T1")
JOURNAL_TAGS = ("JO", "JF", "T2", "JA")
YEAR_TAGS = ("PY", "Y1")
NOTICE_COLUMNS = ("RetractionNature", "OriginalPaperDOI")

RECORD = "source_file string, rec_idx int, authors array<string>, title string, journal string, year string, volume string, pages string, doi string, pmid string, ref_type string"
#: A document type declaration could define entities without bound, so such files are refused.
_DECLARES = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.I)


def files(spark: SparkSession, path: str) -> DataFrame:
    """source_file, content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), "content")


#: Windows-1252 above Latin-1's control characters; its five undefined bytes give the replacement character.
_HIGH = bytes(range(0x80, 0xA0))
_LATIN_CONTROLS, _WINDOWS = _HIGH.decode("iso-8859-1"), _HIGH.decode("cp1252", "replace")


def decoded_line(line: Column) -> Column:
    """One line of bytes as text; never fails."""
    return F.when(F.is_valid_utf8(line.cast("string")), F.decode(line, "utf-8")).otherwise(F.translate(F.decode(line, "iso-8859-1"), _LATIN_CONTROLS, _WINDOWS))


def decoded_lines(content: Column) -> Column:
    """Bytes as text, each line by its own encoding, without a byte order mark."""
    # as Latin-1 every byte is one character, so lines can be parted and turned back into their bytes
    lines = F.split(F.decode(content, "iso-8859-1"), r"(?<=\n)|(?<=\r)(?!\n)")
    text = F.array_join(F.transform(lines, lambda x: decoded_line(F.encode(x, "iso-8859-1"))), "")
    return F.regexp_replace(text, "^\ufeff", "")


def decoded(content: Column) -> Column:
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "utf-8")).otherwise(F.decode(content, "iso-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def is_ris(text: Column) -> Column:
    return text.rlike(r"(?m)^TY  -")


def parse_ris(texts: DataFrame) -> DataFrame:
    """texts(source_file, text) -> one row for each record.

    TY begins a record and ER ends it; a missing ER or TY is tolerated. Splitting and picking fields happens within the row,
    so nothing is shuffled and a file's records need no global line order.
    """
    pieces = F.split(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"(?m)^ER  -.*$", "\u0001"), "\u0001|(?m)(?=^TY  -)")
    lines = F.filter(F.split("piece", "\n"), lambda x: x.rlike(r"^[A-Z][A-Z0-9]  -"))
    rows = texts.select("source_file", F.posexplode(F.filter(pieces, lambda p: p.rlike(r"(?m)^[A-Z][A-Z0-9]  -"))).alias("rec_idx", "piece")).withColumn("lines", lines)

    def values(*tags: str) -> Column:
        found = F.filter("lines", lambda x: F.left(x, F.lit(2)).isin(*tags))
        return F.filter(F.transform(found, lambda x: F.trim(F.substr(x, F.lit(6)))), lambda x: x != "")

    def first(*tags: str) -> Column:
        return F.get(values(*tags), 0)

    pages = none_if_empty(F.concat_ws("-", first("SP"), first("EP")))
    digits = F.when(first("C2").rlike(r"^\d+$"), first("C2"))
    year = F.coalesce(none_if_empty(F.regexp_extract(first(*YEAR_TAGS), r"\d{4}", 0)), first(*YEAR_TAGS))
    return rows.select("source_file", "rec_idx", values(*AUTHOR_TAGS).alias("authors"), first(*TITLE_TAGS).alias("title"), first(*JOURNAL_TAGS).alias("journal"), year.alias("year"), first("VL").alias("volume"), pages.alias("pages"), none_if_empty(F.regexp_replace(first("DO"), r"(?i)^doi:\s*", "")).alias("doi"), digits.alias("pmid"), first("TY").alias("ref_type"))


def _xml_records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def text(e, path: str) -> str | None:
        found = e.find(path)
        return " ".join("".join(found.itertext()).split()) or None if found is not None else None

    for frame in frames:
        out = []
        for name, raw in zip(frame.source_file, frame.content, strict=True):
            if _DECLARES.search(raw[:4096]):
                continue
            n = 0
            try:
                for _, e in ElementTree.iterparse(io.BytesIO(raw)):
                    if e.tag == "record":
                        authors = [" ".join("".join(a.itertext()).split()) for a in e.iterfind(".//contributors/authors/author")]
                        kind = e.find("ref-type")
                        out.append((name, n, [a for a in authors if a], text(e, "titles/title"), text(e, "titles/secondary-title") or text(e, "periodical/full-title"), text(e, "dates/year"), text(e, "volume"), text(e, "pages"), text(e, "electronic-resource-num"), text(e, "accession-num"), kind.get("name") if kind is not None else None))
                        n += 1
                        e.clear()
            except ElementTree.ParseError:
                pass  # records before the fault stay
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])


def parse_endnote_xml(raw: DataFrame) -> DataFrame:
    """raw(source_file, content) -> records; nested style elements count as text, a broken tail loses only itself."""
    rows = raw.mapInPandas(_xml_records, RECORD)
    return rows.withColumn("doi", none_if_empty(F.regexp_replace("doi", r"(?i)^doi:\s*", ""))).withColumn("pmid", pmid_in(F.col("pmid")))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Records of all exports under a path; each file's content decides its format, and unknown ones give none."""
    raw = files(spark, path)
    texts = raw.select("source_file", "content", decoded(F.col("content")).alias("text"))
    xml = texts.where(F.col("text").rlike(r"(?s)^\s*<(?:\?xml|xml|records)"))
    return parse_ris(texts.where(is_ris(F.col("text"))).select("source_file", "text")).unionByName(parse_endnote_xml(xml.select("source_file", "content")))


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """pos, doi, nature, date, title, notice_doi of a notice feed (CSV with quoted, possibly multi-line fields).

    A header without the required columns is an error, not an empty feed.
    """
    # a line's encoding is its own, so bytes are read as Latin-1, which loses none, and decoded field by field
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "iso-8859-1").csv(path)
    raw = raw.toDF(*(c.removeprefix("\u00ef\u00bb\u00bf").lstrip("\ufeff") for c in raw.columns))
    if missing := [c for c in NOTICE_COLUMNS if c not in raw.columns]:
        raise ValueError(f"not a notice feed: no column {', '.join(missing)}")
    pick = lambda c: F.coalesce(decoded_lines(F.encode(F.col(c), "iso-8859-1")), F.lit("")) if c in raw.columns else F.lit("")
    return raw.select(F.monotonically_increasing_id().alias("pos"), pick("OriginalPaperDOI").alias("doi"), pick("RetractionNature").alias("nature"), pick("RetractionDate").alias("date"), pick("Title").alias("title"), pick("RetractionDOI").alias("notice_doi"))
