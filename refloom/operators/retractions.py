"""Retraction notices: one verdict for each work, and the screen of cited works against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.identifiers import normalise_doi
from refloom.functions.rendering import parse_notice_date

# How severe a notice is.
SEVERITY = {"reinstatement": 0, "correction": 1, "expression of concern": 2, "retraction": 3}


def severity(nature: Column) -> Column:
    out = F.lit(-1)
    for name, rank in SEVERITY.items():
        out = F.when(F.lower(F.trim(nature)) == name, rank).otherwise(out)
    return out


def collapse_notices(notices: DataFrame) -> DataFrame:
    """notices(pos, doi, nature, date, title, notice_doi) -> one row for each normalised doi.

    The most severe notice wins, the earliest row among equals; the title is the first row's; natures in order of first
    sight. A winning retraction with a reinstatement beside it stands only if both have readable dates and the latest
    retraction is later than the latest reinstatement; else the latest reinstatement takes its place. All parts are
    aggregates that combine before the shuffle; natures are few, so only their first positions are kept.
    """
    rows = notices.withColumn("doi", normalise_doi(F.col("doi"))).where(F.col("doi") != "")
    rows = rows.withColumn("sev", severity(F.col("nature"))).withColumn("at", parse_notice_date(F.col("date"))).withColumn("kind", F.lower(F.trim("nature")))
    by_nature = rows.groupBy("doi", "nature", "kind").agg(
        F.max_by(F.struct("nature", "date", "notice_doi", "sev"), F.struct("sev", -F.col("pos"))).alias("top"), F.max("sev").alias("sev"), F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"), F.max("at").alias("at"), F.max_by("date", "at").alias("at_text")
    )
    dated = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    out = by_nature.groupBy("doi").agg(
        F.max_by("top", F.struct("sev", -F.col("pos"))).alias("top"), F.min_by("title", "pos").alias("title"), F.array_sort(F.collect_list(F.when(F.col("kind") != "", F.struct("pos", "nature")))).alias("seen"),
        dated("retraction", "at").alias("retracted"), dated("reinstatement", "at").alias("reinstated"), F.max_by("at_text", F.when(F.col("kind") == "reinstatement", F.col("at"))).alias("reinstated_text"), F.max(F.col("kind") == "reinstatement").alias("was_reinstated"),
    )
    back = (F.col("top.sev") == 3) & F.col("was_reinstated") & ~F.coalesce(F.col("reinstated") < F.col("retracted"), F.lit(False))
    return out.select(
        "doi", F.when(back, F.lit("Reinstatement")).otherwise(F.col("top.nature")).alias("nature"), F.array_distinct(F.transform("seen", lambda x: x["nature"])).alias("all_natures"),
        F.when(back, F.coalesce("reinstated_text", F.lit(""))).otherwise(F.col("top.date")).alias("date"), "title", F.col("top.notice_doi").alias("notice_doi"),
    )


def screen(cited: DataFrame, verdicts: DataFrame) -> DataFrame:
    """cited(..., doi) -> rows with a finding: ERROR for a retraction, WARN for an expression of concern."""
    kind = F.lower(F.trim("nature"))
    level = F.when(kind == "retraction", "ERROR").when(kind == "expression of concern", "WARN")
    found = cited.withColumn("doi", normalise_doi(F.col("doi"))).join(verdicts.select("doi", "nature", "date"), "doi")
    return found.withColumn("severity", level).where("severity is not null").withColumn("check", F.when(F.col("severity") == "ERROR", "CITE-RETRACTED").otherwise("CITE-CONCERN"))
