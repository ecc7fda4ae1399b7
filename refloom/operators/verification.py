"""Does a citation say what the record behind its identifier says: identity, authors, records to import, works already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.identifiers import none_if_empty, normalise_doi
from refloom.functions.names import fuzzy_title_key, group_key, jaccard, surname_fold, title_tokens
from refloom.functions.rendering import filled, year_in
from refloom.functions.shapes import is_corporate
from refloom.operators.library import lookup
from refloom.operators.resolver import compare_families, is_group, persons

#: ARRAY<(family, given, literal)>: groups have a literal only.
AUTHORS = "array<struct<family:string,given:string,literal:string>>"
# The least overlap of titles of one work; metadata that are checked in one call.
SAME_TITLE, CHECKED_AT_ONCE = 0.30, 50


def parse_authors(text: Column) -> Column:
    """AUTHORS of "Family,Given;*Group;..."."""
    one = lambda x: F.struct(F.when(~x.startswith("*"), F.split_part(x, F.lit(","), F.lit(1))).alias("family"), F.when(~x.startswith("*"), F.split_part(x, F.lit(","), F.lit(2))).alias("given"), F.when(x.startswith("*"), F.substr(x, F.lit(2))).alias("literal"))
    return F.transform(F.filter(F.split(text, ";"), lambda x: x != ""), one)


def first_author(authors: Column) -> Column:
    """Surname of the first person; null without one."""
    return F.get(F.filter(persons(authors), lambda f: f != ""), 0)


def named_count(authors: Column) -> Column:
    """Authors with any name."""
    return F.size(F.filter(authors, lambda a: filled(a["family"]).isNotNull() | filled(a["given"]).isNotNull() | filled(a["literal"]).isNotNull()))


def shouting(authors: Column) -> Column:
    """Whether a person with a given name has a name all in capitals."""
    loud = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{Lu}\p{Ll}]", "").rlike(r"^\p{Lu}{2,}$")
    return F.exists(authors, lambda a: filled(a["given"]).isNotNull() & ~is_corporate(a["family"], a["given"]) & (loud(a["family"]) | loud(a["given"])))


def align_groups(mine: Column, theirs: Column) -> Column:
    """Their list, with my group in place of an author without a given name whose name is that group's."""
    groups = F.filter(mine, is_group)

    def swap(a: Column) -> Column:
        bare = filled(a["family"]).isNotNull() & filled(a["given"]).isNull()
        twin = F.get(F.filter(groups, lambda g: (group_key(g["literal"]) != "") & (group_key(g["literal"]) == group_key(a["family"]))), 0)
        return F.when(bare & twin.isNotNull(), twin).otherwise(a)

    return F.transform(theirs, swap)


def merge_groups(mine: Column, theirs: Column) -> Column:
    """(authors, kept): their list with my groups that it lacks, each after as many persons as stood before it in mine."""
    have = F.transform(F.filter(theirs, is_group), lambda g: group_key(g["literal"]))
    person = lambda a: ~is_group(a) & (filled(a["family"]).isNotNull() | filled(a["given"]).isNotNull())

    def before(a: Column, i: Column) -> Column:
        return F.struct(F.size(F.filter(F.slice(mine, F.lit(1), i), person)).alias("p"), F.lit(1).alias("k"), i.alias("i"), a.alias("a"))

    def fresh(x: Column) -> Column:
        return is_group(x["a"]) & ~F.array_contains(have, group_key(x["a"]["literal"]))

    def first_of_key(x: Column) -> Column:
        places = F.transform(mine, lambda b, j: F.when(is_group(b) & (group_key(b["literal"]) == group_key(x["a"]["literal"])), j))
        return F.array_min(F.array_compact(places)) == x["i"]

    kept = F.filter(F.filter(F.transform(mine, before), fresh), first_of_key)
    total = F.size(F.filter(theirs, lambda a: ~is_group(a)))

    def placed(a: Column, i: Column) -> Column:
        count = F.size(F.filter(F.slice(theirs, F.lit(1), i + 1), lambda b: ~is_group(b)))
        return F.struct(count.alias("p"), F.when(is_group(a), 2).otherwise(0).alias("k"), i.alias("i"), a.alias("a"))

    late = F.transform(kept, lambda x: F.struct(F.when(x["p"] > total, F.lit(2**30)).otherwise(x["p"]).alias("p"), x["k"].alias("k"), x["i"].alias("i"), x["a"].alias("a")))
    rows = F.array_sort(F.concat(F.transform(theirs, placed), late))
    return F.struct(F.transform(rows, lambda r: r["a"]).alias("authors"), F.transform(kept, lambda x: x["a"]["literal"]).alias("kept"))


def _by_doi(records: DataFrame) -> DataFrame:
    """One record for each DOI, the first by title."""
    keyed = records.withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).where("_doi is not null")
    return keyed.groupBy("_doi").agg(F.min(F.struct("title", "authors")).alias("_r"))


def identity_mismatches(cited: DataFrame, records: DataFrame, least: float = SAME_TITLE) -> DataFrame:
    """cited(key, doi, title, authors) whose DOI's record(doi, title, authors) has another title: key, doi, overlap,
    author_differs. Citations without DOI, title, record or the record's title are not judged."""
    asked = cited.where(filled(F.col("doi")).isNotNull() & filled(F.col("title")).isNotNull()).withColumn("_doi", none_if_empty(normalise_doi(F.col("doi"))))
    met = asked.join(_by_doi(records.where(filled(F.col("title")).isNotNull())), "_doi")
    met = met.withColumn("overlap", jaccard(title_tokens(F.col("_r.title")), title_tokens(F.col("title"))))
    differs = F.coalesce(surname_fold(first_author(F.col("authors"))) != surname_fold(first_author(F.col("_r.authors"))), F.lit(False))
    return met.where(F.col("overlap") < least).select("key", "doi", F.round("overlap", 6).alias("overlap"), differs.alias("author_differs"))


def family_mismatches(cited: DataFrame, by_doi: DataFrame, by_pmid: DataFrame) -> DataFrame:
    """cited(key, doi, pmid, authors) against the DOI's record, or where that gives no authors the PMID's: key, source, cited,
    real, differing of those that disagree."""
    with_authors = lambda d: d.where(F.size("authors") > 0)
    doi = _by_doi(with_authors(by_doi)).select("_doi", F.col("_r.authors").alias("_of_doi"))
    pmid = with_authors(by_pmid).select(F.trim("pmid").alias("_pmid"), "authors").groupBy("_pmid").agg(F.min("authors").alias("_of_pmid"))
    asked = cited.where(F.size("authors") > 0).withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).withColumn("_pmid", filled(F.col("pmid")))
    met = asked.join(doi, "_doi", "left").join(pmid, "_pmid", "left").withColumn("_real", F.coalesce("_of_doi", "_of_pmid")).where("_real is not null")
    met = met.withColumn("c", compare_families(F.col("authors"), F.col("_real"))).where("c.mismatch")
    return met.select("key", F.when(F.col("_of_doi").isNotNull(), "doi").otherwise("pmid").alias("source"), "c.cited", "c.real", "c.differing")


def reconcile_authors(metas: DataFrame, records: DataFrame, most: int = CHECKED_AT_ONCE, offline: bool = False, degraded: bool = False) -> DataFrame:
    """metas(call, pos, doi, pmid, authors) about to be created, against records(pmid, doi, authors) of a second source.

    call, pos, status, reason, pmid, before, after, authors, kept. status is ``pubmed`` where the record's authors replace
    the meta's (which lack, are fewer, all in capitals or other ones), ``confirmed`` where they agree, else
    ``authors_unverified``. The first ``most`` of a call that have an identifier are checked. Groups are never lost. A DOI
    that two records claim decides nothing.
    """
    doi, pmid = none_if_empty(normalise_doi(F.col("doi"))), filled(F.col("pmid"))
    rows = metas.withColumn("_doi", doi).withColumn("_pmid", pmid)
    known = F.col("_doi").isNotNull() | F.col("_pmid").isNotNull()
    nth = F.sum(F.when(known, 1).otherwise(0)).over(Window.partitionBy("call").orderBy("pos"))
    rows = rows.withColumn("_early", F.when(F.lit(offline), "offline").when(~known, "no_pmid").when(nth > most, "over_cap"))
    real = records.select(F.trim("pmid").alias("_pmid"), none_if_empty(normalise_doi(F.col("doi"))).alias("_their_doi"), F.col("authors").alias("_theirs")).groupBy("_pmid").agg(F.min(F.struct("_their_doi", "_theirs")).alias("_r")).select("_pmid", "_r.*")
    claimed = real.where("_their_doi is not null").groupBy(F.col("_their_doi").alias("_doi")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_pmid").alias("p"), F.col("_theirs").alias("t"))).alias("_d")).where("_n = 1").select("_doi", "_d")
    met = rows.join(real, "_pmid", "left").join(claimed, "_doi", "left")
    by_pmid = F.col("_pmid").isNotNull()
    theirs = F.when(by_pmid, F.col("_theirs")).otherwise(F.col("_d.t"))
    found = F.when(by_pmid, F.col("_pmid")).otherwise(F.col("_d.p"))
    met = met.withColumn("_p", align_groups(F.col("authors"), theirs)).withColumn("c", compare_families(F.col("authors"), F.col("_p")))
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(by_pmid & (F.col("_their_doi") != F.col("_doi")), "pmid_doi_disagree")
        .when(theirs.isNull(), F.lit("pubmed_unavailable" if degraded else "no_pubmed_record"))
        .when(F.col("c.real") == 0, "pubmed_no_authors").when(F.col("c.cited") == 0, "crossref_no_authors").when(F.col("c.real") < F.col("c.cited"), "pubmed_shorter")
        .when(F.col("c.mismatch"), "mismatch").when(F.col("c.cited") < F.col("c.real"), "crossref_shorter").when(shouting(F.col("authors")), "crossref_all_caps").otherwise("match")
    )
    met = met.withColumn("reason", reason)
    replaced = F.col("reason").isin("crossref_no_authors", "mismatch", "crossref_shorter", "crossref_all_caps")
    met = met.withColumn("_m", F.when(replaced, merge_groups(F.col("authors"), F.col("_p")))).withColumn("before", named_count(F.col("authors")))
    judged = ~F.col("reason").isin("offline", "no_pmid", "over_cap", "pmid_doi_disagree", "no_pubmed_record", "pubmed_unavailable")
    return met.select(
        "call", "pos", F.when(replaced, "pubmed").when(F.col("reason") == "match", "confirmed").otherwise("authors_unverified").alias("status"), "reason", F.when(judged, found).otherwise(F.col("_pmid")).alias("pmid"),
        "before", F.when(replaced, named_count(F.col("_m.authors"))).otherwise(F.col("before")).alias("after"), F.coalesce("_m.authors", "authors").alias("authors"), F.coalesce("_m.kept", F.array().cast("array<string>")).alias("kept"),
    )


def record_findings(records: DataFrame, retracted: DataFrame) -> DataFrame:
    """records(rec, authors, title, year, doi, pmid) and retracted(doi) -> rec, check, severity, missing: one row for each fault."""
    lacks = F.array_compact(F.array(F.when(F.size("authors") == 0, F.lit("authors")), *(F.when(filled(F.col(c)).isNull(), F.lit(c)) for c in ("title", "year"))))
    known = retracted.select(none_if_empty(normalise_doi(F.col("doi"))).alias("_doi")).distinct().withColumn("_gone", F.lit(True))
    rows = records.withColumn("_lacks", lacks).withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).join(known, "_doi", "left")
    fault = lambda when, check, severity, missing=None: F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), (F.lit("") if missing is None else missing).alias("missing")))
    faults = F.array_compact(F.array(
        fault(F.size("_lacks") > 0, "ENDNOTE-INCOMPLETE", "WARN", F.array_join("_lacks", ", ")),
        fault(filled(F.col("doi")).isNull() & filled(F.col("pmid")).isNull(), "ENDNOTE-NO-ID", "WARN"),
        fault(F.coalesce("_gone", F.lit(False)), "ENDNOTE-RETRACTED", "ERROR"),
    ))
    return rows.select("rec", F.explode(faults).alias("f")).select("rec", "f.*")


def match_exports(cited: DataFrame, exported: DataFrame) -> DataFrame:
    """cited(cite, doi, title) with ``matched``: doi, title (as fuzzy keys) or none among exported(doi, title)."""
    dois = exported.select(none_if_empty(normalise_doi(F.col("doi"))).alias("_doi")).where("_doi is not null").distinct().withColumn("_d", F.lit(True))
    titles = exported.select(none_if_empty(fuzzy_title_key(F.col("title"))).alias("_title")).where("_title is not null").distinct().withColumn("_t", F.lit(True))
    keyed = cited.withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).withColumn("_title", none_if_empty(fuzzy_title_key(F.col("title"))))
    met = keyed.join(dois, "_doi", "left").join(titles, "_title", "left")
    return met.select(*cited.columns, F.when(F.col("_d"), "doi").when(F.col("_t"), "title").otherwise("none").alias("matched"))


def migration_summary(records: DataFrame) -> DataFrame:
    """records(source, tier, in_library, retracted) -> source, n, high, medium, low, to_match, retracted, to_create."""
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("high", "medium", "low")]
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *tiers, F.count_if("in_library").alias("to_match"), F.count_if("retracted").alias("retracted"), F.count_if(~F.col("in_library") & ~F.col("retracted")).alias("to_create"))


def match_foreign(cited: DataFrame, index: DataFrame, items: DataFrame) -> DataFrame:
    """cited(cite, doi, pmid, title, year, author) of another manager with library_key and matched_by.

    First by the library's indexes; else among items(pos, key, title, date, families) of the same fuzzy title the first whose
    year and whose authors don't contradict.
    """
    found = lookup(cited, index, F.col("doi"), F.col("pmid"), F.col("title"))
    open_ = found.where("library_key is null").withColumn("_title", none_if_empty(fuzzy_title_key(F.col("title")))).where("_title is not null")
    # titles that thousands share would meet in all pairs: the first item of each title, year and author is looked up instead, with
    # * for items that any asked year or author meets, and ! for items without one, which contradict none
    any_, none = F.lit("*"), F.lit("!")
    year = F.when(filled(F.col("_year")).isNull(), none).otherwise(F.concat(F.lit("="), "_year"))
    families = F.when(F.size("_families") == 0, F.array(none)).otherwise(F.transform(F.array_compact("_families"), lambda f: F.concat(F.lit("="), f)))
    same = items.select(none_if_empty(fuzzy_title_key(F.col("title"))).alias("_title"), "pos", "key", year_in(F.col("date")).alias("_year"), F.transform("families", lambda f: F.lower(f)).alias("_families")).where("_title is not null")
    by_year = same.select("_title", "pos", "key", F.explode(F.array(any_, year)).alias("_by_year"), F.array_union(F.array(any_), F.coalesce(families, F.array().cast("array<string>"))).alias("_f"))
    firsts = by_year.select("_title", "pos", "key", "_by_year", F.explode("_f").alias("_by_author")).groupBy("_title", "_by_year", "_by_author").agg(F.min(F.struct("pos", "key")).alias("_w"))
    asked_year = F.when(filled(F.col("year")).isNull(), F.array(any_)).otherwise(F.array(F.concat(F.lit("="), "year"), none))
    asked_author = F.when(filled(F.col("author")).isNull(), F.array(any_)).otherwise(F.array(F.concat(F.lit("="), F.lower(F.trim("author"))), none))
    asked = open_.select("cite", "_title", F.explode(asked_year).alias("_by_year"), asked_author.alias("_f")).select("cite", "_title", "_by_year", F.explode("_f").alias("_by_author"))
    best = asked.join(firsts, ["_title", "_by_year", "_by_author"]).groupBy("cite").agg(F.min("_w")["key"].alias("_key"))
    out = found.join(best, "cite", "left")
    return out.select("cite", F.coalesce("library_key", "_key").alias("library_key"), F.coalesce("matched_by", F.when(F.col("_key").isNotNull(), F.lit("search"))).alias("matched_by"))


def place_created(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """wanted(place, doi, title) against results(status, key, doi, title) of creating: place, key, outcome.

    created by DOI, else by title; else matched where an item of the title existed; else refused, failed or unmapped.
    """
    title = lambda c: filled(F.lower(F.trim(c)))
    rows = results.withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).withColumn("_title", title(F.col("title")))
    made = rows.where("status = 'created'")
    by_doi = made.where("_doi is not null").groupBy("_doi").agg(F.max("key").alias("_k1"))
    by_title = rows.where("_title is not null").groupBy("_title").agg(F.max(F.when(F.col("status") == "created", F.col("key"))).alias("_k2"), F.max(F.when(F.col("status") == "existing", F.col("key"))).alias("_k3"), F.max(F.col("status") == "degraded").alias("_slow"), F.max(F.col("status") == "failed").alias("_bad"))
    met = wanted.withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).withColumn("_title", title(F.col("title"))).join(by_doi, "_doi", "left").join(by_title, "_title", "left")
    key = F.coalesce("_k1", "_k2")
    outcome = F.when(key.isNotNull(), "created").when(F.col("_k3").isNotNull(), "matched").when(F.col("_slow"), "refused").when(F.col("_bad"), "failed").otherwise("unmapped")
    return met.select("place", F.coalesce(key, F.col("_k3")).alias("key"), outcome.alias("outcome"))


def batch_status(asked: DataFrame, answered: DataFrame, size: int) -> DataFrame:
    """asked(list, pos, id) in batches of ``size`` and answered(list, batch) -> list, n_batches, n_failed_batches, degraded."""
    batches = asked.select("list", F.floor((F.row_number().over(Window.partitionBy("list").orderBy("pos")) - 1) / size).alias("batch")).distinct()
    met = batches.join(answered.select("list", "batch").distinct().withColumn("_ok", F.lit(True)), ["list", "batch"], "left")
    return met.groupBy("list").agg(F.count(F.lit(1)).alias("n_batches"), F.count_if(F.col("_ok").isNull()).alias("n_failed_batches")).withColumn("degraded", F.col("n_failed_batches") > 0)


def report_ok(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """doc, ok: no finding of severity ERROR."""
    bad = findings.where("severity = 'ERROR'").select("doc").distinct().withColumn("_bad", F.lit(True))
    return documents.select("doc").distinct().join(bad, "doc", "left").select("doc", F.col("_bad").isNull().alias("ok"))
