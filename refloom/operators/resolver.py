"""Resolving a reference against known works: candidates, confidence, authors, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.names import jaccard, surname_fold
from refloom.functions.rendering import filled
from refloom.functions.shapes import is_corporate

# Thresholds of the confidence ladder.
HIGH, MEDIUM, LEAD = 0.55, 0.30, 0.10
#: Titles tried for each of a reference's rarest tokens, to learn what its n-th best score reaches at least.
SEEDS, SEED_TOKENS = 64, 4


def rank_candidates(refs: DataFrame, works: DataFrame, n: int) -> DataFrame:
    """refs(ref, tokens) and works(work, tokens) -> ref, work, score, rank of the n works of the highest Jaccard similarity, ties by smaller
    work; only works that share a token.

    Exact, without comparing all: a few titles of a reference's rarest tokens give a score that its n-th best reaches at least. A
    title that scores as much has most of the reference's tokens, so that it holds one of its first ones when all are ordered by
    how many titles have them; sizes and the places of the first common token rule out most of the rest. Frequent tokens stand
    last and join nothing unless a reference has no better ones. Works and references of the same tokens are compared once.
    """
    titles = _first_works(works, n).withColumnRenamed("tokens", "title")
    forms = refs.select(F.array_sort("tokens").alias("tokens")).distinct()
    seen = titles.select(F.explode("title").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    by_title = _in_order(titles, "title", seen)
    by_form = _in_order(forms, "tokens", seen)

    # the score that the n-th best reaches at least: of works among SEEDS titles of each of the SEED_TOKENS rarest tokens
    place = F.row_number().over(Window.partitionBy("token").orderBy("title"))
    some = by_title.select("title", "firsts", F.explode("ordered").alias("token")).withColumn("k", place).where(F.col("k") <= SEEDS).drop("k")
    rare = by_form.select("tokens", F.explode(F.slice("present", 1, SEED_TOKENS)).alias("token"))
    tried = rare.join(some, "token").groupBy("tokens", "title").agg(F.size(F.first("firsts")).alias("m")).withColumn("score", _score())
    upto = F.sum("m").over(Window.partitionBy("tokens").orderBy(F.desc("score"), "title").rowsBetween(Window.unboundedPreceding, 0))
    least = tried.withColumn("_upto", upto).where(F.col("_upto") >= n).groupBy("tokens").agg(F.max("score").alias("least"))

    size, slack = F.size("tokens"), 1e-6
    asked = by_form.join(least, "tokens", "left").withColumn("least", F.greatest(F.coalesce("least", F.lit(0.0)) - slack, F.lit(0.0)))
    first = asked.select("tokens", "ordered", "least", F.posexplode(F.slice("ordered", F.lit(1), (size - F.greatest(F.ceil(F.col("least") * size), F.lit(1)) + 1).cast("int"))).alias("i", "token")).join(seen.select("token"), "token", "left_semi")
    held = by_title.select("title", "firsts", F.col("ordered").alias("t_ordered"), F.posexplode("ordered").alias("j", "token"))
    t = F.size("title")
    least_common = F.col("least") / (1 + F.col("least")) * (size + t)
    fits = (t >= F.col("least") * size) & (size >= F.col("least") * t) & (F.least(size - F.col("i"), t - F.col("j")) >= least_common)
    pairs = first.join(held, "token").where(fits).where(F.get(F.array_intersect("ordered", "t_ordered"), 0) == F.col("token"))
    scored = pairs.select("tokens", "firsts", _score().alias("score"), "least").where("score >= least").select("tokens", "score", F.explode("firsts").alias("work"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tokens").orderBy(F.desc("score"), "work"))).where(F.col("rank") <= n)
    return refs.select("ref", F.array_sort("tokens").alias("tokens")).join(ranked, "tokens").select("ref", "work", "score", "rank")


def _score() -> Column:
    return F.round(jaccard(F.col("title"), F.col("tokens")), 6)


def _in_order(sets: DataFrame, name: str, seen: DataFrame) -> DataFrame:
    """Sets with ``ordered``, their tokens by how many titles have them, and ``present``, those that any title has, likewise."""
    met = sets.select(name, F.explode(name).alias("token")).join(seen, "token", "left")
    by = met.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token"))).alias("o"))
    tokens = lambda o: F.transform(o, lambda x: x["token"])
    return sets.join(by, name).select(*sets.columns, tokens(F.col("o")).alias("ordered"), tokens(F.filter("o", lambda x: x["c"] > 0)).alias("present"))


def _first_works(works: DataFrame, n: int) -> DataFrame:
    """tokens (sorted), firsts: the n smallest ids of works with these tokens."""
    place = F.row_number().over(Window.partitionBy("tokens").orderBy("work"))
    few = works.select(F.array_sort("tokens").alias("tokens"), "work").withColumn("k", place).where(F.col("k") <= n)
    return few.groupBy("tokens").agg(F.array_sort(F.collect_list("work")).alias("firsts"))


def top_candidates(ranked: DataFrame) -> DataFrame:
    """The best candidate of each reference, and the runner-up's score."""
    return ranked.groupBy("ref").agg(F.max_by("work", -F.col("rank")).alias("work"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))


def confidence(score: Column, second: Column, author_ok: Column, year_ok: Column) -> Column:
    """high: title, author, year and a clear lead; medium: the title alone, or two of three weaker signs; else low."""
    lead = second.isNull() | ((score - second) / score >= LEAD)
    signs = (score >= MEDIUM).cast("int") + author_ok.cast("int") + year_ok.cast("int")
    return F.when((score >= HIGH) & author_ok & year_ok & lead, "high").when((score >= HIGH) | (signs >= 2), "medium").otherwise("low")


def persons(authors: Column) -> Column:
    """Surnames of the persons among ARRAY<(family, given, literal)>: without groups, however they are written."""
    named = F.filter(authors, lambda a: ~is_group(a) & ~is_corporate(a["family"], a["given"]))
    return F.transform(named, lambda a: F.coalesce(F.trim(a["family"]), F.lit("")))


def is_group(author: Column) -> Column:
    """An author of one field only."""
    return filled(author["family"]).isNull() & filled(author["given"]).isNull() & filled(author["literal"]).isNotNull()


def compare_families(cited: Column, real: Column) -> Column:
    """(mismatch, cited, real, differing): surnames of persons compared place by place, accents folded.

    Fewer cited ones than there are is et al and fine; other ones, or more, are a mismatch. ``differing`` are the places, from 1.
    """
    keys = lambda authors: F.transform(persons(authors), surname_fold)

    def compare(x: Column) -> Column:
        places = F.filter(F.transform(x["a"], lambda k, i: F.when(~k.eqNullSafe(F.get(x["b"], i)), i + 1)), lambda i: i.isNotNull())
        return F.struct((F.size(places) > 0).alias("mismatch"), F.size(x["a"]).alias("cited"), F.size(x["b"]).alias("real"), places.alias("differing"))

    return F.element_at(F.transform(F.array(F.struct(keys(cited).alias("a"), keys(real).alias("b"))), compare), 1)


def link_status(cited: DataFrame, library_keys: DataFrame) -> DataFrame:
    """cited(key, where: own/other/unknown) with link: ok, broken, external, unverified."""
    found = cited.join(library_keys.select("key").distinct().withColumn("_there", F.lit(True)), "key", "left")
    return found.withColumn("link", F.when(F.col("where") == "other", "external").when(F.col("where") == "unknown", "unverified").when(F.col("_there"), "ok").otherwise("broken")).drop("_there")


def tier(confidence: Column) -> Column:
    """Tier of a plan entry: what has no confidence at all counts as low."""
    return F.when(confidence == "high", "high").when(confidence == "medium", "medium").otherwise("low")
