"""Ordered text: reference runs, numbered fillers, sections, enumerators, links from markers to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.citations import author_year_items, entry_years, first_author_keys
from refloom.functions.names import compact_surname
from refloom.lineage import cut


def _by_place(*keys: str) -> Window:
    return Window.partitionBy("doc").orderBy(*keys)


def last_run(paragraphs: DataFrame, least: int = 3) -> DataFrame:
    """paragraphs(doc, para, is_ref) -> doc, start, length of the last run of at least so many reference-shaped paragraphs."""
    island = paragraphs.withColumn("gap", F.sum(F.when(F.col("is_ref"), 0).otherwise(1)).over(_by_place("para"))).where("is_ref")
    runs = island.groupBy("doc", "gap").agg(F.min("para").alias("start"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)
    return runs.groupBy("doc").agg(F.max_by(F.struct("start", "length"), "start").alias("r")).select("doc", "r.start", "r.length")


def bridge_fillers(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc, para, number, is_ref, filler_ok) -> doc, para, accepted.

    A year-less paragraph is accepted if its number follows that of the last accepted one, and then moves the counter on: a
    recursion, so a fold over each document's ordered array.
    """
    rows = paragraphs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("para", "number", "is_ref", "filler_ok"))).alias("p"))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<para:int,accepted:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ok = x["is_ref"] | F.coalesce(x["filler_ok"] & (x["number"] == s["last"] + 1), F.lit(False))
        return F.struct(F.when(ok, F.coalesce(x["number"], s["last"])).otherwise(s["last"]).cast("int").alias("last"), F.array_append(s["out"], F.struct(x["para"].cast("int").alias("para"), ok.alias("accepted"))).alias("out"))

    return rows.select("doc", F.inline(F.aggregate("p", start, step, lambda s: s["out"])))


def section_spans(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc, para, heading) -> doc, heading, start, stop: half-open up to the next heading or the document's end."""
    ends = paragraphs.groupBy("doc").agg((F.max("para") + 1).alias("end"))
    heads = paragraphs.where("heading is not null").withColumn("next", F.lead("para").over(_by_place("para")))
    return heads.join(ends, "doc").select("doc", "heading", F.col("para").alias("start"), F.coalesce("next", "end").alias("stop"))


def enumerator_run(markers: DataFrame) -> DataFrame:
    """markers(doc, pos, number, boundary) -> those of the first run 1, 2, 3, ... without a sentence boundary inside: a list, not citations."""
    w = _by_place("pos")
    broken = F.coalesce((F.col("number") != F.lag("number").over(w) + 1) | F.col("boundary"), F.lit(True))
    runs = markers.withColumn("run", F.sum(F.when(broken, 1).otherwise(0)).over(w))
    shape = runs.groupBy("doc", "run").agg(F.min("number").alias("lowest"), F.count(F.lit(1)).alias("length")).where("lowest = 1 and length >= 2")
    first = shape.groupBy("doc").agg(F.min("run").alias("run"))
    return runs.join(first, ["doc", "run"]).select("doc", "pos", "number")


def link_numeric(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """markers(doc, marker, number) against entries(doc, entry, number); of entries with one number the first counts."""
    return markers.join(entries.groupBy("doc", "number").agg(F.min("entry").alias("entry")), ["doc", "number"])


def link_author_year(items: DataFrame, entries: DataFrame) -> DataFrame:
    """items(doc, item, surname, year, suffix) against entries(doc, entry, surname, year, suffix).

    Several hits are narrowed to those of the same suffix; what is still ambiguous stays unlinked.
    """
    e = entries.select("doc", "surname", "year", "entry", F.col("suffix").alias("entry_suffix"))
    open_to = F.col("suffix").isNull() | F.col("entry_suffix").isNull() | (F.col("suffix") == F.col("entry_suffix"))
    hits = items.join(e, ["doc", "surname", "year"]).where(open_to).withColumn("exact", F.col("suffix").eqNullSafe(F.col("entry_suffix")))
    found = hits.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"), F.min("entry").alias("any"), F.min(F.when(F.col("exact"), F.col("entry"))).alias("one"))
    return found.where("n = 1 or n_exact = 1").select("doc", "item", F.when(F.col("n") == 1, F.col("any")).otherwise(F.col("one")).alias("entry"))


def marker_items(markers: DataFrame) -> DataFrame:
    """markers(doc, marker, text) -> doc, marker, item, surname, year, suffix: the works that author-year markers cite, from 0."""
    return markers.select("doc", "marker", F.posexplode(author_year_items(F.col("text"))).alias("item", "x")).select("doc", "marker", "item", "x.*")


def link_markers(markers: DataFrame, entries: DataFrame) -> DataFrame:
    """Each work of markers(doc, marker, text) with the one entry(doc, entry, text) it means, null if there is none or several.

    An entry is a hit by its first author, with or without particles, and the year; an entry's letter must be the item's.
    Several hits are narrowed to those of the item's letter; what is still ambiguous stays unlinked.
    """
    items = marker_items(markers).withColumn("key", compact_surname(F.col("surname")))
    by_name = entries.select("doc", "entry", F.explode(first_author_keys(F.col("text"))).alias("key"), "text")
    dated = by_name.select("doc", "entry", "key", F.explode(entry_years(F.col("text"))).alias("y")).select("doc", "entry", "key", F.col("y.year").alias("year"), F.col("y.suffix").alias("entry_suffix"))
    hits = items.where("key <> '' and year <> ''").join(dated, ["doc", "key", "year"]).where("entry_suffix = '' or entry_suffix = suffix")
    exact = F.when((F.col("suffix") != "") & (F.col("suffix") == F.col("entry_suffix")), F.col("entry"))
    found = hits.groupBy("doc", "marker", "item").agg(F.countDistinct("entry").alias("n"), F.min("entry").alias("any"), F.countDistinct(exact).alias("n_exact"), F.min(exact).alias("one"))
    linked = found.select("doc", "marker", "item", F.when(F.col("n") == 1, F.col("any")).when(F.col("n_exact") == 1, F.col("one")).alias("entry"))
    return items.drop("key").join(linked, ["doc", "marker", "item"], "left")


def numbering_disagreement(entries: DataFrame, numbered: bool, share: float = 0.6, least: int = 3) -> DataFrame:
    """Documents in which most entries disagree with the style's numbering."""
    out = entries.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_number") != numbered).alias("off"))
    return out.where((F.col("n") >= least) & (F.col("off") >= F.col("n") * share))


def doi_coverage(entries: DataFrame, share: float = 0.2, least: int = 10) -> DataFrame:
    """Documents whose entries hardly carry DOIs."""
    out = entries.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if("has_doi").alias("with_doi"))
    return out.where((F.col("n") >= least) & (F.col("with_doi") < F.col("n") * share))


def reference_run(paragraphs: DataFrame, least: int = 3) -> DataFrame:
    """paragraphs(doc, para, is_ref, filler_ok, number, blank, excluded) -> doc, start, length of the last run of at least so many entries.

    A run goes on over entries and over year-less fillers whose number follows the last accepted one. A blank or other paragraph ends
    it; an excluded one (of a list that a heading has already shown) discards it. Each paragraph depends on the state before it, so
    a document is one array and its runs a fold.
    """
    rows = paragraphs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("para", "is_ref", "filler_ok", "number", "blank", "excluded"))).alias("p"))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("start"), F.lit(0).alias("length"), none.alias("last"), none.alias("best"), F.lit(0).alias("best_length"))

    def step(s: Column, x: Column) -> Column:
        filler = s["start"].isNotNull() & x["filler_ok"] & F.coalesce(x["number"] == s["last"] + 1, F.lit(False))
        inside = ~x["excluded"] & ~x["blank"] & (x["is_ref"] | filler)
        done = ~x["excluded"] & ~inside & (s["length"] >= least)
        return F.struct(
            F.when(inside, F.coalesce(s["start"], x["para"].cast("int"))).alias("start"), F.when(inside, s["length"] + 1).otherwise(0).alias("length"), F.when(inside, F.coalesce(x["number"].cast("int"), s["last"])).alias("last"),
            F.when(done, s["start"]).otherwise(s["best"]).alias("best"), F.when(done, s["length"]).otherwise(s["best_length"]).alias("best_length"),
        )

    def finish(s: Column) -> Column:
        open_ = s["length"] >= least
        return F.struct(F.when(open_, s["start"]).otherwise(s["best"]).alias("start"), F.when(open_, s["length"]).otherwise(s["best_length"]).alias("length"))

    return rows.select("doc", F.aggregate("p", start, step, finish).alias("r")).where("r.start is not null").select("doc", "r.start", "r.length")


# Fixed value: one number in round brackets.
ENUMERATOR = r"\(\s*(\d+)\s*\)"


def text_enumerators(text: Column) -> Column:
    """Which of a text's bracketed single numbers, from 0, enumerate a list in one sentence and so cite nothing.

    The list begins at the first 1 that lower-case words follow; a next number belongs to it if it is one more, lower-case words
    follow it, a separator (colon, semicolon, comma, and, or) stands before it, and no sentence ends between the two. One number is no
    list.
    """

    def find(x: Column) -> Column:
        pieces, numbers = x["pieces"], x["numbers"]
        item = lambda i: F.ltrim(F.get(pieces, i + 1)).rlike(r"^\p{Ll}")
        # nothing but white space between two markers is no separator
        separated = lambda i: F.rtrim(F.get(pieces, i)).rlike(r"[:;,]$|(?<![\p{L}\p{N}_])(?:and|or)$")
        places = F.when(F.size(numbers) > 0, F.sequence(F.lit(0), F.size(numbers) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.get(F.filter(places, lambda i: (F.get(numbers, i) == 1) & item(i)), 0)
        goes_on = lambda i: (F.get(numbers, i) == F.get(numbers, i - 1) + 1) & item(i) & separated(i) & ~F.get(pieces, i).rlike(r"[.!?]")
        stop = F.coalesce(F.get(F.filter(places, lambda i: (i > first) & ~goes_on(i)), 0), F.size(numbers))
        return F.when(stop - first >= 2, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))

    numbers = F.transform(F.regexp_extract_all(text, F.lit(ENUMERATOR), F.lit(1)), lambda n: n.try_cast("long"))
    return F.element_at(F.transform(F.array(F.struct(F.split(text, ENUMERATOR).alias("pieces"), numbers.alias("numbers"))), find), 1)


def number_rows(rows: DataFrame, name: str, *keys: Column) -> DataFrame:
    """Rows with their number, from 1, in the order of keys, which must tell rows apart: range partitions, sorted and numbered each, with the
    counts of the partitions before. Only those counts meet in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # as many rows as partitions
    numbered = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*keys))).join(F.broadcast(before), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")
