"""Applying a confirmed unification plan: identifiers that a user names for markers, the works that are accepted, what the library has
of them or must be given, and the markers that become citation fields. A document is one transaction: decisions are
checked first, and one that fails leaves its whole document alone. A marker becomes a field with all of its works or not at all.

Relations, all by ``doc``:
  references(ref, number, title, doi, pmid, auto, retracted, has_data, key): the reference list; key is its item in the library
  markers(marker, kind, text, para, start, items, live): kind numeric (has its place) or author-year (found by its text)
  links(marker, item, ref): the reference that each item of a marker names
  accepted(ref): references accepted by name; given(name, item, identifier): a marker's number or text, with one identifier an item
  placeholders(ph, kind, text, places, chosen, title, doi, pmid)
  gates(readable, add_missing, writable): what the library allows; writable yes, no or unknown
and, for all documents, index(kind, value, key) of the library, known(kind, value, title, doi, pmid) of works by identifier, and
answers(identity, key) of the service to what ``works_to_create`` lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.identifiers import none_if_empty, normalise_doi
from refloom.functions.names import library_title_key
from refloom.operators import library
from refloom.operators.edits import citation_code

WORK = ("doc", "source", "id", "item", "title", "doi", "pmid")


def given_identifier(raw: Column) -> Column:
    """(kind, value) of an identifier: digits, labelled or not, are a PMID of nine at most; eight capitals and digits an item's key;
    else a DOI. Null if it is none of these."""
    x = F.trim(raw)
    pmid = F.coalesce(none_if_empty(F.regexp_extract(x, r"(?i)^pmid\s*:?\s*(\d{1,9})$", 1)), none_if_empty(F.regexp_extract(x, r"^(\d{1,9})$", 1)))
    doi = normalise_doi(F.regexp_replace(x, r"(?i)^doi:\s*", ""))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(pmid.isNotNull(), pair("pmid", pmid)).when(x.rlike(r"^\d+$"), None).when(x.rlike(r"^[A-Z0-9]{8}$"), pair("key", x)).when(doi.rlike(r"^10\.\d{4,9}/\S+$"), pair("doi", doi))


def assign(markers: DataFrame, given: DataFrame) -> DataFrame:
    """doc, marker, item, identifier, name, unknown: what is named for each marker. A marker's number wins over its text, and a text
    stands for all markers that carry it."""
    number = F.when(F.trim("name").rlike(r"^\d{1,9}$"), F.trim("name").cast("int"))
    named = given.withColumn("number", number)
    place = markers.select("doc", "marker", "text", "items")
    by_number = named.where("number is not null").withColumnRenamed("number", "marker").join(place.select("doc", "marker", F.lit(True).alias("there")), ["doc", "marker"], "left")
    by_number = by_number.select("doc", "marker", "item", "identifier", "name", F.col("there").isNull().alias("unknown"))
    texts = named.where("number is null").join(place.select("doc", F.col("text").alias("name"), "marker"), ["doc", "name"], "left")
    taken = by_number.select("doc", "marker").distinct()
    texts = texts.join(taken, ["doc", "marker"], "left_anti").select("doc", "marker", "item", "identifier", "name", F.col("marker").isNull().alias("unknown"))
    return by_number.unionByName(texts)


def parse_assigned(assigned: DataFrame) -> DataFrame:
    """Assigned rows with ``given``, the (kind, value) of the identifier; null if it is malformed."""
    return assigned.withColumn("given", given_identifier(F.col("identifier")))


def problems(markers: DataFrame, assigned: DataFrame, accepted: DataFrame, links: DataFrame, index: DataFrame, gates: DataFrame) -> DataFrame:
    """doc, marker, item, problem: why the decisions of a document can't be applied. Any row refuses the document.

    assigned is that of ``parse_assigned``. One pass: each row learns what there is about its marker and its item.
    """
    explicit = links.join(accepted.select("doc", "ref").distinct(), ["doc", "ref"]).select("doc", "marker").distinct().withColumn("_both", F.lit(True))
    keys = index.select(F.col("key").alias("_key")).distinct().withColumn("_there", F.lit(True))
    rows = assigned.join(markers.select("doc", "marker", "items"), ["doc", "marker"], "left").join(explicit, ["doc", "marker"], "left").join(gates.select("doc", "readable"), "doc", "left")
    rows = rows.withColumn("_key", F.when(F.col("given.kind") == "key", F.col("given.value"))).join(keys, "_key", "left")
    per = Window.partitionBy("doc", "marker")
    rows = rows.withColumns({"_names": F.size(F.collect_set("name").over(per)), "_n": F.count(F.lit(1)).over(per)})
    known = ~F.col("unknown")
    found = {
        "unknown marker": (F.col("unknown"), False), "given twice": (known & (F.col("_names") > 1), False), "wrong number of identifiers": (known & (F.col("_names") == 1) & (F.col("_n") != F.col("items")), False),
        "decided twice": (known & F.col("_both"), False), "malformed identifier": (known & F.col("given").isNull(), True), "no such item": (known & F.col("_key").isNotNull() & F.col("readable") & F.col("_there").isNull(), True),
    }
    what = F.array_compact(F.array(*(F.when(cond, F.struct(F.when(F.lit(of_item), F.col("item")).alias("item"), F.lit(problem).alias("problem"))) for problem, (cond, of_item) in found.items())))
    return rows.select("doc", "marker", F.explode(what).alias("w")).select("doc", "marker", "w.item", "w.problem").distinct()


def _identity() -> Column:
    doi, title = none_if_empty(normalise_doi(F.col("doi"))), none_if_empty(library_title_key(F.col("title")))
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), none_if_empty(F.trim("pmid"))), F.concat(F.lit("title:"), title))


def settle(references: DataFrame, accepted: DataFrame, placeholders: DataFrame, assigned: DataFrame, refused: DataFrame, index: DataFrame, known: DataFrame, gates: DataFrame) -> DataFrame:
    """doc, source, id, item, title, doi, pmid, key, outcome, reason, identity of each work to be cited, before anything is created:
    matched, needs_input, retracted, refused, or create (with the identity that its answer comes under).

    A retracted reference is taken only if it is accepted by name. What the library lacks is created only if it could be read, is
    to be added to and can be written to.
    """
    no = F.lit(None)
    listed = references.select("doc", "ref", "title", "doi", "pmid", "auto", "retracted", "has_data", "key")
    refs = listed.join(accepted.select("doc", "ref").distinct().withColumn("named", F.lit(True)), ["doc", "ref"], "left").where(F.col("auto") | F.col("named"))
    state = F.when(F.col("retracted") & F.col("named").isNull(), "retracted").when(F.col("key").isNotNull(), "matched").when(~F.col("has_data"), "no data")
    refs = refs.select("doc", F.lit("reference").alias("source"), F.col("ref").cast("long").alias("id"), no.cast("int").alias("item"), "title", "doi", "pmid", "key", state.alias("state"))

    held = placeholders.select("doc", F.lit("placeholder").alias("source"), F.col("ph").cast("long").alias("id"), no.cast("int").alias("item"), "title", "doi", "pmid", no.cast("string").alias("key"), F.when(~F.col("chosen"), "not chosen").alias("state"))
    named = assigned.where("not unknown and given is not null").select("doc", F.lit("marker").alias("source"), F.col("marker").cast("long").alias("id"), "item", F.col("given.kind").alias("_kind"), F.col("given.value").alias("_value"))
    named = named.join(known.select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), "title", F.col("doi").alias("_doi"), F.col("pmid").alias("_pmid"), F.lit(True).alias("_known")), ["_kind", "_value"], "left")
    of = lambda kind, other: F.coalesce(F.when(F.col("_kind") == kind, F.col("_value")), F.col(other))
    named = named.select("doc", "source", "id", "item", "title", of("doi", "_doi").alias("doi"), of("pmid", "_pmid").alias("pmid"), F.when(F.col("_kind") == "key", F.col("_value")).alias("key"), F.when(F.col("_kind") == "key", "by key").when(F.col("_known").isNull(), "unknown work").alias("state"))

    rows = refs.unionByName(held).unionByName(named).join(gates, "doc", "left").join(refused.select("doc").distinct().withColumn("_refused", F.lit(True)), "doc", "left")
    rows = rows.fillna({"readable": False, "add_missing": False, "writable": "unknown", "_refused": False})
    found = library.lookup(rows, index, F.col("doi"), F.col("pmid"), F.col("title")).drop("matched_by").withColumn("identity", _identity())
    looked = F.when(F.col("readable"), F.col("library_key"))
    key = F.when(F.col("state").isin("retracted", "not chosen", "no data"), None).when(F.col("state") == "by key", F.when(F.col("readable"), F.col("key"))).otherwise(F.coalesce("key", looked))
    reason = (
        F.when(F.col("state") == "retracted", "retracted").when(key.isNotNull(), None).when(F.col("state") == "not chosen", "no resolution supplied").when(F.col("state") == "no data", "no usable data")
        .when(~F.col("readable"), "library not readable").when(~F.col("add_missing"), "missing from the library").when(F.col("state") == "unknown work", "identifier not resolved")
        .when(F.col("writable") == "no", "no write access").when(F.col("writable") != "yes", "write access not verified").when(F.col("identity").isNull(), "no usable data")
    )
    outcome = F.when(F.col("_refused"), "refused").when(F.col("state") == "retracted", "retracted").when(F.col("_key").isNotNull(), "matched").when(F.col("_reason").isNotNull(), "needs_input").otherwise("create")
    done = found.withColumns({"_key": key, "_reason": reason}).withColumn("outcome", outcome)
    return done.select(*WORK, F.when(F.col("outcome") == "matched", F.col("_key")).alias("key"), "outcome", F.when(F.col("outcome").isin("needs_input", "retracted"), F.col("_reason")).alias("reason"), F.when(F.col("outcome") == "create", F.col("identity")).alias("identity"))


def works_to_create(settled: DataFrame) -> DataFrame:
    """identity, title, doi, pmid, wanted: each work that is missing once, whatever number of documents and markers want it."""
    rows = settled.where("outcome = 'create'")
    first = F.struct("doc", "source", "id", "item")
    return rows.groupBy("identity").agg(*(F.min_by(c, first).alias(c) for c in ("title", "doi", "pmid")), F.count(F.lit(1)).alias("wanted"))


def with_answers(settled: DataFrame, answers: DataFrame) -> DataFrame:
    """Settled works with the keys that the service answered: created works are added; one without an answer needs input."""
    got = answers.select("identity", F.col("key").alias("_new"))
    met = settled.join(got, "identity", "left")
    made = F.col("outcome") == "create"
    outcome = F.when(made, F.when(F.col("_new").isNotNull(), "added").otherwise("needs_input")).otherwise(F.col("outcome"))
    return met.select(*WORK, F.when(made, F.col("_new")).otherwise(F.col("key")).alias("key"), outcome.alias("outcome"), F.when(made & F.col("_new").isNull(), "create failed").otherwise(F.col("reason")).alias("reason"))


def place_markers(markers: DataFrame, links: DataFrame, works: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc, marker, outcome, reason, keys of markers that an accepted work or a named identifier touches: replaced, live (a field already)
    or unresolved. works are settled ones with their answers; markers of refused documents are refused.

    Named identifiers own their marker. Else every item must name a reference with a key, and items of an author-year marker
    different ones. A numeric marker must still stand at its place and not overlap an earlier one; an author-year marker's text
    must occur once.
    """
    linked = links.groupBy("doc", "marker").agg(F.collect_list(F.struct("item", F.col("ref").cast("long").alias("ref"))).alias("links"))
    here = markers.join(linked, ["doc", "marker"], "left").join(paragraphs.select("doc", "para", F.col("text").alias("_text")), ["doc", "para"], "left")
    # the same texts of one document
    places = markers.groupBy("doc", "text").agg(F.count(F.lit(1)).alias("places"))
    return place_located(here.join(places, ["doc", "text"]).withColumn("stands", stands(F.col("_text"))), works)


def stands(paragraph: Column) -> Column:
    """Whether a marker's text stands at its place of the paragraph's text."""
    return F.coalesce(F.substr(paragraph, F.col("start") + 1, F.length("text")) == F.col("text"), F.lit(False))


def place_located(markers: DataFrame, works: DataFrame) -> DataFrame:
    """``place_markers`` of markers that have their links (item, ref) as an array, ``stands``, and ``places``, how many markers of the document
    have their text.

    All of it is by document: a document's works are one row of maps, so markers are shuffled once, without their texts.
    """
    wanted = works.where("source = 'marker' or (source = 'reference' and outcome <> 'retracted')").select("doc", "source", "id", "item", "key", (F.col("outcome") == "refused").alias("refused"))
    each = wanted.repartition("doc").groupBy("doc", "source", "id").agg(F.collect_list(F.struct("item", "key", "refused")).alias("w"))
    of = lambda source: F.map_from_entries(F.collect_list(F.when(F.col("source") == source, F.struct("id", "w"))))
    by_doc = each.groupBy("doc").agg(of("reference").alias("_refs"), of("marker").alias("_named"))

    rows = markers.select("doc", "marker", "kind", "para", "start", (F.col("start") + F.length("text")).alias("_stop"), "items", "live", "stands", "places", "links").join(by_doc, "doc")
    rows = rows.withColumn("_mine", F.try_element_at("_named", F.col("marker").cast("long"))).withColumn("owned", F.col("_mine").isNotNull())
    work = lambda item, ref, w: F.struct(item.alias("item"), ref.cast("long").alias("of"), w["key"].alias("key"), w["refused"].alias("refused"))
    named = F.transform("_mine", lambda w: work(w["item"], w["item"], w))
    linked = F.flatten(F.transform("links", lambda x: F.coalesce(F.transform(F.try_element_at(F.col("_refs"), x["ref"]), lambda w: work(x["item"], x["ref"], w)), F.array().cast("array<struct<item:int,of:bigint,key:string,refused:boolean>>"))))
    rows = rows.withColumn("_found", F.coalesce(F.when(F.col("owned"), named).otherwise(linked), F.array().cast("array<struct<item:int,of:bigint,key:string,refused:boolean>>"))).drop("_refs", "_named", "_mine", "links")
    rows = rows.withColumns({"any": F.size("_found") > 0, "refused": F.exists("_found", lambda w: w["refused"]), "_all": F.array_sort(F.transform(F.filter("_found", lambda w: w["key"].isNotNull()), lambda w: F.struct(w["item"].alias("item"), w["of"].alias("of"), w["key"].alias("key"))))})
    # two references of one number: the first is meant
    rows = rows.withColumn("_w", F.filter("_all", lambda x, i: (i == 0) | (F.get("_all", i - 1)["item"] != x["item"])))
    here = rows.withColumns({"have": F.size("_w"), "different": F.size(F.array_distinct(F.transform("_w", lambda x: x["of"]))), "keys": F.transform("_w", lambda x: x["key"])}).drop("_found", "_all", "_w")

    whole = (F.col("have") == F.col("items")) & (F.col("owned") | (F.col("kind") == "numeric") | (F.col("different") == F.col("items")))
    reason = (
        F.when(F.col("owned") & ~whole, "an identifier has no item").when((F.col("have") == F.col("items")) & ~whole, "two items name one reference").when(~whole, "not all works accepted with a key")
        .when((F.col("kind") != "numeric") & (F.col("places") > 1), "text not unique").when((F.col("kind") == "numeric") & ~F.col("stands"), "not at its place")
    )
    here = here.withColumn("reason", F.when(F.col("refused"), None).when(F.col("live"), None).otherwise(reason))
    ready = F.col("any") & ~F.col("refused") & ~F.col("live") & F.col("reason").isNull()
    # what stands before a marker in its paragraph
    before = F.max(F.when(ready & (F.col("kind") == "numeric"), F.col("_stop"))).over(Window.partitionBy("doc", "para").orderBy("start", "marker").rowsBetween(Window.unboundedPreceding, -1))
    overlaps = ready & (F.col("kind") == "numeric") & F.coalesce(before > F.col("start"), F.lit(False))
    reason = F.when(overlaps, "overlaps an earlier marker").otherwise(F.col("reason"))
    outcome = F.when(F.col("refused"), "refused").when(F.col("live"), "live").when(reason.isNotNull(), "unresolved").otherwise("replaced")
    # markers that no work touches go after the window, through which a filter isn't pushed: below it their works would be sought twice
    return here.select("doc", "marker", "any", outcome.alias("outcome"), reason.alias("reason"), F.when(outcome == "replaced", F.col("keys")).alias("keys")).where("any").drop("any")


def place_placeholders(placeholders: DataFrame, works: DataFrame) -> DataFrame:
    """doc, ph, outcome, reason, key: a placeholder with a key is replaced where its text stands in one place of the body."""
    held = works.where("source = 'placeholder' and outcome in ('matched', 'added')").select("doc", F.col("id").alias("ph"), "key")
    met = placeholders.select("doc", F.col("ph").cast("long").alias("ph"), "kind", "places").join(held, ["doc", "ph"])
    lost = (F.col("kind") == "comment") | (F.col("places") != 1)
    return met.select("doc", "ph", F.when(lost, "unresolved").otherwise("replaced").alias("outcome"), F.when(lost, "not in one place of the body").alias("reason"), F.when(~lost, F.col("key")).alias("key"))


def summary(works: DataFrame, placed: DataFrame, held: DataFrame, found: DataFrame) -> DataFrame:
    """doc, status, replaced, matched, added, needs_input, retracted, unresolved, problems. status: refused if a decision failed, else
    applied, or partial where something is left. Replaced counts places in the text, not works."""
    one = lambda df, **named: df.groupBy("doc").agg(*(F.sum(v.cast("long")).alias(k) for k, v in named.items()))
    o = F.col("outcome")
    w = one(works, matched=o == "matched", added=o == "added", needs_input=o == "needs_input", retracted=o == "retracted")
    m = one(placed.select("doc", "outcome").unionByName(held.select("doc", "outcome")), replaced=o == "replaced", unresolved=o == "unresolved")
    p = found.groupBy("doc").agg(F.count(F.lit(1)).alias("problems"))
    out = w.join(m, "doc", "full").join(p, "doc", "full").fillna(0)
    left = (F.col("needs_input") + F.col("unresolved") + F.col("retracted")) > 0
    status = F.when(F.col("problems") > 0, "refused").when(left, "partial").otherwise("applied")
    return out.select("doc", status.alias("status"), "replaced", "matched", "added", "needs_input", "retracted", "unresolved", "problems")


def cite_into(requests: DataFrame, index: DataFrame, found: DataFrame, paragraphs: DataFrame, base: Column) -> DataFrame:
    """requests(doc, request, anchor, identifiers) -> doc, request, status, keys, para, before, code, after: one citation field for all of a
    request's identifiers, behind the anchor's text.

    found(doc, anchor, n, para) is what ``workflows.find_anchor`` says of the anchors, index the library's. A request whose identifiers
    are malformed or not all in the library, or whose anchor isn't in one place, inserts nothing. Items keep their order.
    """
    each = requests.select("doc", "request", F.posexplode_outer("identifiers").alias("item", "raw")).withColumn("given", given_identifier(F.col("raw")))
    known = index.select("kind", "value", "key").unionByName(index.select(F.lit("key").alias("kind"), F.col("key").alias("value"), "key").distinct())
    met = each.withColumns({"_kind": F.col("given.kind"), "_value": F.col("given.value")}).join(known.toDF("_kind", "_value", "_key"), ["_kind", "_value"], "left")
    per = met.groupBy("doc", "request").agg(F.max(F.col("given").isNull()).alias("_odd"), F.max(F.col("_key").isNull()).alias("_lost"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("item", "_key")))), lambda x: x["_key"]).alias("keys"))
    rows = requests.select("doc", "request", "anchor").join(per, ["doc", "request"]).join(found, ["doc", "anchor"], "left").join(paragraphs.select("doc", "para", "text"), ["doc", "para"], "left")
    status = F.when(F.col("_odd"), "malformed").when(F.col("_lost"), "no such item").when(F.coalesce("n", F.lit(0)) == 0, "not found").when(F.col("para").isNull(), "not unique").otherwise("inserted")
    at = F.instr("text", F.col("anchor")) + F.length("anchor") - 1
    rows = rows.withColumn("status", status)
    only = lambda x: F.when(F.col("status") == "inserted", x)
    return rows.select("doc", "request", "status", only(F.col("keys")).alias("keys"), only(F.col("para")).alias("para"), only(F.substr(F.col("text"), F.lit(1), at)).alias("before"), only(citation_code(F.col("keys"), base)).alias("code"), only(F.substr(F.col("text"), at + 1)).alias("after"))
