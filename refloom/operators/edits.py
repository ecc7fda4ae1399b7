"""Changes to documents as relations: what becomes of each paragraph's pieces, and whether a change is refused.

A document is a table of paragraphs and fields; an edit yields the new pieces of a paragraph in order. Writing them into a
package is a projection of these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.rendering import filled
from refloom.functions.shapes import changed_span
from refloom.operators.items import redline

PIECE = "struct<op:string,text:string>"


def strategy(text: Column, new: Column, tracked: Column, spans: Column, plain: Column) -> Column:
    """How a paragraph takes a new text: none if it has it; in a paragraph with fields (ARRAY<(start, stop)> of their text)
    ``field_safe`` if the change lies outside all of them; ``redline`` where all is plain runs; ``surgical`` where only other
    runs are in the way; and refused, rather than corrupting anything, over changes that are tracked already."""
    change = changed_span(text, new)
    begin = F.length(text) - F.length(_after_prefix(text, new))
    stop = begin + F.length(F.coalesce(change["removed"], F.lit("")))
    touches = F.exists(spans, lambda s: (begin < s["stop"]) & (s["start"] < stop)) | F.exists(spans, lambda s: (begin > s["start"]) & (begin < s["stop"]))
    return (
        F.when(text == new, "none").when(tracked, "refused").when((F.size(spans) > 0) & touches, "refused").when(F.size(spans) > 0, "field_safe")
        .when(plain, "redline").otherwise("surgical")
    )


def _after_prefix(text: Column, new: Column) -> Column:
    """What is left of a text after the beginning it shares with the other."""
    n = F.least(F.length(text), F.length(new))
    same = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(1)) != F.substr(new, i, F.lit(1)))
    return F.substr(text, F.coalesce(F.get(same, 0), n + 1))


def replace_paragraphs(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """paragraphs(doc, para, text, tracked, spans, plain) with edits(doc, para, new) -> doc, para, strategy, place, op, text.

    ops: keep, delete, insert (null where nothing is left to show); a refused edit keeps the text. Joined, kept and deleted pieces give the old text, kept and
    inserted ones the new.
    """
    met = paragraphs.join(edits, ["doc", "para"]).withColumn("strategy", strategy(F.col("text"), F.col("new"), F.col("tracked"), F.col("spans"), F.col("plain")))
    new = F.when(F.col("strategy") == "refused", F.col("text")).otherwise(F.col("new"))
    whole = met.withColumn("new", new).withColumn("steps", redline(F.col("text"), F.col("new")))
    change = changed_span(F.col("text"), F.col("new"))
    rest = _after_prefix(F.col("text"), F.col("new"))
    ahead = F.substr("text", F.lit(1), F.length("text") - F.length(rest))
    behind = F.substr(rest, F.length(change["removed"]) + 1)
    piece = lambda op, x: F.struct(F.lit(op).alias("op"), x.alias("text"))
    surgical = F.array(piece("keep", ahead), piece("delete", change["removed"]), piece("insert", change["added"]), piece("keep", behind))
    words = F.flatten(F.transform("steps", lambda s: F.when(s["op"] == "equal", F.array(piece("keep", s["old"]))).otherwise(F.array(piece("delete", s["old"]), piece("insert", s["new"])))))
    pieces = F.when(F.col("strategy").isin("none", "refused"), F.array(piece("keep", F.col("text")))).when(F.col("strategy") == "redline", words).otherwise(surgical)
    kept = F.filter(pieces, lambda p: p["text"] != "")
    return whole.select("doc", "para", "strategy", F.posexplode_outer(kept).alias("place", "p")).select("doc", "para", "strategy", "place", "p.op", "p.text")


def replace_markers(paragraphs: DataFrame, occurrences: DataFrame) -> DataFrame:
    """paragraphs(doc, para, text) with occurrences(doc, para, start, stop, text, code) -> doc, para, place, kind, text.

    Each occurrence that still stands where it was found becomes a field with its code; one that has moved or overlaps an
    earlier one is left as text. All places refer to the text as it was, so the order of replacing doesn't matter.
    """
    found = occurrences.withColumnRenamed("text", "marker").join(paragraphs, ["doc", "para"]).where(F.substr(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("marker"))
    clear = F.coalesce(F.max("stop").over(Window.partitionBy("doc", "para").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")
    rows = found.withColumn("_clear", clear).where("_clear").groupBy("doc", "para").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("start", "stop", "code"))).alias("o"))
    piece = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))

    def around(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get("o", i - 1)["stop"], F.lit(0))
        return F.array(piece("text", F.substr(F.col("text"), before + 1, x["start"] - before)), piece("field", x["code"]))

    last = F.get("o", F.size("o") - 1)["stop"]
    pieces = F.concat(F.flatten(F.transform("o", around)), F.array(piece("text", F.substr(F.col("text"), last + 1))))
    return rows.select("doc", "para", F.posexplode(F.filter(pieces, lambda p: p["text"] != "")).alias("place", "p")).select("doc", "para", "place", "p.kind", "p.text")


def insert_at_anchor(found: DataFrame, paragraphs: DataFrame, codes: DataFrame) -> DataFrame:
    """found(doc, anchor, n, para), paragraphs(doc, para, text) and codes(doc, anchor, code) -> doc, anchor, status, para, before, code,
    after: the field goes behind the anchor's text; an anchor that isn't there or not in one place only is refused."""
    met = codes.join(found, ["doc", "anchor"], "left").join(paragraphs, ["doc", "para"], "left")
    at = F.instr("text", F.col("anchor")) + F.length("anchor") - 1
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "not found").when(F.col("para").isNull(), "not unique").otherwise("inserted")
    return met.select("doc", "anchor", status.alias("status"), "para", F.substr(F.col("text"), F.lit(1), at).alias("before"), F.when(F.col("para").isNotNull(), F.col("code")).alias("code"), F.substr(F.col("text"), at + 1).alias("after"))


def convert_fields(items: DataFrame) -> DataFrame:
    """items(doc, field, place, doi, key) of other managers' fields -> doc, field, status, keys.

    A field is converted only if every work in it has a key in the library; a work met several times counts once for each field.
    """
    works = items.groupBy("doc", "field", F.coalesce(F.lower("doi"), F.col("key"), F.concat(F.lit("#"), F.col("place").cast("string"))).alias("work")).agg(F.min("place").alias("place"), F.min("key").alias("key"))
    by = works.groupBy("doc", "field").agg(F.max(F.col("key").isNull()).alias("lacks"), F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]).alias("keys"))
    return by.select("doc", "field", F.when(F.col("lacks"), "left").otherwise("converted").alias("status"), F.when(~F.col("lacks"), F.col("keys")).alias("keys"))


def citation_code(keys: Column, base: Column) -> Column:
    """The instruction of a field that cites keys, with their addresses under a base."""
    items = F.transform(keys, lambda k: F.struct(k.alias("id"), F.array(F.concat(base, k)).alias("uris")))
    return F.concat(F.lit("ADDIN ZOTERO_ITEM CSL_CITATION "), F.to_json(F.struct(items.alias("citationItems"))))


def append_bibliography(documents: DataFrame, headings: DataFrame) -> DataFrame:
    """documents(doc, end, has_bibliography) and headings(doc, para) -> doc, status, para: a bibliography field goes under the last
    heading, else at the end; a document that has one keeps it."""
    last = headings.groupBy("doc").agg(F.max("para").alias("head"))
    met = documents.join(last, "doc", "left")
    return met.select("doc", F.when(F.col("has_bibliography"), "kept").when(F.col("head").isNotNull(), "under heading").otherwise("at end").alias("status"), F.when(~F.col("has_bibliography"), F.coalesce(F.col("head") + 1, F.col("end"))).alias("para"))


def tracking_issues(tokens: DataFrame) -> DataFrame:
    """tokens(doc, part, pos, kind, text, in_ins, in_del): doc, part, field, tracked, loose, fixable of complete fields whose begin is
    tracked but some of whose runs are not resolved with it. Only a run that is deleted while the field is inserted can't be
    mended by wrapping it."""
    w = Window.partitionBy("doc", "part").orderBy("pos")
    step = F.when((F.col("kind") == "fld") & (F.col("text") == "begin"), 1).when((F.col("kind") == "fld") & (F.col("text") == "end"), -1).otherwise(0)
    rows = tokens.withColumn("depth", F.sum(step).over(w)).withColumn("_opens", (step == 1) & (F.col("depth") == 1))
    rows = rows.withColumn("field", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(w))
    inside = rows.where("field > 0 and (depth > 0 or (kind = 'fld' and text = 'end'))")
    begins = F.max(F.when(F.col("_opens") & F.col("in_ins"), True)), F.max(F.when(F.col("_opens") & F.col("in_del"), True))
    heads = inside.groupBy("doc", "part", "field").agg(begins[0].alias("ins"), begins[1].alias("del"), F.max((F.col("kind") == "fld") & (F.col("text") == "end") & (F.col("depth") == 0)).alias("complete")).where("complete and (ins or del)")
    heads = heads.select("doc", "part", "field", F.coalesce("ins", F.lit(False)).alias("ins"), F.coalesce("del", F.lit(False)).alias("del"))
    met = inside.join(heads, ["doc", "part", "field"])
    loose = (F.col("ins") & ~F.col("in_ins")) | (F.col("del") & ~F.col("in_del"))
    stuck = F.col("ins") & ~F.col("in_ins") & F.col("in_del")
    out = met.groupBy("doc", "part", "field", "ins", "del").agg(F.count_if(loose).alias("loose"), (F.count_if(stuck) == 0).alias("fixable")).where("loose > 0")
    return out.select("doc", "part", "field", F.concat_ws("+", F.when(F.col("ins"), "ins"), F.when(F.col("del"), "del")).alias("tracked"), "loose", "fixable")


def tracking_summary(issues: DataFrame) -> DataFrame:
    """doc, fields, parts, loose, unfixable."""
    return issues.groupBy("doc").agg(F.count(F.lit(1)).alias("fields"), F.countDistinct("part").alias("parts"), F.sum("loose").alias("loose"), F.count_if(~F.col("fixable")).alias("unfixable"))


def resolve_changes(tokens: DataFrame, accept: bool) -> DataFrame:
    """Tokens after all tracked changes are accepted (or rejected): what goes is dropped, what stays is plain."""
    gone = (F.col("in_del") | F.col("in_move_from")) if accept else (F.col("in_ins") | F.col("in_move_to"))
    kind = F.when(F.col("kind") == "dt", "t").otherwise(F.col("kind"))
    rows = tokens.where(~F.coalesce(gone, F.lit(False))).withColumn("kind", kind)
    for c in ("in_ins", "in_del", "in_move_from", "in_move_to"):
        rows = rows.withColumn(c, F.lit(False))
    return rows


def pair_box_copies(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc, box, branch, index, text) of text boxes, branch ``choice`` or ``fallback`` -> doc, box, index, text, paired: the
    twin of a paragraph has its index in the other branch, and counts only if the branches are as long and its text is equal."""
    w = Window.partitionBy("doc", "box", "branch")
    rows = paragraphs.withColumn("n", F.count(F.lit(1)).over(w))
    a, b = (rows.where(F.col("branch") == x).select("doc", "box", "index", F.col("text").alias(x), F.col("n").alias(f"n_{x}")) for x in ("choice", "fallback"))
    return a.join(b, ["doc", "box", "index"], "left").select("doc", "box", "index", F.col("choice").alias("text"), F.coalesce((F.col("choice") == F.col("fallback")) & (F.col("n_choice") == F.col("n_fallback")), F.lit(False)).alias("paired"))


def comment_contexts(comments: DataFrame, anchors: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """comments(doc, id), anchors(doc, id, para) and paragraphs(doc, para, text) -> doc, id, para, text of the first paragraph an anchor is in."""
    first = anchors.groupBy("doc", "id").agg(F.min("para").alias("para"))
    return comments.join(first, ["doc", "id"], "left").join(paragraphs, ["doc", "para"], "left").select("doc", "id", "para", "text")


def saved_parts(parts: DataFrame, changed: DataFrame) -> DataFrame:
    """parts(doc, name, crc, kind) of a package with changed(doc, name, crc, kind): parts that are the same keep their bytes, new ones
    are added with an override of their content type: doc, name, crc, action, override."""
    met = parts.select("doc", "name", F.col("crc").alias("old"), F.col("kind").alias("old_kind")).join(changed, ["doc", "name"], "full")
    action = F.when(F.col("old").isNull(), "added").when(F.col("crc").isNull() | (F.col("crc") == F.col("old")), "kept").otherwise("written")
    return met.select("doc", "name", F.coalesce("crc", "old").alias("crc"), action.alias("action"), F.when(F.col("old").isNull(), filled(F.col("kind"))).alias("override"))
