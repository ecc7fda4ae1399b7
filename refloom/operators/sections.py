"""Sections of a manuscript: where they begin and end, the reference region, and lines that cite without a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.citations import NAME
from refloom.functions.identifiers import DOI
from refloom.functions.rendering import filled
from refloom.functions.shapes import ENUMERATED, SECTION_WORD, is_heading_shape, is_heading_style, rough_title
from refloom.operators import revisions
from refloom.operators.revisions import nested_fields

# How early a label stands in its line, what an enumerator of a top-level section looks like, particles of surnames.
LABEL_WITHIN = 60
PARTICLES = "van|von|de|der|den|del|della|di|da|la|le|du"
TOP_LEVEL = r"^\s*(?:[A-Za-z]|[IVXivx]{2,4}|\d{1,2})[.)]\s+"
AFTER_LABEL = r"^[ \t.:;)\]}\-–—]*$"
REFERENCE_HEADING = r"(?i)^\s*(?:\d+\.?\s+)?(?:references|bibliography|works cited|literature cited|reference list)\s*:?\s*$"
INLINE_CITATION = rf"\({NAME}(?:\s+et\s+al\.?)?(?:\s*(?:&|and)\s*{NAME})?,?\s+\d{{4}}[a-z]?"


def find_section(paragraphs: DataFrame, cue: str, word: str | None = None, strict: bool = False, heading_for_label: bool = True) -> DataFrame:
    """paragraphs(doc, para, text, style) -> doc, para of the first that begins the section; documents without it have no row.

    strict: the cue anywhere. Otherwise: the cue at a line's start; or early in a line that is shaped like a heading (any
    line, if ``heading_for_label`` is off); or anywhere in such a line; or ``word`` in a line with a heading's style.
    """
    text = F.col("text")
    at = F.regexp_instr(text, F.lit(cue))
    if strict:
        hit = at > 0
    else:
        heading = is_heading_shape(text)
        early = (at > 0) & (at <= LABEL_WITHIN)
        hit = F.trim(text).rlike(f"^(?:{cue.removeprefix('(?i)')})" if not cue.startswith("(?i)") else f"(?i)^(?:{cue[4:]})") | (early & (heading if heading_for_label else F.lit(True))) | ((at > 0) & heading)
        if word:
            hit = hit | (is_heading_style(F.col("style")) & text.rlike(word))
    return paragraphs.where(F.coalesce(hit, F.lit(False))).groupBy("doc").agg(F.min("para").alias("para"))


def find_label(paragraphs: DataFrame, cue: str) -> DataFrame:
    """paragraphs(doc, para, text) -> doc, para of the first that is a label of the section: the cue at its start, after at most a
    top-level enumerator, with nothing but punctuation or a colon after it, or after an enumerator a full stop or a
    heading's shape."""
    flags, bare = ("(?i)", cue[4:]) if cue.startswith("(?i)") else ("", cue)
    text = F.col("text")
    numbered = text.rlike(TOP_LEVEL)
    rest = F.when(numbered, F.regexp_replace(text, TOP_LEVEL, "")).otherwise(F.ltrim(text))
    starts = rest.rlike(f"{flags}^(?:{bare})")
    after = F.regexp_replace(rest, f"{flags}^(?:{bare})", "")
    hit = starts & (after.rlike(AFTER_LABEL) | F.ltrim(after).startswith(":") | (numbered & (F.ltrim(after).startswith(".") | is_heading_shape(text))))
    return paragraphs.where(F.coalesce(hit, F.lit(False))).groupBy("doc").agg(F.min("para").alias("para"))


def reference_region(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc, para, text, style) -> doc, start, stop: from the last reference heading's next paragraph to the next
    section's heading, half-open; the document's end without one."""
    heads = paragraphs.where(F.col("text").rlike(REFERENCE_HEADING)).groupBy("doc").agg(F.max("para").alias("head"))
    section = is_heading_style(F.col("style")) | F.trim("text").rlike(rf"(?i)^(?:\d+\.?\s+)?{SECTION_WORD}\s*:?$")
    nexts = paragraphs.join(heads, "doc").groupBy("doc", "head").agg(F.min(F.when((F.col("para") > F.col("head")) & section, F.col("para"))).alias("next"), (F.max("para") + 1).alias("end"))
    return nexts.select("doc", (F.col("head") + 1).alias("start"), F.coalesce("next", "end").alias("stop"))


def section_text(lines: DataFrame, heading: str) -> DataFrame:
    """lines(doc, line, text) -> doc, text: what follows the first line that is the heading, blank lines ahead skipped, up to the
    next blank line. Documents without the heading have no row."""
    first = lines.where(F.lower(F.trim("text")) == heading.strip().lower()).groupBy("doc").agg(F.min("line").alias("head"))
    after = lines.join(first, "doc").where(F.col("line") > F.col("head")).withColumn("blank", F.trim("text") == "")
    begin = after.groupBy("doc").agg(F.min(F.when(~F.col("blank"), F.col("line"))).alias("begin"))
    stop = after.join(begin, "doc").groupBy("doc").agg(F.min(F.when(F.col("blank") & (F.col("line") > F.col("begin")), F.col("line"))).alias("stop"), F.first("begin").alias("begin"))
    body = after.join(stop, "doc").where((F.col("line") >= F.col("begin")) & (F.col("stop").isNull() | (F.col("line") < F.col("stop"))))
    found = body.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return first.select("doc").join(found, "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))


def manual_references(paragraphs: DataFrame, fields: DataFrame, regions: DataFrame) -> DataFrame:
    """paragraphs(doc, para, text) before the reference region that cite without a field: doc, para, doi, title.

    A numbered entry, an author and year in parentheses, or a DOI; a year alone is prose.
    """
    body = paragraphs.join(regions.select("doc", "start"), "doc", "left").where(F.col("start").isNull() | (F.col("para") < F.col("start") - 1))
    typed = body.join(fields.select("doc", "para").distinct(), ["doc", "para"], "left_anti")
    text = F.trim("text")
    cites = text.rlike(ENUMERATED) | text.rlike(INLINE_CITATION) | text.rlike(DOI)
    doi = filled(F.lower(F.regexp_replace(F.regexp_extract(text, DOI, 1), r"[.,);:\]]+$", "")))
    return typed.where((text != "") & cites).select("doc", "para", doi.alias("doi"), rough_title(text).alias("title"))


def contents_paragraphs(paragraphs: DataFrame, spans: DataFrame) -> DataFrame:
    """paragraphs(doc, para, style) with ``is_toc``: a contents style, or within one of the spans(doc, start, stop) of a contents field.

    Spans are few a document and are turned into steps, so no interval is joined.
    """
    steps = spans.select("doc", F.explode(F.array(F.struct(F.col("start").alias("para"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).alias("para"), F.lit(-1).alias("d")))).alias("s")).select("doc", "s.para", "s.d")
    both = paragraphs.select("doc", "para", "style", F.lit(0).alias("d"), F.lit(True).alias("own")).unionByName(steps.select("doc", "para", F.lit(None).cast("string").alias("style"), "d", F.lit(False).alias("own")))
    inside = F.sum("d").over(Window.partitionBy("doc").orderBy("para")) > 0
    return both.withColumn("inside", inside).where("own").select("doc", "para", (F.col("inside") | F.coalesce(F.lower("style").startswith("toc"), F.lit(False))).alias("is_toc"))


def token_contents(tokens: DataFrame) -> DataFrame:
    """doc, part, para, is_toc of the paragraphs of tokens (``sources.docx``): a contents style, a simple contents field, or text shown
    inside a complete contents field (whatever fields are open within it) or a content control of the contents gallery.

    A paragraph that only has the field's end isn't part of the contents. Copies for old readers don't count. All is sums within
    a part; fields that stay open hold nothing.
    """
    contents = lambda c: F.upper(F.trim(c)).rlike(r"^TOC(?:$|[ \\])")
    by_part = Window.partitionBy("doc", "part")
    rows = revisions.by_part(tokens).withColumn("place", F.row_number().over(by_part.orderBy("pos")))
    spans = nested_fields(tokens).where(contents(F.col("instruction"))).select("doc", "part", F.explode(F.array(F.struct(F.col("begin").alias("place"), F.lit(1).alias("d")), F.struct(F.col("end").alias("place"), F.lit(-1).alias("d")))).alias("s"))
    steps = spans.groupBy("doc", "part", "s.place").agg(F.sum("s.d").alias("_d"))
    gallery = F.when(F.col("kind") == "toc", F.when(F.col("text") == "begin", 1).otherwise(-1)).otherwise(0)
    shown = (F.col("kind") == "t") & (~F.col("in_fallback") if "in_fallback" in tokens.columns else F.lit(True))
    open_ = F.sum(F.coalesce("_d", F.lit(0)) + gallery).over(by_part.orderBy("place")) > 0
    style = F.coalesce(F.col("pstyle").startswith("TOC"), F.lit(False)) if "pstyle" in tokens.columns else F.lit(False)
    met = rows.join(steps, ["doc", "part", "place"], "left").withColumn("_in", (open_ & shown) | style | ((F.col("kind") == "fldsimple") & contents(F.coalesce("text", F.lit("")))))
    return met.where("kind <> 'toc'").groupBy("doc", "part", "para").agg(F.max(F.coalesce("_in", F.lit(False))).alias("is_toc"))


def live_renderings(fields: DataFrame) -> DataFrame:
    """doc, text: what citation fields(doc, instruction) show, distinct; malformed payloads show nothing."""
    payload = F.from_json(F.regexp_extract("instruction", r"(?s)\{.*\}", 0), "properties STRUCT<formattedCitation: STRING, plainCitation: STRING>")
    shown = fields.where(F.contains("instruction", F.lit("ZOTERO_ITEM CSL_CITATION"))).select("doc", payload.alias("p"))
    return shown.select("doc", F.explode(F.array("p.properties.formattedCitation", "p.properties.plainCitation")).alias("text")).select("doc", filled(F.col("text")).alias("text")).where("text is not null").distinct()


def not_live(markers: DataFrame, renderings: DataFrame) -> DataFrame:
    """markers(doc, text) that no live field shows."""
    return markers.join(renderings, ["doc", "text"], "left_anti").select(*markers.columns)


def has_bibliography(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc").agg(F.max(F.contains("instruction", F.lit("ZOTERO_BIBL"))).alias("has_bibliography"))


def enumerated_author_groups(entry: Column) -> Column:
    """How many "Surname AB" groups lead an entry, one after a comma each, up to the one that a full stop or the end closes."""
    group = rf"\s*(?:(?:{PARTICLES})\s+)*[A-Z][A-Za-z'\-]+(?:\s+(?:{PARTICLES})\b)*\s+(?:[A-Z]\.?){{1,4}}\s*"
    bare = F.trim(F.regexp_replace(entry, r"^\s*(?:\[\s*\d+\s*\]|\(?\d+\)\.?|\d+\.)\s+", ""))
    led = F.regexp_extract(bare, rf"^((?:{group},)*(?:{group}(?:\.|$))?)", 1)
    return F.regexp_count(led, F.lit(rf"{group}(?:,|\.|$)"))
