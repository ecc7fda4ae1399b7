"""Queries over drafts: their sections, and what edits make of their paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import documents, edits, sections, workflows
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

_DRAFT = inline("draft")
_HEADING = "(trim(text) <> '' AND len(regexp_split_to_array(trim(text), '\\s+')) <= 8 AND right(trim(text), 1) <> '.')"
_STYLED = "(starts_with(lower(style), 'heading') OR starts_with(lower(style), 'title'))"


@query(rf"""WITH h AS (SELECT *, regexp_matches(text, '(?i)\bmethods\b') AS has, strpos(lower(text), 'methods') AS found_at FROM {_DRAFT})
SELECT doc, min(para) FILTER (has) AS strict, CAST(min(para) FILTER (regexp_matches(trim(text), '(?i)^methods\b') OR (has AND {_HEADING}) OR ({_STYLED} AND contains(lower(text), 'method'))) AS VARCHAR) AS loose,
  CAST(min(para) FILTER (regexp_matches(trim(text), '(?i)^methods\b') OR (has AND (found_at <= 60 OR {_HEADING}))) AS VARCHAR) AS header,
  CAST(min(para) FILTER (regexp_matches(regexp_replace(text, '^\s*(?:[A-Za-z]|[IVXivx]{{2,4}}|\d{{1,2}})[.)]\s+', ''), '(?i)^\s*methods\b(?:[ \t.:;)\]}}\-–—]*$|\s*:)') OR (regexp_matches(text, '^\s*(?:[A-Za-z]|[IVXivx]{{2,4}}|\d{{1,2}})[.)]\s+(?i:methods)\b') AND (regexp_matches(text, '(?i)methods\s*\.') OR {_HEADING}))) AS VARCHAR) AS label
FROM h GROUP BY doc HAVING min(para) FILTER (has) IS NOT NULL""")
def section_starts(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    cue = r"(?i)\bmethods\b"
    found = sections.find_section(d, cue, strict=True).withColumnRenamed("para", "strict")
    for name, some in (("loose", sections.find_section(d, cue, word="(?i)method")), ("header", sections.find_section(d, cue, heading_for_label=False)), ("label", sections.find_label(d, cue))):
        found = found.join(some.select("doc", F.col("para").cast("string").alias(name)), "doc", "left")
    return found


@query(rf"""WITH h AS (SELECT doc, max(para) AS head FROM {_DRAFT} WHERE text = 'References' GROUP BY doc)
SELECT d.doc, head + 1 AS start, coalesce(min(para) FILTER (para > head AND ({_STYLED} OR text IN ('Acknowledgements', 'Results', 'Abstract'))), max(para) + 1) AS stop FROM {_DRAFT} d JOIN h USING (doc) GROUP BY d.doc, head""")
def reference_regions(spark, sf_dir):
    return sections.reference_region(relation(spark, sf_dir, "draft"))


@query(rf"""WITH b AS (SELECT d.doc, min(para) FILTER (para > 8 AND trim(text) <> '') AS b FROM {_DRAFT} d GROUP BY d.doc), s AS (SELECT d.doc, any_value(b) AS b, coalesce(min(para) FILTER (para > b AND trim(text) = ''), 99) AS e FROM {_DRAFT} d JOIN b USING (doc) GROUP BY d.doc)
SELECT d.doc, string_agg(text, chr(10) ORDER BY para) AS text FROM {_DRAFT} d JOIN s USING (doc) WHERE para >= b AND para < e AND d.doc IN (SELECT doc FROM {_DRAFT} WHERE para = 8) GROUP BY d.doc""")
def section_bodies(spark, sf_dir):
    return sections.section_text(relation(spark, sf_dir, "draft").select("doc", F.col("para").alias("line"), "text"), "results")


@query(rf"""WITH h AS (SELECT doc, max(para) AS head FROM {_DRAFT} WHERE text = 'References' GROUP BY doc)
SELECT d.doc, para, CASE WHEN para = 5 THEN lower(regexp_extract(text, '10\.1234/P\.\d+')) END AS doi FROM {_DRAFT} d LEFT JOIN h USING (doc) WHERE (head IS NULL OR para < head) AND size % 6 <> 1
  AND (para IN (3, 5, 6, 18, 19) OR (para = 4 AND (regexp_matches(text, '^(?:2\.|[12]\))'))) OR (para = 20))""")
def manual_references(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    found = sections.manual_references(d, d.where("size % 6 = 1"), sections.reference_region(d))
    return found.select("doc", "para", "doi")


@query(f"SELECT doc, para, style LIKE 'TOC%' OR (doc % 2 = 0 AND para BETWEEN 13 AND 15) AS is_toc FROM {_DRAFT}")
def contents_lines(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    spans = d.where("para = 13 and doc % 2 = 0").select("doc", F.col("para").alias("start"), (F.col("para") + 2).alias("stop"))
    return sections.contents_paragraphs(d, spans)


@query(rf"""SELECT doc, para, len(regexp_extract_all(regexp_extract(regexp_replace(text, '^\s*(?:\[\s*\d+\s*\]|\(?\d+\)\.?|\d+\.)\s+', ''), '^((?:(?:(?:van|der)\s+)*[A-Z][A-Za-z]+\s+[A-Z]{{1,4}},\s*)*(?:(?:(?:van|der)\s+)*[A-Z][A-Za-z]+\s+[A-Z]{{1,4}}(?:\.|$))?)', 1), '[A-Z]{{1,4}}(?:,|\.|$)')) AS groups FROM {_DRAFT}""")
def author_group_counts(spark, sf_dir):
    return relation(spark, sf_dir, "draft").select("doc", "para", sections.enumerated_author_groups(F.col("text")).cast("long").alias("groups"))


_RENDERED_CODE = "CASE cited % 4 WHEN 0 THEN 'ADDIN ZOTERO_ITEM CSL_CITATION ' || chr(123) || '\"properties\":' || chr(123) || '\"formattedCitation\":\"(' || CAST(cited % 50 AS STRING) || ')\",\"plainCitation\":\" \"' || chr(125) || chr(125) WHEN 1 THEN 'ADDIN ZOTERO_ITEM CSL_CITATION ' || chr(123) || 'broken' WHEN 2 THEN 'ADDIN ZOTERO_BIBL x' ELSE 'PAGEREF' END"


@query(f"""WITH l AS (SELECT DISTINCT doc, '(' || cited % 50 || ')' AS text FROM {inline("citations")} WHERE cited % 4 = 0), b AS (SELECT doc, bool_or(cited % 4 = 2) AS bib FROM {inline("citations")} GROUP BY doc)
SELECT m.doc, m.n, m.text, b.bib FROM (SELECT doc, n, '(' || cited % 50 || ')' AS text FROM {inline("citations")}) m JOIN b USING (doc) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc = m.doc AND l.text = m.text)""")
def plain_markers(spark, sf_dir):
    c = relation(spark, sf_dir, "citations")
    fields = c.select("doc", F.expr(_RENDERED_CODE).alias("instruction"))
    markers = c.select("doc", "n", F.concat(F.lit("("), F.col("cited") % 50, F.lit(")")).alias("text"))
    return sections.not_live(markers, sections.live_renderings(fields)).join(sections.has_bibliography(fields).withColumnRenamed("has_bibliography", "bib"), "doc")


# --- edits


@query(f"""SELECT doc, para, CASE WHEN size % 4 = 0 THEN 'none' WHEN size % 7 = 1 THEN 'refused' WHEN size % 5 = 0 AND length(text) >= 2 THEN 'field_safe' WHEN size % 5 = 1 AND length(text) >= 2 THEN 'refused' WHEN size % 3 = 0 THEN 'surgical' ELSE 'redline' END AS strategy,
  text AS old, CASE WHEN size % 4 = 0 OR size % 7 = 1 OR (size % 5 = 1 AND length(text) >= 2) THEN text ELSE text || ' and a whole new end' END AS new FROM {_DRAFT}""")
def paragraph_edits(spark, sf_dir):
    """The edits of paragraphs, put together again: kept and deleted pieces are the old text, kept and inserted ones the new."""
    d = relation(spark, sf_dir, "draft")
    s = F.col("size")
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop")))
    n = F.length("text")
    spans = F.when((s % 5 == 0) & (n >= 2), span(F.lit(0), F.lit(1))).when((s % 5 == 1) & (n >= 2), span(n - 1, n + 1)).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    paras = d.select("doc", "para", "text", (s % 7 == 1).alias("tracked"), spans.alias("spans"), (s % 3 != 0).alias("plain"))
    pieces = edits.replace_paragraphs(paras, d.select("doc", "para", F.when(s % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" and a whole new end"))).alias("new")))
    joined = lambda *ops: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isin(*ops), F.struct("place", "text")))), lambda x: x["text"]), "")
    return d.select("doc", "para").join(pieces.groupBy("doc", "para").agg(F.first("strategy").alias("strategy"), joined("keep", "delete").alias("old"), joined("keep", "insert").alias("new")), ["doc", "para"], "left").select("doc", "para", "strategy", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))


@query(f"""SELECT doc, para, CASE WHEN length(text) < 6 THEN NULL WHEN size % 3 = 0 THEN 'F' || text[3:] ELSE text[1:2] || 'F' || text[5:] END AS text FROM {_DRAFT} WHERE length(text) >= 6 AND NOT (size % 3 = 1 AND size % 2 = 1)""")
def marker_replacements(spark, sf_dir):
    d = relation(spark, sf_dir, "draft").where("length(text) >= 6")
    at = lambda a, b, where, wrong=False: d.where(where).select("doc", "para", F.lit(a).alias("start"), F.lit(b).alias("stop"), (F.lit("no such text") if wrong else F.substr("text", F.lit(a + 1), F.lit(b - a))).alias("text"), F.lit("F").alias("code"))
    places = at(0, 2, "size % 3 = 0").unionByName(at(1, 4, "size % 3 = 0")).unionByName(at(2, 4, "size % 3 <> 0 and not (size % 3 = 1 and size % 2 = 1)")).unionByName(at(2, 4, "size % 3 = 1 and size % 2 = 1", True))
    pieces = edits.replace_markers(d, places)
    return pieces.groupBy("doc", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "").alias("text"))


@query(f"""WITH k AS (SELECT x.doc, a.anchor, count(d.para) AS n, min(d.para) AS p, min_by(d.text, d.para) AS t FROM (SELECT DISTINCT doc FROM {_DRAFT}) x CROSS JOIN (SELECT unnest(['Results', 'and more of', 'no such words', 'our methods']) AS anchor) a LEFT JOIN {_DRAFT} d ON d.doc = x.doc AND contains(d.text, a.anchor) GROUP BY x.doc, a.anchor)
SELECT doc, anchor, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' ELSE 'inserted' END AS status, CASE WHEN n = 1 THEN t[1:strpos(t, anchor) + length(anchor) - 1] || '[F]' || t[strpos(t, anchor) + length(anchor):] END AS text FROM k""")
def citation_insertions(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    codes = d.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, ("Results", "and more of", "no such words", "our methods")))).alias("anchor")).withColumn("code", F.lit("[F]"))
    found = workflows.find_anchor(codes.select("doc", "anchor"), d.select("doc", "para", "text", F.lit(False).alias("is_toc")))
    out = edits.insert_at_anchor(found, d.select("doc", "para", "text"), codes)
    return out.select("doc", "anchor", "status", F.concat("before", "code", "after").alias("text"))


_ITEMS = f"(SELECT doc, n // 3 AS field, n AS place, CASE WHEN cited % 3 = 0 THEN '10.1/' || cited % 5 END AS doi, CASE WHEN cited % 9 <> 4 THEN 'K' || cited END AS key FROM {inline('citations')})"


@query(f"""WITH w AS (SELECT doc, field, coalesce(doi, key, '#' || place) AS work, min(place) AS place, min(key) AS key FROM {_ITEMS} GROUP BY 1, 2, 3)
SELECT doc, field, CASE WHEN bool_or(key IS NULL) THEN 'left' ELSE 'converted' END AS status, CASE WHEN NOT bool_or(key IS NULL) THEN 'ADDIN ZOTERO_ITEM CSL_CITATION ' || chr(123) || '"citationItems":[' || string_agg(chr(123) || '"id":"' || key || '","uris":["http://x/' || key || '"]' || chr(125), ',' ORDER BY place) || ']' || chr(125) END AS code FROM w GROUP BY doc, field""")
def converted_fields(spark, sf_dir):
    c = relation(spark, sf_dir, "citations")
    items = c.select("doc", F.floor(F.col("n") / 3).alias("field"), F.col("n").alias("place"), F.when(F.col("cited") % 3 == 0, F.concat(F.lit("10.1/"), F.col("cited") % 5)).alias("doi"), F.when(F.col("cited") % 9 != 4, F.concat(F.lit("K"), F.col("cited"))).alias("key"))
    return edits.convert_fields(items).select("doc", "field", "status", F.when(F.col("keys").isNotNull(), edits.citation_code(F.col("keys"), F.lit("http://x/"))).alias("code"))


@query(f"""WITH h AS (SELECT doc, max(para) FILTER (text = 'References') AS head, max(para) + 1 AS e FROM {_DRAFT} GROUP BY doc)
SELECT doc, CASE WHEN doc % 3 = 0 THEN 'kept' WHEN head IS NOT NULL THEN 'under heading' ELSE 'at end' END AS status, CAST(CASE WHEN doc % 3 <> 0 THEN coalesce(head + 1, e) END AS VARCHAR) AS para FROM h""")
def bibliography_fields(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    docs = d.groupBy("doc").agg((F.max("para") + 1).alias("end")).withColumn("has_bibliography", F.col("doc") % 3 == 0)
    return edits.append_bibliography(docs, d.where("text = 'References'").select("doc", "para")).withColumn("para", F.col("para").cast("string"))


_MARKS = f"(SELECT doc, size % 2 AS part, k, para * 5 + k AS pos, para, size FROM {_DRAFT} CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) q)"


@query(f"""WITH f AS (SELECT doc, CAST(size % 2 AS VARCHAR) AS part, row_number() OVER (PARTITION BY doc, size % 2 ORDER BY para) AS field, size FROM {_DRAFT}),
i AS (SELECT *, size % 3 = 0 AS ins, size % 5 = 0 AS del, (CASE WHEN size % 3 = 0 AND size % 4 = 1 THEN 1 ELSE 0 END) + (CASE WHEN size % 5 = 0 AND size % 3 <> 0 THEN 1 ELSE 0 END) + 0 AS x FROM f),
l AS (SELECT *, CASE WHEN ins AND NOT del THEN (size % 4 = 1)::INT WHEN del AND NOT ins THEN (size % 7 <> 2)::INT WHEN ins AND del THEN CASE WHEN size % 4 = 1 OR size % 7 <> 2 THEN 1 ELSE 0 END ELSE 0 END AS loose, NOT (ins AND size % 4 = 1 AND size % 7 = 2) AS fixable FROM i)
SELECT doc, count(*) AS fields, count(DISTINCT part) AS parts, CAST(sum(loose) AS BIGINT) AS loose, count(*) FILTER (NOT fixable) AS unfixable FROM l WHERE loose > 0 AND size % 11 <> 3 GROUP BY doc""")
def field_tracking(spark, sf_dir):
    """Five tokens a field: begin, instruction, separator, result, end; the result loses the tracking of its field in some."""
    d = relation(spark, sf_dir, "draft")
    s, k = F.col("size"), F.col("k")
    t = d.select("doc", (s % 2).cast("string").alias("part"), "para", "size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    ins, dele = s % 3 == 0, s % 5 == 0
    t = t.select("doc", "part", (F.col("para") * 5 + k).cast("long").alias("pos"), F.when(k.isin(0, 2, 4), "fld").when(k == 1, "instr").otherwise("t").alias("kind"), F.when(k == 0, "begin").when(k == 2, "separate").when((k == 4) & (s % 11 != 3), "end").when(k == 4, "x").otherwise("text").alias("text"),
        F.when(k == 3, ins & (s % 4 != 1)).otherwise(ins).alias("in_ins"), F.when(k == 3, F.when(ins | dele, s % 7 == 2).otherwise(False)).otherwise(dele).alias("in_del"), "size")
    return edits.tracking_summary(edits.tracking_issues(t.where("size % 11 <> 3")))


@query(f"""SELECT doc, CAST(floor(para / 5) AS BIGINT) AS box, para % 5 AS index, text, size % 4 <> 0 AND NOT bool_or(para % 5 = 4 AND size % 3 = 0) OVER (PARTITION BY doc, floor(para / 5)) AS paired FROM {_DRAFT}""")
def box_copies(spark, sf_dir):
    d = relation(spark, sf_dir, "draft").select("doc", F.floor(F.col("para") / 5).alias("box"), (F.col("para") % 5).alias("index"), "text", "size", "para")
    a = d.select("doc", "box", F.lit("choice").alias("branch"), "index", "text")
    b = d.where("not (para % 5 = 4 and size % 3 = 0)").select("doc", "box", F.lit("fallback").alias("branch"), "index", F.when(F.col("size") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return edits.pair_box_copies(a.unionByName(b))


@query(f"""SELECT d.doc, d.para + 100 AS id, CAST(a.p AS VARCHAR) AS para, t.text FROM {_DRAFT} d LEFT JOIN (SELECT doc, para + 100 AS id, least(para, (para + size) % 25) AS p FROM {_DRAFT} WHERE size % 3 <> 0) a ON a.doc = d.doc AND a.id = d.para + 100 LEFT JOIN {_DRAFT} t ON t.doc = d.doc AND t.para = a.p""")
def comment_anchors(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    at = lambda p: d.where("size % 3 <> 0").select("doc", (F.col("para") + 100).alias("id"), p.cast("int").alias("para"))
    anchors = at(F.col("para")).unionByName(at((F.col("para") + F.col("size")) % 25))
    return edits.comment_contexts(d.select("doc", (F.col("para") + 100).alias("id")), anchors, d.select("doc", "para", "text")).withColumn("para", F.col("para").cast("string"))


@query(f"""SELECT doc, 'part' || para AS name, CASE WHEN size % 3 = 1 THEN size + 1 ELSE size END AS crc, CASE WHEN size % 5 = 0 THEN 'added' WHEN size % 3 = 1 THEN 'written' ELSE 'kept' END AS action, CASE WHEN size % 5 = 0 THEN 'text/xml' END AS override FROM {_DRAFT} WHERE NOT (size % 5 = 0 AND size % 3 = 2)""")
def saved_packages(spark, sf_dir):
    d = relation(spark, sf_dir, "draft").select("doc", F.concat(F.lit("part"), "para").alias("name"), F.col("size").alias("crc"), F.lit("text/xml").alias("kind"), "size")
    changed = d.where("size % 3 <> 2").withColumn("crc", F.when(F.col("size") % 3 == 1, F.col("crc") + 1).otherwise(F.col("crc")))
    return edits.saved_parts(d.where("size % 5 <> 0"), changed)


_CODE = "CASE size % 4 WHEN 0 THEN 'ADDIN ZOTERO_ITEM CSL_CITATION  ' || translate('<\"citationItems\":[<\"id\":\"1\",\"itemData\":<\"DOI\":\"10.1/' || CAST(para AS STRING) || '\",\"title\":\"T\">>]>', '<>', chr(123) || chr(125)) WHEN 1 THEN 'CITATION Abc20' WHEN 2 THEN 'PAGEREF x' ELSE 'ADDIN EN.CITE ' || text END"
_SOURCES = rf"""h AS (SELECT doc, max(para) AS head FROM {_DRAFT} WHERE text = 'References' GROUP BY doc),
cited AS (SELECT doc, para, text, size, {_CODE} AS code FROM {_DRAFT} WHERE size % 6 = 1 AND size % 4 <> 2),
typed AS (SELECT d.doc, para, text, CASE WHEN para = 5 THEN lower(regexp_extract(text, '10\.1234/P\.\d+')) END AS doi FROM {_DRAFT} d LEFT JOIN h USING (doc) WHERE (head IS NULL OR para < head) AND size % 6 <> 1
  AND (para IN (3, 5, 6, 18, 19, 20) OR (para = 4 AND regexp_matches(text, '^(?:2\.|[12]\))')))),
found AS (SELECT doc, CASE size % 4 WHEN 0 THEN 'zotero' WHEN 1 THEN 'word' ELSE 'endnote' END AS manager, CAST(para AS BIGINT) AS place, trim(regexp_replace(code, '\s+', ' ', 'g')) AS x, CASE WHEN size % 4 = 0 THEN '10.1/' || para END AS doi, false AS low_confidence FROM cited
  UNION ALL SELECT doc, 'manual', para, trim(regexp_replace(text, '\s+', ' ', 'g')), doi, true FROM typed)"""


def _citation_sources(spark, sf_dir):
    d = relation(spark, sf_dir, "draft")
    with_field = d.where("size % 6 = 1")
    typed = sections.manual_references(d, with_field, sections.reference_region(d)).join(d.select("doc", "para", "text"), ["doc", "para"])
    return documents.citation_sources(with_field.select("doc", F.col("para").alias("pos"), F.expr(_CODE).alias("instruction")), typed)


@query(f"WITH {_SOURCES} SELECT doc, manager, place, CASE WHEN length(x) > 140 THEN x[1:140] || '…' ELSE x END AS excerpt, doi, low_confidence FROM found")
def citation_source_rows(spark, sf_dir):
    return _citation_sources(spark, sf_dir).drop("title")


@query(f"""WITH {_SOURCES} SELECT doc, count(*) FILTER (manager = 'zotero') AS zotero, count(*) FILTER (manager = 'mendeley') AS mendeley, count(*) FILTER (manager = 'endnote') AS endnote, count(*) FILTER (manager = 'word') AS word, count(*) FILTER (manager = 'manual') AS manual FROM found GROUP BY doc""")
def citation_source_counts(spark, sf_dir):
    return documents.source_counts(_citation_sources(spark, sf_dir))
