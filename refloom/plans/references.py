"""Queries over references, markers and the records behind identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import names, shapes
from refloom.operators import library, ordered, resolver, verification
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

_METAS = inline("metas")
_STOP = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]+')), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _doi(x: str) -> str:
    """Normalised form of the DOIs of this module's relations, which end without punctuation."""
    return f"nullif(lower(regexp_replace(trim({x}), '(?i)^https?://(dx\\.)?doi\\.org/', '')), '')"


def _authors(x: str) -> str:
    return f"list_transform(list_filter(string_split({x}, ';'), lambda s1: s1 <> ''), lambda s2: CASE WHEN s2[1] = '*' THEN {{'f': '', 'g': '', 'l': s2[2:]}} ELSE {{'f': split_part(s2, ',', 1), 'g': split_part(s2, ',', 2), 'l': ''}} END)"


_ORG = shapes.ORGANISATION.replace("'", "''")


def _surname(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower(strip_accents({x})), 'ø', 'o'), 'ß', 'ss'), '[^a-z \\-]', '', 'g'))"


def _persons(x: str) -> str:
    """Surname keys of the persons of a parsed list."""
    return f"list_transform(list_filter({x}, lambda s3: s3.l = '' AND NOT (trim(s3.f || ' ' || s3.g) = '' OR (regexp_matches(trim(s3.f || ' ' || s3.g), '{_ORG}') AND (s3.g = '' OR NOT contains(s3.f || s3.g, ','))))), lambda s4: {_surname('s4.f')})"


def _differing(a: str, b: str) -> str:
    return f"list_filter(range(1, len({a}) + 1), lambda i: i > len({b}) OR {a}[i] <> {b}[i])"


def _metas(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    return m.withColumn("authors", verification.parse_authors(F.col("authors"))).withColumn("rec_authors", verification.parse_authors(F.col("rec_authors")))


# --- markers


_ITEMS = r"""
  chunks AS (SELECT marker, doc, unnest(string_split(translate(text, '()', '  '), ';')) AS chunk, generate_subscripts(string_split(translate(text, '()', '  '), ';'), 1) AS k FROM {markers}),
  pieces AS (SELECT marker, doc, k, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM (SELECT marker, doc, k, regexp_split_to_array(chunk, '\s+(?:and|&)\s+|\s*&\s*') AS p FROM chunks)),
  dated AS (SELECT *, regexp_matches(piece, '(?:1[6-9]|20)\d{{2}}') AS has FROM pieces),
  runs AS (SELECT *, coalesce(sum(has::INT) OVER (PARTITION BY marker, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, bool_or(has) OVER (PARTITION BY marker, k) AS any_has FROM dated),
  parts AS (SELECT marker, doc, k, run, string_agg(piece, ' and ' ORDER BY j) AS part, bool_or(has) AS has, any_value(any_has) AS any_has FROM runs GROUP BY ALL),
  named AS (SELECT marker, doc, k, run, part, has, nullif(regexp_extract(part, '(?:(?:Ó|Ní|Nic|Mac)\s+)?\p{{Lu}}(?:\p{{L}}|[''’\-])+'), '') AS name,
    regexp_extract_all(part, '((?:1[6-9]|20)\d{{2}}(?:[a-z]\b(?:,\s*[a-z]\b)*)?)', 1) AS ys FROM parts WHERE has OR NOT any_has),
  kept AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY k, run) AS r FROM named WHERE has OR (name IS NOT NULL AND NOT regexp_matches(name, '^(?:In|Since|From)\b'))),
  who AS (SELECT *, coalesce(last_value(name IGNORE NULLS) OVER (PARTITION BY marker ORDER BY r ROWS UNBOUNDED PRECEDING), '') AS surname FROM kept),
  years AS (SELECT marker, doc, r, surname, y[1:4] AS year, regexp_extract_all(y[5:], '[a-z]') AS letters, i FROM (SELECT *, unnest(CASE WHEN len(ys) > 0 THEN ys ELSE [''] END) AS y, generate_subscripts(CASE WHEN len(ys) > 0 THEN ys ELSE [''] END, 1) AS i FROM who)),
  items AS (SELECT marker, doc, CAST(row_number() OVER (PARTITION BY marker ORDER BY r, i, j) - 1 AS INT) AS item, surname, year, suffix FROM (SELECT *, unnest(CASE WHEN len(letters) > 0 THEN letters ELSE [''] END) AS suffix, generate_subscripts(CASE WHEN len(letters) > 0 THEN letters ELSE [''] END, 1) AS j FROM years))
""".format(markers=inline("ay_markers"))


@query(f"WITH {_ITEMS} SELECT doc, marker, item, surname, year, suffix FROM items")
def marker_works(spark, sf_dir):
    return ordered.marker_items(relation(spark, sf_dir, "ay_markers").select("doc", "marker", "text"))


@query(rf"""WITH {_ITEMS},
e AS (SELECT doc, marker AS entry, regexp_replace(entry, '^\s*(?:\[\d+\]|\(?\d+\)?[.)])\s*', '') AS t FROM {inline("ay_markers")}),
m AS (SELECT *, regexp_extract(t, '^\s*((?:[a-z]{{1,4}}\s+){{0,3}})((?:(?:Ó|Ní|Nic|Mac)\s+)?\p{{Lu}}(?:\p{{L}}|[''’\-])+)', 1) AS p, regexp_extract(t, '^\s*((?:[a-z]{{1,4}}\s+){{0,3}})((?:(?:Ó|Ní|Nic|Mac)\s+)?\p{{Lu}}(?:\p{{L}}|[''’\-])+)', 2) AS n, regexp_extract(t, '((?:1[6-9]|20)\d{{2}})([a-z]?)\b', 1) AS year, regexp_extract(t, '((?:1[6-9]|20)\d{{2}})([a-z]?)\b', 2) AS es FROM e),
keys AS (SELECT DISTINCT doc, entry, year, es, unnest([regexp_replace({_surname("p || n")}, '[\s\-]', '', 'g'), regexp_replace({_surname("n")}, '[\s\-]', '', 'g')]) AS key FROM m),
h AS (SELECT i.doc, i.marker, i.item, k.entry, i.suffix <> '' AND i.suffix = k.es AS exact FROM items i JOIN keys k ON k.doc = i.doc AND k.year = i.year AND k.key = regexp_replace({_surname("i.surname")}, '[\s\-]', '', 'g') AND (k.es = '' OR k.es = i.suffix) WHERE i.year <> '' AND i.surname <> ''),
l AS (SELECT doc, marker, item, CASE WHEN count(DISTINCT entry) = 1 THEN min(entry) WHEN count(DISTINCT entry) FILTER (exact) = 1 THEN min(entry) FILTER (exact) END AS entry FROM h GROUP BY ALL)
SELECT i.doc, i.marker, i.item, CAST(l.entry AS VARCHAR) AS entry FROM items i LEFT JOIN l USING (doc, marker, item)""")
def link_authoryear_markers(spark, sf_dir):
    m = relation(spark, sf_dir, "ay_markers")
    return ordered.link_markers(m.select("doc", "marker", "text"), m.select("doc", F.col("marker").alias("entry"), F.col("entry").alias("text"))).select("doc", "marker", "item", F.col("entry").cast("string").alias("entry"))


# --- authors and identity


@query(f"""WITH x AS (SELECT pos, {_persons(_authors("authors"))} AS a, {_persons(_authors("rec_authors"))} AS b FROM {_METAS}), y AS (SELECT *, {_differing("a", "b")} AS d FROM x)
SELECT pos, len(d) > 0 AS mismatch, CAST(len(a) AS INT) AS cited, CAST(len(b) AS INT) AS real, array_to_string(d, ',') AS differing FROM y""")
def author_compare(spark, sf_dir):
    m = _metas(spark, sf_dir).select("pos", resolver.compare_families(F.col("authors"), F.col("rec_authors")).alias("c"))
    return m.select("pos", "c.mismatch", "c.cited", "c.real", F.array_join(F.transform("c.differing", lambda i: i.cast("string")), ",").alias("differing"))


_RECORDS = f"(SELECT d, min({{'t': rec_title, 'a': rec_authors}}) AS r FROM (SELECT {_doi('rec_doi')} AS d, rec_title, rec_authors FROM {_METAS} WHERE rec_title <> '') GROUP BY d)"


@query(f"""WITH x AS (SELECT pos AS key, doi, {_jaccard(_tokens("r.t"), _tokens("title"))} AS o, {_persons(_authors("authors"))} AS a, {_persons(_authors("r.a"))} AS b FROM {_METAS} m JOIN {_RECORDS} q ON q.d = {_doi("m.doi")})
SELECT key, doi, round(o, 6) AS overlap, coalesce(a[1] <> b[1], false) AS author_differs FROM x WHERE o < 0.3""")
def doi_identity(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    cited = m.select(F.col("pos").alias("key"), "doi", "title", verification.parse_authors(F.col("authors")).alias("authors"))
    # records keep their authors as text until one of several is chosen, as the other engine does
    records = m.where("rec_title <> ''").groupBy(F.expr(r"lower(regexp_replace(trim(rec_doi), '(?i)^https?://(dx\\.)?doi\\.org/', ''))").alias("doi")).agg(F.min(F.struct("rec_title", "rec_authors")).alias("r"))
    return verification.identity_mismatches(cited, records.select("doi", F.col("r.rec_title").alias("title"), verification.parse_authors(F.col("r.rec_authors")).alias("authors")))


@query(f"""WITH d AS (SELECT {_doi("rec_doi")} AS d, min(rec_authors) AS a FROM {_METAS} WHERE rec_authors <> '' AND pos % 2 = 0 GROUP BY 1), p AS (SELECT rec_pmid AS p, rec_authors AS a FROM {_METAS} WHERE rec_authors <> '' AND rec_pmid <> ''),
x AS (SELECT pos AS key, CASE WHEN d.a IS NOT NULL THEN 'doi' ELSE 'pmid' END AS source, {_persons(_authors("m.authors"))} AS a, {_persons(_authors("coalesce(d.a, p.a)"))} AS b FROM {_METAS} m LEFT JOIN d ON d.d = {_doi("m.doi")} LEFT JOIN p ON p.p = m.pmid WHERE m.authors <> '' AND coalesce(d.a, p.a) IS NOT NULL),
y AS (SELECT *, {_differing("a", "b")} AS df FROM x)
SELECT key, source, CAST(len(a) AS INT) AS cited, CAST(len(b) AS INT) AS real, array_to_string(df, ',') AS differing FROM y WHERE len(df) > 0""")
def author_families(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    cited = m.select(F.col("pos").alias("key"), "doi", "pmid", verification.parse_authors(F.col("authors")).alias("authors"))
    by_doi = m.where("rec_authors <> '' and pos % 2 = 0").groupBy(F.col("rec_doi").alias("doi")).agg(F.min("rec_authors").alias("a")).select("doi", F.lit("").alias("title"), verification.parse_authors(F.col("a")).alias("authors"))
    by_pmid = m.where("rec_pmid <> ''").select(F.col("rec_pmid").alias("pmid"), verification.parse_authors(F.col("rec_authors")).alias("authors"))
    found = verification.family_mismatches(cited, by_doi, by_pmid)
    return found.withColumn("differing", F.array_join(F.transform("differing", lambda i: i.cast("string")), ","))


def _aligned(mine: str, theirs: str) -> str:
    key = lambda x: f"regexp_replace({_surname(x)}, '^the ', '')"
    groups = f"list_filter({mine}, lambda q: q.l <> '')"
    return f"list_transform({theirs}, lambda z: CASE WHEN z.f <> '' AND z.g = '' AND list_contains(list_transform({groups}, lambda q: {key('q.l')}), {key('z.f')}) THEN {{'f': '', 'g': '', 'l': z.f}} ELSE z END)"


_GROUP_KEYS = lambda x: f"list_transform(list_filter({x}, lambda q: q.l <> ''), lambda q: regexp_replace({_surname('q.l')}, '^the ', ''))"


@query(f"""WITH r AS (SELECT rec_pmid AS p, {_doi("rec_doi")} AS d, rec_authors AS t FROM {_METAS} WHERE rec_pmid <> ''), one AS (SELECT d, min({{'p': p, 't': t}}) AS o FROM r GROUP BY d HAVING count(*) = 1),
x AS (SELECT m.call, m.pos, {_doi("m.doi")} AS d, nullif(m.pmid, '') AS p, {_authors("m.authors")} AS a FROM {_METAS} m),
n AS (SELECT *, d IS NOT NULL OR p IS NOT NULL AS known, sum((d IS NOT NULL OR p IS NOT NULL)::INT) OVER (PARTITION BY call ORDER BY pos) AS nth FROM x),
j AS (SELECT n.*, r.d AS rd, CASE WHEN n.p IS NOT NULL THEN r.t ELSE one.o.t END AS t, CASE WHEN n.p IS NOT NULL THEN n.p ELSE one.o.p END AS fp FROM n LEFT JOIN r ON r.p = n.p LEFT JOIN one ON one.d = n.d),
k AS (SELECT *, {_aligned("a", _authors("t"))} AS b FROM j), l AS (SELECT *, {_persons("a")} AS pa, {_persons("b")} AS pb FROM k), q AS (SELECT *, {_differing("pa", "pb")} AS df FROM l),
w AS (SELECT *, CASE WHEN NOT known THEN 'no_pmid' WHEN nth > 50 THEN 'over_cap' WHEN p IS NOT NULL AND rd <> d THEN 'pmid_doi_disagree' WHEN t IS NULL THEN 'no_pubmed_record' WHEN len(pb) = 0 THEN 'pubmed_no_authors' WHEN len(pa) = 0 THEN 'crossref_no_authors'
  WHEN len(pb) < len(pa) THEN 'pubmed_shorter' WHEN len(df) > 0 THEN 'mismatch' WHEN len(pa) < len(pb) THEN 'crossref_shorter' WHEN len(list_filter(a, lambda z: z.g <> '' AND (regexp_matches(z.f, '^[A-Z]{{2,}}$') OR regexp_matches(z.g, '^[A-Z]{{2,}}$')))) > 0 THEN 'crossref_all_caps' ELSE 'match' END AS reason FROM q),
v AS (SELECT *, reason IN ('crossref_no_authors', 'mismatch', 'crossref_shorter', 'crossref_all_caps') AS replaced, list_filter({_GROUP_KEYS("a")}, lambda g: NOT list_contains({_GROUP_KEYS("b")}, g)) AS lost FROM w)
SELECT call, pos, CASE WHEN replaced THEN 'pubmed' WHEN reason = 'match' THEN 'confirmed' ELSE 'authors_unverified' END AS status, reason,
  CASE WHEN reason IN ('no_pmid', 'over_cap', 'pmid_doi_disagree', 'no_pubmed_record') THEN p ELSE fp END AS pmid, CAST(len(a) AS INT) AS before, CAST(CASE WHEN replaced THEN len(b) + len(lost) ELSE len(a) END AS INT) AS after, CAST(CASE WHEN replaced THEN len(lost) ELSE 0 END AS INT) AS kept FROM v""")
def author_reconciliation(spark, sf_dir):
    m = _metas(spark, sf_dir)
    records = m.where("rec_pmid <> ''").select(F.col("rec_pmid").alias("pmid"), F.col("rec_doi").alias("doi"), F.col("rec_authors").alias("authors"))
    return verification.reconcile_authors(m.select("call", "pos", "doi", "pmid", "authors"), records).drop("authors").withColumn("kept", F.size("kept"))


# --- records and works


@query(f"""WITH x AS (SELECT pos AS rec, nullif(concat_ws(', ', CASE WHEN rec_authors = '' THEN 'authors' END, CASE WHEN rec_title = '' THEN 'title' END), '') AS lacks, rec_doi = '10.1234/other' AND rec_pmid = '' AS no_id, rec_doi FROM {_METAS})
SELECT rec, 'ENDNOTE-INCOMPLETE' AS "check", 'WARN' AS severity, lacks AS missing FROM x WHERE lacks IS NOT NULL UNION ALL SELECT rec, 'ENDNOTE-NO-ID', 'WARN', '' FROM x WHERE no_id
UNION ALL SELECT rec, 'ENDNOTE-RETRACTED', 'ERROR', '' FROM x WHERE rec_doi <> '10.1234/other' AND rec_doi IN (SELECT '10.1234/m.' || pos FROM {_METAS} WHERE pos % 19 = 4)""")
def record_findings(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    records = m.select(F.col("pos").alias("rec"), verification.parse_authors(F.col("rec_authors")).alias("authors"), F.col("rec_title").alias("title"), "year", F.when(F.col("rec_doi") != "10.1234/other", F.col("rec_doi")).alias("doi"), F.col("rec_pmid").alias("pmid"))
    return verification.record_findings(records, m.where("pos % 19 = 4").select("doi").withColumn("doi", F.coalesce(F.nullif("doi", F.lit("")), F.lit(""))).unionByName(m.where("pos % 19 = 4").select(F.concat(F.lit("10.1234/M."), "pos").alias("doi"))))


@query(f"""WITH e AS (SELECT {_doi("rec_doi")} AS d, trim(regexp_replace(lower(rec_title), '[^a-z0-9]+', ' ', 'g')) AS t FROM {_METAS} WHERE pos % 2 = 0)
SELECT pos AS cite, CASE WHEN {_doi("doi")} IN (SELECT d FROM e) THEN 'doi' WHEN trim(regexp_replace(lower(rec_title), '[^a-z0-9]+', ' ', 'g')) IN (SELECT t FROM e WHERE t <> '') THEN 'title' ELSE 'none' END AS matched FROM {_METAS}""")
def export_matches(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    exported = m.where("pos % 2 = 0").select(F.col("rec_doi").alias("doi"), F.col("rec_title").alias("title"))
    return verification.match_exports(m.select(F.col("pos").alias("cite"), "doi", F.col("rec_title").alias("title")), exported).select("cite", "matched")


@query(f"""SELECT call AS source, count(*) AS n, count(*) FILTER (pos % 3 = 0) AS high, count(*) FILTER (pos % 3 = 1) AS medium, count(*) FILTER (pos % 3 = 2) AS low, count(*) FILTER (pos % 4 = 0) AS to_match, count(*) FILTER (pos % 10 = 0) AS retracted, count(*) FILTER (pos % 4 <> 0 AND pos % 10 <> 0) AS to_create FROM {_METAS} GROUP BY call""")
def migration_plan(spark, sf_dir):
    k = F.col("pos")
    rows = relation(spark, sf_dir, "metas").select(F.col("call").alias("source"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("tier"), (k % 4 == 0).alias("in_library"), (k % 10 == 0).alias("retracted"))
    return verification.migration_summary(rows)


_FOREIGN = "CASE pos % 3 WHEN 0 THEN title ELSE upper(title) || '!' END"


@query(f"""WITH l AS (SELECT pos, 'K' || lpad(CAST(pos AS VARCHAR), 7, '0') AS key, title, year, {_doi("doi")} AS d, split_part(split_part(authors, ';', 1), ',', 1) AS fam FROM {_METAS} WHERE pos % 5 < 3),
c AS (SELECT pos AS cite, CASE WHEN pos % 4 = 0 THEN {_doi("doi")} END AS d, {_FOREIGN} AS t, year, split_part(split_part(authors, ';', 1), ',', 1) AS fam FROM {_METAS}),
x AS (SELECT cite, max(l.key) FILTER (l.d = c.d) AS by_doi FROM c LEFT JOIN l ON l.d = c.d GROUP BY cite), y AS (SELECT c.cite, min_by(l.key, l.pos) AS k FROM c JOIN l ON lower(trim(l.title)) = lower(trim(c.t)) GROUP BY c.cite),
z AS (SELECT c.cite, min_by(l.key, l.pos) AS k FROM c JOIN l ON trim(regexp_replace(lower(l.title), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(c.t), '[^a-z0-9]+', ' ', 'g')) AND l.year = c.year AND (c.fam = '' OR l.fam = '' OR lower(l.fam) = lower(c.fam)) GROUP BY c.cite)
SELECT c.cite, coalesce(x.by_doi, y.k, z.k) AS library_key, CASE WHEN x.by_doi IS NOT NULL THEN 'doi' WHEN y.k IS NOT NULL THEN 'title' WHEN z.k IS NOT NULL THEN 'search' END AS matched_by FROM c LEFT JOIN x USING (cite) LEFT JOIN y USING (cite) LEFT JOIN z USING (cite)""")
def foreign_matches(spark, sf_dir):
    m = relation(spark, sf_dir, "metas").withColumn("fam", F.split_part(F.split_part("authors", F.lit(";"), F.lit(1)), F.lit(","), F.lit(1)))
    lib = m.where("pos % 5 < 3").select("pos", F.concat(F.lit("K"), F.lpad(F.col("pos").cast("string"), 7, "0")).alias("key"), "title", "doi", F.lit("").alias("pmid"), F.lit("").alias("extra"), F.col("year").alias("date"), F.filter(F.array("fam"), lambda f: f != "").alias("families"))
    cited = m.select(F.col("pos").alias("cite"), F.when(F.col("pos") % 4 == 0, F.col("doi")).alias("doi"), F.lit("").alias("pmid"), F.expr(_FOREIGN).alias("title"), "year", F.col("fam").alias("author"))
    return verification.match_foreign(cited, library.build_indexes(lib), lib)


@query(f"""WITH r AS (SELECT CASE pos % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'existing' WHEN 2 THEN 'degraded' WHEN 3 THEN 'failed' ELSE 'created' END AS status, 'N' || pos AS key, CASE WHEN pos % 5 = 0 THEN {_doi("doi")} END AS d, lower(title) AS t FROM {_METAS} WHERE pos % 2 = 0),
d AS (SELECT d, max(key) AS k FROM r WHERE status = 'created' AND d IS NOT NULL GROUP BY d), t AS (SELECT t, max(key) FILTER (status = 'created') AS k2, max(key) FILTER (status = 'existing') AS k3, bool_or(status = 'degraded') AS slow, bool_or(status = 'failed') AS bad FROM r GROUP BY t)
SELECT pos AS place, coalesce(d.k, k2, k3) AS key, CASE WHEN coalesce(d.k, k2) IS NOT NULL THEN 'created' WHEN k3 IS NOT NULL THEN 'matched' WHEN slow THEN 'refused' WHEN bad THEN 'failed' ELSE 'unmapped' END AS outcome FROM {_METAS} m LEFT JOIN d ON d.d = {_doi("m.doi")} LEFT JOIN t ON t.t = lower(m.title)""")
def created_placements(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    k = F.col("pos") % 5
    status = F.when(k == 0, "created").when(k == 1, "existing").when(k == 2, "degraded").when(k == 3, "failed").otherwise("created")
    results = m.where("pos % 2 = 0").select(status.alias("status"), F.concat(F.lit("N"), "pos").alias("key"), F.when(k == 0, F.col("doi")).alias("doi"), "title")
    return verification.place_created(m.select(F.col("pos").alias("place"), "doi", "title"), results)


@query(f"""WITH b AS (SELECT DISTINCT call AS list, (row_number() OVER (PARTITION BY call ORDER BY pos) - 1) // 20 AS batch FROM {_METAS})
SELECT list, count(*) AS n_batches, count(*) FILTER ((list + batch) % 4 = 1) AS n_failed_batches, count(*) FILTER ((list + batch) % 4 = 1) > 0 AS degraded FROM b GROUP BY list""")
def request_batches(spark, sf_dir):
    m = relation(spark, sf_dir, "metas").select(F.col("call").alias("list"), "pos", F.col("pos").alias("id"))
    answered = m.select("list").distinct().select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("batch")).where("(list + batch) % 4 <> 1")
    return verification.batch_status(m, answered, 20)


@query(f"""SELECT doc, count(*) FILTER (cited % 7 = 0) = 0 AS ok FROM {inline("citations")} GROUP BY doc""")
def documents_ok(spark, sf_dir):
    c = relation(spark, sf_dir, "citations")
    return verification.report_ok(c.select("doc", F.when(F.col("cited") % 7 == 0, "ERROR").otherwise("WARN").alias("severity")), c)
