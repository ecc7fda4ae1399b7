"""All registered queries over the given tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from refloom.functions import identifiers as ident
from refloom.functions import names, rendering
from refloom.operators import documents, library, ordered, resolver, retractions
from refloom.plans import drafts, exchanges, files, manuscripts, markup, references, runs  # noqa: F401
from refloom.plans.registry import ORACLES, oracle_sql, queries, query  # noqa: F401
from refloom.plans.relations import inline, relation

def _doi(x: str) -> str:
    """The oracle's form of a normalised DOI."""
    return rf"""list_reduce(list_prepend(lower(regexp_replace(trim({x}), '(?i)^https?://(dx\.)?doi\.org/', '')), list_transform(range(12), lambda i: '')), lambda a, i: CASE
  WHEN right(a, 1) IN ('.', ',', ';', ':') OR (right(a, 1) = ')' AND length(replace(a, '(', '')) > length(replace(a, ')', ''))) OR (right(a, 1) = ']' AND length(replace(a, '[', '')) > length(replace(a, ']', '')))
  THEN a[1:length(a) - 1] ELSE a END)"""


def _array(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


_ITEM_DOI = r"coalesce(nullif(doi, ''), nullif(regexp_extract(extra, '(?im)^\s*DOI:\s*(.+)', 1), ''))"
_LIB = rf"""(SELECT pos, key, nullif({_doi(_ITEM_DOI)}, '') AS doi,
  nullif(regexp_extract(extra, '(?im)^\s*PMID:\s*(\d+)', 1), '') AS pmid, lower(trim(regexp_replace(strip_accents(title), '\s+', ' ', 'g'))) AS title_key FROM {inline("lib_items")})"""
_INDEX = f"""(SELECT 'doi' AS kind, doi AS value, max_by(key, pos) AS key FROM {_LIB} WHERE doi IS NOT NULL GROUP BY doi
  UNION ALL SELECT 'pmid', pmid, max_by(key, pos) FROM {_LIB} WHERE pmid IS NOT NULL GROUP BY pmid
  UNION ALL SELECT 'title', title_key, min_by(key, pos) FROM {_LIB} GROUP BY title_key)"""

# --- retractions

_VERDICTS = f"""
notes AS (SELECT * REPLACE ({_doi("doi")} AS doi), lower(trim(nature)) AS kind,
  CASE lower(trim(nature)) WHEN 'retraction' THEN 3 WHEN 'expression of concern' THEN 2 WHEN 'correction' THEN 1 WHEN 'reinstatement' THEN 0 ELSE -1 END AS sev,
  try_strptime(regexp_replace(trim(date), 'Z$', ''), ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y %H:%M', '%m/%d/%Y']) AS moment FROM {inline("notices")}),
won AS (SELECT doi, arg_max(nature, (sev, -pos)) AS nature, arg_max(date, (sev, -pos)) AS date, arg_max(notice_doi, (sev, -pos)) AS notice_doi, max(sev) AS sev, min_by(title, pos) AS title,
  max(moment) FILTER (kind = 'retraction') AS retracted, max(moment) FILTER (kind = 'reinstatement') AS reinstated, arg_max(date, moment) FILTER (kind = 'reinstatement' AND moment IS NOT NULL) AS reinstated_text, bool_or(kind = 'reinstatement') AS was FROM notes GROUP BY doi),
seen AS (SELECT doi, string_agg(nature, '|' ORDER BY pos) AS all_natures FROM (SELECT doi, nature, min(pos) AS pos FROM notes GROUP BY doi, nature) GROUP BY doi),
verdicts AS (SELECT doi, CASE WHEN sev = 3 AND was AND NOT coalesce(reinstated < retracted, false) THEN 'Reinstatement' ELSE nature END AS nature, all_natures,
  CASE WHEN sev = 3 AND was AND NOT coalesce(reinstated < retracted, false) THEN coalesce(reinstated_text, '') ELSE date END AS date, title, notice_doi FROM won JOIN seen USING (doi))"""


@query(f"WITH {_VERDICTS} SELECT * FROM verdicts")
def retraction_verdicts(spark, sf_dir):
    return retractions.collapse_notices(relation(spark, sf_dir, "notices")).withColumn("all_natures", F.array_join("all_natures", "|"))


@query(f"""WITH {_VERDICTS} SELECT CASE WHEN lower(trim(nature)) = 'retraction' THEN 'CITE-RETRACTED' ELSE 'CITE-CONCERN' END AS "check",
  CASE WHEN lower(trim(nature)) = 'retraction' THEN 'ERROR' ELSE 'WARN' END AS severity, count(*) AS n_citations, count(DISTINCT doc) AS n_docs
  FROM {inline("citations")} c JOIN verdicts v ON {_doi("c.doi")} = v.doi WHERE lower(trim(nature)) IN ('retraction', 'expression of concern') GROUP BY 1, 2""")
def retraction_screen(spark, sf_dir):
    found = retractions.screen(relation(spark, sf_dir, "citations"), retractions.collapse_notices(relation(spark, sf_dir, "notices")))
    return found.groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n_citations"), F.countDistinct("doc").alias("n_docs"))


@query(f"""SELECT pos, strftime(try_strptime(regexp_replace(trim(date), 'Z$', ''), ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%m/%d/%Y %H:%M', '%m/%d/%Y']), '%Y-%m-%d %H:%M:%S') AS at,
  coalesce(nullif(regexp_extract(date, '\\d{{4}}'), ''), date) AS year FROM {inline("notices")}""")
def parse_dates(spark, sf_dir):
    return relation(spark, sf_dir, "notices").select("pos", F.date_format(rendering.parse_notice_date(F.col("date")), "yyyy-MM-dd HH:mm:ss").alias("at"), rendering.year_in(F.col("date")).alias("year"))


# --- identifiers and keys


@query(f"SELECT doc, n, {_doi('doi')} AS doi FROM {inline('citations')}")
def norm_doi(spark, sf_dir):
    return relation(spark, sf_dir, "citations").select("doc", "n", ident.normalise_doi(F.col("doi")).alias("doi"))


@query(rf"""WITH x AS (SELECT ref, list_transform(regexp_extract_all(text, '(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)?(10\.\d{{4,9}}/[^\s"<>'']+)', 1), lambda d: regexp_replace(d, '[.,);:\]]+$', '')) AS d FROM {inline("refs")})
SELECT ref, {_array("list_filter(d, lambda v, i: list_position(list_transform(d, lambda q: lower(q)), lower(v)) = i)")} AS dois FROM x""")
def extract_dois(spark, sf_dir):
    return relation(spark, sf_dir, "refs").select("ref", F.array_join(ident.extract_dois(F.col("text")), "|").alias("dois"))


_PMIDS = r"regexp_extract_all(text, '(?i)(?:PubMed\s+PMID|PMID)\s*:?\s*(\d+)', 1)"


@query(rf"""WITH x AS (SELECT ref, text, regexp_extract_all(text, '(?i)PMC\d+') AS p, upper(regexp_replace(regexp_extract(text, '(?i)ISBN[-: ]*([\dX][\d\- X]{{8,17}})', 1), '[^0-9Xx]', '', 'g')) AS isbn FROM {inline("refs")})
SELECT ref, {_array(_PMIDS)} AS pmids, {_array("list_filter(p, lambda v, i: list_position(list_transform(p, lambda q: lower(q)), lower(v)) = i)")} AS pmcids,
  'PMC' || nullif(regexp_extract(upper(trim(p[1])), '^(?:PMC)?(\d+)', 1), '') AS pmcid, nullif(regexp_extract(text, '(?i)arxiv:\s*(\d{{4}}\.\d{{4,5}})', 1), '') AS arxiv,
  CASE WHEN length(isbn) IN (10, 13) THEN isbn END AS isbn FROM x""")
def extract_ids(spark, sf_dir):
    t = F.col("text")
    return relation(spark, sf_dir, "refs").select(
        "ref", F.array_join(ident.extract_pmids(t), "|").alias("pmids"), F.array_join(ident.extract_pmcids(t), "|").alias("pmcids"), ident.normalise_pmcid(F.get(ident.extract_pmcids(t), 0)).alias("pmcid"), ident.extract_arxiv(t).alias("arxiv"), ident.extract_isbn(t).alias("isbn")
    )


@query(rf"""WITH x AS (SELECT ref, text, regexp_extract_all(text, '(?i)(10\.\d{{4,9}}/[^\s"<>'']+)', 1) AS d FROM {inline("refs")})
SELECT ref, CASE WHEN len(d) > 0 THEN len(list_filter(d, lambda v: NOT (starts_with(lower(v), '10.1101/') OR starts_with(lower(v), '10.21203/') OR starts_with(lower(v), '10.2139/')))) = 0
  ELSE regexp_matches(text, '(?i)arxiv:\s*(\d{{4}}\.\d{{4,5}})') END AS preprint FROM x""")
def preprint_flag(spark, sf_dir):
    return relation(spark, sf_dir, "refs").select("ref", ident.is_preprint(F.col("text")).alias("preprint"))


@query(f"SELECT key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS fuzzy, lower(trim(regexp_replace(strip_accents(title), '\\s+', ' ', 'g'))) AS exact FROM {inline('lib_items')}")
def title_keys(spark, sf_dir):
    return relation(spark, sf_dir, "lib_items").select("key", names.fuzzy_title_key(F.col("title")).alias("fuzzy"), names.library_title_key(F.col("title")).alias("exact"))


@query(f"""SELECT ref, k AS surname, regexp_replace(k, '[\\s\\-]', '', 'g') AS compact FROM (SELECT ref, trim(regexp_replace(replace(replace(lower(strip_accents(surname)), 'ø', 'o'), 'ß', 'ss'), '[^a-z \\-]', '', 'g')) AS k FROM {inline("refs")})""")
def surname_keys(spark, sf_dir):
    return relation(spark, sf_dir, "refs").select("ref", names.surname_key(F.col("surname")).alias("surname"), names.compact_surname(F.col("surname")).alias("compact"))


_STOP = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


def _tokens(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]+')), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


@query(f"SELECT doc_id, array_to_string(list_sort({_tokens('text')}), ' ') AS tokens FROM documents")
def title_tokens(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(F.sort_array(names.title_tokens(F.col("text"))), " ").alias("tokens"))


@query(f"""WITH t AS (SELECT key, pos, {_tokens("title")} AS t FROM {inline("lib_items")})
SELECT a.key AS a, b.key AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS overlap FROM t a JOIN t b ON b.pos = a.pos + 1""")
def jaccard_pairs(spark, sf_dir):
    t = relation(spark, sf_dir, "lib_items").select("key", "pos", names.title_tokens(F.col("title")).alias("t"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, F.col("b.pos") == F.col("a.pos") + 1).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.round(names.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("overlap"))


# --- library


@query(f"SELECT * FROM {_INDEX}")
def index_build(spark, sf_dir):
    return library.build_indexes(relation(spark, sf_dir, "lib_items"))


_LOOKED = f"""looked AS (SELECT r.ref, r.doc, r.number, r.surname, r.year, r.title, r.doi, coalesce(d.key, p.key, t.key) AS library_key, CASE WHEN d.key IS NOT NULL THEN 'doi' WHEN p.key IS NOT NULL THEN 'pmid' WHEN t.key IS NOT NULL THEN 'title' END AS matched_by
  FROM {inline("refs")} r LEFT JOIN {_INDEX} d ON d.kind = 'doi' AND d.value = nullif({_doi("r.doi")}, '') LEFT JOIN {_INDEX} p ON p.kind = 'pmid' AND p.value = nullif(trim(r.pmid), '')
  LEFT JOIN {_INDEX} t ON t.kind = 'title' AND t.value = lower(trim(r.title || ' ' || replace(replace(r.journal, 'Journal of ', ''), '.', ''))))"""


def _looked(spark, sf_dir):
    refs = relation(spark, sf_dir, "refs")
    title = F.concat_ws(" ", "title", F.replace(F.replace("journal", F.lit("Journal of "), F.lit("")), F.lit("."), F.lit("")))
    return library.lookup(refs, library.build_indexes(relation(spark, sf_dir, "lib_items")), F.col("doi"), F.col("pmid"), title)


@query(f"WITH {_LOOKED} SELECT ref, library_key, matched_by FROM looked")
def presence_lookup(spark, sf_dir):
    return _looked(spark, sf_dir).select("ref", "library_key", "matched_by")


@query(f"""WITH {_LOOKED} SELECT doc, count(*) AS n, count(library_key) AS in_library, count(*) - count(library_key) AS missing, count(*) FILTER (matched_by = 'title') AS by_title FROM looked GROUP BY doc""")
def plan_summary(spark, sf_dir):
    return _looked(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count("library_key").alias("in_library"), (F.count(F.lit(1)) - F.count("library_key")).alias("missing"), F.count_if(F.col("matched_by") == "title").alias("by_title"))


@query(f"""WITH c AS (SELECT doc * 100 + n AS pos, CASE WHEN cited % 3 = 0 THEN doi END AS doi, CASE WHEN cited % 3 = 1 THEN CAST(10000000 + cited AS VARCHAR) END AS pmid, 'work ' || cited % 500 AS title FROM {inline("citations")}),
f AS (SELECT c.*, coalesce(d.key, p.key, t.key) AS library_key, coalesce('doi:' || nullif({_doi("c.doi")}, ''), 'pmid:' || c.pmid, 'title:' || lower(c.title)) AS identity FROM c
  LEFT JOIN {_INDEX} d ON d.kind = 'doi' AND d.value = nullif({_doi("c.doi")}, '') LEFT JOIN {_INDEX} p ON p.kind = 'pmid' AND p.value = c.pmid LEFT JOIN {_INDEX} t ON t.kind = 'title' AND t.value = lower(c.title))
SELECT pos, identity, CASE WHEN library_key IS NOT NULL THEN 'skipped' WHEN min(pos) OVER (PARTITION BY identity) < pos THEN 'repeated' ELSE 'created' END AS outcome FROM f""")
def create_dedup(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").select((F.col("doc") * 100 + F.col("n")).alias("pos"), F.when(F.col("cited") % 3 == 0, F.col("doi")).alias("doi"), F.when(F.col("cited") % 3 == 1, (F.col("cited") + 10000000).cast("string")).alias("pmid"), F.concat(F.lit("work "), F.col("cited") % 500).alias("title"))
    return library.gate_creation(c, library.build_indexes(relation(spark, sf_dir, "lib_items"))).select("pos", "identity", "outcome")


@query(f"""WITH cited AS (SELECT DISTINCT doc, cited AS key FROM {inline("citations")} WHERE n <= 3), custom AS (SELECT DISTINCT doc, cited + 1 AS key FROM {inline("citations")} WHERE n = 1 AND doc % 2 = 0),
omitted AS (SELECT doc, cited AS key FROM {inline("citations")} WHERE n = 2 AND doc % 5 = 0), listed AS (SELECT DISTINCT doc, cited AS key FROM {inline("citations")} WHERE n >= 2),
e AS (SELECT * FROM (SELECT * FROM cited UNION SELECT * FROM custom) x ANTI JOIN omitted o USING (doc, key))
SELECT doc, key, CASE WHEN l.key IS NULL THEN 'orphan' WHEN e.key IS NULL THEN 'uncited' ELSE 'ok' END AS status FROM e FULL JOIN listed l USING (doc, key)""")
def reconcile_keys(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").withColumn("key", F.col("cited"))
    return library.reconcile(c.where("n <= 3"), c.where("n = 1 and doc % 2 = 0").withColumn("key", F.col("key") + 1), c.where("n = 2 and doc % 5 = 0"), c.where("n >= 2"))


@query("""WITH l AS (SELECT key, max(version) AS version FROM (SELECT event_id AS version, user_id AS key FROM events) GROUP BY key)
SELECT user_id AS key, event_id AS version, event_type || ':' || event_id AS payload FROM events JOIN l ON l.key = user_id AND l.version = event_id WHERE event_type <> 'error'""")
def delta_merge_latest(spark, sf_dir):
    return library.merge_changes(relation(spark, sf_dir, "changelog"))


@query("""WITH c AS (SELECT user_id AS key, event_type, event_id FROM events WHERE event_id >= 500), gone AS (SELECT DISTINCT key FROM c WHERE event_type = 'error'), got AS (SELECT DISTINCT key FROM c WHERE event_type <> 'error' AND event_id % 7 <> 0)
SELECT count(DISTINCT key) AS changed, count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM got) AND key NOT IN (SELECT key FROM gone)) AS lacking FROM c""")
def changelog_completeness(spark, sf_dir):
    c = relation(spark, sf_dir, "changelog").where("version >= 500")
    by = c.groupBy("key").agg(F.max((F.col("op") == "delete") | (F.col("version") % 7 != 0)).alias("known"))
    return by.agg(F.count(F.lit(1)).alias("changed"), F.count_if(~F.col("known")).alias("lacking"))


@query(f"""SELECT c.doc, c.n, CASE WHEN i.key IS NOT NULL THEN 'ok' WHEN cited % 10 = 9 THEN 'external' WHEN cited % 10 = 8 THEN 'unverified' ELSE 'broken' END AS link
FROM {inline("citations")} c LEFT JOIN {inline("lib_items")} i ON i.key = 'K' || lpad(CAST(c.cited * 2 AS VARCHAR), 7, '0') AND c.cited % 10 < 8""")
def check_links(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").withColumn("where", F.when(F.col("cited") % 10 == 9, "other").when(F.col("cited") % 10 == 8, "unknown").otherwise("own")).withColumn("key", F.concat(F.lit("K"), F.lpad((F.col("cited") * 2).cast("string"), 7, "0")))
    return resolver.link_status(c, relation(spark, sf_dir, "lib_items").select("key")).select("doc", "n", "link")


# --- resolver


# all references against all titles that share a token
_CANDIDATES = f"""w AS (SELECT list_sort({_tokens("title")}) AS t, list_slice(list_sort(list(pos)), 1, 5) AS firsts FROM {inline("lib_items")} GROUP BY 1), r AS (SELECT ref, list_sort({_tokens("text")}) AS tt FROM {inline("refs")}),
f AS (SELECT DISTINCT tt FROM r),
scored AS (SELECT tt, firsts, round(len(list_intersect(t, tt)) / len(list_distinct(list_concat(t, tt))), 6) AS score FROM f JOIN w ON list_has_any(t, tt)),
best AS (SELECT *, row_number() OVER (PARTITION BY tt ORDER BY score DESC, work) AS rank FROM (SELECT tt, score, unnest(firsts) AS work FROM scored)),
ranked AS (SELECT ref, work, score, rank FROM r JOIN best USING (tt) WHERE rank <= 5)"""


def _ranked(spark, sf_dir, n: int):
    refs = relation(spark, sf_dir, "refs").select("ref", names.title_tokens(F.col("text")).alias("tokens"))
    works = relation(spark, sf_dir, "lib_items").select(F.col("pos").alias("work"), names.title_tokens(F.col("title")).alias("tokens"))
    return resolver.rank_candidates(refs, works, n)


@query(f"WITH {_CANDIDATES} SELECT ref, work, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def top5_candidates(spark, sf_dir):
    return _ranked(spark, sf_dir, 5)


@query(f"""WITH {_CANDIDATES}, top AS (SELECT ref, work, score, lead(score) OVER (PARTITION BY ref ORDER BY rank) AS second, rank FROM ranked)
SELECT t.ref, t.work, CASE WHEN score >= 0.55 AND year_ok AND author_ok AND (second IS NULL OR (score - second) / score >= 0.1) THEN 'high' WHEN score >= 0.55 OR (score >= 0.3)::INT + year_ok::INT + author_ok::INT >= 2 THEN 'medium' ELSE 'low' END AS confidence
FROM top t JOIN (SELECT ref, contains(text, CAST(1990 + ref % 30 AS VARCHAR)) AS year_ok, ref % 3 <> 0 AS author_ok FROM {inline("refs")}) y USING (ref) WHERE rank = 1""")
def resolve_confidence(spark, sf_dir):
    found = resolver.top_candidates(_ranked(spark, sf_dir, 5))
    refs = relation(spark, sf_dir, "refs").select("ref", F.contains("text", (F.lit(1990) + F.col("ref") % 30).cast("string")).alias("year_ok"), (F.col("ref") % 3 != 0).alias("author_ok"))
    return found.join(refs, "ref").select("ref", "work", resolver.confidence(F.col("score"), F.col("second"), F.col("author_ok"), F.col("year_ok")).alias("confidence"))


# --- ordered text

_PARA = inline("paragraphs")


@query(f"""WITH x AS (SELECT *, sum(CASE WHEN is_ref THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY para) AS gap FROM {_PARA}), r AS (SELECT doc, gap, min(para) AS start, count(*) AS length FROM x WHERE is_ref GROUP BY doc, gap HAVING count(*) >= 3)
SELECT doc, max(start) AS start, arg_max(length, start) AS length FROM r GROUP BY doc""")
def ref_runs_last(spark, sf_dir):
    return ordered.last_run(relation(spark, sf_dir, "paragraphs"))


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY para) AS k FROM {_PARA}),
s AS (SELECT doc, k, para, is_ref AS accepted, CASE WHEN is_ref THEN number END AS last FROM p WHERE k = 1
  UNION ALL SELECT p.doc, p.k, p.para, p.is_ref OR coalesce(p.filler_ok AND p.number = s.last + 1, false), CASE WHEN p.is_ref OR coalesce(p.filler_ok AND p.number = s.last + 1, false) THEN p.number ELSE s.last END FROM s JOIN p ON p.doc = s.doc AND p.k = s.k + 1)
SELECT doc, para, accepted FROM s""")
def numbered_filler(spark, sf_dir):
    return ordered.bridge_fillers(relation(spark, sf_dir, "paragraphs"))


@query(f"""SELECT doc, heading, para AS start, coalesce(lead(para) OVER (PARTITION BY doc ORDER BY para), stop) AS stop FROM {_PARA} JOIN (SELECT doc, max(para) + 1 AS stop FROM {_PARA} GROUP BY doc) USING (doc) WHERE heading IS NOT NULL""")
def section_spans(spark, sf_dir):
    return ordered.section_spans(relation(spark, sf_dir, "paragraphs"))


@query(f"""WITH m AS (SELECT doc, pos, number, coalesce(number <> lag(number) OVER w + 1 OR boundary, true) AS broken FROM {inline("markers")} WINDOW w AS (PARTITION BY doc ORDER BY pos)),
r AS (SELECT *, sum(CASE WHEN broken THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM m), f AS (SELECT doc, min(run) AS run FROM (SELECT doc, run FROM r GROUP BY doc, run HAVING min(number) = 1 AND count(*) >= 2) GROUP BY doc)
SELECT r.doc, pos, number FROM r JOIN f USING (doc, run)""")
def enumerator_suppress(spark, sf_dir):
    return ordered.enumerator_run(relation(spark, sf_dir, "markers"))


_NUMBERS = f"""(SELECT doc, pos, list_doc, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(marker, '[^0-9,\\-]', '', 'g'), ','), lambda p: p <> ''), lambda p: CASE
  WHEN NOT contains(p, '-') THEN [CAST(p AS INT)] WHEN CAST(split_part(p, '-', 2) AS INT) >= CAST(split_part(p, '-', 1) AS INT) AND CAST(split_part(p, '-', 2) AS INT) - CAST(split_part(p, '-', 1) AS INT) <= 100
  THEN range(CAST(split_part(p, '-', 1) AS INT), CAST(split_part(p, '-', 2) AS INT) + 1)::INT[] ELSE [CAST(split_part(p, '-', 1) AS INT), CAST(split_part(p, '-', 2) AS INT)] END))) AS v FROM {inline("markers")})"""


@query(f"SELECT doc, pos, array_to_string(list_sort(v), ',') AS numbers FROM {_NUMBERS}")
def range_expand(spark, sf_dir):
    return relation(spark, sf_dir, "markers").select("doc", "pos", F.array_join(F.sort_array(rendering.marker_numbers(F.col("marker"))), ",").alias("numbers"))


@query(f"""SELECT list_doc AS doc, n.doc * 100 + pos AS marker, number, entry FROM (SELECT list_doc, doc, pos, unnest(v) AS number FROM {_NUMBERS}) n JOIN (SELECT doc AS d, number, min(ref) AS entry FROM {inline("refs")} GROUP BY 1, 2) e ON e.d = n.list_doc AND e.number = n.number""".replace("AS marker, number,", "AS marker, n.number AS number,"))
def intext_link_numeric(spark, sf_dir):
    m = relation(spark, sf_dir, "markers").select(F.col("list_doc").alias("doc"), (F.col("doc") * 100 + F.col("pos")).alias("marker"), F.explode(rendering.marker_numbers(F.col("marker"))).alias("number"))
    return ordered.link_numeric(m, relation(spark, sf_dir, "refs").select("doc", F.col("ref").alias("entry"), "number")).select("doc", "marker", "number", "entry")


@query(f"""WITH e AS (SELECT ref AS entry, doc, surname, CAST(2000 + ref % 4 AS VARCHAR) AS year, suffix FROM {inline("refs")}), i AS (SELECT ref AS item, doc, surname, CAST(2000 + ref % 4 AS VARCHAR) AS year, CASE WHEN ref % 2 = 0 THEN suffix END AS suffix FROM {inline("refs")}),
h AS (SELECT i.doc, item, entry, i.suffix IS NOT DISTINCT FROM e.suffix AS exact FROM i JOIN e ON i.doc = e.doc AND i.surname = e.surname AND i.year = e.year WHERE i.suffix IS NULL OR e.suffix IS NULL OR i.suffix = e.suffix)
SELECT doc, item, CASE WHEN count(*) = 1 THEN min(entry) ELSE min(entry) FILTER (exact) END AS entry FROM h GROUP BY doc, item HAVING count(*) = 1 OR count(*) FILTER (exact) = 1""")
def intext_link_authoryear(spark, sf_dir):
    r = relation(spark, sf_dir, "refs").withColumn("year", (F.lit(2000) + F.col("ref") % 4).cast("string"))
    items = r.select(F.col("ref").alias("item"), "doc", "surname", "year", F.when(F.col("ref") % 2 == 0, F.col("suffix")).alias("suffix"))
    return ordered.link_author_year(items, r.select(F.col("ref").alias("entry"), "doc", "surname", "year", "suffix"))


@query(f"SELECT doc, count(*) AS n, count(*) FILTER (NOT regexp_matches(text, '^\\d+\\.')) AS off FROM {inline('refs')} GROUP BY doc HAVING count(*) >= 3 AND count(*) FILTER (NOT regexp_matches(text, '^\\d+\\.')) >= count(*) * 0.1")
def refstyle_numbering(spark, sf_dir):
    return ordered.numbering_disagreement(relation(spark, sf_dir, "refs").select("doc", F.col("text").rlike(r"^\d+\.").alias("has_number")), True, share=0.1)


@query(f"SELECT doc, count(*) AS n, count(*) FILTER (contains(lower(text), '10.1234/')) AS with_doi FROM {inline('refs')} GROUP BY doc HAVING count(*) >= 10 AND count(*) FILTER (contains(lower(text), '10.1234/')) < count(*) * 0.25")
def refstyle_doi_coverage(spark, sf_dir):
    return ordered.doi_coverage(relation(spark, sf_dir, "refs").select("doc", F.exists(ident.extract_dois(F.col("text")), lambda d: F.lower(d).startswith("10.1234/")).alias("has_doi")), share=0.25)


# --- rendering

_AUTHORS = "list_slice([surname || ' AB', 'Other CD', 'Third E', 'Fourth FG', 'Fifth H', 'Sixth I', 'Seventh JK', 'Eighth L'], 1, ref % 9)"


def _with_authors(spark, sf_dir):
    rest = [F.lit(a) for a in ("Other CD", "Third E", "Fourth FG", "Fifth H", "Sixth I", "Seventh JK", "Eighth L")]
    return relation(spark, sf_dir, "refs").withColumn("authors", F.slice(F.array(F.concat("surname", F.lit(" AB")), *rest), F.lit(1), (F.col("ref") % 9).cast("int")))


def _dot(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({x}, '[.?!]$') THEN {x} ELSE {x} || '.' END"


@query(f"""WITH x AS (SELECT *, nullif(array_to_string({_AUTHORS}[1:6], ', ') || CASE WHEN ref % 9 > 6 THEN ', et al' ELSE '' END, '') AS a, volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END AS vi FROM {inline("refs")}),
y AS (SELECT *, vi || CASE WHEN pages = '' THEN '' WHEN vi <> '' THEN ':' || pages ELSE pages END AS loc FROM x)
SELECT ref, concat_ws(' ', {_dot("a")}, {_dot("title")}, {_dot("journal")}, concat_ws(';', year, nullif(loc, '')) || '.', 'doi: ' || nullif(doi, '') || '.', 'PMID: ' || nullif(pmid, '') || '.') AS reference FROM y""")
def format_vancouver(spark, sf_dir):
    c = F.col
    return _with_authors(spark, sf_dir).select("ref", rendering.vancouver(c("authors"), c("title"), c("journal"), c("year"), c("volume"), c("issue"), c("pages"), c("pmid"), c("doi")).alias("reference"))


_STYLE = "CASE WHEN substr(md5(CAST(ref AS STRING)), 1, 1) < '6' THEN 'author_year' ELSE 'vancouver' END"
_JOURNAL_STYLE = "CASE WHEN substr(md5(CAST(ref AS STRING)), 2, 1) < '5' THEN 'three' WHEN substr(md5(CAST(ref AS STRING)), 2, 1) < '8' THEN 'one' ELSE 'none' END"


@query(f"""WITH s AS (SELECT *, {_STYLE} AS style, CASE {_JOURNAL_STYLE} WHEN 'three' THEN 3 WHEN 'one' THEN 1 ELSE 6 END AS most, ref % 9 AS n FROM {inline("refs")}),
x AS (SELECT *, CASE WHEN style = 'vancouver' THEN most ELSE 6 END AS k, volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END AS vi FROM s),
y AS (SELECT *, vi || CASE WHEN pages = '' THEN '' WHEN vi <> '' THEN ':' || pages ELSE pages END AS loc, nullif(array_to_string({_AUTHORS}[1:k], ', ') || CASE WHEN n > k THEN ', et al' ELSE '' END, '') AS a FROM x)
SELECT ref, CASE style WHEN 'vancouver' THEN concat_ws(' ', {_dot("a")}, {_dot("title")}, {_dot("journal")}, concat_ws(';', year, nullif(loc, '')) || '.', 'doi: ' || nullif(doi, '') || '.', 'PMID: ' || nullif(pmid, '') || '.')
  ELSE concat_ws(' ', coalesce(a, 'Anon') || ' (' || year || ').', {_dot("title")}, {_dot("nullif(concat_ws(', ', regexp_replace(journal, '\\.$', ''), nullif(loc, '')), '')")}, 'doi: ' || nullif(doi, '') || '.') END AS reference FROM y""")
def styled_references(spark, sf_dir):
    rows = _with_authors(spark, sf_dir)
    fields = [F.col(c) for c in ("authors", "title", "journal", "year", "volume", "issue", "pages", "pmid", "doi")]
    return rows.select("ref", rendering.format_reference(F.expr(_STYLE), *fields, F.expr(_JOURNAL_STYLE), {"three": 3, "one": 1}).alias("reference"))


@query(f"""SELECT ref, '(' || CASE ref % 9 WHEN 0 THEN 'Anon' WHEN 1 THEN surname WHEN 2 THEN surname || ' & Other' ELSE surname || ' et al.' END || ', ' || year || ')' AS marker FROM {inline("refs")}""")
def intext_markers(spark, sf_dir):
    return _with_authors(spark, sf_dir).select("ref", rendering.marker_author_year(F.col("authors"), F.col("year")).alias("marker"))


@query(f"""SELECT doc, ref, row_number() OVER (PARTITION BY doc ORDER BY trim(regexp_replace(replace(lower(strip_accents(surname)), 'ø', 'o'), '[^a-z \\-]', '', 'g')), year, ref) AS place FROM {inline("refs")}""")
def bibliography_order(spark, sf_dir):
    r = relation(spark, sf_dir, "refs").withColumn("k", names.surname_key(F.col("surname")))
    return r.select("doc", "ref", F.row_number().over(Window.partitionBy("doc").orderBy("k", "year", "ref")).cast("long").alias("place"))


@query("""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\p{Z}]+'), lambda w: w <> '')) AS INT) AS words, CAST(length(text) AS INT) AS chars, CAST(length(translate(text, ' ' || chr(10) || chr(9), '')) AS INT) AS dense FROM documents""")
def view_counts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", rendering.word_count(F.col("text")).alias("words"), F.length("text").alias("chars"), rendering.chars_without_spaces(F.col("text")).alias("dense"))


@query(f"""WITH x AS (SELECT *, coalesce(nullif(array_to_string({_AUTHORS}[1:6], ', ') || CASE WHEN ref % 9 > 6 THEN ', et al' ELSE '' END, ''), 'Anon') AS a, volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END AS vi FROM {inline("refs")}),
y AS (SELECT *, vi || CASE WHEN pages = '' THEN '' WHEN vi <> '' THEN ':' || pages ELSE pages END AS loc FROM x), z AS (SELECT *, concat_ws(', ', regexp_replace(journal, '\\.$', ''), nullif(loc, '')) AS place FROM y)
SELECT ref, concat_ws(' ', a || ' (' || year || ').', {_dot("title")}, {_dot("place")}, 'doi: ' || nullif(doi, '') || '.') AS reference FROM z""")
def format_author_year(spark, sf_dir):
    c = F.col
    return _with_authors(spark, sf_dir).select("ref", rendering.author_year(c("authors"), c("title"), c("journal"), c("year"), c("volume"), c("issue"), c("pages"), c("doi")).alias("reference"))


@query("SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain, url FROM pages")
def strip_markup(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.trim(rendering.strip_tags(F.col("html"))).alias("plain"), "url")


@query("""SELECT page_id, sha256('GET' || chr(10) || url || chr(10) || 'text/html') AS key FROM pages""")
def cache_keys(spark, sf_dir):
    bare, rest = F.regexp_extract("url", "^([^#]*)(.*)$", 1), F.regexp_extract("url", "^([^#]*)(.*)$", 2)
    url = F.concat(bare, F.when(F.contains(bare, F.lit("?")), F.lit("&api_key=s3cret")).otherwise(F.lit("?api_key=s3cret")), rest)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", rendering.cache_key(url, F.lit("text/html")).alias("key"))


_INSTRUCTION = "CASE cited % 6 WHEN 0 THEN 'ADDIN ZOTERO_ITEM CSL_CITATION {}' WHEN 1 THEN ' ADDIN CSL_CITATION {}' WHEN 2 THEN 'ADDIN EN.CITE x' WHEN 3 THEN 'CITATION Abc20 \\\\l 1033' WHEN 4 THEN 'PAGEREF CITATION' ELSE 'Mendeley Citation' END"


@query(f"""SELECT doc, count(*) FILTER (cited % 6 = 0) AS zotero, count(*) FILTER (cited % 6 IN (1, 5)) AS mendeley, count(*) FILTER (cited % 6 = 2) AS endnote, count(*) FILTER (cited % 6 = 3) AS word FROM {inline("citations")} GROUP BY doc""")
def manager_counts(spark, sf_dir):
    return documents.manager_counts(relation(spark, sf_dir, "citations").select("doc", F.expr(_INSTRUCTION).alias("instruction")))


@query(f"""WITH {_VERDICTS}, f AS (
  SELECT c.doc, CASE WHEN lower(trim(nature)) = 'retraction' THEN 'CITE-RETRACTED' ELSE 'CITE-CONCERN' END AS "check", CASE WHEN lower(trim(nature)) = 'retraction' THEN 'ERROR' ELSE 'WARN' END AS severity FROM {inline("citations")} c JOIN verdicts v ON {_doi("c.doi")} = v.doi WHERE lower(trim(nature)) IN ('retraction', 'expression of concern')
  UNION ALL SELECT doc, 'CITE-ORPHAN', 'ERROR' FROM {inline("citations")} WHERE cited % 50 = 0 UNION ALL SELECT doc, 'CITE-FOREIGN', 'WARN' FROM {inline("citations")} WHERE cited % 6 = 2)
SELECT doc, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARN') AS warnings, count(DISTINCT "check") AS kinds FROM f GROUP BY doc""")
def citecheck_findings(spark, sf_dir):
    c = relation(spark, sf_dir, "citations")
    found = retractions.screen(c, retractions.collapse_notices(relation(spark, sf_dir, "notices"))).select("doc", "check", "severity")
    found = found.unionByName(c.where("cited % 50 = 0").select("doc", F.lit("CITE-ORPHAN").alias("check"), F.lit("ERROR").alias("severity")))
    foreign = c.withColumn("m", documents.manager(F.expr(_INSTRUCTION))).where("m = 'endnote'").select("doc", F.lit("CITE-FOREIGN").alias("check"), F.lit("WARN").alias("severity"))
    return found.unionByName(foreign).groupBy("doc").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"), F.countDistinct("check").alias("kinds"))


_RAW_ID = "CASE cited % 5 WHEN 0 THEN 'PMID: ' || CAST(cited AS STRING) WHEN 1 THEN CAST(cited AS STRING) WHEN 2 THEN 'K' || lpad(CAST(cited AS STRING), 7, '0') WHEN 3 THEN doi ELSE 'none of these' END"


@query(f"SELECT doc, n, CASE cited % 5 WHEN 0 THEN 'pmid' WHEN 1 THEN 'pmid' WHEN 2 THEN 'key' WHEN 3 THEN CASE WHEN regexp_matches({_doi('doi')}, '^10\\.\\d{{4,9}}/\\S+$') THEN 'doi' END END AS kind FROM {inline('citations')}")
def identifier_kinds(spark, sf_dir):
    return relation(spark, sf_dir, "citations").select("doc", "n", ident.identifier_kind(F.expr(_RAW_ID)).alias("kind"))


@query("""SELECT p_partkey, slug, regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') AND length(slug) >= 3 AND regexp_matches(slug, '[a-z]') AND len(list_filter(string_split(slug, '-'), lambda w: length(w) >= 3)) > 0 AS plausible
  FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_name, ' ', '-')) WHEN 1 THEN p_name WHEN 2 THEN CAST(p_partkey AS VARCHAR) ELSE 'a-' || CAST(p_size AS VARCHAR) END AS slug FROM part)""")
def plausible_slugs(spark, sf_dir):
    slug = F.expr("CASE p_partkey % 4 WHEN 0 THEN lower(replace(p_name, ' ', '-')) WHEN 1 THEN p_name WHEN 2 THEN CAST(p_partkey AS STRING) ELSE 'a-' || CAST(p_size AS STRING) END")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", slug.alias("slug")).withColumn("plausible", ident.is_plausible_slug(F.col("slug")))


@query("""SELECT conv_id, turn, role, CASE WHEN length(x) > 140 THEN x[1:140] || '…' ELSE x END AS excerpt FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM conversations)""")
def excerpts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", rendering.excerpt(F.col("text")).alias("excerpt"))


_HEADING = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) || ') ' || p_name WHEN 1 THEN CAST(p_partkey AS STRING) || '. ' || p_name WHEN 2 THEN '  1.02.' || CAST(p_size AS STRING) WHEN 3 THEN CAST(p_size AS STRING) || 'a ' || p_name ELSE p_name END"


@query(f"""WITH x AS (SELECT p_partkey, string_split(nullif(regexp_extract({_HEADING}, '^\\s*(\\d+(?:\\.\\d+)*)[.)]?(?:\\s|$)', 1), ''), '.') AS p FROM part)
SELECT p_partkey, CASE WHEN len(p) > 1 OR CAST(p[1] AS INT) <= 99 THEN array_to_string(list_transform(p, lambda v: CAST(v AS INT)), '.') END AS number FROM x""")
def heading_numbers(spark, sf_dir):
    text = F.expr(_HEADING)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_join(rendering.heading_number(text), ".").alias("number"))


@query(f"""SELECT a.doc, a.place, a.key, i.title FROM (SELECT doc, n AS place, 'K' || lpad(CAST(cited * 3 % 5000 AS VARCHAR), 7, '0') AS key FROM {inline("citations")}) a LEFT JOIN {inline("lib_items")} i ON i.key = a.key""")
def reorder_by_keys(spark, sf_dir):
    asked = relation(spark, sf_dir, "citations").select("doc", F.col("n").alias("place"), F.concat(F.lit("K"), F.lpad((F.col("cited") * 3 % 5000).cast("string"), 7, "0")).alias("key"))
    return library.reorder(asked, relation(spark, sf_dir, "lib_items").select("key", "title")).select("doc", "place", "key", "title")


@query(f"""WITH f AS (SELECT ref, CASE WHEN doi <> '' THEN 'doi:' || {_doi("doi")} ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || year || '|' || surname END AS k FROM {inline("refs")}),
seen AS (SELECT DISTINCT k FROM f WHERE ref % 4 = 1)
SELECT ref, k AS cited_key FROM f WHERE ref % 4 <> 1 AND k NOT IN (SELECT k FROM seen)""")
def already_cited_anti(spark, sf_dir):
    r = relation(spark, sf_dir, "refs")
    keyed = r.select("ref", library.cited_key(F.col("doi"), F.col("title"), F.col("year"), F.col("surname")).alias("cited_key"))
    return library.not_yet_cited(keyed.where("ref % 4 <> 1"), keyed.where("ref % 4 = 1"))


_META = f"""SELECT ref, doc, substr(md5(CAST(ref AS STRING)), 1, 1) < '6' AS live, CASE WHEN substr(md5(CAST(ref AS STRING)), 2, 1) < '7' THEN '' ELSE doi END AS doi, CASE WHEN ref % 3 = 0 THEN 'Work ' ELSE 'work: ' END || CAST(ref % 90 AS STRING) AS title,
  CASE WHEN substr(md5(CAST(ref AS STRING)), 3, 1) < '5' THEN '' ELSE year END AS year, CASE WHEN substr(md5(CAST(ref AS STRING)), 3, 1) < '5' THEN '' ELSE surname END AS author FROM {{refs}}"""


@query(f"""WITH m AS ({_META.replace("{refs}", inline("refs"))}), k AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, CASE WHEN doi <> '' THEN 'doi:' || {_doi("doi")} ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || year || '|' || lower(author) END AS key FROM m)
SELECT ref FROM k WHERE NOT live AND key NOT IN (SELECT key FROM k WHERE live) AND NOT (doi = '' AND t IN (SELECT t FROM k WHERE live))""")
def already_cited_titles(spark, sf_dir):
    works = spark.sql(_META, refs=relation(spark, sf_dir, "refs"))
    return library.not_yet_cited_works(works.where("not live"), works.where("live")).select("ref")


@query(f"""WITH f AS (SELECT doc, ref, CASE WHEN ref % 8 < 3 THEN 'high' WHEN ref % 8 < 5 THEN 'medium' WHEN ref % 8 = 5 THEN 'low' ELSE 'none' END AS confidence FROM {inline("refs")})
SELECT doc, count(*) FILTER (confidence = 'high') AS auto, count(*) FILTER (confidence = 'medium') AS medium, count(*) FILTER (confidence IN ('low', 'none')) AS low FROM f GROUP BY doc""")
def tier_summary(spark, sf_dir):
    k = F.col("ref") % 8
    c = F.when(k < 3, "high").when(k < 5, "medium").when(k == 5, "low").otherwise("none")
    r = relation(spark, sf_dir, "refs").select("doc", resolver.tier(c).alias("tier"))
    return r.groupBy("doc").agg(F.count_if(F.col("tier") == "high").alias("auto"), F.count_if(F.col("tier") == "medium").alias("medium"), F.count_if(F.col("tier") == "low").alias("low"))


# these use the forms above
from refloom.plans import unify, works  # noqa: E402, F401
