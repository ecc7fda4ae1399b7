"""Queries over rendered citations and over what services answer and caches keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.functions import citations, rendered
from refloom.operators import ordered, services
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

_METAS = inline("metas")
_PART = "part"


def _part(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


# --- rendered citations

_RENDER = "CASE k % 7 WHEN 0 THEN '(<i>' || f1 || '</i> et al., ' || year || ')' WHEN 1 THEN '(Ó ' || f2 || ', ' || year || 'a)' WHEN 2 THEN '(' || f1 || ' &amp; Lee, n.d.)' WHEN 3 THEN '<span>(éa ' || f2 || ' in press)</span>' WHEN 4 THEN '(' || f2 || ', ' || year || ')' WHEN 5 THEN '(' || f2 || ', ' || year || 'b)' ELSE CASE WHEN call % 2 = 0 THEN '(12)' ELSE '(' || f1 || ' 1999)' END END"
_RENDERED = f"(SELECT pos, call, floor(pos / 3) AS grp, pos % 3 AS j, pos % 5 = 2 AS year_only, {_RENDER} AS html FROM (SELECT *, floor(pos / 2) AS k, split_part(title, ' ', 1) AS f1, split_part(title, ' ', 3) AS f2 FROM {{}}))"
_FOLD = "lower(regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g'))"


@query(rf"""WITH r AS (SELECT *, trim(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&')) AS t FROM {_RENDERED.format(_METAS)}),
i AS (SELECT *, t[2:length(t) - 1] AS inner_text, replace(regexp_replace(html, '\((.*)\)', '\1'), '()', '') AS inner_html, CASE WHEN contains(t, ',') THEN trim(regexp_extract(t[2:length(t) - 1], '([^,]*)$', 1)) ELSE regexp_extract(t[2:length(t) - 1], '(\S*)$', 1) END AS tail FROM r),
f AS (SELECT *, '(?i)\b\d{{4}}[a-z]?\b|\bn\.\s?d\.|\bin press\b' AS p FROM i),
x AS (SELECT grp, j, CASE WHEN regexp_matches(inner_text, '\p{{L}}') AND regexp_matches(inner_text, p) AND (NOT year_only OR regexp_matches(tail, p)) THEN CASE WHEN year_only THEN tail ELSE inner_html END END AS h, CASE WHEN year_only THEN tail ELSE inner_text END AS key FROM f)
SELECT CAST(grp AS BIGINT) AS grp, CASE WHEN count(h) = count(*) THEN '(' || string_agg(h, '; ' ORDER BY {_FOLD.format("key")}, j) || ')' ELSE '(citation)' END AS citation FROM x GROUP BY grp""")
def grouped_citations(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    rows = m.selectExpr("*", "floor(pos / 2) AS k", "split_part(title, ' ', 1) AS f1", "split_part(title, ' ', 3) AS f2").selectExpr("floor(pos / 3) AS grp", "pos % 3 AS j", "pos % 5 = 2 AS year_only", f"{_RENDER} AS html")
    items = rows.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("j", "html", "year_only"))).alias("items"))
    return items.select("grp", rendered.shown_citation(F.col("items")).alias("citation"))


_ENTRY = "CASE pos % 3 WHEN 0 THEN '<div class=\"csl-bib-body\"><div class=\"csl-entry\">' || CASE WHEN call % 2 = 0 THEN '<div class=\"csl-left-margin\">' || pos || '.</div> <div class=\"csl-right-inline\">' ELSE '<div>' END || 'Ö' || title || '.</div></div></div>' WHEN 1 THEN CASE WHEN call % 2 = 0 THEN '[' || pos || '] ' ELSE '' END || title || ' <i>J</i>' WHEN 2 THEN '<div> </div>' END"


@query(rf"""WITH e AS (SELECT call, pos, CASE pos % 3 WHEN 0 THEN CASE WHEN call % 2 = 0 THEN pos || '. ' ELSE '' END || 'Ö' || title || '.' WHEN 1 THEN CASE WHEN call % 2 = 0 THEN '[' || pos || '] ' ELSE '' END || title || ' <i>J</i>' END AS h FROM {_METAS} WHERE pos % 3 < 2),
t AS (SELECT *, {_FOLD.format("replace(replace(h, '<i>', ''), '</i>', '')")} AS k FROM e)
SELECT call, CASE WHEN call % 2 = 0 THEN string_agg(replace(h, '. Ö', '.</X> Ö'), '|' ORDER BY pos) ELSE string_agg(h, '|' ORDER BY k, pos) END AS entries FROM t GROUP BY call""".replace("replace(h, '. Ö', '.</X> Ö')", "h"))
def bibliography_entries(spark, sf_dir):
    m = relation(spark, sf_dir, "metas").select("call", "pos", F.expr(_ENTRY).alias("html"))
    lists = m.groupBy("call").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]).alias("e"))
    return lists.select("call", F.array_join(rendered.ordered_entries(F.col("e")), "|").alias("entries"))


@query(r"""WITH x AS (SELECT p_partkey, lower(replace(p_name, ' ', '-')) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-2' ELSE '_x' END AS style, p_partkey % 4 = 0 AS known, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE p_partkey % 5 <> 1 END AS found FROM part), y AS (SELECT *, regexp_matches(style, '^[a-z0-9]+(?:-[a-z0-9]+)*$') AS slug FROM x)
SELECT p_partkey, known OR (slug AND coalesce(found, true)) AS valid, CASE WHEN NOT known AND slug AND found IS NULL THEN 'unverified style: ' || style WHEN NOT known AND slug AND found THEN 'style outside the catalogue: ' || style END AS note FROM y""")
def style_validity(spark, sf_dir):
    k = F.col("p_partkey")
    style = F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.when(k % 3 == 0, "").when(k % 3 == 1, "-2").otherwise("_x"))
    x = _part(spark, sf_dir).select("p_partkey", style.alias("s"), (k % 4 == 0).alias("known"), F.when(k % 5 != 0, k % 5 != 1).alias("found"))
    return x.select("p_partkey", rendered.is_valid_style(F.col("s"), F.col("known"), F.col("found")).alias("valid"), rendered.style_note(F.col("s"), F.col("known"), F.col("found")).alias("note"))


@query("SELECT brand, title, row_number() OVER (ORDER BY lower(title), brand) AS place FROM (SELECT DISTINCT p_brand AS brand, p_brand || ' ' || p_type AS title FROM part)")
def listed_styles(spark, sf_dir):
    """The style catalogue in order of lower-cased names."""
    styles = _part(spark, sf_dir).select(F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_brand", "p_type").alias("title")).distinct()
    return ordered.number_rows(styles, "place", F.lower("title"), F.col("brand"))


@query(rf"""SELECT pos, '{{"id":"K' || pos || '","type":"article-journal","title":"' || title || '"' || ',"issued":{{"date-parts":[[' || year || ']]}}' || CASE WHEN pos % 2 = 0 THEN ',"container-title":"J \"' || call || '\""' ELSE '' END || CASE WHEN doi <> '' THEN ',"DOI":"' || doi || '"' ELSE '' END || '}}' AS item,
  concat_ws('. ', nullif(doi, ''), 'PMID: ' || nullif(pmid, ''), 'A, B, C', title, year) AS query, regexp_extract(title, 'and (\w+)', 1) AS word FROM {_METAS}""")
def item_blocks(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    journal = F.when(F.col("pos") % 2 == 0, F.concat(F.lit('J "'), "call", F.lit('"')))
    item = rendered.item_data(F.concat(F.lit("K"), "pos"), F.lit(None).cast("string"), F.col("title"), F.col("year"), journal, F.col("doi"))
    asked = citations.record_query(F.col("doi"), F.col("pmid"), F.array(*map(F.lit, "ABCD")), F.col("title"), F.lit(""), F.col("year"))
    return m.select("pos", item.alias("item"), asked.alias("query"), F.regexp_extract("title", r"and (\w+)", 1).alias("word"))


_XML = "'ADDIN EN.CITE <EndNote><Cite><record><contributors><authors><author><style>' || split_part(title, ' ', 1) || ', A</style></author><author>Ng, B</author></authors></contributors><titles><title>' || title || ' <i>x</i> &amp;amp; y</title></titles><dates><year>' || year || '</year></dates><electronic-resource-num>' || doi || '</electronic-resource-num></record></Cite></EndNote>'"
_FIELD = "CASE pos % 4 WHEN 0 THEN 'CITATION Tag' || CAST(pos AS STRING) || ' \\\\\\\\l 1033' WHEN 1 THEN ' CITATION \\\\\\\\m 12 \\\\\\\\n T' || CAST(pos AS STRING) WHEN 2 THEN 'ADDIN ZOTERO_ITEM CSL_CITATION x' ELSE 'PAGEREF a' END"


@query(rf"""SELECT pos, title || ' x &amp; y' AS title, year, nullif(lower(regexp_extract(doi, '10\.\d+/\S+')), '') AS doi, split_part(title, ' ', 1) || ', A|Ng, B' AS authors,
  CASE pos % 4 WHEN 0 THEN 'Tag' || pos WHEN 1 THEN 'T' || pos END AS tag, CASE pos % 4 WHEN 2 THEN 'ZOTERO_ITEM' WHEN 3 THEN 'PAGEREF' ELSE 'CITATION' END AS kind, CASE WHEN pos % 3 = 0 THEN 'groups:' || pos WHEN pos % 3 = 1 THEN 'users:' || pos END AS library,
  CASE pos % 3 WHEN 0 THEN CAST(pos AS VARCHAR) WHEN 1 THEN '77' END AS pmid FROM {_METAS}""")
def field_payloads(spark, sf_dir):
    k = F.col("pos")
    m = relation(spark, sf_dir, "metas").withColumn("r", F.get(citations.endnote_items(F.expr(_XML)), 0))
    uri = F.concat(F.when(k % 3 == 0, "http://zotero.org/groups/").when(k % 3 == 1, "https://www.zotero.org/users/").otherwise("http://example.org/"), k.cast("string"), F.lit("/items/ABC"))
    pmid = citations.payload_pmid(F.when(k % 3 == 0, F.concat(F.lit("PMID"), k)), F.when(k % 3 == 1, F.lit("x: 1\nPMID: 77")), F.lit(None).cast("string"))
    instruction = F.expr(_FIELD.replace("\\\\\\\\", "\\\\"))
    return m.select("pos", "r.title", "r.year", "r.doi", F.array_join("r.authors", "|").alias("authors"), citations.word_tag(instruction).alias("tag"), citations.field_kind(instruction).alias("kind"), citations.uri_library(uri).alias("library"), pmid.alias("pmid"))


# --- services

_EV = "events"


@query("""WITH p AS (SELECT user_id AS scan, event_id AS page, event_id % 90 + 10 AS n, value AS elapsed, 400 AS total FROM events),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY scan ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p), s AS (SELECT *, before >= total OR elapsed > 120 AS stop, elapsed > 120 AS late FROM b),
f AS (SELECT scan, min(page) FILTER (stop) AS stop_at FROM s GROUP BY scan)
SELECT s.scan, count(*) FILTER (stop_at IS NULL OR page < stop_at) AS pages, CAST(coalesce(sum(n) FILTER (stop_at IS NULL OR page < stop_at), 0) AS BIGINT) AS items,
  CASE WHEN coalesce(sum(n) FILTER (stop_at IS NULL OR page < stop_at), 0) >= 400 THEN 'complete' WHEN coalesce(bool_or(late) FILTER (page = stop_at), false) THEN 'out of time' ELSE 'incomplete' END AS status FROM s JOIN f USING (scan) GROUP BY s.scan""")
def library_scans(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return services.scan_status(e.select(F.col("user_id").alias("scan"), F.col("event_id").alias("page"), (F.col("event_id") % 90 + 10).alias("n"), F.col("value").alias("elapsed"), F.lit(400).alias("total"), services.budget(F.lit("x")).alias("budget")))


@query("""WITH x AS (SELECT p_partkey AS scan, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN 'many' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)
SELECT scan, CAST(TRY_CAST(trim(t) AS BIGINT) AS VARCHAR) AS total, scan AS version, TRY_CAST(trim(t) AS BIGINT) IS NOT NULL AS ok, greatest(coalesce(TRY_CAST(trim(t) AS DOUBLE), 120.0), 5.0) AS budget, greatest(coalesce(TRY_CAST(trim(t) AS DOUBLE), 10.0), 1.0) AS timeout FROM x""")
def count_probes(spark, sf_dir):
    k = F.col("p_partkey")
    x = _part(spark, sf_dir).select(k.alias("scan"), F.when(k % 4 == 1, F.concat(F.lit(" "), "p_size", F.lit(" "))).when(k % 4 == 2, "many").when(k % 4 == 3, F.col("p_size").cast("string")).alias("total"), k.cast("string").alias("version"))
    return services.probe(x).withColumn("total", F.col("total").cast("string")).join(x.select("scan", services.budget(F.col("total")).alias("budget"), services.timeout(F.col("total")).alias("timeout")), "scan")


@query("""WITH i AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || CAST(1990 + p_size AS VARCHAR)) AS t FROM part), q AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS a, CAST(1990 + p_size AS VARCHAR) AS y FROM part WHERE p_size % 9 = 1)
SELECT a || ' ' || y AS query, p_partkey AS key FROM q JOIN i ON list_contains(string_split(t, ' '), a) AND list_contains(string_split(t, ' '), y)""")
def quick_search(spark, sf_dir):
    p = _part(spark, sf_dir)
    items = p.select(F.col("p_partkey").alias("key"), "p_name", F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array().cast("array<string>").alias("families"), (F.lit(1990) + F.col("p_size")).cast("string").alias("date"))
    asked = p.where("p_size % 9 = 1").select(F.concat_ws(" ", F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))), (F.lit(1990) + F.col("p_size")).cast("string")).alias("text")).distinct()
    return services.search_items(items, asked.select(F.col("text").alias("query"), "text"))


@query(f"""SELECT c.doc, c.n AS pos, CAST(c.cited * 3 % 5000 AS VARCHAR) AS key, l.event_id IS NOT NULL AS found, CAST(l.event_id AS VARCHAR) AS version FROM {inline("citations")} c LEFT JOIN (SELECT DISTINCT event_id FROM events) l ON l.event_id = c.cited * 3 % 5000""")
def point_lookups(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").select(F.concat_ws(":", "doc", "n").alias("pos"), "doc", "n", (F.col("cited") * 3 % 5000).cast("string").alias("key"))
    items = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("version")).distinct()
    return services.by_key(c.select("pos", "key"), items).select(F.split_part("pos", F.lit(":"), F.lit(1)).cast("long").alias("doc"), F.split_part("pos", F.lit(":"), F.lit(2)).cast("long").alias("pos"), "key", "found", "version")


@query("""WITH k AS (SELECT n_regionkey AS p, 'N' || n_nationkey AS key FROM nation WHERE n_nationkey % 4 <> 0) SELECT 'R' || r_regionkey AS key, count(k.key) AS n, coalesce(string_agg(k.key, ',' ORDER BY k.key), '') AS children FROM region LEFT JOIN k ON k.p = r_regionkey GROUP BY r_regionkey""")
def item_children(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    items = read("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("key"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 4 == 0, True).alias("deleted"))
    return services.children(read("region").select(F.concat(F.lit("R"), "r_regionkey").alias("key")), items).withColumn("children", F.array_join("children", ","))


@query(f"""WITH f AS (SELECT cited % 10 AS list, cited AS key, min(doc * 100 + n) AS pos FROM {inline("citations")} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY pos) - 1 AS r FROM f)
SELECT list, r // 50 AS batch, string_agg(key, ',' ORDER BY r) AS keys FROM k GROUP BY 1, 2""")
def batched_keys(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").select((F.col("cited") % 10).alias("list"), (F.col("doc") * 100 + F.col("n")).alias("pos"), F.col("cited").alias("key"))
    return services.key_batches(c).withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query("SELECT DISTINCT user_id AS key FROM events WHERE event_type = 'error' AND event_id > 500")
def deleted_keys(spark, sf_dir):
    return services.deleted_since(relation(spark, sf_dir, "changelog"), 500)


_PMC = "CASE p_partkey % 4 WHEN 0 THEN 'PMC' || CAST(p_size AS STRING) WHEN 1 THEN 'pmc' || CAST(p_size AS STRING) || '.2' WHEN 2 THEN CAST(p_size AS STRING) ELSE 'none' END"


@query(f"""WITH r AS (SELECT p_partkey AS id, max(CAST(900000 + p_partkey AS VARCHAR)) AS pmid FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), a AS (SELECT DISTINCT p_brand AS list, {_PMC} AS pmcid, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS id FROM part)
SELECT list, pmcid, r.pmid FROM a LEFT JOIN r USING (id)""")
def pmcid_lookup(spark, sf_dir):
    p = _part(spark, sf_dir)
    records = p.select(F.concat(F.lit("PMC"), "p_partkey").alias("pmcid"), F.when(F.col("p_partkey") % 3 != 0, (F.lit(900000) + F.col("p_partkey")).cast("string")).alias("pmid"))
    return services.pmids_of_pmcids(p.select(F.col("p_brand").alias("list"), F.expr(_PMC).alias("pmcid")), records)


@query(f"""SELECT pos, CASE WHEN pmid <> '' THEN CASE WHEN rec_pmid <> '' THEN 'PMC' || pos END END AS by_pmid FROM {_METAS}""")
def pmcid_of_ids(spark, sf_dir):
    m = relation(spark, sf_dir, "metas")
    records = m.select(F.concat(F.lit("pmc"), "pos", F.lit(".1")).alias("pmcid"), F.col("rec_pmid").alias("pmid"), F.lit("").alias("doi"))
    return services.pmcids_of(m.select("pos", F.col("pmid").alias("id")), records).select("pos", F.col("pmcid").alias("by_pmid"))


@query("""WITH g AS (SELECT p_brand AS term, CAST(p_size AS VARCHAR) AS pmid, min(p_partkey) AS pos FROM part WHERE p_partkey % 6 NOT IN (2, 5) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY pos) AS r FROM g)
SELECT b.term, coalesce(string_agg(pmid, ',' ORDER BY r) FILTER (r <= 5), '') AS pmids, any_value(degraded) AS degraded FROM (SELECT p_brand AS term, bool_or(p_partkey % 6 = 5) AS degraded FROM part GROUP BY 1) b LEFT JOIN k USING (term) GROUP BY b.term""")
def term_search(spark, sf_dir):
    k = F.col("p_partkey")
    answers = _part(spark, sf_dir).select(F.col("p_brand").alias("term"), k.alias("pos"), F.when(k % 6 == 2, "x").otherwise(F.col("p_size").cast("string")).alias("pmid"), (k % 6 != 5).alias("ok"))
    return services.search_results(answers, 5).withColumn("pmids", F.array_join("pmids", ","))


@query(f"""WITH f AS (SELECT cited % 7 AS plan, cited % 400 AS query, min(doc * 100 + n) AS first FROM {inline("citations")} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY first) AS r FROM f)
SELECT c.cited % 7 AS plan, doc * 100 + n AS pos, CAST(c.cited % 400 AS BIGINT) AS query, r <= 20 AS asked FROM {inline("citations")} c JOIN k ON k.plan = c.cited % 7 AND k.query = c.cited % 400""")
def query_budget(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").select((F.col("cited") % 7).alias("plan"), (F.col("doc") * 100 + F.col("n")).alias("pos"), (F.col("cited") % 400).alias("query"))
    return services.limited_queries(c, 20)


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS age, p_partkey % 2 = 0 AS net, p_partkey % 3 = 0 AS refreshed, p_partkey % 5 = 0 AS dois FROM part)
SELECT p_partkey, CASE WHEN age <= 7 THEN 'cached' WHEN NOT net AND age IS NOT NULL THEN 'stale' WHEN NOT net THEN 'none' WHEN refreshed THEN 'refreshed' WHEN age IS NOT NULL THEN 'stale' ELSE 'none' END AS notices,
  CASE WHEN age <= 7 THEN NULL WHEN NOT net THEN 'CITE-RW-STALE-GATE' WHEN refreshed THEN 'CITE-RW-REFRESH' WHEN age IS NOT NULL THEN 'CITE-RW-STALE' ELSE 'CITE-RW-UNAVAIL' END AS "check",
  CASE WHEN age < 24 THEN 'cached' WHEN net THEN 'read' WHEN refreshed THEN 'unavailable' WHEN age IS NOT NULL THEN 'stale' WHEN dois THEN 'dois only' ELSE 'unavailable' END AS source, coalesce(age < 24, false) OR net AS whole, coalesce(age < 14, false) AS answer_fresh,
  CASE WHEN p_partkey % 4 = 0 THEN true ELSE false END AS usable, least(p_partkey, 100) AS watermark, p_partkey % 3 = 1 AS writable, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'http://zotero.org/' || CASE p_partkey % 4 WHEN 0 THEN 'groups/5' WHEN 1 THEN 'users/9' ELSE 'groups/5' END || '/items/K' || p_partkey END AS uri FROM x""")
def cache_policy(spark, sf_dir):
    k, age = F.col("p_partkey"), F.when(F.col("p_size") % 10 != 0, F.col("p_size"))
    net, refreshed, dois = k % 2 == 0, k % 3 == 0, k % 5 == 0
    cached = F.struct(F.when(k % 8 < 6, F.array(F.lit(1))).otherwise(F.array(F.lit(2))).alias("items"), F.when(k % 4 == 1, "x").otherwise("7").alias("version"), F.when(k % 4 == 2, False).alias("top"), F.when(k % 4 != 3, "groups").alias("library_type"), F.lit("5").alias("library_id"))
    who = services.library_identity(F.when(k % 2 == 0, "5"), F.when(k % 4 == 1, "9"))
    p = _part(spark, sf_dir).select("p_partkey", services.notice_source(age, net, refreshed).alias("n"), services.index_source(age, net, dois, refreshed).alias("i"), services.fresh(age, services.ANSWER_DAYS).alias("answer_fresh"),
        services.cache_usable(cached, F.lit(True), F.lit("groups"), F.lit("5")).alias("usable"), services.resync_watermark(k, F.lit(100)).alias("watermark"), services.can_write(F.when(k % 3 == 1, "true").when(k % 3 == 2, "false")).alias("writable"), who.alias("who"))
    return p.select("p_partkey", F.col("n.use").alias("notices"), "n.check", F.col("i.use").alias("source"), (~F.col("i.degraded")).alias("whole"), "answer_fresh", "usable", "watermark", "writable", services.item_uri(F.col("who.kind"), F.col("who.id"), F.concat(F.lit("K"), "p_partkey")).alias("uri"))
