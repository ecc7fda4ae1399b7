"""Queries over the works that documents cite: in their fields, in their stores of sources, in another manager's export."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.lineage import cut
from refloom.operators import documents, library, migration, services
from refloom.plans.catalogue import _doi
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

_CITED = rf"""payloads AS (SELECT doc, pos, regexp_extract(instruction, '(?s)\{{.*\}}') AS p FROM {inline("cited_fields")} WHERE contains(instruction, 'ZOTERO_ITEM CSL_CITATION')),
works AS (SELECT doc, pos, unnest(range(0, len(l))) AS item, unnest(l) AS x FROM (SELECT doc, pos, CAST(json_extract(p, '$.citationItems') AS JSON[]) AS l FROM payloads WHERE json_valid(p))),
rows_ AS (SELECT doc, pos, item, split(trim(coalesce(nullif(x->>'$.itemData.id', ''), x->>'$.id', '')), '/')[-1] AS key, trim(coalesce(nullif(x->>'$.itemData.DOI', ''), x->>'$.itemData.doi', '')) AS doi, trim(coalesce(x->>'$.itemData.title', '')) AS title,
  coalesce(nullif(regexp_replace(coalesce(x->>'$.itemData.PMID', ''), '\D', '', 'g'), ''), nullif(regexp_extract(coalesce(x->>'$.itemData.note', ''), '(?i)\bPMID\s*:?\s*(\d{{1,9}})\b', 1), ''), '') AS pmid,
  CASE WHEN json_type(x->'$.itemData.author') = 'ARRAY' THEN x->>'$.itemData.author[0].family' ELSE '' END AS author FROM works)"""


@query(f"""WITH {_CITED}, n AS (SELECT *, {_doi("doi")} AS same FROM rows_ WHERE doi <> '')
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos, item) AS rank, doi FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc, same ORDER BY pos, item) = 1)""")
def cited_dois(spark, sf_dir):
    return documents.cited_dois(relation(spark, sf_dir, "cited_fields"))


@query(f"""WITH {_CITED}
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos, item) AS rank, key, doi, pmid, title, coalesce(author, '') AS author FROM (SELECT *, CASE WHEN key = '' THEN CAST(pos AS VARCHAR) || '/' || CAST(item AS VARCHAR) ELSE 'k' || key END AS same FROM rows_ QUALIFY row_number() OVER (PARTITION BY doc, same ORDER BY pos, item) = 1)""")
def cited_references(spark, sf_dir):
    return documents.cited_references(relation(spark, sf_dir, "cited_fields")).withColumn("author", F.coalesce(F.get("authors", 0)["family"], F.lit(""))).drop("authors")


@query(f"""WITH f AS (SELECT doc, pos, regexp_extract(instruction, '(Tag\\d+)', 1) AS tag FROM {inline("word_fields")} WHERE regexp_matches(trim(instruction), '^CITATION')), s AS (SELECT * FROM {inline("word_sources")})
SELECT f.doc, f.pos, f.tag, CASE WHEN m.tag IS NOT NULL THEN 'found' WHEN f.doc IN (SELECT doc FROM s WHERE error IS NOT NULL) THEN 'unreadable' ELSE 'not found' END AS status, coalesce(m.title, '') AS title, coalesce(m.doi, '') AS doi, coalesce(m.year, '') AS year
FROM f LEFT JOIN (SELECT * FROM s WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY doc, tag ORDER BY part DESC, place DESC) = 1) m ON m.doc = f.doc AND m.tag = f.tag""")
def cited_sources(spark, sf_dir):
    sources = relation(spark, sf_dir, "word_sources").withColumn("authors", F.array().cast("array<string>"))
    found = documents.cited_sources(relation(spark, sf_dir, "word_fields"), sources)
    return found.select("doc", "pos", "tag", "status", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "doi", "year")))


_GATES = "CASE WHEN source % 11 = 3 THEN 'no' WHEN source % 11 = 4 THEN 'unknown' ELSE 'yes' END"
_CITES = "(SELECT l_orderkey AS doc, CAST(l_linenumber % 3 AS INT) AS field, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS item, l_partkey AS cited, l_linenumber % 4 AS way FROM {lineitem})"


def _decided(spark, sf_dir):
    # a table of parts is a file of few pieces: dealt out, so that keys and merged data are worked out by all cores
    rows = relation(spark, sf_dir, "migrated").repartition("pos")
    person = lambda x: F.struct(F.get(F.split(x, ","), 0).alias("family"), F.coalesce(F.get(F.split(x, ","), 1), F.lit("")).alias("given"), F.lit(None).cast("string").alias("literal"))
    found = F.struct(F.when(F.col("k") % 5 != 1, F.col("title")).alias("title"), F.when(F.col("k") % 3 != 1, F.col("doi")).alias("doi"), F.lit("J").alias("journal"), F.when(F.col("k") % 2 == 0, F.col("year")).alias("year"), F.lit("").alias("type"), F.lit(None).cast("string").alias("volume"), F.lit("1-2").alias("pages"), F.transform(F.filter(F.split("authors", ";"), lambda x: x != ""), person).alias("authors"))
    record = F.struct(F.col("rec_title").alias("title"), F.col("rec_doi").alias("doi"), F.lit("Own journal").alias("journal"), F.lit("1999").alias("year"), F.lit("9").alias("volume"), F.lit(None).cast("string").alias("pages"), F.filter(F.split("rec_authors", ";"), lambda x: x != "").alias("authors"))
    records = rows.select("source", F.col("pos").alias("rec"), "tier", "retracted", found.alias("found"), record.alias("record"), F.col("rec_pmid").alias("pmid"))
    gates = rows.select("source").distinct().selectExpr("source", "source % 13 <> 5 AS readable", f"{_GATES} AS writable")
    index = cut(library.build_indexes(relation(spark, sf_dir, "migrated_into").repartition("pos")))
    return cut(migration.decide_records(records, index, gates))


def _created(decided):
    made = migration.items_to_create(decided).withColumn("h", F.md5("identity")).where(~F.col("h").startswith("f"))
    return cut(migration.with_created(decided, made.select("identity", F.concat(F.lit("N"), F.left("h", F.lit(8))).alias("key"))))


_INTO = f"""(SELECT pos, key, nullif({_doi("doi")}, '') AS doi, nullif(pmid, '') AS pmid, lower(trim(regexp_replace(strip_accents(title), '\\s+', ' ', 'g'))) AS t FROM {inline("migrated_into")})"""
_MIGRATED = f"""into_ AS (SELECT * FROM {_INTO}), r AS (SELECT *, CASE WHEN tier = 'high' AND k % 5 <> 1 AND title <> '' THEN trim(title) ELSE trim(rec_title) END AS new_title, CASE WHEN tier = 'high' AND k % 3 <> 1 AND trim(doi) <> '' THEN trim(doi) ELSE trim(rec_doi) END AS new_doi,
  CASE WHEN tier = 'high' AND k % 2 = 0 THEN year ELSE '1999' END AS new_year, CASE WHEN tier = 'high' AND authors <> '' THEN split(authors, ';')[1] WHEN rec_authors <> '' THEN split(rec_authors, ';')[1] ELSE '' END AS new_author FROM {inline("migrated")}),
i AS (SELECT r.*, coalesce((SELECT max_by(key, pos) FROM into_ x WHERE x.doi = nullif({_doi("r.new_doi")}, '')), (SELECT max_by(key, pos) FROM into_ x WHERE x.pmid = nullif(trim(r.rec_pmid), '')), (SELECT min_by(key, pos) FROM into_ x WHERE x.t = nullif(lower(trim(regexp_replace(strip_accents(r.new_title), '\\s+', ' ', 'g'))), ''))) AS there,
  coalesce('doi:' || nullif({_doi("r.new_doi")}, ''), 'title:' || nullif(trim(regexp_replace(lower(r.new_title), '[^a-z0-9]+', ' ', 'g')), '')) AS identity FROM r),
d AS (SELECT *, CASE WHEN source % 13 = 5 OR {_GATES} <> 'yes' THEN 'refused' WHEN retracted THEN 'skipped' WHEN there IS NOT NULL THEN 'matched' ELSE 'create' END AS plan FROM i),
done AS (SELECT *, CASE WHEN plan = 'matched' THEN there WHEN plan = 'create' AND md5(identity)[1] <> 'f' THEN 'N' || md5(identity)[1:8] END AS key, CASE WHEN plan = 'create' THEN CASE WHEN md5(identity)[1] <> 'f' THEN 'created' ELSE 'failed' END ELSE plan END AS outcome FROM d)"""


@query(f"""WITH {_MIGRATED} SELECT pos AS rec, outcome, coalesce(key, '') AS key, CASE WHEN plan = 'create' THEN new_title ELSE '' END AS title, CASE WHEN plan = 'create' THEN new_doi ELSE '' END AS doi, CASE WHEN plan = 'create' THEN new_year ELSE '' END AS year,
  CASE WHEN plan = 'create' THEN split(new_author || ',', ',')[1] ELSE '' END AS author FROM done""")
def migrated_records(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    text = lambda c: F.coalesce(c, F.lit(""))
    data = decided.select("rec", text(F.col("data.title")).alias("title"), text(F.col("data.doi")).alias("doi"), text(F.col("data.year")).alias("year"), text(F.get("data.authors", 0)["family"]).alias("author"))
    return _created(decided).select("rec", "outcome", text(F.col("key")).alias("key")).join(data, "rec")


@query(f"""WITH {_MIGRATED}, c AS (SELECT x.doc, x.field, x.item, x.way, m.call AS source, CASE WHEN way < 2 THEN upper(m.rec_doi) WHEN way = 2 THEN '' ELSE '10.1/none' END AS doi, CASE WHEN way > 0 THEN upper(m.rec_title) || '!' ELSE '' END AS title FROM {_CITES.replace("{lineitem}", "lineitem")} x JOIN {inline("metas")} m ON m.pos = x.cited),
k AS (SELECT source, pos, key, outcome, nullif({_doi("rec_doi")}, '') AS doi, nullif(trim(regexp_replace(lower(rec_title), '[^a-z0-9]+', ' ', 'g')), '') AS t FROM done),
kd AS (SELECT source, doi, min_by({{'pos': pos, 'key': key, 'outcome': outcome}}, pos) AS r FROM k WHERE doi IS NOT NULL GROUP BY 1, 2), kt AS (SELECT source, t, min_by({{'pos': pos, 'key': key, 'outcome': outcome}}, pos) AS r FROM k WHERE t IS NOT NULL GROUP BY 1, 2),
met AS (SELECT c.doc, c.field, c.item, coalesce(kd.r, kt.r) AS r FROM c LEFT JOIN kd ON kd.source = c.source AND kd.doi = nullif({_doi("c.doi")}, '') LEFT JOIN kt ON kt.source = c.source AND kt.t = nullif(trim(regexp_replace(lower(c.title), '[^a-z0-9]+', ' ', 'g')), ''))
SELECT doc, field, item, coalesce(r.pos, -1) AS rec, coalesce(r.key, '') AS key, coalesce(r.outcome, 'unmatched') AS outcome, CASE WHEN bool_and(r.key IS NOT NULL) OVER (PARTITION BY doc, field) THEN 'converted' ELSE 'left' END AS status FROM met""")
def migrated_citations(spark, sf_dir):
    metas = relation(spark, sf_dir, "metas").select(F.col("pos").alias("cited"), F.col("call").alias("source"), "rec_doi", "rec_title")
    cites = spark.sql(f"SELECT * FROM {_CITES}", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).join(metas, "cited")
    doi = F.when(F.col("way") < 2, F.upper("rec_doi")).when(F.col("way") == 2, "").otherwise("10.1/none")
    cited = cites.select("source", "doc", "field", "item", doi.alias("doi"), F.when(F.col("way") > 0, F.concat(F.upper("rec_title"), F.lit("!"))).otherwise("").alias("title"))
    out = migration.migrate_citations(cited, _created(_decided(spark, sf_dir)))
    return out.select("doc", "field", "item", F.coalesce("rec", F.lit(-1)).alias("rec"), F.coalesce("key", F.lit("")).alias("key"), "outcome", "status")


_ASKED = "(SELECT l_suppkey AS list, CAST(l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS pos, l_partkey * 2 AS id FROM {lineitem})"
_BROKEN = "substr(md5(CAST(list AS STRING) || '/' || CAST(batch AS STRING)), 1, 1) < '3'"
_RECORDS = "(SELECT CAST(p_partkey + floor(p_size / 5) AS BIGINT) AS id, p_name AS title, p_brand AS journal FROM {part})"


@query(f"""WITH a AS (SELECT * FROM {_ASKED.replace("{lineitem}", "lineitem")}), u AS (SELECT list, id, CAST(floor((row_number() OVER (PARTITION BY list ORDER BY min(pos), id) - 1) / 50) AS BIGINT) AS batch FROM a GROUP BY list, id),
r AS (SELECT * FROM {_RECORDS.replace("{part}", "part")} QUALIFY row_number() OVER (PARTITION BY id ORDER BY title, journal) = 1)
SELECT a.list, a.pos, a.id, u.batch, CASE WHEN {_BROKEN.replace("list", "a.list")} THEN 'degraded' WHEN r.id IS NULL THEN 'missing' ELSE 'found' END AS status, CASE WHEN {_BROKEN.replace("list", "a.list")} THEN '' ELSE coalesce(r.title, '') END AS title
FROM a JOIN u ON u.list = a.list AND u.id = a.id LEFT JOIN r ON r.id = a.id""")
def fetched_records(spark, sf_dir):
    asked = spark.sql(f"SELECT * FROM {_ASKED}", lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    records = spark.sql(f"SELECT * FROM {_RECORDS}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    # a list's batches: as many as its ids can make
    most = asked.groupBy("list").agg(F.countDistinct("id").alias("n")).select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 50))).alias("batch"))
    return services.fetch_batched(asked, records, most.where(_BROKEN), 50).select("list", "pos", "id", "batch", "status", F.coalesce("title", F.lit("")).alias("title"))
