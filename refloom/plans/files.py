"""Queries over file names and over where a work's open file is."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import access, naming
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

# names with dates, fillers, counters, foreign characters, several dots, and some that clash
_NAME = (
    "CASE p_partkey % 7 WHEN 0 THEN '2026_Oct_R01_Smith_' || replace(p_name, ' ', '_') || '_Aims_draft_' || CAST(p_size AS STRING) || '.docx' WHEN 1 THEN replace(p_name, ' ', '_') || '.docx'"
    " WHEN 2 THEN '2026_10_' || CAST(p_size AS STRING) || ' ' || p_name || ' ' || p_type || ' final v2.docx' WHEN 3 THEN p_name || ' ' || p_type || '.' || p_brand || '.tar.gz' WHEN 4 THEN '202610_' || p_brand || '__' || p_type || '_' || p_name || '_copy_12_rev.docx'"
    " WHEN 5 THEN 'Report_' || CAST(p_size % 3 AS STRING) || '.docx' ELSE replace(p_brand || p_type || p_name || p_type || p_type, ' ', '') || '_v' || CAST(p_size AS STRING) || '_.' || p_brand || p_brand END"
)

_SHORT = rf"""WITH RECURSIVE f AS (SELECT p_brand AS folder, p_partkey AS pos, {_NAME} AS name FROM part),
c AS (SELECT *, regexp_replace(stem, '[^A-Za-z0-9_\-]', '_', 'g') AS clean FROM (SELECT *, regexp_replace(name, '^(\.*[^.].*)\.[^.]*$', '\1') AS stem, regexp_replace(regexp_extract(name, '^\.*[^.].*(\.[^.]*)$', 1), '[^A-Za-z0-9_.\-]', '_', 'g') AS ext FROM f)),
w AS (SELECT *, list_filter(string_split(clean, '_'), lambda x: x <> '') AS t FROM c),
g AS (SELECT *, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN regexp_matches(t[i], '(?i)^(draft|final|copy|version|ver|rev|v\d+)$') THEN i
  WHEN regexp_matches(t[i], '^\d{{1,3}}$') THEN CASE WHEN i > 1 AND regexp_matches(t[i - 1], '(?i)^(draft|final|copy|version|ver|rev|v\d+)$') THEN i - 1 WHEN i > 1 AND i = len(t) THEN i ELSE 0 END ELSE 0 END) AS g FROM w),
steps AS (
  SELECT folder, pos, name, ext, t, g, false AS dated, false AS done, length(array_to_string(t, '_')) + length(ext) <= 50 AS ok, 0 AS n FROM g
  UNION ALL SELECT folder, pos, name, ext, nt, ng, nd, stuck, length(array_to_string(nt, '_')) + length(ext) <= 50, n + 1 FROM (
    SELECT *, CASE rule WHEN 'filler' THEN [t[i] FOR i IN range(1, len(t) + 1) IF g[i] <> top] WHEN 'date' THEN t[lead + 1:] WHEN 'middle' THEN list_concat(t[1:cut], t[cut + 2:]) ELSE t END AS nt,
      CASE rule WHEN 'filler' THEN list_filter(g, lambda x: x <> top) ELSE list_transform(g, lambda x: 0) END AS ng, dated OR rule = 'date' AS nd, rule = 'none' AS stuck FROM (
      SELECT *, CASE WHEN top > 0 AND len(list_filter(g, lambda x: x <> top)) > 0 THEN 'filler' WHEN NOT dated AND lead > 0 THEN 'date' WHEN len(t) > 2 THEN 'middle' ELSE 'none' END AS rule FROM (
        SELECT *, coalesce(list_max(g), 0) AS top, CASE WHEN dated AND len(t) > 3 THEN 2 ELSE len(t) // 2 END AS cut,
          CASE WHEN NOT regexp_matches(t[1], '^(19|20)\d\d(\d\d(\d\d)?)?$') THEN 0 WHEN length(t[1]) = 4 AND regexp_matches(coalesce(t[2], ''), '(?i)^oct(ober)?$') AND len(t) > 2 THEN 2
            WHEN length(t[1]) = 4 AND regexp_matches(coalesce(t[2], ''), '^\d\d?$') THEN CASE WHEN regexp_matches(coalesce(t[3], ''), '^\d\d?$') THEN CASE WHEN len(t) > 3 THEN 3 ELSE 0 END WHEN len(t) > 2 THEN 2 ELSE 0 END WHEN len(t) > 1 THEN 1 ELSE 0 END AS lead
        FROM steps WHERE NOT ok AND NOT done)))),
last AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY pos ORDER BY n DESC) = 1),
s AS (SELECT l.*, CASE WHEN c.clean = c.stem AND length(c.clean || c.ext) <= 50 THEN c.name WHEN ok THEN array_to_string(t, '_') || l.ext END AS short FROM last l JOIN c USING (pos)),
o AS (SELECT *, short IS NOT NULL AND row_number() OVER (PARTITION BY folder, short ORDER BY pos) = 1 AS own FROM s),
h AS (SELECT *, substr(sha1(name || repeat('+', CAST(row_number() OVER (PARTITION BY folder, name, own ORDER BY pos) - 1 AS INT))), 1, 6) AS h, 43 - length(ext) AS room FROM o),
e AS (SELECT *, list_filter(list_transform(range(1, len(t) + 1), lambda i: array_to_string(t[i:], '_')), lambda x: length(x) <= room) AS ends FROM h)
SELECT folder, pos, name, CASE WHEN own THEN short ELSE h || CASE WHEN len(ends) > 0 THEN '_' || ends[1] WHEN room > 0 THEN '_' || right(t[-1], room) ELSE '' END || ext END AS short FROM e"""


@query(_SHORT)
def short_file_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return naming.short_names(part.select(F.col("p_brand").alias("folder"), F.col("p_partkey").alias("pos"), F.expr(_NAME).alias("name")))


@query("""SELECT p_partkey AS pos, '2026_Oct_R01_' || p_brand || '_' || replace(trim(p_name), ' ', '_') || '_' || replace(p_type, ' ', '_') || '_draft_' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.docx' ELSE '.pdf' END AS name FROM part""")
def convention_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    ext = F.when(F.col("p_partkey") % 2 == 0, "docx").otherwise(".pdf")
    name = naming.convention_name(F.lit("2026"), F.lit("Oct"), F.lit("R01"), F.col("p_brand"), F.concat(F.lit(" "), "p_name"), F.col("p_type"), F.col("p_size").cast("string"), ext)
    return part.select(F.col("p_partkey").alias("pos"), name.alias("name"))


_PAYLOADS = inline("payloads")


@query(rf"""WITH w AS (SELECT pos, TRY_CAST(access AS JSON) AS a, TRY_CAST(work AS JSON) AS r FROM {_PAYLOADS}),
s AS (SELECT pos, CASE WHEN pos % 12 = 0 THEN 'https://arxiv.org/pdf/2101.' || (10000 + pos % 80000) || '.pdf' END AS arxiv,
  CASE WHEN pos % 12 IN (10, 11) OR pos % 5 <> 0 OR a IS NULL THEN NULL ELSE CASE pos % 3 WHEN 0 THEN 'https://x.org/best.pdf' WHEN 1 THEN 'https://x.org/other.pdf' ELSE 'https://x.org/landing' END END AS locations,
  CASE WHEN pos % 12 IN (10, 11) OR pos % 4 <> 0 OR r IS NULL THEN NULL ELSE 'https://arxiv.org/pdf/' || CASE pos % 3 WHEN 0 THEN '2101.' || lpad(CAST(pos % 10000 AS VARCHAR), 5, '0') WHEN 1 THEN '1999.12345' ELSE '2002.00001v2' END || '.pdf' END AS registry,
  CASE WHEN pos % 12 IN (10, 11) OR pos % 3 <> 0 THEN NULL ELSE 'https://s.org/' || pos || '.pdf' END AS graph,
  CASE WHEN pos % 12 NOT IN (10, 11) AND pos % 7 = 0 THEN pos WHEN pos % 12 <> 11 AND pos % 2 = 0 THEN pos + 1000000 END AS archive FROM w)
SELECT pos AS work, CASE WHEN arxiv IS NOT NULL THEN 'arxiv' WHEN locations IS NOT NULL THEN 'locations' WHEN registry IS NOT NULL THEN 'registry' WHEN graph IS NOT NULL THEN 'graph' WHEN archive IS NOT NULL THEN 'archive' END AS source,
  coalesce(arxiv, locations, registry, graph, 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || archive || '/pdf/') AS url FROM s""")
def open_file_sources(spark, sf_dir):
    p = relation(spark, sf_dir, "payloads").withColumn("doi", F.concat(F.lit("10.1234/P."), "pos"))
    pos = F.col("pos")
    works = p.select(pos.alias("work"), F.when(~(pos % 12).isin(10, 11), F.concat(F.lit("https://doi.org/"), "doi")).alias("doi"), F.when(pos % 12 != 11, pos.cast("string")).alias("pmid"), F.when(pos % 12 == 0, F.concat(F.lit("2101."), (F.lit(10000) + pos % 80000).cast("string"))).alias("arxiv"))
    graph = p.where("pos % 3 = 0").select("doi", F.concat(F.lit('{"openAccessPdf":{"url":"https://s.org/'), "pos", F.lit('.pdf"}}')).alias("payload"))
    ids = p.select(F.concat(F.lit("pmc"), "pos").alias("pmcid"), F.lit("").alias("pmid"), F.when(pos % 7 == 0, F.col("doi")).otherwise("").alias("doi")).unionByName(p.where("pos % 2 = 0").select(F.concat(F.lit("PMC"), pos + 1000000).alias("pmcid"), pos.cast("string").alias("pmid"), F.lit("").alias("doi")))
    return access.open_files(works, p.where("pos % 5 = 0").select("doi", F.col("access").alias("payload")), p.where("pos % 4 = 0").select("doi", F.col("work").alias("payload")), graph, ids)
