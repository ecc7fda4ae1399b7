"""Queries over manuscript lines, service payloads and the plan and apply workflows, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from refloom.functions import payloads, people, rendering, shapes
from refloom.operators import items, workflows
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

_LINES = inline("lines")
_PAYLOADS = inline("payloads")


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _one_author(x: str) -> str:
    """The oracle's pattern dialect has no look-ahead."""
    return f"({_m(x, rf'^{shapes.PARTICLE}{shapes.SURNAME}\s+{shapes.INITIALS}\.')} OR (NOT {_m(x, rf'^{shapes.SECTION_WORD}[.\s]')} AND {_m(x, rf'^(?:{shapes.ORGANISED})')}))"


_BYLINE = rf"^{shapes.PARTICLE}{shapes.SURNAME}\s+{shapes.INITIALS}\s*(?:,|and\b|&)"
_LISTED = rf"^{shapes.PARTICLE}{shapes.SURNAME}(?:\s+{shapes.INITIALS})?(?:\s*,|\s+and\b|\s+&)"


def _citation(x: str) -> str:
    return f"({_m(x, shapes.CITED_ID)} OR ({_m(x, shapes.YEAR)} AND ({_m(x, _BYLINE)} OR (length({x}) >= 40 AND {_one_author(x)}))))"


def _signal(x: str) -> str:
    return f"({_m(x, _BYLINE)} OR {_one_author(x)} OR {_m(f"regexp_replace({x}, '{shapes.ID_TOKEN}', ' ', 'g')", shapes.YEAR)})"


def _lines(spark, sf_dir):
    return relation(spark, sf_dir, "lines")


# --- lines


@query(f"""SELECT doc, count(*) FILTER ({_m("line", shapes.P_VALUE)}) AS p_values, count(*) FILTER ({_m("line", shapes.EFFECT_SIZE.replace(r"|(?<![\p{L}\p{N}_])β\s*=", ""))}) AS effects,
  count(*) FILTER ({_m("line", shapes.DISPERSION)}) AS dispersions, count(*) FILTER ({_m("line", shapes.SIGNIFICANCE)}) AS significances, count(*) FILTER ({_m("line", shapes.FIGURE_LABEL)}) AS figures, count(*) FILTER ({_m("line", shapes.TABLE_LABEL)}) AS tables FROM {_LINES} GROUP BY doc""")
def line_statistics(spark, sf_dir):
    n = lambda p: F.count_if(F.col("line").rlike(p))
    return _lines(spark, sf_dir).groupBy("doc").agg(
        n(shapes.P_VALUE).alias("p_values"), n(shapes.EFFECT_SIZE).alias("effects"), n(shapes.DISPERSION).alias("dispersions"), n(shapes.SIGNIFICANCE).alias("significances"), n(shapes.FIGURE_LABEL).alias("figures"), n(shapes.TABLE_LABEL).alias("tables")
    )


@query(f"""SELECT para, heading, caption, citation, CASE WHEN {_m("line", shapes.ENUMERATED)} AND {_citation("bare")} THEN {_signal("bare")} ELSE citation AND {_signal("t")} END AS entry,
  NOT {_m("t", shapes.NOT_A_REFERENCE)} AND {_m("t", shapes.YEAR)} AND ({_m("t", shapes.ENUMERATED)} OR (length(t) > 40 AND ({_m("t", _LISTED)} OR {_one_author("t")}))) AS shaped, nullif(regexp_extract(line, '{shapes.NUMBERING}', 1), '') AS numbering
  FROM (SELECT *, t <> '' AND len(regexp_split_to_array(t, '\\s+')) <= 8 AND NOT ends_with(t, '.') AS heading, {_m("line", shapes.CAPTION)} AS caption, {_citation("t")} AS citation
    FROM (SELECT *, trim(line) AS t, regexp_replace(line, '{shapes.ENUMERATOR}', '') AS bare FROM {_LINES}))""")
def line_shapes(spark, sf_dir):
    x = F.col("line")
    return _lines(spark, sf_dir).select(
        "para", shapes.is_heading_shape(x).alias("heading"), shapes.is_caption(x).alias("caption"), shapes.is_citation_line(x).alias("citation"), shapes.is_reference_entry(x).alias("entry"), shapes.is_reference_shaped(x).alias("shaped"), shapes.numbering(x).alias("numbering")
    )


_INNER = "CASE cited % 7 WHEN 0 THEN CAST(cited AS STRING) WHEN 1 THEN '3, 5-7' WHEN 2 THEN 'see ref 4' WHEN 3 THEN 'Smith 2019' WHEN 4 THEN '0' WHEN 5 THEN CAST(cited % 900 + 150 AS STRING) || ',12' ELSE 'n = 12' END"


@query(f"""SELECT doc, n, regexp_matches(i, '{shapes.NUMBERS_ONLY}') AND len(list_filter(regexp_extract_all(i, '\\d+'), lambda x: CAST(x AS INT) NOT BETWEEN 1 AND 999)) = 0 AS numeric_citation, {_m("i", shapes.PLACEHOLDER)} OR {_m("i", shapes.YEAR)} AS placeholder
  FROM (SELECT doc, n, {_INNER} AS i FROM {inline("citations")})""")
def bracket_kinds(spark, sf_dir):
    return relation(spark, sf_dir, "citations").withColumn("i", F.expr(_INNER)).select("doc", "n", shapes.is_numeric_citation(F.col("i")).alias("numeric_citation"), shapes.is_placeholder(F.col("i")).alias("placeholder"))


_FAMILY = "CASE ref % 6 WHEN 0 THEN 'WHO' WHEN 1 THEN 'Study Group' WHEN 2 THEN '' WHEN 3 THEN 'Nice' WHEN 4 THEN 'Working Group, Ann' ELSE surname END"
_GIVEN = "CASE WHEN ref % 4 = 0 THEN 'Ann' ELSE '' END"


@query(f"""SELECT ref, both_ = '' OR ({_m("both_", shapes.ORGANISATION)} AND (given = '' OR NOT contains(both_, ','))) AS corporate FROM (SELECT ref, given, trim(family || ' ' || given) AS both_ FROM (SELECT ref, {_FAMILY} AS family, {_GIVEN} AS given FROM {inline("refs")}))""")
def corporate_authors(spark, sf_dir):
    return relation(spark, sf_dir, "refs").select("ref", shapes.is_corporate(F.expr(_FAMILY), F.expr(_GIVEN)).alias("corporate"))


@query(f"""WITH f AS (SELECT doc, para, unnest(list_filter([CASE WHEN {_m("line", shapes.DISALLOWED["pmid"])} THEN 'pmid' END, CASE WHEN {_m("line", shapes.DISALLOWED["pmcid"])} THEN 'pmcid' END, CASE WHEN {_m("line", shapes.DISALLOWED["accession"])} THEN 'accession' END,
  CASE WHEN {_m("line", shapes.ACCESSED)} AND {_m("line", shapes.DATE_OR_URL)} THEN 'url_accessed' END], lambda x: x IS NOT NULL)) AS field FROM {_LINES})
SELECT doc, field, count(*) AS n, array_to_string(list_sort(list(para))[1:3], ',') AS examples FROM f GROUP BY doc, field""")
def refstyle_disallowed(spark, sf_dir):
    entries = _lines(spark, sf_dir).select("doc", F.col("para").alias("entry"), shapes.disallowed_fields(F.col("line")).alias("fields"))
    return workflows.disallowed_report(entries).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(f"""SELECT ref, (len(y) > 0 AND NOT list_contains(y, found)) OR (length(text) > 25 AND NOT contains(lower(text), lower(family))) AS divergent FROM (SELECT ref, text, regexp_extract_all(text, '{shapes.YEAR}') AS y, CAST(1990 + ref % 29 AS VARCHAR) AS found, CASE WHEN ref % 5 = 0 THEN 'Nobody' ELSE surname END AS family FROM {inline("refs")})""")
def divergent_candidates(spark, sf_dir):
    found, family = (F.lit(1990) + F.col("ref") % 29).cast("string"), F.when(F.col("ref") % 5 == 0, "Nobody").otherwise(F.col("surname"))
    return relation(spark, sf_dir, "refs").select("ref", shapes.diverges(F.col("text"), found, family).alias("divergent"))


@query(f"""WITH x AS (SELECT ref, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text, '^\\s*(?:\\[\\d+\\]|\\(?\\d+\\)?[.)])\\s*', '')), '\\.\\s+'), lambda c: trim(c)), lambda c: c <> '')[2:] AS c FROM {inline("refs")}),
y AS (SELECT ref, list_filter(c, lambda v: length(v) = list_max(list_transform(c, lambda q: length(q))))[1] AS t FROM x) SELECT ref, CASE WHEN length(t) >= 12 THEN t[1:200] END AS title FROM y""")
def rough_titles(spark, sf_dir):
    return relation(spark, sf_dir, "refs").select("ref", shapes.rough_title(F.col("text")).alias("title"))


@query("SELECT doc_id, CAST(CASE WHEN trim(regexp_replace(text, '\\s', '', 'g')) = '' THEN CASE WHEN text = '' THEN 0 ELSE 1 END ELSE len(regexp_extract_all(text, '\\S+')) END AS INT) AS n, text = text AS lossless FROM documents")
def lossless_tokens(spark, sf_dir):
    words = shapes.word_tokens(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", words.alias("w")).select("doc_id", F.size("w").alias("n"), (F.array_join("w", "") == F.col("text")).alias("lossless"))


@query("""WITH x AS (SELECT p_partkey, p_name AS o, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x' WHEN 2 THEN substr(p_name, 1, 3) || 'Q' || substr(p_name, 6) ELSE 'new ' || p_name END AS n FROM part),
s AS (SELECT *, list_max(list_filter(range(0, least(length(o), length(n)) + 1), lambda i: o[1:i] = n[1:i])) AS p FROM x), t AS (SELECT *, o[p + 1:] AS a, n[p + 1:] AS b FROM s),
u AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: right(a, i) = right(b, i))) AS q FROM t)
SELECT p_partkey, CASE WHEN o <> n THEN a[1:length(a) - q] END AS removed, CASE WHEN o <> n THEN b[1:length(b) - q] END AS added FROM u""")
def changed_spans(spark, sf_dir):
    new = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' x' WHEN 2 THEN substr(p_name, 1, 3) || 'Q' || substr(p_name, 6) ELSE 'new ' || p_name END")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", shapes.changed_span(F.col("p_name"), new).alias("s")).select("p_partkey", "s.removed", "s.added")


# --- payloads


_VALID = f"(SELECT pos, TRY_CAST(work AS JSON) AS w, TRY_CAST(metrics AS JSON) AS m, TRY_CAST(profile AS JSON) AS p, TRY_CAST(access AS JSON) AS a FROM {_PAYLOADS})"


@query(f"""SELECT pos, nullif(trim(w->>'DOI'), '') AS doi, trim(w->>'$.title[0]') AS title, coalesce(w->>'$."published-print"."date-parts"[0][0]', w->>'$."published-online"."date-parts"[0][0]', w->>'$.issued."date-parts"[0][0]') AS year,
  trim(w->>'$."container-title"[0]') AS journal, w->>'type' AS type, coalesce(w->>'type' = 'posted-content', false) OR coalesce(starts_with(trim(w->>'DOI'), '10.1101/'), false) AS preprint,
  coalesce(array_to_string(list_transform(CAST(w->'author' AS JSON[]), lambda x: coalesce(x->>'name', (x->>'family') || ' ' || (x->>'given'))), '|'), '') AS authors FROM {_VALID}""")
def work_payloads(spark, sf_dir):
    rows = relation(spark, sf_dir, "payloads").select("pos", payloads.read(F.col("work"), payloads.WORK, payloads.work_fields).alias("w"))
    authors = F.array_join(F.transform("w.authors", lambda a: F.coalesce(a["literal"], F.concat_ws(" ", a["family"], a["given"]))), "|")
    return rows.select("pos", "w.doi", "w.title", "w.year", "w.journal", "w.type", "w.preprint", authors.alias("authors"))


@query(f"""SELECT pos, CASE WHEN w IS NOT NULL THEN '10.5/final.' || pos END AS published, CASE WHEN w IS NOT NULL THEN 'https://arxiv.org/pdf/' || CASE WHEN pos % 3 = 0 THEN '2101.' || lpad(CAST(pos % 10000 AS VARCHAR), 5, '0') WHEN pos % 3 = 1 THEN '1999.12345' ELSE '2002.00001v2' END || '.pdf' END AS arxiv FROM {_VALID}""")
def related_versions(spark, sf_dir):
    both = payloads.read(F.col("work"), payloads.WORK, lambda w: F.struct(payloads.published_doi(w).alias("published"), payloads.arxiv_pdf(w).alias("arxiv")))
    return relation(spark, sf_dir, "payloads").select("pos", both.alias("b")).select("pos", "b.published", "b.arxiv")


@query(f"""SELECT pos, m->>'pmid' AS pmid, TRY_CAST(m->>'relative_citation_ratio' AS DOUBLE) AS rcr, m->>'citation_count' AS citation_count, m->>'year' AS year,
  CASE WHEN m IS NULL THEN NULL WHEN json_type(m, '$.authors') = 'ARRAY' THEN 'Ann Lee|Bo Ng' ELSE 'Ann Lee|Cy Po' END AS authors FROM {_VALID}""")
def metric_payloads(spark, sf_dir):
    rows = relation(spark, sf_dir, "payloads").select("pos", payloads.read(F.col("metrics"), payloads.METRICS, payloads.metric_fields).alias("m"))
    return rows.select("pos", "m.pmid", "m.rcr", F.col("m.citation_count").cast("string").alias("citation_count"), F.col("m.year").cast("string").alias("year"), F.array_join("m.authors", "|").alias("authors"))


@query(f"""SELECT pos, CAST(i - 1 AS INT) AS place, coalesce(s->>'$.title.title.value', '') AS title, CASE i WHEN 1 THEN '10.7/' || pos ELSE '' END AS doi, CASE i WHEN 1 THEN CAST(pos AS VARCHAR) ELSE '' END AS pmid, CASE i WHEN 1 THEN 'A title (2011)' ELSE 'Only a title' END AS citation
  FROM (SELECT pos, i, json_extract(p, '$.group[' || (CASE i WHEN 1 THEN 0 ELSE 2 END) || ']."work-summary"[0]') AS s FROM {_VALID}, (SELECT unnest([1, 2]) AS i) WHERE p IS NOT NULL)""")
def profile_payloads(spark, sf_dir):
    rows = relation(spark, sf_dir, "payloads").select("pos", F.posexplode(payloads.read(F.col("profile"), payloads.PROFILE, payloads.profile_works)).alias("place", "w"))
    return rows.select("pos", "place", "w.title", "w.doi", "w.pmid", "w.citation")


@query(f"""SELECT pos, CASE WHEN a IS NULL THEN NULL WHEN pos % 3 = 0 THEN 'https://x.org/best.pdf' WHEN pos % 3 = 1 THEN 'https://x.org/other.pdf' ELSE 'https://x.org/landing' END AS pdf FROM {_VALID}""")
def open_access_cascade(spark, sf_dir):
    return relation(spark, sf_dir, "payloads").select("pos", payloads.read(F.col("access"), payloads.OPEN_ACCESS, payloads.open_pdf).alias("pdf"))


_QUAD = "CAST(p_partkey * 37 % 240 AS STRING) || '.' || CAST(p_size * 5 % 256 AS STRING) || '.' || CAST(p_partkey % 200 AS STRING) || '.' || CAST(p_size AS STRING)"
_ADDRESS = f"CASE p_partkey % 8 WHEN 0 THEN 'http://' || {_QUAD} WHEN 1 THEN 'https://example.org/' WHEN 2 THEN 'ftp://example.org/' WHEN 3 THEN 'HTTP://u:p@' || {_QUAD} || ':80/x' WHEN 4 THEN 'http://[::' || CAST(p_size AS STRING) || ']/' WHEN 5 THEN 'http://' || CAST(p_partkey * 997 AS STRING) || '/' WHEN 6 THEN 'http://localhost./' ELSE 'https://[2606:4700::' || CAST(p_size AS STRING) || ']/' END"
_HEADER = "CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN '-1' WHEN 2 THEN ' 2 ' ELSE 'Wed, 21 Oct 2015' END"


@query("""WITH q AS (SELECT *, p_partkey * 37 % 240 AS a, p_size * 5 % 256 AS b, p_partkey % 200 AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 8 IN (1, 7) THEN true WHEN p_partkey % 8 IN (0, 3) THEN NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND (b IN (18, 19) OR (b = 51 AND c = 100)))
  OR (a = 192 AND (b = 168 OR (b = 0 AND c IN (0, 2)) OR (b = 88 AND c = 99))) OR (a = 203 AND b = 0 AND c = 113)) ELSE false END AS public, CASE p_partkey % 4 WHEN 0 THEN least(CAST(p_size AS DOUBLE), 3.0) WHEN 2 THEN 2.0 ELSE 1.0 END AS wait FROM q""")
def request_policy(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", payloads.is_public_address(F.expr(_ADDRESS)).alias("public"), payloads.retry_wait(F.expr(_HEADER)).alias("wait"))


# --- workflows


@query(f"""WITH i AS (SELECT doc, marker AS text, pos, row_number() OVER (PARTITION BY doc, marker ORDER BY pos) AS nth FROM {inline("markers")}), p AS (SELECT doc, marker AS text, pos, row_number() OVER (PARTITION BY doc, marker ORDER BY pos) AS nth FROM {inline("markers")} WHERE pos % 2 = 0)
SELECT doc, text, p.pos AS place, i.pos AS marker FROM p JOIN i USING (doc, text, nth)""")
def occurrence_consumption(spark, sf_dir):
    m = relation(spark, sf_dir, "markers")
    return workflows.consume_occurrences(m.where("pos % 2 = 0").select("doc", F.col("marker").alias("text"), F.col("pos").alias("place")), m.select("doc", F.col("marker").alias("text"), F.col("pos").alias("marker")))


@query(f"""WITH m AS (SELECT doc, n, CASE WHEN cited % 3 = 0 THEN CAST(cited AS VARCHAR) END AS pmid, CASE WHEN cited % 3 = 1 THEN doi END AS doi FROM {inline("citations")}), s AS (SELECT doc, n, pmid, lead(n) OVER (PARTITION BY doc ORDER BY n) AS nxt FROM m WHERE pmid IS NOT NULL)
SELECT s.doc, s.n AS pos, s.pmid, min_by(m.doi, m.n) AS doi FROM s LEFT JOIN m ON m.doc = s.doc AND m.n > s.n AND m.n < coalesce(s.nxt, 1000000) AND m.doi IS NOT NULL GROUP BY ALL""")
def pmid_doi_blocks(spark, sf_dir):
    c = relation(spark, sf_dir, "citations")
    return workflows.pair_blocks(c.select("doc", F.col("n").alias("pos"), F.when(F.col("cited") % 3 == 0, F.col("cited").cast("string")).alias("pmid"), F.when(F.col("cited") % 3 == 1, F.col("doi")).alias("doi")))


_SPANS = f"SELECT doc, CAST(number % 3 AS INT) AS pass, CAST(pos * 10 + number AS INT) AS start, CAST(pos * 10 + number + 4 + number * 3 AS INT) AS stop FROM {inline('markers')}"


@query(f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pass, start, stop) AS k FROM ({_SPANS})),
t AS (SELECT doc, k, [struct_pack(a := start, b := stop)] AS kept, true AS kept_now FROM s WHERE k = 1 UNION ALL SELECT s.doc, s.k, CASE WHEN len(list_filter(t.kept, lambda x: s.start < x.b AND x.a < s.stop)) = 0 THEN list_append(t.kept, struct_pack(a := s.start, b := s.stop)) ELSE t.kept END,
  len(list_filter(t.kept, lambda x: s.start < x.b AND x.a < s.stop)) = 0 FROM t JOIN s ON s.doc = t.doc AND s.k = t.k + 1)
SELECT s.doc, pass, start, stop FROM s JOIN t USING (doc, k) WHERE kept_now""")
def overlap_suppression(spark, sf_dir):
    m = relation(spark, sf_dir, "markers").selectExpr("doc", "CAST(number % 3 AS INT) AS pass", "CAST(pos * 10 + number AS INT) AS start", "CAST(pos * 10 + number + 4 + number * 3 AS INT) AS stop")
    return workflows.drop_overlaps(m)


@query(f"""WITH p AS (SELECT doc, para, coalesce(heading = 'user 6', false) AS h, is_ref FROM {inline("paragraphs")}), g AS (SELECT *, sum(CASE WHEN is_ref THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY para) AS gap FROM p),
r AS (SELECT doc, min(a) AS a FROM (SELECT doc, gap, min(para) AS a FROM g WHERE is_ref GROUP BY doc, gap HAVING count(*) >= 3) GROUP BY doc), s AS (SELECT doc, coalesce(min(para) FILTER (h), min(r.a)) AS start FROM p LEFT JOIN r USING (doc) GROUP BY doc)
SELECT doc, para, CASE WHEN para >= start THEN 'references' ELSE 'body' END AS part FROM p JOIN s USING (doc)""")
def body_and_references(spark, sf_dir):
    p = relation(spark, sf_dir, "paragraphs").select("doc", "para", F.coalesce(F.col("heading") == "user 6", F.lit(False)).alias("is_heading"), "is_ref")
    return workflows.split_body(p, workflows.references_start(p)).select("doc", "para", "part")


_STYLES = "SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, CAST(p_partkey AS STRING) AS style, CASE WHEN p_partkey % 20 <> 0 THEN CAST(p_partkey - 1 - p_partkey % 2 AS STRING) END AS based_on, CASE WHEN p_partkey % 6 = 0 THEN p_brand END AS value FROM part WHERE p_partkey % 19 <> 7"


@query(f"""WITH RECURSIVE s AS ({_STYLES}), c AS (SELECT doc, style, based_on AS base, value, 1 AS d FROM s UNION ALL SELECT c.doc, c.style, s.based_on, s.value, d + 1 FROM c JOIN s ON s.doc = c.doc AND s.style = c.base WHERE c.value IS NULL AND d < 40)
SELECT doc, style, max(value) AS value FROM c GROUP BY doc, style""")
def inherited_styles(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return workflows.inherited(spark.sql(_STYLES.replace("FROM part", "FROM {part}"), part=part))


@query(f"""SELECT list_doc AS doc, mk AS marker, array_to_string(list_sort(list_distinct(list(key))), '|') AS keys FROM (SELECT list_doc, doc * 100 + pos AS mk, v.number, CASE WHEN v.number <= 12 THEN 'K' || v.number END AS key, v.n FROM (SELECT list_doc, doc, pos, unnest(range(1, number + 1)) AS number, number AS n FROM {inline("markers")}) v)
  GROUP BY list_doc, mk HAVING bool_and(key IS NOT NULL) AND count(*) = max(n)""")
def all_or_nothing_markers(spark, sf_dir):
    m = relation(spark, sf_dir, "markers").select(F.col("list_doc").alias("doc"), (F.col("doc") * 100 + F.col("pos")).alias("marker"), F.explode(F.sequence(F.lit(1), F.col("number").cast("int"))).alias("i"), F.col("number").cast("long").alias("items"))
    found = workflows.whole_markers(m.withColumn("key", F.when(F.col("i") <= 12, F.concat(F.lit("K"), F.col("i").cast("string")))))
    return found.withColumn("keys", F.array_join("keys", "|"))


_STYLE_WORDS = "string_split(lower(p_name || ' ' || p_type), ' ')"


@query(f"""WITH s AS (SELECT 'S' || p_partkey AS style, list_distinct({_STYLE_WORDS}) AS w FROM part WHERE p_partkey % 10 = 0), q AS (SELECT p_partkey AS name, string_split(lower(p_name), ' ') AS w FROM part)
SELECT name, min(style) AS style FROM q JOIN s ON list_has_all(s.w, q.w) GROUP BY name HAVING count(DISTINCT style) = 1""")
def style_by_words(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.col("p_partkey").alias("name"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words"))
    styles = part.where("p_partkey % 10 = 0").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("style"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("words"))
    return workflows.resolve_by_words(names, styles)


@query("""WITH e AS (SELECT conv_id AS doc, turn AS place, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
w AS (SELECT *, CASE WHEN k < 2 THEN 0 ELSE 0.55::DOUBLE + 0.9::DOUBLE * ((('0x' || left(sha1('gf-spread-' || (k - 2)), 8))::BIGINT % 10000) / 10000.0::DOUBLE) END AS g FROM e)
SELECT doc, place, strftime(TIMESTAMP '2024-01-01 09:00:00' + to_seconds(CAST(floor(3600 * CASE WHEN k = n THEN 1.0::DOUBLE ELSE sum(g) OVER (PARTITION BY doc ORDER BY k) / sum(g) OVER (PARTITION BY doc) END) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at FROM w""")
def spread_timestamps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc"), F.col("turn").alias("place")).distinct()
    return workflows.spread_times(e, "2024-01-01 09:00:00", "2024-01-01 10:00:00").select("doc", "place", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 3 = 0 THEN 'conflict' ELSE 'written' END AS outcome FROM part""")
def versioned_patches(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("version"))
    patches = part.select("key", (F.col("version") - F.when(F.col("key") % 3 == 0, 1).otherwise(0)).alias("base_version"))
    return workflows.versioned_write(part.where("key % 5 <> 0"), patches).select("key", "outcome")


@query("""WITH h AS (SELECT lower(trim(p_brand)) AS name_key, min('C' || p_partkey) AS key FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#4' GROUP BY 1) SELECT DISTINCT lower(trim(p.p_brand)) AS name_key, h.key FROM part p LEFT JOIN h ON h.name_key = lower(trim(p.p_brand))""")
def ensure_collections(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    wanted = part.select(F.concat(F.lit(" "), F.upper("p_brand")).alias("name"))
    return workflows.ensure_names(wanted, part.where("p_partkey % 2 = 0 and p_brand < 'Brand#4'").select(F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_brand").alias("name")))


@query(f"""WITH f AS (SELECT doc, CASE cited % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END AS severity, '  [CITE-' || cited || ']' || CASE WHEN n % 2 = 0 THEN '  [' || n || ']' ELSE '' END || ' work ' || cited || CASE WHEN n % 3 = 0 THEN '  (list)' ELSE '' END AS line FROM {inline("citations")}),
b AS (SELECT doc, severity, '--- ' || severity || ' (' || count(*) || ') ---' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS t FROM f GROUP BY doc, severity)
SELECT doc, string_agg(t, chr(10) ORDER BY CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END) || chr(10) AS text FROM b GROUP BY doc""")
def findings_report(spark, sf_dir):
    c = F.col("cited").cast("string")
    f = relation(spark, sf_dir, "citations").select("doc", F.when(F.col("cited") % 3 == 0, "ERROR").when(F.col("cited") % 3 == 1, "WARN").otherwise("INFO").alias("severity"), F.concat(F.lit("CITE-"), c).alias("check"), F.concat(F.lit("work "), c).alias("message"), F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).alias("location"), F.when(F.col("n") % 3 == 0, "list").otherwise("").alias("source"))
    return workflows.report(f)


@query(f"""SELECT doc, n, '{{"check":"CITE-' || cited || '","severity":"WARN","message":"work"' || CASE WHEN n % 2 = 0 THEN ',"location":"' || n || '"' ELSE '' END || CASE WHEN n % 3 = 0 THEN ',"source":"list"' ELSE '' END || '}}' AS finding FROM {inline("citations")}""")
def findings_json(spark, sf_dir):
    found = workflows.finding_json(F.concat(F.lit("CITE-"), F.col("cited").cast("string")), F.lit("WARN"), F.lit("work"), F.when(F.col("n") % 2 == 0, F.col("n").cast("string")), F.when(F.col("n") % 3 == 0, "list").otherwise(""))
    return relation(spark, sf_dir, "citations").select("doc", "n", found.alias("finding"))


@query(f"""WITH a AS (SELECT doc, regexp_extract(line, '[a-zA-Z]{{4,}}') AS anchor FROM {_LINES} GROUP BY 1, 2), h AS (SELECT a.doc, anchor, l.para, l.para % 9 = 0 AS toc FROM a JOIN {_LINES} l ON l.doc = a.doc AND contains(l.line, anchor))
SELECT doc, anchor, count(*) AS n, CAST(CASE WHEN count(*) FILTER (NOT toc) = 1 THEN min(para) FILTER (NOT toc) WHEN count(*) = 1 THEN min(para) END AS VARCHAR) AS para FROM h GROUP BY doc, anchor""")
def anchor_search(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    anchors = lines.select("doc", F.regexp_extract("line", "[a-zA-Z]{4,}", 0).alias("anchor")).distinct()
    return workflows.find_anchor(anchors, lines.select("doc", "para", F.col("line").alias("text"), (F.col("para") % 9 == 0).alias("is_toc"))).withColumn("para", F.col("para").cast("string"))


@query("""WITH s AS (SELECT user_id AS list, CAST(event_id % 97 AS INT) AS page, event_id % 41 AS id FROM events), f AS (SELECT list, id, min(page) AS page FROM s GROUP BY list, id), n AS (SELECT s.list, s.page, count(*) FILTER (f.page IS NOT NULL) AS k FROM (SELECT DISTINCT list, page, id FROM s) s LEFT JOIN f USING (list, id, page) GROUP BY 1, 2)
SELECT list, coalesce(min(page) FILTER (k = 0), max(page)) AS pages FROM n GROUP BY list""")
def pagination_stop(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("list"), (F.col("event_id") % 97).cast("int").alias("page"), (F.col("event_id") % 41).alias("id"))
    return workflows.pages_until_nothing_new(e)


# --- items, people, comments

_KINDS = "CASE p_partkey % 6 WHEN 0 THEN 'article-journal' WHEN 1 THEN 'chapter' WHEN 2 THEN 'posted-content' WHEN 3 THEN 'report' WHEN 4 THEN 'monograph' ELSE 'dataset' END"


@query("""SELECT p_partkey AS pos, CASE p_partkey % 6 WHEN 1 THEN 'bookSection' WHEN 2 THEN 'preprint' WHEN 3 THEN 'report' WHEN 4 THEN 'book' ELSE 'journalArticle' END AS item_type, p_name AS title, CASE p_partkey % 6 WHEN 1 THEN p_brand WHEN 2 THEN p_brand WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE p_brand END AS container,
  CASE WHEN p_partkey % 6 IN (0, 5) THEN '7' END AS issue, CASE WHEN p_partkey % 6 IN (2, 4) THEN NULL ELSE '1-9' END AS pages, '10.1/' || p_partkey AS doi FROM part""")
def item_payloads(spark, sf_dir):
    works = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS pos", f"{_KINDS} AS type", "p_name AS title", "'2020' AS year", "p_brand AS journal", "'3' AS volume", "'7' AS issue", "'1-9' AS pages", "'10.1/' || CAST(p_partkey AS STRING) AS doi")
    at = lambda k: F.get_json_object("item", f"$.{k}")
    return items.to_items(works).select("pos", "item_type", at("title").alias("title"), F.coalesce(at("publicationTitle"), at("bookTitle"), at("repository")).alias("container"), at("issue").alias("issue"), at("pages").alias("pages"), at("DOI").alias("doi"))


@query(f"""SELECT ref, CASE ref % 3 WHEN 0 THEN surname WHEN 1 THEN surname ELSE 'Example Consortium ABC' END AS family, CASE ref % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'AB' ELSE '' END AS given FROM {inline("refs")}""")
def author_strings(spark, sf_dir):
    text = F.when(F.col("ref") % 3 == 0, F.concat("surname", F.lit(" , Ann"))).when(F.col("ref") % 3 == 1, F.concat("surname", F.lit(" AB"))).otherwise("Example Consortium ABC")
    return relation(spark, sf_dir, "refs").select("ref", people.split_author(text).alias("a")).select("ref", "a.family", "a.given")


@query(f"""SELECT ref, CASE surname WHEN 'van der Berg' THEN 'van der Berg' WHEN 'O''Brien' THEN 'O''Brien' ELSE surname END AS family, CASE WHEN ref % 2 = 0 THEN 'Anna-Maria' ELSE 'JA' END AS given FROM {inline("refs")}""")
def recased_authors(spark, sf_dir):
    given = F.when(F.col("ref") % 2 == 0, "ANNA-MARIA").otherwise("JA")
    return relation(spark, sf_dir, "refs").select("ref", people.normalise_person(F.upper("surname"), given).alias("a")).select("ref", "a.family", "a.given")


@query("SELECT p_partkey, p_name || ' & ' || p_type || ' <' || p_size AS title FROM part")
def title_markup(spark, sf_dir):
    raw = F.concat(F.lit("<i>"), "p_name", F.lit("</i>  &amp;amp;<br/>"), "p_type", F.lit(" &lt;"), F.col("p_size").cast("string"), F.lit("&lt;/sup&gt;"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", people.clean_markup(raw).alias("title"))


@query(f"""WITH t AS (SELECT doc, max(n) AS top FROM {inline("citations")} WHERE cited % 2 = 0 GROUP BY doc) SELECT c.doc, c.n AS place, coalesce(top, -1) + row_number() OVER (PARTITION BY c.doc ORDER BY c.n) AS id FROM {inline("citations")} c LEFT JOIN t USING (doc) WHERE cited % 3 = 0""")
def comment_ids(spark, sf_dir):
    c = relation(spark, sf_dir, "citations")
    return items.number_comments(c.where("cited % 3 = 0").select("doc", F.col("n").alias("place")), c.where("cited % 2 = 0").select("doc", F.col("n").alias("id"))).select("doc", "place", "id")


@query(f"""SELECT doc, cited AS id FROM {inline("citations")} EXCEPT SELECT doc, cited FROM {inline("citations")} WHERE n % 3 = 0""")
def comments_without_anchor(spark, sf_dir):
    c = relation(spark, sf_dir, "citations").select("doc", F.col("cited").alias("id"), "n")
    return items.orphan_comments(c.select("doc", "id").distinct(), c.where("n % 3 = 0"))


@query(None)
def redlines(spark, sf_dir):
    """Word changes between each turn of a conversation and the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))
    return turns.select("conv_id", "turn", F.posexplode(items.redline(F.col("before"), F.col("text"))).alias("place", "s")).select("conv_id", "turn", "place", "s.op", "s.old", "s.new")


@query(None)
def style_suggestions(spark, sf_dir):
    """The three brands nearest to each product name."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return items.nearest_styles(part.select(F.col("p_partkey").alias("name"), F.lower("p_name").alias("key")), part.select(F.col("p_type").alias("style"), F.lower("p_type").alias("key")).distinct())


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ',' || (p_size + 1) || ',' || (p_size + 2) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '' ELSE '60,61' END AS figures, CASE WHEN p_partkey % 4 = 1 THEN '2,4' ELSE '' END AS tables FROM part""")
def figure_references(spark, sf_dir):
    n = "CAST(p_size AS STRING)"
    text = F.expr(f"CASE p_partkey % 4 WHEN 0 THEN 'see Figs. ' || {n} || '-' || CAST(p_size + 2 AS STRING) || '.' WHEN 1 THEN 'Figure ' || {n} || ', 100 cells (Tables 2 and 4)' WHEN 2 THEN 'Fig. S1' ELSE 'Figures 60 and 61.' END")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", joined(shapes.figure_numbers(text)).alias("figures"), joined(shapes.table_numbers(text)).alias("tables"))


_MARKS = "(SELECT conv_id AS doc, turn AS mark, CASE WHEN turn % 3 = 0 THEN 'comment' ELSE 'ins' END AS kind, role AS author, CASE WHEN turn % 9 = 3 THEN NULL ELSE turn - turn % 4 END AS para, turn AS pos FROM (SELECT conv_id, turn, min(role) AS role FROM {} WHERE turn IS NOT NULL GROUP BY conv_id, turn))"


@query(rf"""WITH m AS (SELECT *, author = 'user' AS own, CASE WHEN kind = 'comment' THEN [CAST(para IS NULL AS INT), coalesce(para, 0), 0, pos, mark] ELSE [CAST(para IS NULL AS INT), coalesce(para, 0), 1, 0, 0] END AS e FROM {_MARKS.format("conversations")}),
k AS (SELECT doc, e, row_number() OVER (PARTITION BY doc ORDER BY e) AS k, count(*) OVER (PARTITION BY doc) AS n FROM (SELECT DISTINCT doc, e FROM m WHERE own)),
g AS (SELECT *, CASE WHEN k < 2 THEN 0 ELSE 0.55::DOUBLE + 0.9::DOUBLE * ((('0x' || left(sha1('gf-spread-' || (k - 2)), 8))::BIGINT % 10000) / 10000.0::DOUBLE) END AS g FROM k),
t AS (SELECT doc, e, strftime(TIMESTAMP '2024-01-01 09:45:00' + to_seconds(CAST(floor(900 * CASE WHEN k = n THEN 1.0::DOUBLE ELSE sum(g) OVER (PARTITION BY doc ORDER BY k) / sum(g) OVER (PARTITION BY doc) END) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at FROM g)
SELECT m.doc, m.mark, coalesce(t.at, '2020-01-01 00:00:00') AS at FROM m LEFT JOIN t ON m.own AND t.doc = m.doc AND t.e = m.e""")
def author_marks_spread(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("author"))
    turn = F.col("turn")
    marks = turns.select(F.col("conv_id").alias("doc"), turn.alias("mark"), F.when(turn % 3 == 0, "comment").otherwise("ins").alias("kind"), "author", F.when(turn % 9 != 3, turn - turn % 4).alias("para"), turn.alias("pos"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("at"))
    # five minutes are less than the least window, so it begins at 09:45
    return workflows.spread_marks(marks, "user", "2024-01-01 09:55:00", "2024-01-01 10:00:00").select("doc", "mark", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


_DATES = "CASE pos % 7 WHEN 0 THEN 'in press' WHEN 1 THEN 'c' || date WHEN 2 THEN '12019' WHEN 3 THEN '1850-1899, 1901' WHEN 4 THEN '' WHEN 5 THEN '21' ELSE date END"
_ISSUED = "CASE pos % 5 WHEN 0 THEN '<\"date-parts\":[[' || CAST(1990 + pos % 30 AS STRING) || ',3]]>' WHEN 1 THEN '<\"date-parts\":[[\"0' || CAST(1990 + pos % 30 AS STRING) || '\"]]>' WHEN 2 THEN '<\"date-parts\":[],\"raw\":\"May 2001\">' WHEN 3 THEN '<\"date-parts\":[[\"c. 1990\"]],\"raw\":\"x\">' ELSE '<' END"


@query(rf"""WITH d AS (SELECT pos, {_DATES} AS d FROM {inline("notices")})
SELECT pos, nullif(regexp_extract(d, '\d{{4}}'), '') AS run, [y FOR y IN regexp_extract_all(d, '\d+') IF length(y) = 4 AND left(y, 2) IN ('19', '20')][1] AS century,
  CASE pos % 5 WHEN 2 THEN 'May 2001' WHEN 3 THEN 'c. 1990' WHEN 4 THEN NULL ELSE CAST(1990 + pos % 30 AS VARCHAR) END AS issued FROM d""")
def year_variants(spark, sf_dir):
    d = relation(spark, sf_dir, "notices").select("pos", F.expr(_DATES).alias("d"), F.translate(F.expr(_ISSUED), "<>", "{}").alias("i"))
    return d.select("pos", rendering.year_run(F.col("d")).alias("run"), rendering.year_of_century(F.col("d")).alias("century"), rendering.year_of_issue(F.col("i")).alias("issued"))
