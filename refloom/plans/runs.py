"""Queries over runs: reference lists without a heading, and enumerators in sentences. The oracles step row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import ordered
from refloom.plans.registry import query
from refloom.plans.relations import _HASHED, SQL, inline, relation

SQL["run_lines"] = f"""
SELECT CAST(floor(event_id / 50) AS BIGINT) AS doc, CAST(event_id % 50 AS INT) AS para, one < 10 AS is_ref, one > 11 AS filler_ok, CAST(CASE WHEN two < 13 THEN event_id % 50 + 1 WHEN two < 15 THEN 7 END AS INT) AS number, flag = 0 AS blank, flag = 1 AND two < 9 AS excluded FROM {_HASHED}"""
SQL["listing_lines"] = """
SELECT pos, CASE WHEN a < 3 THEN 'We saw ' ELSE 'The patient had ' END || '(' || CASE WHEN b < 13 THEN '1' ELSE '2' END || ')' || CASE WHEN c < 12 THEN ' mild ' ELSE ' Severe ' END || p_name || CASE WHEN d < 5 THEN ', ' WHEN d < 9 THEN '; and ' WHEN d < 12 THEN ' or ' WHEN d < 14 THEN '. ' ELSE ' band ' END
  || '(2)' || CASE WHEN e < 11 THEN ' low ' WHEN e < 13 THEN '' ELSE ', ' END || CASE WHEN f < 9 THEN 'x: ' WHEN f < 12 THEN 'x? ' ELSE 'x ' END || '( 3 ) last' || CASE WHEN g < 6 THEN ', (4) more (1) mild, (2) again' WHEN g < 9 THEN ' [5], and (4) more' ELSE '.' END AS line
FROM (SELECT p_partkey AS pos, p_name, {digits} FROM (SELECT *, md5(CAST(p_partkey AS STRING)) AS m FROM {{part}}))""".replace("{digits}", ", ".join(f"instr('0123456789abcdef', substr(m, {i + 1}, 1)) - 1 AS {c}" for i, c in enumerate("abcdefg"))).replace("{{part}}", "{part}")


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY para) AS k FROM {inline("run_lines")}),
i AS (SELECT *, NOT excluded AND NOT blank AND is_ref AS sure, NOT excluded AND NOT blank AND filler_ok AS maybe FROM p),
s AS (SELECT doc, k, excluded, sure AS inside, CASE WHEN sure THEN para END AS start, CASE WHEN sure THEN 1 ELSE 0 END AS length, CASE WHEN sure THEN number END AS last, CAST(NULL AS INT) AS done, 0 AS done_length FROM i WHERE k = 1
  UNION ALL SELECT i.doc, i.k, i.excluded, x.inside, CASE WHEN x.inside THEN coalesce(s.start, i.para) END, CASE WHEN x.inside THEN s.length + 1 ELSE 0 END, CASE WHEN x.inside THEN coalesce(i.number, s.last) END,
    CASE WHEN NOT i.excluded AND NOT x.inside AND s.length >= 3 THEN s.start END, CASE WHEN NOT i.excluded AND NOT x.inside AND s.length >= 3 THEN s.length ELSE 0 END
  FROM s JOIN i ON i.doc = s.doc AND i.k = s.k + 1, LATERAL (SELECT i.sure OR (i.maybe AND s.start IS NOT NULL AND coalesce(i.number = s.last + 1, false)) AS inside) x),
ends AS (SELECT doc, k, done AS start, done_length AS length FROM s WHERE done IS NOT NULL UNION ALL SELECT doc, k + 1, start, length FROM s WHERE length >= 3 QUALIFY k = max(k) OVER (PARTITION BY doc) AND k = (SELECT max(z.k) FROM p z WHERE z.doc = s.doc))
SELECT doc, arg_max(start, k) AS start, arg_max(length, k) AS length FROM ends GROUP BY doc""")
def reference_runs(spark, sf_dir):
    return ordered.reference_run(relation(spark, sf_dir, "run_lines"))


@query(rf"""WITH t AS (SELECT pos, line, regexp_extract_all(line, '\(\s*(\d+)\s*\)', 1) AS n, string_split_regex(line, '\(\s*\d+\s*\)') AS p FROM {inline("listing_lines")}),
m AS (SELECT pos, unnest(range(0, len(n))) AS i, unnest(n)::INT AS v, p FROM t),
f AS (SELECT *, regexp_matches(ltrim(p[i + 2]), '^\p{{Ll}}') AS item, regexp_matches(rtrim(p[i + 1]), '[:;,]$|\b(and|or)$') AS sep, regexp_matches(p[i + 1], '[.!?]') AS cut FROM m),
a AS (SELECT pos, min(i) AS first FROM f WHERE v = 1 AND item GROUP BY pos),
b AS (SELECT f.pos, first, min(i) FILTER (i > first AND NOT (item AND sep AND NOT cut AND v = (SELECT g.v + 1 FROM f g WHERE g.pos = f.pos AND g.i = f.i - 1))) AS stop, max(i) + 1 AS n FROM f JOIN a ON a.pos = f.pos GROUP BY f.pos, first)
SELECT t.pos, CASE WHEN coalesce(stop, b.n) - first >= 2 THEN array_to_string(range(first, coalesce(stop, b.n)), ',') ELSE '' END AS listed FROM t LEFT JOIN b ON b.pos = t.pos""")
def text_enumerators(spark, sf_dir):
    lines = relation(spark, sf_dir, "listing_lines")
    return lines.select("pos", F.array_join(ordered.text_enumerators(F.col("line")), ",").alias("listed"))
