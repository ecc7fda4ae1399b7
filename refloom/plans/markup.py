"""Queries over the structure and the tracked changes of documents. The oracles match fields pair by pair and fold token by token."""

from __future__ import annotations

from pyspark.sql import functions as F

from refloom.operators import revisions, sections, workflows
from refloom.plans.registry import query
from refloom.plans.relations import inline, relation

_T = f"""t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS place, kind = 'fld' AND text = 'begin' AS opens, kind = 'fld' AND text = 'end' AS closes FROM {inline("tokens")}),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY place) AS balance FROM t),
f AS (SELECT b.doc, b.place AS first, any_value(b.in_ins) AS ins, any_value(b.in_del) AS del, min(e.place) AS last FROM s b LEFT JOIN s e ON e.doc = b.doc AND e.closes AND e.place > b.place AND e.balance < b.balance WHERE b.opens GROUP BY b.doc, b.place)"""


@query(rf"""WITH {_T},
up AS (SELECT c.doc, c.first, max(p.first) AS parent, count(p.first) + 1 AS level FROM f c LEFT JOIN f p ON p.doc = c.doc AND p.first < c.first AND coalesce(p.last > c.first, true) GROUP BY c.doc, c.first),
own AS (SELECT t.doc, t.place, t.kind, t.text, t.in_del, max(f.first) AS owner FROM t JOIN f ON f.doc = t.doc AND f.first < t.place AND coalesce(f.last > t.place, true) WHERE t.kind = 'instr' OR (t.kind = 'fld' AND t.text = 'separate') GROUP BY ALL),
cut AS (SELECT doc, owner, min(place) AS cut FROM own WHERE kind = 'fld' GROUP BY ALL),
code AS (SELECT o.doc, o.owner, string_agg(text, '' ORDER BY place) FILTER (NOT in_del) AS code, string_agg(text, '' ORDER BY place) AS instruction FROM own o LEFT JOIN cut c ON c.doc = o.doc AND c.owner = o.owner WHERE kind = 'instr' AND coalesce(place < cut, true) GROUP BY o.doc, o.owner),
w AS (SELECT f.doc, f.first, last, cut, level, parent, coalesce(code, '') AS code, coalesce(instruction, '') AS instruction, list_filter(regexp_split_to_array(trim(coalesce(instruction, '')), '\s+'), lambda x: x <> '') AS words
  FROM f JOIN up ON up.doc = f.doc AND up.first = f.first LEFT JOIN cut ON cut.doc = f.doc AND cut.owner = f.first LEFT JOIN code ON code.doc = f.doc AND code.owner = f.first WHERE last IS NOT NULL)
SELECT doc, first AS "begin", coalesce(cut, -1) AS separate, last AS "end", level, coalesce(parent, -1) AS parent, coalesce(CASE WHEN words[1] = 'ADDIN' THEN words[2] ELSE words[1] END, '') AS kind, code, instruction, last - first AS members, row_number() OVER (PARTITION BY doc ORDER BY last) AS rank FROM w""")
def nested_fields(spark, sf_dir):
    found = revisions.nested_fields(relation(spark, sf_dir, "tokens")).drop("part")
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("separate", "parent")})


_MENDED = f"""{_T},
around AS (SELECT s.doc, s.place, list({{'ins': f.ins, 'del': f.del, 'wraps': 0, 'stuck': false}} ORDER BY f.last) AS fs FROM s JOIN f ON f.doc = s.doc AND f.first < s.place AND f.last >= s.place GROUP BY s.doc, s.place),
fold AS (SELECT s.*, list_reduce(list_prepend({{'ins': in_ins, 'del': in_del, 'wraps': 0, 'stuck': false}}, coalesce(fs, [])), lambda a, x: CASE
    WHEN x.ins AND NOT (a.ins OR in_move_to) AND (a.del OR in_move_from) THEN {{'ins': a.ins, 'del': a.del, 'wraps': a.wraps, 'stuck': true}}
    ELSE {{'ins': a.ins OR (x.ins AND NOT in_move_to), 'del': a.del OR (x.del AND NOT in_move_from), 'wraps': a.wraps + CAST((x.ins AND NOT (a.ins OR in_move_to)) OR (x.del AND NOT (a.del OR in_move_from)) AS INT), 'stuck': a.stuck}} END) AS m
  FROM s LEFT JOIN around a ON a.doc = s.doc AND a.place = s.place)"""


@query(f"WITH {_MENDED} SELECT doc, pos, m.ins AS in_ins, m.del AS in_del, m.wraps > 0 AS fixed, m.stuck AS stuck FROM fold WHERE m.wraps > 0 OR m.stuck")
def mended_tracking(spark, sf_dir):
    return revisions.fix_tracking(relation(spark, sf_dir, "tokens")).where("fixed or stuck").select("doc", "pos", "in_ins", "in_del", "fixed", "stuck")


@query(f"""WITH {_MENDED},
pairs AS (SELECT x.doc, f.last AS field, b.m.ins AND NOT (x.m.ins OR x.in_move_to) AS ins, b.m.del AND NOT (x.m.del OR x.in_move_from) AS del, x.m.del OR x.in_move_from AS struck FROM fold x JOIN f ON f.doc = x.doc AND f.first < x.place AND f.last >= x.place JOIN fold b ON b.doc = f.doc AND b.place = f.first)
SELECT doc, field AS "end", count(*) AS loose, count(*) FILTER (ins AND struck) AS stuck FROM pairs WHERE ins OR del GROUP BY doc, field""")
def loose_after_mending(spark, sf_dir):
    """What the repair leaves: fields whose loose runs are all stuck."""
    mended = revisions.fix_tracking(relation(spark, sf_dir, "tokens")).drop("fixed", "stuck")
    return revisions.loose_runs(mended).drop("part")


def _resolved(view: str) -> str:
    gone = "in_del OR in_move_from" if view == "accepted" else "in_ins OR in_move_to"
    into = "k.para" if view == "accepted" else "(SELECT min(q.para) FROM kept q WHERE q.doc = k.doc AND q.para >= k.para AND (NOT q.joins OR q.para = (SELECT max(z.para) FROM kept z WHERE z.doc = k.doc)))"
    return f"""SELECT x.doc, '{view}' AS view, 'resolved' AS status, {into} AS para, coalesce(string_agg(x.text, '' ORDER BY pos) FILTER (kind IN ('t', 'dt')), '') AS text,
  coalesce(string_agg(kind || x.text, ' ' ORDER BY pos) FILTER (kind IN ('cstart', 'cend', 'cref')), '') AS marks, coalesce(string_agg(CASE WHEN kind = 'fmt' THEN json_extract_string(x.text, '$.{"now" if view == "accepted" else "prior"}') END, ';' ORDER BY pos), '') AS props
  FROM live x JOIN kept k ON k.doc = x.doc AND k.para = x.para WHERE kind IN ('cstart', 'cend', 'cref', 'p') OR NOT ({gone}) GROUP BY 1, 2, 3, 4
  HAVING {"true" if view == "accepted" else "count(*) FILTER (kind NOT IN ('p', 'pmark')) > 0 OR NOT bool_and(joins)"}"""


@query(f"""WITH t AS (SELECT * FROM {inline("tokens")}), no AS (SELECT DISTINCT doc FROM t WHERE kind = 'geom'), live AS (SELECT * FROM t WHERE doc NOT IN (SELECT doc FROM no)),
kept AS (SELECT doc, para, coalesce(bool_or(kind = 'pmark' AND in_ins), false) AS joins FROM live GROUP BY doc, para)
{_resolved("accepted").replace("kind IN ('cstart', 'cend', 'cref', 'p')", "kind IN ('cstart', 'cend', 'cref', 'p', 'pmark')")} UNION ALL {_resolved("rejected").replace("kind IN ('cstart', 'cend', 'cref', 'p')", "kind IN ('cstart', 'cend', 'cref', 'p', 'pmark')")}
UNION ALL SELECT doc, v, 'refused', -1, CAST(count(*) AS VARCHAR), '', '' FROM t, (VALUES ('accepted'), ('rejected')) AS x(v) WHERE doc IN (SELECT doc FROM no) GROUP BY doc, v""")
def resolved_changes(spark, sf_dir):
    tokens = relation(spark, sf_dir, "tokens")
    out = None
    for view in ("accepted", "rejected"):
        rows = revisions.resolve_all(tokens, view == "accepted").withColumn("view", F.lit(view))
        inorder = lambda cond, x, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", x.alias("x"))))), lambda z: z["x"]), sep)
        refused = F.col("status") == "refused"
        found = rows.groupBy("doc", "view", "status", F.when(refused, -1).otherwise(F.col("para")).alias("para")).agg(
            F.when(F.first("status") == "refused", F.count(F.lit(1)).cast("string")).otherwise(inorder((F.col("kind") == "t") & ~refused, F.col("text"), "")).alias("text"),
            inorder(F.col("kind").isin(*revisions.COMMENT_MARKS) & ~refused, F.concat("kind", "text"), " ").alias("marks"),
            inorder((F.col("kind") == "props") & ~refused, F.col("text"), ";").alias("props"),
        )
        out = found if out is None else out.unionByName(found)
    return out


_EDITS = """(SELECT CAST(floor(l_partkey / 25) AS BIGINT) AS doc, CAST(row_number() OVER (PARTITION BY floor(l_partkey / 25) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq, CASE WHEN l_linenumber % 3 = 0 THEN 'delete' ELSE 'insert' END AS op,
  CASE l_suppkey % 6 WHEN 0 THEN 'no such text' WHEN 1 THEN ' and more of ' WHEN 2 THEN 'Results' ELSE p_name END AS anchor, CAST(l_quantity AS INT) % 3 + 1 AS n, 'New ' || l_returnflag || CAST(l_orderkey AS STRING) AS text FROM {lineitem} JOIN {part} ON p_partkey = l_partkey)"""


def _edits(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}
    rows = spark.sql(f"SELECT * FROM {_EDITS}", **tables)
    block = lambda i: F.struct(F.when(i == 1, "Heading 2").alias("style"), F.concat("text", F.lit("."), i.cast("string")).alias("text"))
    return rows.select("doc", "seq", "op", "anchor", F.when(F.col("op") == "insert", F.transform(F.sequence(F.lit(1), F.col("n")), block)).alias("blocks"))


def _placed(spark, sf_dir):
    edits = _edits(spark, sf_dir)
    draft = relation(spark, sf_dir, "draft").withColumn("is_toc", F.col("style").startswith("TOC"))
    return revisions.place_edits(edits, workflows.find_anchor(edits.select("doc", "anchor").distinct(), draft)), draft


_PLACED = f"""edits AS (SELECT * FROM {_EDITS.replace("{", "").replace("}", "")}), draft AS (SELECT * FROM {inline("draft")}),
hits AS (SELECT e.doc, e.anchor, count(*) AS n, count(*) FILTER (style NOT LIKE 'TOC%') AS body, min(para) AS any_, min(para) FILTER (style NOT LIKE 'TOC%') AS one FROM (SELECT DISTINCT doc, anchor FROM edits) e JOIN draft d ON d.doc = e.doc AND contains(text, anchor) GROUP BY 1, 2),
placed AS (SELECT e.*, CASE WHEN body = 1 THEN one WHEN h.n = 1 THEN any_ END AS para, CASE WHEN h.n IS NULL THEN 'not found' WHEN body = 1 OR h.n = 1 THEN 'placed' ELSE 'not unique' END AS status FROM edits e LEFT JOIN hits h ON h.doc = e.doc AND h.anchor = e.anchor)"""


@query(f"WITH {_PLACED} SELECT doc, op, status, count(*) AS n FROM placed GROUP BY ALL")
def edit_outcomes(spark, sf_dir):
    return _placed(spark, sf_dir)[0].groupBy("doc", "op", "status").agg(F.count(F.lit(1)).alias("n"))


# each insert in turn at the front of what already stands behind its paragraph
@query(f"""WITH {_PLACED},
behind AS (SELECT doc, para, list_reduce(list_prepend([], list(list_transform(range(1, n + 1), lambda i: {{'style': CASE WHEN i = 1 THEN 'Heading 2' END, 'text': text || '.' || i}}) ORDER BY seq)), lambda a, x: list_concat(x, a)) AS b FROM placed WHERE op = 'insert' AND para IS NOT NULL GROUP BY doc, para),
rows_ AS (SELECT d.doc, d.para, 0 AS k, CASE WHEN EXISTS (SELECT 1 FROM placed p WHERE p.op = 'delete' AND p.doc = d.doc AND p.para = d.para) AND text <> '' THEN 'delete' ELSE 'keep' END AS op, style, text FROM draft d
  UNION ALL SELECT doc, para, unnest(range(1, len(b) + 1)), 'insert', unnest(b).style, unnest(b).text FROM behind)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY para, k) - 1 AS place, op, coalesce(style, '') AS style, text FROM rows_""")
def edited_paragraphs(spark, sf_dir):
    edits, draft = _placed(spark, sf_dir)
    out = revisions.edit_paragraphs(draft.select("doc", "para", "text", "style"), edits.where("status = 'placed'"))
    return out.select("doc", "place", "op", F.coalesce("style", F.lit("")).alias("style"), "text")


@query(f"""WITH {_T}, own AS (SELECT t.doc, t.place, t.kind, t.text, max(f.first) AS owner FROM t JOIN f ON f.doc = t.doc AND f.first < t.place AND coalesce(f.last > t.place, true) WHERE t.kind = 'instr' OR (t.kind = 'fld' AND t.text = 'separate') GROUP BY ALL),
cut AS (SELECT doc, owner, min(place) AS cut FROM own WHERE kind = 'fld' GROUP BY ALL),
code AS (SELECT o.doc, o.owner, upper(trim(replace(string_agg(text, '' ORDER BY place), 'PAGEREF _T', 'TOC x'))) AS code FROM own o LEFT JOIN cut c ON c.doc = o.doc AND c.owner = o.owner WHERE kind = 'instr' AND coalesce(place < cut, true) GROUP BY o.doc, o.owner),
toc AS (SELECT f.* FROM f JOIN code c ON c.doc = f.doc AND c.owner = f.first WHERE last IS NOT NULL AND (code = 'TOC' OR left(code, 4) = 'TOC ')),
shown AS (SELECT DISTINCT t.doc, t.para FROM t JOIN toc ON toc.doc = t.doc AND toc.first < t.place AND toc.last > t.place WHERE t.kind = 't')
SELECT t.doc, t.para, bool_or(s.doc IS NOT NULL) AS is_toc FROM t LEFT JOIN shown s ON s.doc = t.doc AND s.para = t.para GROUP BY t.doc, t.para""")
def contents_of_tokens(spark, sf_dir):
    t = relation(spark, sf_dir, "tokens").withColumn("text", F.when(F.col("kind") == "instr", F.replace("text", F.lit("PAGEREF _T"), F.lit("TOC x"))).otherwise(F.col("text")))
    return sections.token_contents(t).drop("part")
