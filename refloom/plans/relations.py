"""Bibliographic relations projected out of the given tables, as SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_N = "CAST({} AS STRING)"
_SURNAME = "CASE p_partkey % 7 WHEN 0 THEN 'Smith' WHEN 1 THEN 'García' WHEN 2 THEN 'O''Brien' WHEN 3 THEN 'van der Berg' WHEN 4 THEN 'Müller' WHEN 5 THEN 'Lee' ELSE 'Østergård' END"

SQL = {
    "lib_items": """
SELECT p_partkey AS pos, 'K' || lpad(CAST(p_partkey AS STRING), 7, '0') AS key, p_name || ' ' || p_type || ' ' || p_brand AS title,
  CASE WHEN p_partkey % 4 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.1234/P.' || CAST(p_partkey AS STRING) WHEN 1 THEN ' 10.1234/p.' || CAST(p_partkey AS STRING)
    ELSE 'HTTP://DX.DOI.ORG/10.1234/P.' || CAST(p_partkey AS STRING) || ').' END END AS doi, CAST(NULL AS STRING) AS pmid,
  CASE p_partkey % 4 WHEN 1 THEN 'note' || chr(10) || 'DOI: 10.1234/P.' || CAST(p_partkey AS STRING) WHEN 2 THEN 'PMID: ' || CAST(10000000 + p_partkey AS STRING) ELSE '' END AS extra
FROM {part}""",
    "citations": """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS n, l_partkey AS cited,
  CASE l_linenumber % 3 WHEN 0 THEN 'https://doi.org/10.1234/p.' WHEN 1 THEN '10.1234/P.' ELSE 'HTTP://dx.doi.org/10.1234/(x)' END || CAST(l_partkey AS STRING)
    || CASE l_linenumber % 5 WHEN 0 THEN '.' WHEN 1 THEN ');' WHEN 2 THEN '' WHEN 3 THEN '(1)' ELSE '].,' END AS doi
FROM {lineitem}""",
    "notices": """
SELECT event_id AS pos, '10.1234/P.' || CAST(event_id % (SELECT count(*) FROM {part}) AS STRING) || CASE event_id % 3 WHEN 0 THEN '' ELSE '.' END AS doi,
  CASE event_type WHEN 'signup' THEN 'Reinstatement' WHEN 'purchase' THEN 'Retraction' WHEN 'error' THEN 'Expression of concern' WHEN 'click' THEN ' correction' ELSE 'Comment' END AS nature,
  CASE WHEN event_id % 17 = 0 THEN 'soon' WHEN event_id % 4 = 0 THEN CAST(2000 + event_id * 7 % 23 AS STRING) || '-' || CAST(1 + event_id % 12 AS STRING) || '-' || CAST(1 + event_id % 28 AS STRING)
    WHEN event_id % 4 = 1 THEN CAST(1 + event_id % 12 AS STRING) || '/' || CAST(1 + event_id % 28 AS STRING) || '/' || CAST(2000 + event_id * 7 % 23 AS STRING)
    WHEN event_id % 4 = 2 THEN CAST(1 + event_id % 12 AS STRING) || '/' || CAST(1 + event_id % 28 AS STRING) || '/' || CAST(2000 + event_id * 7 % 23 AS STRING) || ' 0:00'
    ELSE CAST(2000 + event_id * 7 % 23 AS STRING) || '-' || lpad(CAST(1 + event_id % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || 'T01:02:03Z' END AS date,
  'Notice ' || CAST(event_id AS STRING) AS title, '10.9999/r.' || CAST(event_id AS STRING) AS notice_doi
FROM {events}""",
    "refs": f"""
SELECT p_partkey AS ref, CAST(floor(p_partkey / 20) AS BIGINT) AS doc, CAST(p_partkey % 20 + 1 AS INT) AS number, {_SURNAME} AS surname, CAST(1990 + p_partkey % 30 AS STRING) AS year,
  CASE p_partkey % 11 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS suffix, p_name || ' ' || p_type AS title,
  CASE p_partkey % 3 WHEN 0 THEN 'Journal of ' || p_brand ELSE p_brand || '.' END AS journal, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS volume,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE CAST(p_partkey % 12 + 1 AS STRING) END AS issue, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '1-' || CAST(p_size AS STRING) END AS pages,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(10000000 + p_partkey AS STRING) ELSE '' END AS pmid, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '10.1234/p.' || CAST(p_partkey AS STRING) END AS doi,
  CASE WHEN p_partkey % 9 = 4 THEN '' ELSE CAST(p_partkey % 20 + 1 AS STRING) || '. ' END || {_SURNAME} || ' AB, Other CD. ' || p_name || '. ' || p_brand || '. '
    || CASE WHEN p_partkey % 13 = 5 THEN '' ELSE CAST(1990 + p_partkey % 30 AS STRING) || ';5(3):1-9. ' END
    || CASE p_partkey % 5 WHEN 0 THEN 'doi:10.1234/P.' || CAST(p_partkey AS STRING) || '. https://doi.org/10.1234/p.' || CAST(p_partkey AS STRING) || ';' WHEN 1 THEN 'PMID: ' || CAST(p_partkey AS STRING) || ' PMC' || CAST(p_partkey AS STRING) || ', pmc' || CAST(p_partkey AS STRING) WHEN 2 THEN 'arXiv: 2101.' || lpad(CAST(p_partkey % 10000 AS STRING), 5, '0')
      WHEN 3 THEN 'ISBN 978-0-306-40615-7, doi: 10.1101/2020.' || CAST(p_partkey AS STRING) || ').' ELSE 'ISBN: 0-306-40615-X' END AS text
FROM {{part}}""",
    "paragraphs": """
SELECT conv_id AS doc, CAST(turn AS INT) AS para, CAST(turn % 5 + 1 AS INT) AS number, (conv_id + turn) % 4 <> 0 AS is_ref, (conv_id + turn) % 4 = 0 AND turn % 2 = 0 AS filler_ok, role, text,
  CASE WHEN turn % 3 = 0 THEN role || ' ' || CAST(turn AS STRING) END AS heading
FROM (SELECT conv_id, min(turn) AS turn, min(role) AS role, min(text) AS text FROM {conversations} GROUP BY conv_id, turn)""",
    "changelog": """
SELECT event_id AS version, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type || ':' || CAST(event_id AS STRING) AS payload FROM {events}""",
    "markers": """
SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS pos, l_linenumber AS number, l_quantity > 45 AS boundary,
  CASE l_linenumber % 4 WHEN 0 THEN '[' || CAST(l_partkey % 20 + 1 AS STRING) || ']' WHEN 1 THEN '[' || CAST(l_partkey % 9 + 1 AS STRING) || ',' || CAST(l_partkey % 20 + 1 AS STRING) || ']'
    WHEN 2 THEN '[' || CAST(l_partkey % 9 + 1 AS STRING) || '-' || CAST(l_partkey % 20 + 1 AS STRING) || ']' ELSE '(' || CAST(l_partkey % 5 + 1 AS STRING) || ', ' || CAST(l_partkey % 5 + 2 AS STRING) || '-' || CAST(l_partkey % 500 + 2 AS STRING) || ')' END AS marker,
  CAST(floor(l_partkey / 20) AS BIGINT) AS list_doc
FROM {lineitem}""",
    "lines": """
SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc, p_partkey AS para, CASE p_partkey % 20 WHEN 0 THEN 'Results were significant (p < 0.05) with OR = 1.8 and SD 2' WHEN 1 THEN '2.1 ' || p_name WHEN 2 THEN 'Table ' || CAST(p_size AS STRING) || '. ' || p_type
    WHEN 3 THEN 'Fig. 3 shows ' || p_name || '.' WHEN 4 THEN '[12] Smith AB, Jones C. ' || p_name || '. J ' || p_brand || '. 2019;5:1-9. PMID: 123' WHEN 5 THEN 'van der Berg H. ' || p_name || ' ' || p_type || '. Brain. 2001. Accessed May 2, 2020.'
    WHEN 6 THEN 'ENIGMA Consortium. ' || p_name || ' ' || p_type || ' and more. 2012. PMCID: PMC55' WHEN 7 THEN 'World Health Organization. ' || p_name || '. Geneva; 1999. accession GSE1' WHEN 8 THEN 'See doi.org/10.1016/j.x.2019.5678 for ' || p_name
    WHEN 9 THEN 'Methods. ' || p_name || ' in 2014 and later years were taken from the list.' WHEN 10 THEN 'Adapted from Smith AB, Jones C. 2010.' WHEN 11 THEN '3. Lee K and Ng P. ' || p_name || ' 2020' WHEN 12 THEN p_name
    WHEN 13 THEN 'the p-value, standard error and 95% CI of ' || p_name || ' (odds ratio 2)' WHEN 14 THEN '(4) ' || p_name || ' PMC123 https://x.org/2011' WHEN 15 THEN '' WHEN 16 THEN 'Cohen et al. found that ' || p_name || ' in 2013.' WHEN 17 THEN '7) First step'
    WHEN 18 THEN 'Accessed https://x.org' ELSE 'Smith & Co, a study of ' || p_name || ' and ' || p_type || ', 2018' END AS line
FROM {part}""",
    "draft": """
SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS doc, CAST(p_partkey % 25 AS INT) AS para, CASE p_partkey % 25 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'In this study our methods were ' || p_name || '.' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN '' ELSE 'A ' || p_name END WHEN 3 THEN 'They agree (Smith et al., 2019) on ' || p_name
    WHEN 4 THEN CASE p_size % 5 WHEN 0 THEN '2. Methods' WHEN 1 THEN 'Methods and materials' WHEN 2 THEN 'Methods: we took ' || p_name WHEN 3 THEN 'B) Methods. We took ' || p_name ELSE 'About methods' END WHEN 5 THEN 'See https://doi.org/10.1234/P.' || CAST(p_size AS STRING) || '. and (in 2019) ' || p_name WHEN 6 THEN '(2) ' || p_name || ' text of a list'
    WHEN 7 THEN '' WHEN 8 THEN 'Results' WHEN 9 THEN p_name || ' was found in 2015' WHEN 10 THEN '' WHEN 17 THEN CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'References' END WHEN 18 THEN '1. Smith AB, Lee C. On ' || p_name || '. J. 2019;1:2.' WHEN 19 THEN '2. van der Berg H, Ng P, Roe R. ' || p_name || '. 2020' WHEN 20 THEN '[3] ENIGMA Group. ' || p_name WHEN 21 THEN 'Lee K, ' || p_name
    WHEN 23 THEN CASE WHEN p_size % 4 = 0 THEN 'Acknowledgements' ELSE p_name END ELSE p_name || ' and more of ' || p_type END AS text,
  CASE WHEN p_partkey % 25 = 4 AND p_size % 3 = 1 THEN 'Heading 2' WHEN p_partkey % 25 IN (11, 12) THEN 'TOC 1' WHEN p_partkey % 25 = 22 AND p_size % 5 = 0 THEN 'Heading1' ELSE 'Normal' END AS style, p_size AS size
FROM {part}""",
    "metas": """
SELECT p_partkey AS pos, CAST(floor(p_partkey / 90) AS BIGINT) AS call, f1 || ' and ' || f2 || ' of the study' AS title, CAST(1990 + p_size AS STRING) AS year,
  CASE WHEN p_partkey % 7 = 3 THEN '' ELSE 'https://doi.org/10.1234/M.' || CAST(p_partkey AS STRING) END AS doi, CASE WHEN p_partkey % 3 = 1 THEN CAST(500000 + p_partkey AS STRING) ELSE '' END AS pmid,
  CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN f1 || ',Ann;' || f2 || ',Bo' WHEN 2 THEN 'Müller,Eva;' || f2 || ',Bo' WHEN 3 THEN '*' || f1 || ' Consortium;' || f1 || ',Ann;' || f2 || ',Bo' WHEN 4 THEN upper(f1) || ',ANN;' || f2 || ',Bo'
    WHEN 5 THEN f1 || ',Ann;' || f2 || ',Bo;Ng,Po' WHEN 6 THEN f1 || ' Working Group,;' || f2 || ',Bo' WHEN 7 THEN f2 || ',Bo;*The Data Group' ELSE f1 || ',Ann' END AS authors,
  CASE WHEN p_partkey % 13 = 5 THEN '' WHEN p_partkey % 13 = 6 THEN f2 || ' alone' WHEN p_partkey % 13 = 7 THEN 'Nothing in common here' ELSE upper(f1) || ': ' || f2 || ' study' END AS rec_title,
  CASE WHEN p_partkey % 17 = 2 THEN '10.1234/other' ELSE '10.1234/m.' || CAST(p_partkey - p_partkey % 2 * (1 - p_partkey % 3 % 2) AS STRING) END AS rec_doi, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(500000 + p_partkey AS STRING) END AS rec_pmid,
  CASE p_partkey % 5 WHEN 0 THEN f1 || ',Ann;' || f2 || ',Bo' WHEN 1 THEN 'Muller,Eva;' || f2 || ',Bo;*Data Group' WHEN 2 THEN f1 || ' Consortium,;' || f1 || ',Ann;' || f2 || ',Bo' WHEN 3 THEN f1 || ',Ann' ELSE '' END AS rec_authors
FROM (SELECT p_partkey, p_size, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS f1, upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS f2 FROM {part})""",
    "ay_markers": """
SELECT p_partkey AS marker, CAST(floor(p_partkey / 12) AS BIGINT) AS doc, CASE p_partkey % 8 WHEN 0 THEN '(' || f1 || ' et al., 20' || y || ')' WHEN 1 THEN '(' || f1 || ' and ' || f2 || ', 20' || y || 'a, b)' WHEN 2 THEN '(' || f1 || ', 2001; ' || f2 || ' & Lee, 20' || y || 'b)'
    WHEN 3 THEN '(' || f1 || ' et al., 2001 and ' || f2 || ' et al., 20' || y || ')' WHEN 4 THEN '(' || f1 || ', n.d.; ' || f2 || ', 2001; 20' || y || ')' WHEN 5 THEN f2 || ' (20' || y || ')' WHEN 6 THEN '(In 20' || y || ' and references therein)' ELSE '(Ó ' || f1 || ', 20' || y || 'a; since then)' END AS text,
  CAST(p_partkey % 12 + 1 AS STRING) || '. ' || CASE p_partkey % 4 WHEN 0 THEN 'de ' || f1 WHEN 1 THEN 'Ó ' || f1 WHEN 2 THEN f2 ELSE f1 END || ' A, Other B. Title. 20' || y || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END || ';1:2-9.' AS entry
FROM (SELECT p_partkey, lpad(CAST(p_size % 4 AS STRING), 2, '0') AS y, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS f1, upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS f2 FROM {part})""",
    "payloads": """
SELECT pos, CASE WHEN pos % 17 = 0 THEN '[' ELSE translate(work, '<>', chr(123) || chr(125)) END AS work, CASE WHEN pos % 13 = 0 THEN 'no' ELSE translate(metrics, '<>', chr(123) || chr(125)) END AS metrics,
  CASE WHEN pos % 11 = 0 THEN '' ELSE translate(profile, '<>', chr(123) || chr(125)) END AS profile, CASE WHEN pos % 19 = 0 THEN '' ELSE translate(access, '<>', chr(123) || chr(125)) END AS access
FROM (SELECT p_partkey AS pos,
  '<"DOI":" ' || CASE WHEN p_partkey % 5 = 0 THEN '10.1101/p.' ELSE '10.1234/p.' END || CAST(p_partkey AS STRING) || '","title":["' || p_name || ' "],"author":[<"family":"Smith","given":"Ann">,<"name":"Data Group">],"issued":<"date-parts":[[' || CAST(1990 + p_size AS STRING) || ']]>'
    || CASE p_partkey % 3 WHEN 0 THEN ',"published-print":<"date-parts":[[2001,2]]>' WHEN 1 THEN ',"published-online":<"date-parts":[[2002]]>' ELSE '' END || ',"container-title":["' || p_brand || '"],"type":"' || CASE p_partkey % 4 WHEN 0 THEN 'posted-content' ELSE 'journal-article' END
    || '","relation":<"has-version":[<"id-type":"doi","id":"10.9/later">],"is-preprint-of":[<"id-type":"doi","id":"10.1101/x">,<"id-type":"doi","id":" 10.5/final.' || CAST(p_partkey AS STRING) || '">'
    || CASE WHEN p_partkey % 3 = 0 THEN ',<"id-type":"arxiv","id":"2101.' || lpad(CAST(p_partkey % 10000 AS STRING), 5, '0') || '">' ELSE '' END || ']>,"alternative-id":["S1"' || CASE WHEN p_partkey % 3 = 1 THEN ',"1999.12345"' ELSE '' END || '],"link":[<"URL":"https://x.org">,<"URL":"http://arxiv.org/abs/2002.00001v2">]>' AS work,
  '<"pmid":' || CAST(p_partkey AS STRING) || ',"relative_citation_ratio":' || CASE p_partkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '0.5' ELSE '"x"' END || ',"citation_count":' || CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE CAST(p_size AS STRING) END || ',"year":2011,"authors":'
    || CASE WHEN p_partkey % 2 = 0 THEN '[<"lastName":"Lee","firstName":"Ann","fullName":" Ann Lee">,<"fullName":"Bo Ng">]' ELSE '"Ann Lee, Cy Po, "' END || '>' AS metrics,
  '<"group":[<"work-summary":[<"title":<"title":<"value":"A title">>,"publication-date":<"year":<"value":"2011">>,"external-ids":<"external-id":[<"external-id-type":"DOI","external-id-value":" 10.7/' || CAST(p_partkey AS STRING) || '">,<"external-id-type":"doi","external-id-value":"10.8/x">,<"external-id-type":"pmid","external-id-value":"'
    || CAST(p_partkey AS STRING) || '">]>>,<"title":null>]>,<"work-summary":[]>,<"work-summary":[<"title":<"title":<"value":"Only a title">>,"publication-date":null,"external-ids":null>]>,<"work-summary":[<"title":null>]>]>' AS profile,
  '<"best_oa_location":<"url_for_pdf":' || CASE WHEN p_partkey % 3 = 0 THEN '"https://x.org/best.pdf"' ELSE 'null' END || ',"url":"https://x.org/landing">,"oa_locations":[<"url_for_pdf":null>' || CASE WHEN p_partkey % 3 = 1 THEN ',<"url_for_pdf":"https://x.org/other.pdf">' ELSE '' END || ']>' AS access FROM {part})""",
    "tokens": """
SELECT doc, 'word/document.xml' AS part, CAST(sum(CASE WHEN kind = 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS INT) AS para, pos, kind, text,
  flag IN (0, 1, 2, 7) AND kind <> 'p' AS in_ins, flag IN (3, 4, 5, 7) AND kind <> 'p' AS in_del, flag = 8 AND kind = 't' AS in_move_from, flag = 9 AND kind = 't' AS in_move_to
FROM (
  SELECT doc, 2 * event_id AS pos, flag, CASE WHEN one IN (0, 1, 2, 3, 4, 5, 6) THEN 'fld' WHEN one IN (7, 8) THEN 'instr' WHEN one = 9 THEN 'p' WHEN one = 10 AND two < 6 THEN 'cstart' WHEN one = 10 AND two < 11 THEN 'cend'
      WHEN one = 10 THEN 'cref' WHEN one = 11 AND two < 6 THEN 'fmt' WHEN one = 12 AND two = 0 AND flag < 4 THEN 'geom' WHEN flag IN (3, 4, 5, 7) THEN 'dt' ELSE 't' END AS kind,
    CASE WHEN one IN (0, 1, 2) THEN 'begin' WHEN one IN (3, 4, 5) THEN 'end' WHEN one = 6 THEN 'separate' WHEN one = 7 THEN CASE WHEN two < 5 THEN 'ADDIN ZOTERO_ITEM ' WHEN two < 10 THEN 'PAGEREF _T' ELSE ' CITATION ' END WHEN one = 8 THEN 'x' || CAST(two AS STRING) || ' '
      WHEN one = 9 THEN CAST(NULL AS STRING) WHEN one = 10 THEN CAST(two AS STRING) WHEN one = 11 AND two < 6 THEN translate('<"scope":"rPr","now":"b ' || CAST(two AS STRING) || '","prior":"i ' || CAST(flag AS STRING) || '">', '<>', chr(123) || chr(125))
      WHEN one = 12 AND two = 0 AND flag < 4 THEN CASE WHEN flag % 2 = 0 THEN 'cellIns' ELSE 'cellMerge' END ELSE event_type || CAST(event_id % 97 AS STRING) || ' ' END AS text
  FROM {hashed}
  UNION ALL SELECT doc, 2 * event_id + 1, flag, 'pmark', CAST(NULL AS STRING) FROM {hashed} WHERE one = 9 AND flag < 6)""",
}

SQL["cited_fields"] = """
SELECT doc, pos, CASE WHEN one = 0 THEN 'ADDIN ZOTERO_ITEM CSL_CITATION ' || chr(123) || '"citationItems":[' WHEN one = 1 THEN 'ADDIN ZOTERO_BIBL x' ELSE 'ADDIN ZOTERO_ITEM CSL_CITATION ' || translate('<"citationID":"c","citationItems":[' || item || CASE WHEN one < 8 THEN ',' || other ELSE '' END || ']>', '<>', chr(123) || chr(125)) || ' x' END AS instruction
FROM (SELECT *, instr('0123456789abcdef', substr(m, 1, 1)) - 1 AS one,
    '<"id":"' || CAST(cited AS STRING) || '","itemData":<' || CASE WHEN substr(m, 2, 1) < '3' THEN '' ELSE '"id":"12/K' || CAST(cited % 50 AS STRING) || '",' END || '"title":" Work ' || CAST(cited AS STRING) || ' ","DOI":"' || CASE WHEN substr(m, 3, 1) < '4' THEN '' ELSE doi END || '"'
      || CASE WHEN substr(m, 4, 1) < '5' THEN ',"PMID":"PMID ' || CAST(cited AS STRING) || '"' WHEN substr(m, 4, 1) < 'a' THEN ',"note":"x PMID: ' || CAST(cited AS STRING) || ' y"' ELSE '' END || ',"author":' || CASE WHEN substr(m, 5, 1) < '4' THEN '"x"' ELSE '[<"family":"F' || CAST(cited AS STRING) || '","given":"A">]' END || '>>' AS item,
    CASE WHEN substr(m, 6, 1) < '4' THEN '<"id":""' ELSE '<"id":"a/b/K' || CAST(cited % 7 AS STRING) || '"' END || ',"itemData":<"doi":"10.1234/O.' || CAST(cited % 90 AS STRING) || '","title":"Other">>' AS other
  FROM (SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS doc, CAST(l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS pos, l_partkey AS cited, md5(CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS m,
    CASE l_linenumber % 3 WHEN 0 THEN 'https://doi.org/10.1234/p.' WHEN 1 THEN '10.1234/P.' ELSE 'HTTP://dx.doi.org/10.1234/(x)' END || CAST(l_partkey % 40 AS STRING) || CASE l_linenumber % 2 WHEN 0 THEN '.' ELSE '' END AS doi FROM {lineitem}))"""
SQL["word_fields"] = """
SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS doc, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS pos, CASE l_linenumber % 3 WHEN 0 THEN ' CITATION ' WHEN 1 THEN 'CITATION ' || chr(92) || 'l 1033 ' ELSE ' ADDIN x ' END || 'Tag' || CAST(l_partkey % 30 AS STRING) || ' ' || chr(92) || 'p 3' AS instruction FROM {lineitem}"""
SQL["word_sources"] = """
SELECT CAST(floor(o_orderkey / 8) AS BIGINT) AS doc, 'customXml/item' || CAST(o_custkey % 3 AS STRING) || '.xml' AS part, CAST(o_orderkey AS INT) AS place, CASE WHEN bad THEN NULL ELSE 'Tag' || CAST(o_custkey % 30 AS STRING) END AS tag, CASE WHEN bad THEN NULL ELSE 'Source ' || CAST(o_orderkey AS STRING) END AS title,
  CASE WHEN NOT bad AND o_orderkey % 2 = 0 THEN '10.1234/s.' || CAST(o_orderkey AS STRING) END AS doi, CASE WHEN NOT bad THEN CAST(1990 + o_orderkey % 30 AS STRING) END AS year, CASE WHEN bad THEN 'ParseError' END AS error
FROM (SELECT *, substr(md5(CAST(o_orderkey AS STRING)), 1, 2) < '0a' AS bad FROM {orders})"""
SQL["migrated"] = """
SELECT pos, call AS source, CASE WHEN h < 9 THEN 'high' WHEN h < 13 THEN 'medium' ELSE 'low' END AS tier, k = 0 AS retracted, title, doi, year, authors, rec_title, rec_doi, rec_pmid, rec_authors, h, k
FROM (SELECT *, instr('0123456789abcdef', substr(md5('t' || CAST(pos AS STRING)), 1, 1)) - 1 AS h, instr('0123456789abcdef', substr(md5('t' || CAST(pos AS STRING)), 2, 1)) - 1 AS k FROM (""" + SQL["metas"] + """))"""
#: The library that records are migrated into: some of the same works.
SQL["migrated_into"] = "SELECT pos, 'L' || CAST(pos AS STRING) AS key, CASE WHEN k < 6 THEN rec_title ELSE 'Item ' || CAST(pos AS STRING) END AS title, CASE WHEN k < 3 THEN doi WHEN k < 5 THEN rec_doi END AS doi, CASE WHEN k = 5 THEN rec_pmid END AS pmid, '' AS extra FROM (" + SQL["migrated"] + ")"

#: Events with three hexadecimal digits of their number's hash.
_HASHED = """(SELECT event_id, event_type, CAST(floor(event_id / 60) AS BIGINT) AS doc, instr('0123456789abcdef', substr(m, 1, 1)) - 1 AS one, instr('0123456789abcdef', substr(m, 2, 1)) - 1 AS two, instr('0123456789abcdef', substr(m, 3, 1)) - 1 AS flag
  FROM (SELECT event_id, event_type, md5(CAST(event_id AS STRING)) AS m FROM {events}))"""
SQL["tokens"] = SQL["tokens"].replace("{hashed}", _HASHED)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of a folder."""
    used = sorted(set(re.findall(r"\{(\w+)\}", SQL[name])))
    return spark.sql(SQL[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def inline(name: str) -> str:
    """The same relation as a subquery for the other engine."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", SQL[name]) + ")"
