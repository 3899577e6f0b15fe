"""Registered queries over blocks inside descriptions.

Each line takes a place in a docblock from its own length: elements, items and code blocks at four indentations, blanks
and prose; or, for tables, the tags of a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import blocks as B
from palimpsest.plans import derived as D
from palimpsest.plans.registry import query

BLOCKS = D.LINES_SQL.strip() + """,
src AS (SELECT doc_id, line_no, CAST(length(text) AS BIGINT) % 9 AS k, CAST(length(text) AS BIGINT) // 9 % 4 * 2 AS indent, text FROM lines),
st AS (SELECT *, coalesce(last_value(CASE k WHEN 5 THEN 1 WHEN 6 THEN 0 END IGNORE NULLS) OVER (
         PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was_open FROM src),
outside AS (SELECT *, k = 7 AS blank, lag(k = 7) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM st WHERE NOT was_open OR k = 6),
runs AS (SELECT *, sum(CASE WHEN k = 0 OR (blank AND before) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM outside),
ev AS (SELECT doc_id, run, line_no, indent, k = 5 AS is_code FROM runs WHERE NOT was_open AND k BETWEEN 1 AND 5),
up AS (SELECT e.*, (SELECT max(p.line_no) FROM ev p WHERE p.doc_id = e.doc_id AND p.run = e.run AND p.line_no < e.line_no AND p.indent < e.indent
         AND NOT EXISTS (SELECT 1 FROM ev q WHERE q.doc_id = e.doc_id AND q.run = e.run AND q.line_no > p.line_no
                         AND q.line_no < e.line_no AND q.indent <= p.indent)) AS above FROM ev e),
climb AS (SELECT doc_id, line_no, above AS owner FROM up
  UNION ALL SELECT c.doc_id, c.line_no, u.above FROM climb c JOIN up u ON u.doc_id = c.doc_id AND u.line_no = c.owner),
owned AS (SELECT u.doc_id, u.run, u.line_no, u.is_code, max(p.line_no) AS owner, count(p.line_no) + 1 AS level
  FROM up u LEFT JOIN climb c ON c.doc_id = u.doc_id AND c.line_no = u.line_no
  LEFT JOIN up p ON p.doc_id = u.doc_id AND p.line_no = c.owner AND NOT p.is_code GROUP BY ALL)
"""


def docblock_lines(t):
    n = F.length("text").cast("bigint")
    k, deep = n % 9, F.repeat(F.lit(" "), (F.floor(n / 9) % 4 * 2).cast("int"))
    form = (F.when(k == 0, F.concat(F.lit("\\effects "), "text")).when(k <= 4, F.concat(deep, F.lit("\\item "), "text"))
            .when(k == 5, F.concat(deep, F.lit("\\codeblock"))).when(k == 6, "\\endcodeblock").when(k == 7, "")
            .otherwise(F.concat(F.lit("  "), "text")))
    return D.doc_lines(t).select("doc_id", "line_no", form.alias("text"))


@query("list_items", f"""
WITH RECURSIVE {BLOCKS.strip()},
parted AS (SELECT *, sum(CASE WHEN is_code AND owner IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM owned),
items AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run, part) AS list_ord FROM parted WHERE NOT is_code),
said AS (SELECT s.*, sum(CASE WHEN was_open OR k < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS talk FROM st s),
texts AS (SELECT doc_id, min(line_no) AS line_no, string_agg(trim(text), ' ' ORDER BY line_no) FILTER (WHERE trim(text) <> '') AS text
          FROM said GROUP BY doc_id, talk)
SELECT doc_id, line_no, list_ord, owner, level, coalesce(text, '') AS text FROM items JOIN texts USING (doc_id, line_no)""")
def list_items(t):
    """Items of lists, those of inner lists with the item around them."""
    return B.list_items(docblock_lines(t))


@query("nested_code", f"""
WITH RECURSIVE {BLOCKS.strip()},
opened AS (SELECT *, last_value(CASE WHEN k = 5 AND NOT was_open THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS code_line,
           CASE k WHEN 0 THEN '\\effects ' || text WHEN 5 THEN repeat(' ', indent) || '\\codeblock' WHEN 7 THEN '' WHEN 8 THEN '  ' || text
           ELSE repeat(' ', indent) || '\\item ' || text END AS raw FROM st),
inside AS (SELECT o.doc_id, o.code_line, o.line_no, o.k, o.raw, c.indent FROM opened o JOIN src c ON c.doc_id = o.doc_id AND c.line_no = o.code_line WHERE o.was_open),
bodies AS (SELECT doc_id, code_line AS line_no, bool_or(k = 6) AS closed, string_agg(
             substr(raw, CAST(least(indent, length(raw) - length(ltrim(raw, ' '))) + 1 AS BIGINT)), chr(10) ORDER BY line_no) FILTER (WHERE k <> 6) AS text
           FROM inside GROUP BY ALL)
SELECT o.doc_id, o.line_no, o.owner, coalesce(b.closed, false) AS closed, coalesce(b.text, '') AS text
FROM owned o LEFT JOIN bodies b USING (doc_id, line_no) WHERE o.is_code""")
def nested_code(t):
    """Code blocks and the items they are in."""
    return B.code_blocks(docblock_lines(t))


TABLE_LINES = D.LINES_SQL.strip() + """,
src AS (SELECT doc_id, line_no, CAST(length(text) AS BIGINT) % 7 AS k, trim(text) AS text FROM lines),
st AS (SELECT *, coalesce(last_value(CASE k WHEN 0 THEN 1 WHEN 6 THEN 0 END IGNORE NULLS) OVER (
         PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was_open FROM src),
held AS (SELECT *, max(CASE WHEN k = 0 AND NOT was_open THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS table_line
         FROM st WHERE was_open OR k = 0),
parts AS (SELECT *, CASE WHEN line_no = table_line THEN 'caption' WHEN k IN (1, 2) THEN 'column' WHEN k = 3 THEN 'row' WHEN k = 4 THEN 'cell' END AS part FROM held),
numbered AS (SELECT *, count(part) OVER w AS nth, count(*) FILTER (WHERE part = 'column') OVER w AS column_no, count(*) FILTER (WHERE part = 'row') OVER w AS row_no
             FROM parts WINDOW w AS (PARTITION BY doc_id, table_line ORDER BY line_no)),
celled AS (SELECT *, count(*) FILTER (WHERE part = 'cell') OVER (PARTITION BY doc_id, table_line, row_no ORDER BY line_no) AS cell_no FROM numbered)
"""


def table_lines(t):
    k = F.length("text").cast("bigint") % 7
    form = F.when(k == 5, F.concat(F.lit("  "), "text")).when(k == 6, "\\endlib2dtab2").otherwise(F.concat(
        F.when(k == 0, F.lit("\\lib2dtab2 ")).when(k <= 2, F.lit("\\column ")).when(k == 3, F.lit("\\row ")).otherwise(F.lit("\\cell ")), "text"))
    return D.doc_lines(t).select("doc_id", "line_no", form.alias("text"))


@query("tag_tables", f"""
WITH {TABLE_LINES.strip()}
SELECT doc_id, table_line, max(part) AS part, max(row_no) AS row_no,
       CASE max(part) WHEN 'column' THEN max(column_no) WHEN 'cell' THEN max(cell_no) ELSE 0 END AS part_no,
       coalesce(string_agg(text, ' ' ORDER BY line_no) FILTER (WHERE text <> ''), '') AS text
FROM celled WHERE (part IS NOT NULL OR k = 5) GROUP BY doc_id, table_line, nth""")
def tag_tables(t):
    """Captions, columns, rows and cells of tables written as tags."""
    return B.tag_tables(table_lines(t))[0]


@query("tag_table_findings", f"""
WITH {TABLE_LINES.strip()},
per_row AS (SELECT doc_id, table_line, row_no, max(cell_no) AS n FROM celled GROUP BY ALL),
whole AS (SELECT doc_id, table_line, max(line_no) AS line_no, max(column_no) AS cols, max(row_no) AS n_rows, arg_max(cell_no, line_no) AS cells, bool_or(k = 6) AS ended
          FROM celled GROUP BY ALL)
SELECT doc_id, line_no, 'error' AS severity, message FROM (
  SELECT doc_id, line_no, '\\column must precede every \\row' AS message FROM celled WHERE part = 'column' AND row_no > 0
  UNION ALL SELECT doc_id, line_no, '\\lib2dtab2 accepts exactly two \\column entries' FROM celled WHERE part = 'column' AND column_no > 2
  UNION ALL SELECT doc_id, line_no, '\\row requires two preceding \\column entries' FROM celled WHERE part = 'row' AND column_no <> 2
  UNION ALL SELECT c.doc_id, c.line_no, 'the preceding \\row requires exactly two \\cell entries; found ' || p.n FROM celled c JOIN per_row p
    ON p.doc_id = c.doc_id AND p.table_line = c.table_line AND p.row_no = c.row_no - 1 WHERE c.part = 'row' AND c.row_no > 1 AND p.n <> 2
  UNION ALL SELECT doc_id, line_no, '\\cell requires a preceding \\row' FROM celled WHERE part = 'cell' AND row_no = 0
  UNION ALL SELECT doc_id, line_no, 'each \\row accepts exactly two \\cell entries' FROM celled WHERE part = 'cell' AND row_no > 0 AND cell_no > 2
  UNION ALL SELECT doc_id, line_no, 'nested \\lib2dtab2 is not allowed' FROM celled WHERE k = 0 AND line_no <> table_line
  UNION ALL SELECT doc_id, line_no, 'missing \\endlib2dtab2' FROM whole WHERE NOT ended
  UNION ALL SELECT doc_id, line_no, '\\lib2dtab2 requires exactly two \\column entries; found ' || cols FROM whole WHERE cols <> 2
  UNION ALL SELECT doc_id, line_no, '\\lib2dtab2 requires at least one \\row' FROM whole WHERE n_rows = 0
  UNION ALL SELECT doc_id, line_no, 'the final \\row requires exactly two \\cell entries; found ' || cells FROM whole WHERE n_rows > 0 AND cells <> 2)""")
def tag_table_findings(t):
    """What is wrong with tables written as tags."""
    return B.tag_tables(table_lines(t))[1]
