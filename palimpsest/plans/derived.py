"""Markup, revisions and registers derived from the given tables, in Spark and as the SQL the checks start from.

The given prose carries no markup, so each line takes a markup form from its own length: the same text always
gives the same annotated corpus, and the corpus grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import lines as L

# --- plain lines ----------------------------------------------------------------------------------------------

LINES_SQL = """
split_text AS (
  SELECT doc_id, lang, source,
         CASE WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2)
              ELSE string_split(text, chr(10)) END AS parts
  FROM documents),
lines AS (
  SELECT doc_id, lang, source, unnest(parts) AS text,
         CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no FROM split_text)
"""


def doc_lines(t) -> DataFrame:
    return L.split_lines(t.documents.select("doc_id", "lang", "source", "text"), keep=("lang", "source"))


# --- annotated corpus --------------------------------------------------------------------------------------------

ANNOTATED_SQL = LINES_SQL + """,
cut AS (
  SELECT doc_id, source, line_no, text, CAST(length(text) AS BIGINT) AS n,
         split_part(text, ' ', 1) AS w1,
         CASE WHEN strpos(text, ' ') > 0 THEN split_part(text, ' ', 2) ELSE text END AS w2
  FROM lines),
annotated AS (
  SELECT doc_id, line_no,
    CASE n % 17
      WHEN 0 THEN '/// \\rSec' || CAST((n // 17) % 13 AS VARCHAR) || '[' || source || '.s' || line_no || ']{' ||
             CASE WHEN n // 17 % 2 = 1 THEN 'Of \\tcode{' || w1 || '{}} and ' || text || '} {after}' ELSE text || '}' END
      WHEN 1 THEN '/// END [' || source || '.s' || (line_no - 1 - n % 2) || ']'
      WHEN 2 THEN '//! \\effects ' || text
      WHEN 3 THEN '//! \\returns ' || text
      WHEN 4 THEN '//! \\remarks ' || text
      WHEN 5 THEN '//! \\unknown ' || text
      WHEN 6 THEN '  // \\ref{' || source || '.s' || line_no // 2 || '}'
      WHEN 7 THEN ''
      WHEN 8 THEN '\\indexlibrarymember{' || w1 || '}{' || w2 || '}'
      WHEN 9 THEN '// \\rSec2[' || source || '.s' || n || '] ' || text
      WHEN 10 THEN '//! \\item ' || text
      WHEN 11 THEN '//! \\note ' || text
      WHEN 12 THEN '//! \\endnote'
      WHEN 13 THEN '//! Let `' || w1 || '` be `' || w2 || '`.'
      WHEN 14 THEN '//! std::' || w1 || ' see \\iref{' || source || '.s1} or `' || text
      WHEN 15 THEN '//! ' || w1 || ' :: ' || w2 || ' % ' || text
      ELSE '//! \\throws ' || text END AS raw
  FROM cut)
"""


def annotated(t) -> DataFrame:
    """(doc_id, line_no, raw): each line of the corpus in the markup form its length gives."""
    df = doc_lines(t)
    n, text = F.length("text"), F.col("text")
    w1 = F.split_part(text, F.lit(" "), F.lit(1))
    w2 = F.when(F.instr(text, " ") > 0, F.split_part(text, F.lit(" "), F.lit(2))).otherwise(text)
    name = F.concat(F.col("source"), F.lit(".s"))
    forms = [
        F.concat(F.lit("/// \\rSec"), (F.floor(n / 17) % 13).cast("string"), F.lit("["), name, F.col("line_no"),
                 F.lit("]{"), F.when(F.floor(n / 17) % 2 == 1, F.concat(
                     F.lit("Of \\tcode{"), w1, F.lit("{}} and "), text, F.lit("} {after}"))).otherwise(
                     F.concat(text, F.lit("}")))),
        F.concat(F.lit("/// END ["), name, F.col("line_no") - 1 - n % 2, F.lit("]")),
        F.concat(F.lit("//! \\effects "), text),
        F.concat(F.lit("//! \\returns "), text),
        F.concat(F.lit("//! \\remarks "), text),
        F.concat(F.lit("//! \\unknown "), text),
        F.concat(F.lit("  // \\ref{"), name, F.floor(F.col("line_no") / 2).cast("string"), F.lit("}")),
        F.lit(""),
        F.concat(F.lit("\\indexlibrarymember{"), w1, F.lit("}{"), w2, F.lit("}")),
        F.concat(F.lit("// \\rSec2["), name, n, F.lit("] "), text),
        F.concat(F.lit("//! \\item "), text),
        F.concat(F.lit("//! \\note "), text),
        F.lit("//! \\endnote"),
        F.concat(F.lit("//! Let `"), w1, F.lit("` be `"), w2, F.lit("`.")),
        F.concat(F.lit("//! std::"), w1, F.lit(" see \\iref{"), name, F.lit("1} or `"), text),
        F.concat(F.lit("//! "), w1, F.lit(" :: "), w2, F.lit(" % "), text),
    ]
    raw = F.concat(F.lit("//! \\throws "), text)
    for i in reversed(range(len(forms))):
        raw = F.when(n % 17 == i, forms[i]).otherwise(raw)
    return df.select("doc_id", "line_no", raw.alias("raw"))


# --- revisions ---------------------------------------------------------------------------------------------------

REVISED_SQL = LINES_SQL + """,
old_lines AS (SELECT doc_id, line_no, text FROM lines),
edited AS (
  SELECT doc_id, line_no, CAST(length(text) AS BIGINT) % 9 AS k, text,
         strpos(text, ' ') AS gap FROM lines),
edited_lines AS (
  SELECT doc_id, line_no, 0 AS sub, CASE k
           WHEN 1 THEN 'Revised' || CASE WHEN gap > 0 THEN substr(text, gap) ELSE '' END
           WHEN 3 THEN CASE WHEN gap > 0 THEN substr(text, gap + 1) || ' ' || substr(text, 1, gap - 1) ELSE text END
           ELSE text END AS text
  FROM edited WHERE k <> 0
  UNION ALL
  SELECT doc_id, line_no, 1, 'Added ' || line_no || ' after ' || text FROM edited WHERE k = 2),
new_lines AS (
  SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sub) AS BIGINT) AS line_no
  FROM edited_lines)
"""


def revisions(t) -> DataFrame:
    """(doc_id, old_text, new_text): each document and a revision whose edits its own lines decide."""
    return revised(t.documents)


def revised(docs: DataFrame) -> DataFrame:
    def edit(line):
        k, gap = F.length(line) % 9, F.instr(line, " ")
        rest = F.substring(line, gap + 1, F.length(line))
        return (F.when(k == 1, F.concat(F.lit("Revised"), F.when(gap > 0, F.concat(F.lit(" "), rest)).otherwise("")))
                .when((k == 3) & (gap > 0), F.concat(rest, F.lit(" "), F.substring(line, F.lit(1), gap - 1)))
                .otherwise(line))

    def revised(line, i):
        k = F.length(line) % 9
        return (F.when(k == 0, F.array().cast("array<string>"))
                .when(k == 2, F.array(line, F.concat(F.lit("Added "), i + 1, F.lit(" after "), line)))
                .otherwise(F.array(edit(line))))

    new = F.flatten(F.transform(F.split("text", "\n", -1), revised))
    return docs.select("doc_id", F.col("text").alias("old_text"), F.array_join(new, "\n").alias("new_text"))


def revision_lines(t) -> tuple[DataFrame, DataFrame]:
    """The lines of the old and of the new revision; a revision with no line left has none."""
    both = revisions(t)
    old = L.split_lines(both.select("doc_id", F.col("old_text").alias("text")))
    new = L.split_lines(both.filter(F.col("new_text") != "").select("doc_id", F.col("new_text").alias("text")))
    return old, new
