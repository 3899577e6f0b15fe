"""Registered queries over spans, edits, rendered text, fragments, papers and saved documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X
from palimpsest.operators import diff as R
from palimpsest.operators import edits as ED
from palimpsest.operators import fragments as FR
from palimpsest.operators import lines as L
from palimpsest.operators import ordered as O
from palimpsest.operators import render as RN
from palimpsest.operators import sections as S
from palimpsest.operators import spans as P
from palimpsest.plans import derived as D
from palimpsest.plans.registry import query
from palimpsest.plans.structure import TREE, heads_of
from palimpsest.plans.text import ANNOTATED, HEADS, LINES, STRIPPED
from palimpsest.sources import documents as SD
from palimpsest.streaming import relint

# --- spans --------------------------------------------------------------------------------------------------------

LINE_SPANS = LINES + """,
offs AS (SELECT doc_id, line_no, text, CAST(coalesce(sum(length(text) + 1) OVER (
  PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM lines),
spans AS (SELECT o.doc_id, o.line_no AS span_ord, off AS "begin",
  CAST(off + length(o.text) + CASE WHEN length(o.text) % 13 = 0 THEN 5 ELSE 0 END - CASE WHEN length(o.text) % 11 = 0 THEN length(o.text) + 3 ELSE 0 END AS BIGINT) AS "end",
  CAST(length(d.text) AS BIGINT) AS n, strpos(o.text, ' ') = 0 AS one_word FROM offs o JOIN documents d USING (doc_id))
"""


def line_spans(t):
    lines = L.line_offsets(D.doc_lines(t))
    n = F.length("text")
    total = F.max(F.col("offset") + n).over(Window.partitionBy("doc_id"))
    end = F.col("offset") + n + F.when(n % 13 == 0, 5).otherwise(0) - F.when(n % 11 == 0, n + 3).otherwise(0)
    return lines.select("doc_id", F.col("line_no").alias("span_ord"), F.col("offset").cast("bigint").alias("begin"),
                        end.cast("bigint").alias("end"), total.cast("bigint").alias("length"),
                        (F.instr("text", " ") == 0).alias("one_word"))


@query("span_findings", f"""
WITH {LINE_SPANS}, p AS (SELECT *, row_number() OVER w - 1 AS i, lag("end") OVER w AS prev FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY span_ord))
SELECT doc_id, span_ord, 'inverted' AS defect, 'span ' || i || ' is inverted: begin ' || "begin" || ' > end ' || "end" AS message FROM p WHERE "begin" > "end"
UNION ALL SELECT doc_id, span_ord, 'past_end', 'span ' || i || ' end ' || "end" || ' exceeds text length ' || n FROM p WHERE "end" > n
UNION ALL SELECT doc_id, span_ord, 'overlap', 'span ' || i || ' begins at ' || "begin" || ', before span ' || (i - 1) || ' ends at ' || prev FROM p WHERE "begin" < prev""")
def span_findings(t):
    return P.span_findings(line_spans(t), ["doc_id"])


@query("valid_spans", f"""
WITH RECURSIVE {LINE_SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "begin", span_ord) AS k FROM spans
  WHERE "begin" <= "end" AND "end" <= n),
walk AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS span_ord, FALSE AS took FROM (SELECT DISTINCT doc_id FROM r)
  UNION ALL SELECT r.doc_id, r.k, CASE WHEN r."begin" >= w.pos THEN r."end" ELSE w.pos END, r.span_ord, r."begin" >= w.pos
  FROM walk w JOIN r ON r.doc_id = w.doc_id AND r.k = w.k + 1)
SELECT doc_id, span_ord FROM walk WHERE took""")
def valid_spans(t):
    return P.valid_spans(line_spans(t), ["doc_id"]).select("doc_id", "span_ord")


# Long words of every text, as spans to be redacted.
WORD_SPANS = r"""
ws AS (SELECT doc_id, regexp_extract_all(text, '^[ \t\r\n]+|[^ \t\r\n]+[ \t\r\n]*', 0) AS w FROM documents),
we AS (SELECT doc_id, CAST(generate_subscripts(w, 1) AS BIGINT) AS pos, unnest(w) AS word FROM ws)
"""


def long_words(t):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    words = L.words(t.documents.select("doc_id", "text"), ["doc_id"])
    placed = words.withColumn("begin", F.coalesce(F.sum(F.length("word")).over(w), F.lit(0)).cast("bigint"))
    core = F.length(X.rstripped("word"))
    sized = placed.filter(core > 12).join(t.documents.select("doc_id", F.length("text").cast("bigint").alias("length")), "doc_id")
    return sized.select("doc_id", F.col("pos").alias("span_ord"), "begin", (F.col("begin") + core).alias("end"), "length")


@query("redacted_spans", rf"""
WITH {WORD_SPANS} SELECT doc_id, md5(string_agg(CASE WHEN length(regexp_replace(word, '[ \t\r\n]+$', '')) > 12
  THEN '[' || length(regexp_replace(word, '[ \t\r\n]+$', '')) || ']' || regexp_extract(word, '([ \t\r\n]*)$', 1) ELSE word END, '' ORDER BY pos)) AS text
FROM we GROUP BY doc_id""")
def redacted_spans(t):
    out = P.substitute(t.documents.select("doc_id", "text"), long_words(t), ["doc_id"], lambda span, covered: F.concat(
        F.lit("["), F.length(covered).cast("string"), F.lit("]")))
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("masked_and_recovered", "SELECT doc_id, md5(text) AS text FROM documents")
def masked_and_recovered(t):
    masked, table = P.mask(t.documents.select("doc_id", "text"), long_words(t), ["doc_id"])
    return P.recover(masked, table, ["doc_id"]).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


RUNS = LINE_SPANS + """,
runs AS (SELECT doc_id, "begin" AS run_begin, "end" AS run_end, CASE WHEN span_ord % 2 = 0 THEN 'added' ELSE 'removed' END AS change FROM spans),
inner_spans AS (SELECT doc_id, span_ord, "begin" + 2 AS "begin", "begin" + 2 + n % 40 AS "end" FROM spans)
"""


@query("spans_in_runs", f"""
WITH {RUNS} SELECT s.doc_id, s.span_ord, r.run_begin, r.change FROM inner_spans s JOIN runs r
  ON r.doc_id = s.doc_id AND s."begin" >= r.run_begin AND s."end" <= r.run_end AND s."begin" <= s."end\"""")
def spans_in_runs(t):
    spans = line_spans(t)
    runs = spans.select("doc_id", "begin", "end", F.when(F.col("span_ord") % 2 == 0, "added").otherwise("removed").alias("change"))
    inner = spans.select("doc_id", "span_ord", (F.col("begin") + 2).alias("begin"),
                         (F.col("begin") + 2 + F.col("length") % 40).alias("end"))
    return P.spans_in_runs(inner, runs, ["doc_id"]).select("doc_id", "span_ord", "run_begin", "change")


# Every line is an edit of its own text; one that is a single word also dominates what stands near it.
EDITS = LINE_SPANS + """,
edits AS (SELECT doc_id, "begin", "end", 'x' || span_ord AS replacement FROM spans WHERE "begin" <= "end"),
dominant AS (SELECT doc_id, "begin" + 3 AS "begin", "end" + 20 AS "end" FROM spans WHERE one_word)
"""


def span_edits(t):
    return line_spans(t).filter("begin <= end").select(
        "doc_id", "begin", "end", F.concat(F.lit("x"), "span_ord").alias("replacement"))


@query("dominated_edits", f"""
WITH {EDITS} SELECT doc_id, "begin", "end", replacement FROM edits e WHERE NOT EXISTS (
  SELECT 1 FROM dominant d WHERE d.doc_id = e.doc_id AND e."begin" < d."end" AND d."begin" < e."end")""")
def dominated_edits(t):
    dominant = line_spans(t).filter("one_word").select("doc_id", (F.col("begin") + 3).alias("begin"), (F.col("end") + 20).alias("end"))
    return P.drop_dominated(span_edits(t), dominant, ["doc_id"])


@query("shifted_offsets", f"""
WITH {EDITS} SELECT o.doc_id, o.off AS "offset", CAST(o.off + coalesce(sum(length(e.replacement) - (e."end" - e."begin")), 0) AS BIGINT) AS moved
FROM offs o LEFT JOIN edits e ON e.doc_id = o.doc_id AND e."end" <= o.off GROUP BY o.doc_id, o.off""")
def shifted_offsets(t):
    points = L.line_offsets(D.doc_lines(t)).select("doc_id", F.col("offset").cast("bigint").alias("offset"))
    return P.shift_offsets(points, span_edits(t), ["doc_id"])


@query("edits_back_to_front", f"""
WITH {EDITS} SELECT doc_id, string_agg("begin" || '-' || "end", ',' ORDER BY "begin" DESC, "end" DESC) AS edits
FROM (SELECT DISTINCT doc_id, "begin", "end" FROM edits) GROUP BY doc_id""")
def edits_back_to_front(t):
    return P.back_to_front(span_edits(t).select("doc_id", "begin", "end"), ["doc_id"]).select(
        "doc_id", F.array_join(F.transform("edits", lambda e: F.concat(e["begin"], F.lit("-"), e["end"])), ",").alias("edits"))


@query("edit_rejects", f"""
WITH {EDITS}, c AS (SELECT e.*, length(d.text) AS n, max("end") OVER (PARTITION BY doc_id ORDER BY "begin", "end", replacement
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT DISTINCT * FROM edits) e JOIN documents d USING (doc_id))
SELECT doc_id, "begin", "end", 'an edit of bytes ' || "begin" || ' to ' || "end" || ' overlaps another or runs past the end' AS message
FROM c WHERE "begin" < coalesce(prev, 0) OR "end" > n""")
def edit_rejects(t):
    return P.apply_edits(t.documents.select("doc_id", "text"), span_edits(t), ["doc_id"])[1]


@query("planned_edits", f"""
WITH {D.REVISED_SQL}, w AS (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY line_no) AS text FROM new_lines GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(w.text, '')) AS text FROM documents d LEFT JOIN w USING (doc_id)""")
def planned_edits(t):
    """The old sources with the edits planned from the revision diff applied: the new sources."""
    old, new = D.revision_lines(t)
    nodes = R.diff_nodes(old, new, ["doc_id"])
    # The source is its lines with a newline after each; a NULL text has none.
    texts = t.documents.select("doc_id", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(
        F.coalesce(F.concat("text", F.lit("\n")), F.lit(""))).alias("text"))
    done, _ = P.apply_edits(texts, ED.plan_edits(nodes, old, ["doc_id"]), ["doc_id"])
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("reconciled_attributes", f"""
WITH {LINES}, w AS (SELECT doc_id, string_agg(CASE WHEN length(text) % 3 = 0 THEN 'constexpr ' ELSE '' END || CASE WHEN length(text) % 7 = 0 THEN 'explicit ' ELSE '' END
  || text || CASE WHEN length(text) % 4 = 0 THEN ' noexcept' ELSE '' END, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id)
SELECT doc_id, md5(text) AS text FROM w""")
def reconciled_attributes(t):
    """Listings whose attribute words are put right from their declarations."""
    n = F.length("text")
    lines = D.doc_lines(t).withColumn("_n", n)
    listed = lines.select("doc_id", "line_no", "_n", F.concat(
        F.when(F.col("_n") % 2 == 0, "constexpr ").otherwise(""), "text",
        F.when(F.col("_n") % 5 == 0, " noexcept").otherwise("")).alias("text"))
    placed = L.line_offsets(listed).select("doc_id", F.col("line_no").alias("i"), F.col("offset").cast("bigint").alias("begin"), "text", "_n")
    declared = placed.select("doc_id", "i", (F.col("_n") % 3 == 0).alias("c"), (F.col("_n") % 7 == 0).alias("e"), (F.col("_n") % 4 == 0).alias("x"))
    edits, _ = ED.reconcile(placed.drop("_n"), declared, ["doc_id"], {"constexpr": "c", "explicit": "e", "noexcept": "x"})
    texts = listed.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"))
    done, _ = P.apply_edits(texts, edits, ["doc_id"])
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


# --- rendering ----------------------------------------------------------------------------------------------------

PIECES = STRIPPED + r""",
worded AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '^[ \t]*\\[a-z0-9-]+') THEN trim(regexp_replace(text, '^[ \t]*\\[a-z0-9-]+(\([^)]*\))?', ''))
  ELSE text END AS text FROM stripped WHERE vocab = 'markup'),
pl AS (SELECT doc_id, line_no, regexp_extract_all(text, '`[^`]*`|`[^`]*$|\\iref\{[^}]*\}|[^`\\]+', 0) AS ps FROM worded),
pe AS (SELECT doc_id, line_no, CAST(generate_subscripts(ps, 1) AS BIGINT) AS ord, unnest(ps) AS p FROM pl),
pieces AS (SELECT doc_id, line_no, ord,
  CASE WHEN regexp_matches(p, '^`[^`]*`$') THEN 'code' WHEN p LIKE '`%' THEN 'open_code' WHEN p LIKE '\iref{%' THEN 'iref' ELSE 'text' END AS kind,
  CASE WHEN regexp_matches(p, '^`[^`]*`$') THEN p[2:-2] WHEN p LIKE '`%' THEN p[2:] WHEN p LIKE '\iref{%' THEN p[7:-2] ELSE p END AS text FROM pe)
"""


def pieces(t):
    return L.pieces(L.wording(D.annotated(t)), ["doc_id", "line_no"])


@query("rendered_markdown", f"""
WITH {PIECES} SELECT doc_id, line_no, string_agg(CASE kind WHEN 'code' THEN '`' || text || '`' WHEN 'iref' THEN '([' || text || ']{{- .sref}})' ELSE text END, '' ORDER BY ord) AS text
FROM pieces GROUP BY doc_id, line_no""")
def rendered_markdown(t):
    return RN.render_pieces(pieces(t), ["doc_id", "line_no"], "markdown")


@query("rendered_latex", rf"""
WITH {PIECES} SELECT doc_id, line_no, string_agg(CASE kind WHEN 'code' THEN '\tcode{{' || text || '}}' WHEN 'iref' THEN '\iref{{' || text || '}}'
  WHEN 'text' THEN regexp_replace(text, '([&%#])', '\\\1', 'g') ELSE text END, '' ORDER BY ord) AS text FROM pieces GROUP BY doc_id, line_no""")
def rendered_latex(t):
    return RN.render_pieces(pieces(t), ["doc_id", "line_no"], "latex")


@query("rendered_org", f"""
WITH {PIECES} SELECT doc_id, line_no, string_agg(CASE kind WHEN 'code' THEN '~' || text || '~' WHEN 'iref' THEN '([[' || text || ']])' ELSE text END, '' ORDER BY ord) AS text
FROM pieces GROUP BY doc_id, line_no""")
def rendered_org(t):
    return RN.render_pieces(pieces(t), ["doc_id", "line_no"], "org")


@query("flattened_pieces", f"""
WITH {PIECES} SELECT doc_id, line_no, string_agg(text, '' ORDER BY ord) AS text FROM pieces GROUP BY doc_id, line_no""")
def flattened_pieces(t):
    return RN.flatten_pieces(pieces(t), ["doc_id", "line_no"])


@query("marked_lines", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k,
  CASE WHEN role = 'user' THEN 'removed' ELSE 'added' END AS change FROM conversations)
SELECT conv_id, turn, string_agg(CASE WHEN line = '' THEN '' WHEN change = 'added' THEN '[' || line || ']{.add}' ELSE '[' || line || ']{.rm}' END, chr(10) ORDER BY k) AS text
FROM l GROUP BY conv_id, turn""")
def marked_lines(t):
    change = F.when(F.col("role") == "user", "removed").otherwise("added")
    return t.conversations.select("conv_id", "turn", RN.wrap_runs(F.col("text"), change, "markdown").alias("text"))


@query("marked_revisions")
def marked_revisions(t):
    """Every edited line of a revision with its word runs marked."""
    from palimpsest.plans.revisions import edited_pairs
    key = ["doc_id", "i", "j"]
    return RN.render_marked(R.mark_words(edited_pairs(t), key), key, "markdown")


@query("rendered_tables", rf"""
WITH {LINES}, r AS (SELECT doc_id, line_no, string_split(text, '|') AS c FROM lines WHERE text LIKE '%|%'),
b AS (SELECT doc_id, string_agg('| **' || trim(c[1]) || '** | ' || trim(coalesce(c[2], '')) || ' | ' || trim(coalesce(c[3], '')) || ' |' || chr(10), '' ORDER BY line_no) AS body FROM r GROUP BY doc_id)
SELECT d.doc_id, '| | ' || lang || ' | ' || source || ' |' || chr(10) || '|---|---|---|' || chr(10) || body || ': [' || source || ']{{#d' || d.doc_id || '}}' || chr(10) AS text
FROM documents d JOIN b USING (doc_id)""")
def rendered_tables(t):
    cells = X.cells_of("text", "|")
    rows = D.doc_lines(t).filter(F.col("text").contains("|")).select(
        "doc_id", F.col("line_no").alias("row_ord"), F.get(cells, 0).alias("header"), F.coalesce(F.get(cells, 1), F.lit("")).alias("cell1"),
        F.coalesce(F.get(cells, 2), F.lit("")).alias("cell2"))
    tables = t.documents.filter(F.col("text").contains("|")).select(
        "doc_id", F.concat(F.lit("d"), "doc_id").alias("name"), F.col("source").alias("caption"),
        F.col("lang").alias("column1"), F.col("source").alias("column2"))
    return RN.render_tables(tables, rows, ["doc_id"])


LABELS = "[" + ", ".join(f"'{x}'" for x in V.ELEMENT_LABELS) + "]"


@query("rendered_items", f"""
WITH {LINES}, p AS (SELECT doc_id, line_no // 8 AS node_id, line_no AS ord, text, length(text) AS n FROM lines),
e AS (SELECT *, n % 14 AS rank, row_number() OVER (PARTITION BY doc_id, node_id, n % 14 ORDER BY ord) AS nth FROM p WHERE n % 3 = 2),
rows AS (
  SELECT doc_id, node_id, 0 AS part, 0 AS rank, 0 AS ord, '```cpp' || chr(10) || string_agg(text, chr(10) ORDER BY ord) || chr(10) || '```' || chr(10) AS text FROM p WHERE n % 3 = 0 GROUP BY ALL
  UNION ALL SELECT doc_id, node_id, 1, 0, ord, text FROM p WHERE n % 3 = 1
  UNION ALL SELECT doc_id, node_id, 2, rank, ord, CASE WHEN nth = 1 THEN '*' || {LABELS}[CAST(rank + 1 AS BIGINT)] || '*: ' ELSE '' END || text FROM e)
SELECT doc_id, CAST(node_id AS BIGINT) AS node_id, string_agg(text, chr(10) ORDER BY part, rank, ord) AS text FROM rows GROUP BY doc_id, node_id""")
def rendered_items(t):
    n = F.length("text")
    rows = D.doc_lines(t).select("doc_id", F.floor(F.col("line_no") / 8).cast("bigint").alias("node_id"), F.col("line_no").alias("ord"), "text", n.alias("n"))
    elements = rows.filter("n % 3 = 2").withColumn("rank", (F.col("n") % 14).cast("int"))
    return RN.render_items(rows.filter("n % 3 = 0"), rows.filter("n % 3 = 1"), elements, ["doc_id", "node_id"])


@query("rendered_headings", f"""
WITH {HEADS} SELECT doc_id, line_no, repeat('#', CAST(least(depth + 3, 6) AS INTEGER)) || CASE WHEN title = '' THEN '' ELSE ' ' || title END || ' [' || stable || ']' AS text FROM heads""")
def rendered_headings(t):
    return heads_of(t).select("doc_id", "line_no", RN.heading(F.col("depth"), F.col("title"), F.col("stable"), base_level=4).alias("text"))


@query("rendered_documents", f"""
WITH {LINES}, c AS (SELECT doc_id, line_no AS ord, text, CASE length(text) % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'added' ELSE 'removed' END AS change FROM lines),
s AS (SELECT *, CASE WHEN lag(change) OVER (PARTITION BY doc_id ORDER BY ord) = change THEN 0 ELSE 1 END AS st FROM c),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY ord) AS g FROM s),
p AS (SELECT doc_id, g, change, string_agg(text, chr(10) ORDER BY ord) AS t FROM g GROUP BY ALL)
SELECT doc_id, string_agg(CASE change WHEN 'added' THEN '::: add' || chr(10) || chr(10) || t || chr(10) || ':::' || chr(10)
  WHEN 'removed' THEN '::: rm' || chr(10) || chr(10) || t || chr(10) || ':::' || chr(10) ELSE t END, chr(10) ORDER BY g) AS text FROM p GROUP BY doc_id""")
def rendered_documents(t):
    n = F.length("text") % 3
    blocks = D.doc_lines(t).select("doc_id", F.col("line_no").alias("ord"), "text",
                                   F.when(n == 0, "same").when(n == 1, "added").otherwise("removed").alias("change"))
    return RN.render_documents(blocks, ["doc_id"], "markdown")


@query("section_numbers", f"""
WITH {HEADS}, o AS (SELECT DISTINCT source || '.s' || (1 + quality) AS stable, '7.' || (1 + quality) AS number FROM labels JOIN documents USING (doc_id))
SELECT h.doc_id, h.line_no, h.stable, o.number FROM heads h LEFT JOIN o USING (stable)""")
def section_numbers(t):
    return RN.with_section_numbers(heads_of(t).select("doc_id", "line_no", "stable"), number_options(t)).select(
        "doc_id", "line_no", "stable", "number")


def number_options(t):
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.concat("source", F.lit(".s"), 1 + F.col("quality")).alias("stable"),
        F.concat(F.lit("7."), 1 + F.col("quality")).alias("number")).distinct()


@query("unmatched_numbers", f"""
WITH {TREE}, o AS (SELECT DISTINCT source || '.s' || (1 + quality) AS stable, '7.' || (1 + quality) AS number FROM labels JOIN documents USING (doc_id))
SELECT stable, number FROM o WHERE stable NOT IN (SELECT stable FROM tree WHERE parent IS NULL)""")
def unmatched_numbers(t):
    return RN.unmatched_options(number_options(t), S.fold_headings(heads_of(t))).select("stable", "number")


@query("sentence_lists", r"""
WITH h AS (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS l FROM pages),
s AS (SELECT page_id, list_sort(l) AS l, len(l) AS n FROM h)
SELECT page_id, CASE n WHEN 0 THEN '' WHEN 1 THEN l[1] || '.' WHEN 2 THEN l[1] || ' and ' || l[2] || '.'
  ELSE array_to_string(l[1:-2], ', ') || ', and ' || l[-1] || '.' END AS sentence,
  CASE WHEN n <= 5 THEN '' ELSE '- ' || array_to_string(l, ',' || chr(10) || '- ') || '.' END AS bullets FROM s""")
def sentence_lists(t):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))))
    return t.pages.select("page_id", links.alias("l")).select(
        "page_id", X.sentence(F.col("l")).alias("sentence"),
        F.when(F.size("l") <= 5, "").otherwise(X.render_list(F.col("l"), 5)).alias("bullets"))


# --- fragments and papers ------------------------------------------------------------------------------------------

PLACED = TREE + """,
top AS (SELECT a.doc_id, a.line_no AS ord, a.raw AS text, (SELECT max(t.line_no) FROM tree t WHERE t.doc_id = a.doc_id AND t.line_no <= a.line_no AND t.parent IS NULL) AS top_ord FROM annotated a),
tops AS (SELECT doc_id, line_no, stable FROM tree WHERE parent IS NULL),
parts AS (SELECT doc_id, string_split(stable, '.') AS p, stable FROM tops),
shared AS (SELECT doc_id, CASE WHEN count(DISTINCT stable) = 1 THEN string_split(min(stable), '.')[1:-2]
    WHEN count(DISTINCT p[1]) = 1 THEN [min(p[1])] ELSE CAST([] AS VARCHAR[]) END AS k FROM parts GROUP BY doc_id),
roots AS (SELECT doc_id, CASE WHEN len(k) > 0 THEN array_to_string(k, '.') END AS root FROM shared),
placed AS (SELECT t.doc_id, t.ord, t.text, coalesce(t.top_ord, 0) AS piece, coalesce(s.stable, r.root) AS fragment
  FROM top t LEFT JOIN tops s ON s.doc_id = t.doc_id AND s.line_no = t.top_ord LEFT JOIN roots r ON r.doc_id = t.doc_id),
frags AS (SELECT doc_id, piece, fragment, min(ord) AS pos, count(*) AS n_nodes, string_agg(text, chr(10) ORDER BY ord) AS text FROM placed GROUP BY doc_id, piece, fragment)
"""


def placed(t):
    lines = D.annotated(t)
    tree = S.fold_headings(heads_of(t))
    tops = tree.filter("parent IS NULL").select("doc_id", "line_no", "stable")
    under = S.section_of_lines(lines, tops)
    nodes = under.select("doc_id", F.col("line_no").alias("ord"), F.col("raw").alias("text"),
                         F.col("section").alias("top"), F.col("section_line").alias("top_ord"))
    return FR.split_documents(nodes, FR.derive_roots(tops))


def fragments(t):
    return FR.fragments_of(placed(t), ["doc_id"])


@query("fragment_roots", f"WITH {PLACED} SELECT doc_id, root FROM roots")
def fragment_roots(t):
    return FR.derive_roots(S.fold_headings(heads_of(t)).filter("parent IS NULL").select("doc_id", "stable"))


@query("fragments", f"WITH {PLACED} SELECT doc_id, CAST(piece AS BIGINT) AS piece, fragment, pos, CAST(n_nodes AS BIGINT) AS n_nodes, md5(text) AS text FROM frags")
def all_fragments(t):
    return fragments(t).withColumn("text", F.md5(F.col("text").cast("binary")))


@query("whole_equals_fragments", f"WITH {ANNOTATED} SELECT doc_id, md5(string_agg(raw, chr(10) ORDER BY line_no)) AS text FROM annotated GROUP BY doc_id")
def whole_equals_fragments(t):
    """A document's fragments in manifest order, joined, are the document."""
    return fragments(t).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").cast("binary")).alias("text"))


def paper_fragments(t):
    return fragments(t).join(t.documents.select("doc_id", F.col("source").alias("paper_id")), "doc_id")


@query("fragment_collisions", f"""
WITH {PLACED} SELECT source AS paper_id, fragment, CAST(count(*) AS BIGINT) AS n_writers, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM frags JOIN documents USING (doc_id) GROUP BY source, fragment HAVING count(*) > 1""")
def fragment_collisions(t):
    return FR.collisions(paper_fragments(t))


@query("fragment_findings", f"""
WITH {PLACED}, p AS (SELECT f.*, d.source AS paper_id FROM frags f JOIN documents d USING (doc_id)),
c AS (SELECT paper_id, fragment, max(doc_id) AS doc_id FROM p WHERE fragment <> '' GROUP BY ALL HAVING count(*) > 1)
SELECT paper_id, doc_id, 'error' AS severity, 'two fragments would both be named ''' || fragment || '''' AS message FROM c
UNION ALL SELECT paper_id, doc_id, 'error', CAST(sum(n_nodes) AS BIGINT) || ' top-level nodes sit outside every section, and the section stable names share no common prefix to name it by'
FROM p WHERE coalesce(fragment, '') = '' GROUP BY paper_id, doc_id
UNION ALL SELECT paper_id, doc_id, 'error', '''' || fragment || ''' cannot name a file, so it cannot name a fragment' FROM p WHERE NOT regexp_matches(fragment, '^[A-Za-z0-9._+-]+$')""")
def fragment_findings(t):
    return FR.fragment_findings(paper_fragments(t))


def paper_chunk():
    return F.floor(F.col("doc_id") / 65536)


@query("manifest", f"""
WITH {PLACED}, p AS (SELECT f.*, d.source AS paper_id FROM frags f JOIN documents d USING (doc_id))
SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY doc_id, pos) AS BIGINT) AS pos,
  paper_id || '/' || coalesce(nullif(fragment, ''), 'document-' || doc_id) || '.tex' AS path FROM p""")
def manifest(t):
    return FR.manifest(FR.named(paper_fragments(t).drop("text")), ["doc_id", "pos"], paper_chunk(), "latex")


@query("lineage", f"""
WITH {PLACED} SELECT DISTINCT d.source || '/' || coalesce(nullif(f.fragment, ''), 'document-' || doc_id) AS output, 'docs/' || d.lang || '.json' AS input
FROM frags f JOIN documents d USING (doc_id)""")
def lineage(t):
    outputs = FR.named(paper_fragments(t)).select("doc_id", F.concat_ws("/", "paper_id", "fragment").alias("output"))
    inputs = t.documents.select("doc_id", F.concat(F.lit("docs/"), "lang", F.lit(".json")).alias("input"))
    return FR.lineage(outputs, inputs)


@query("paper_documents", """
SELECT source AS paper_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS doc_ord, doc_id FROM documents WHERE trim(text) <> ''""")
def paper_documents(t):
    good, _ = SD.paper(t.documents.select(F.col("source").alias("paper_id"), "doc_id", "text"), "paper_id", "doc_id", paper_chunk())
    return good.select("paper_id", "doc_ord", "doc_id")


@query("paper_rejects", """
SELECT source AS paper_id, doc_id, 'nothing to read' AS message FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT source, -1 - doc_id, 'nothing to read' FROM documents WHERE length(text) % 7 = 0""")
def paper_rejects(t):
    """Documents of a paper that cannot be read; every seventh length adds one that says nothing."""
    docs = t.documents.select(F.col("source").alias("paper_id"), "doc_id", "text")
    blank = docs.filter(F.length("text") % 7 == 0).select("paper_id", (-1 - F.col("doc_id")).alias("doc_id"), F.lit(" ").alias("text"))
    return SD.paper(docs.unionByName(blank), "paper_id", "doc_id", paper_chunk())[1]


@query("whole_papers", """
SELECT source AS paper_id, doc_id, CAST(row_number() OVER w AS BIGINT) AS pos, CAST(coalesce(sum(length(text) + 1) OVER (
  PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(length(text) AS BIGINT) AS length
FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def whole_papers(t):
    pieces = t.documents.select(F.col("source").alias("paper_id"), "doc_id", F.length("text").cast("bigint").alias("length"))
    return FR.positions(pieces, ["paper_id"], ["doc_id"], paper_chunk())


# --- sources --------------------------------------------------------------------------------------------------------

def saved_nodes(t):
    tree = S.fold_headings(heads_of(t))
    return tree.select("doc_id", F.col("line_no").alias("ord"), (F.size("ancestors") + 1).alias("depth"),
                       F.lit("section").alias("type"), "stable", "title", "parent")


@query("saved_documents", f"""
WITH RECURSIVE {TREE}, lv AS (SELECT doc_id, line_no, stable, CAST(1 AS BIGINT) AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.doc_id, t.line_no, t.stable, l.depth + 1 FROM lv l JOIN tree t ON t.doc_id = l.doc_id AND t.parent = l.line_no),
n AS (SELECT *, lag(depth) OVER w AS before, lead(depth) OVER w AS after FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, '{{"nodes":[' || string_agg(CASE WHEN before >= depth THEN ',' ELSE '' END || '{{"type":"section","stable":"' || stable || '"'
  || CASE WHEN coalesce(after, 1) > depth THEN ',"children":[' ELSE '}}' || repeat(']}}', CAST(depth - coalesce(after, 1) AS INTEGER)) END, '' ORDER BY line_no) || ']}}' AS json
FROM n GROUP BY doc_id""")
def saved_documents(t):
    return SD.emit_saved(saved_nodes(t), ["doc_id"], ["type", "stable"])


@query("saved_round_trip", f"""
WITH RECURSIVE {TREE}, lv AS (SELECT doc_id, line_no, stable, title, CAST(1 AS BIGINT) AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.doc_id, t.line_no, t.stable, t.title, l.depth + 1 FROM lv l JOIN tree t ON t.doc_id = l.doc_id AND t.parent = l.line_no)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS ord, depth, 'section' AS type, stable, title FROM lv""")
def saved_round_trip(t):
    """Node tables written as saved documents and read back."""
    saved = SD.emit_saved(saved_nodes(t), ["doc_id"], ["type", "stable", "title"])
    nodes, _ = SD.parse_saved(saved, "doc_id", "json")
    return nodes.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_path")).alias("ord"), "depth", "type", "stable", "title")


@query("saved_rejects", "SELECT doc_id FROM documents")
def saved_rejects(t):
    """Prose is no saved document: every text is rejected, with where it fails."""
    _, rejects = SD.parse_saved(t.documents.select("doc_id", "text"), "doc_id", "text")
    return rejects.filter("message IS NOT NULL").select("doc_id")


LEGACY = LINES + """,
el AS (SELECT doc_id, line_no, CASE WHEN length(text) % 4 < 2 THEN [text] END AS body,
  CASE WHEN length(text) % 4 = 2 THEN string_split(text, ' ') END AS paragraphs,
  CASE WHEN length(text) % 4 IN (1, 2, 3) AND length(text) % 3 = 0 THEN ['list of ' || length(text)] END AS itemize FROM lines)
"""


@query("legacy_elements", f"""
WITH {LEGACY} SELECT doc_id, line_no, array_to_string(coalesce(body, list_concat(coalesce(paragraphs, []), coalesce(itemize, []))), '/') AS body
FROM el WHERE NOT (body IS NOT NULL AND (paragraphs IS NOT NULL OR itemize IS NOT NULL))""")
def legacy_elements(t):
    return normalized(t)[0].select("doc_id", "line_no", F.array_join("body", "/").alias("body"))


@query("mixed_elements", f"""
WITH {LEGACY} SELECT doc_id, line_no, 'description mixes ordered body and legacy fields' AS message
FROM el WHERE body IS NOT NULL AND (paragraphs IS NOT NULL OR itemize IS NOT NULL)""")
def mixed_elements(t):
    return normalized(t)[1]


def normalized(t):
    n = F.length("text")
    rows = D.doc_lines(t).select(
        "doc_id", "line_no", F.when(n % 4 < 2, F.array("text")).alias("body"), F.when(n % 4 == 2, F.split("text", " ")).alias("paragraphs"),
        F.when((n % 4).isin(1, 2, 3) & (n % 3 == 0), F.array(F.concat(F.lit("list of "), n))).alias("itemize"))
    return SD.normalize_elements(rows, ["paragraphs", "itemize"], ["doc_id", "line_no"])


DECLARED = HEADS + r""",
asked AS (SELECT DISTINCT source || '.s' || line_no // 2 AS name FROM lines),
declared AS (SELECT stable AS name, min(doc_id) AS file FROM heads GROUP BY stable)
"""


def declarations(t):
    declared = heads_of(t).select(F.col("stable").alias("name"), F.col("doc_id").alias("file"))
    asked = D.doc_lines(t).select(F.concat("source", F.lit(".s"), F.floor(F.col("line_no") / 2).cast("string")).alias("name"))
    return SD.first_declarations(declared, asked)


@query("first_declarations", f"WITH {DECLARED} SELECT name, file FROM asked JOIN declared USING (name)")
def first_declarations(t):
    return declarations(t)[0]


@query("missing_declarations", f"WITH {DECLARED} SELECT name FROM asked WHERE name NOT IN (SELECT name FROM declared)")
def missing_declarations(t):
    return declarations(t)[1]


@query("corpus_as_of", """
WITH r AS (SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-01 12:00:00' GROUP BY user_id)
SELECT u.user_id, r.event_type, r.event_id, r.event_id IS NULL AS is_empty FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r USING (user_id)""")
def corpus_as_of(t):
    revisions = t.events.select("user_id", "ts", "event_type", "event_id")
    return SD.as_of(revisions, revisions, "user_id", ["ts", "event_id"], F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).select(
        "user_id", "event_type", "event_id", "is_empty")


@query("changed_documents", """
SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents d2 WHERE d2.doc_id = documents.doc_id AND d2.lang = 'en')""")
def changed_documents(t):
    """Documents a second run has to lint when the first one saw those in English."""
    docs = t.documents.select("doc_id", "text", "lang")
    seen = docs.filter("lang = 'en'").withColumn("content_key", F.sha2("text", 256))
    return relint.changed_documents(docs.select("doc_id", "text"), seen).select("doc_id")
