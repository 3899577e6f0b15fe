"""Registered queries over section trees, groups, blocks and ordered siblings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X
from palimpsest.operators import elements as E
from palimpsest.operators import lines as L
from palimpsest.operators import ordered as O
from palimpsest.operators import sections as S
from palimpsest.operators import sequences as Q
from palimpsest.operators import spans as P
from palimpsest.plans import derived as D
from palimpsest.plans.registry import query
from palimpsest.plans.text import ANNOTATED, HEADS, LINES, STRIPPED, TAGS

RANKS = ", ".join(f"('{k}', {i})" for i, k in enumerate(V.ELEMENT_KINDS))

TREE = HEADS + """,
tree AS (
  SELECT h.*, (SELECT max(p.line_no) FROM heads p WHERE p.doc_id = h.doc_id AND p.line_no < h.line_no
               AND p.depth < h.depth AND NOT EXISTS (
                 SELECT 1 FROM heads q WHERE q.doc_id = h.doc_id AND q.line_no > p.line_no
                 AND q.line_no < h.line_no AND q.depth <= p.depth)) AS parent
  FROM heads h)
"""
PATHS = TREE + """,
RECURSIVEPATHS AS (
  SELECT doc_id, line_no, stable AS context FROM tree WHERE parent IS NULL
  UNION ALL
  SELECT t.doc_id, t.line_no, p.context || '/' || t.stable FROM tree t
  JOIN RECURSIVEPATHS p ON p.doc_id = t.doc_id AND p.line_no = t.parent)
""".replace("RECURSIVEPATHS", "paths")


def heads_of(t):
    return L.headings(D.annotated(t)).filter("NOT malformed").select("doc_id", "line_no", "depth", "stable", "title")


@query("section_tree", f"WITH {TREE} SELECT doc_id, line_no, depth, stable, parent FROM tree")
def section_tree(t):
    return S.fold_headings(heads_of(t)).select("doc_id", "line_no", "depth", "stable", "parent")


@query("section_paths", f"WITH RECURSIVE {PATHS} SELECT doc_id, line_no, context FROM paths")
def section_paths(t):
    return S.context_paths(S.fold_headings(heads_of(t))).select("doc_id", "line_no", "context")


TAG_RANKS = [("nav", 1), ("article", 1), ("div", 1), ("h1", 2), ("ul", 2), ("p", 3), ("li", 3)]
PAGE_TAGS = f"""
m AS (SELECT page_id, regexp_extract_all(html, '<(nav|article|div|h1|ul|p|li)[ >]', 1) AS tags FROM pages),
e AS (SELECT page_id, CAST(generate_subscripts(tags, 1) AS BIGINT) AS line_no, unnest(tags) AS stable FROM m),
tagged AS (SELECT e.*, CAST(r.depth AS BIGINT) AS depth
           FROM e JOIN (VALUES {", ".join(f"('{n}', {d})" for n, d in TAG_RANKS)}) r(stable, depth) USING (stable))
"""


def page_tags(t):
    tags = F.regexp_extract_all("html", F.lit("<(nav|article|div|h1|ul|p|li)[ >]"), F.lit(1))
    ranks = F.create_map(*[F.lit(x) for pair in TAG_RANKS for x in pair])
    return t.pages.select("page_id", F.posexplode(tags).alias("_p", "stable")).select(
        "page_id", (F.col("_p") + 1).cast("bigint").alias("line_no"), "stable",
        F.try_element_at(ranks, F.col("stable")).alias("depth"))


@query("page_tree", f"""
WITH {PAGE_TAGS}, o AS (
  SELECT *, last_value(CASE WHEN depth = 1 THEN line_no END IGNORE NULLS) OVER w AS o1,
         last_value(CASE WHEN depth = 2 THEN line_no WHEN depth = 1 THEN -1 END IGNORE NULLS) OVER w AS o2
  FROM tagged WINDOW w AS (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, line_no, stable AS tag, depth,
  CASE depth WHEN 3 THEN CASE WHEN o2 > 0 THEN o2 ELSE o1 END WHEN 2 THEN o1 END AS parent FROM o""")
def page_tree(t):
    return S.fold_headings(page_tags(t), ["page_id"]).select(
        "page_id", "line_no", F.col("stable").alias("tag"), "depth", "parent")


@query("fenced_sections", rf"""
WITH RECURSIVE {HEADS},
raw_events AS (
  SELECT doc_id, line_no, 'open' AS event, depth, stable FROM heads
  UNION ALL
  SELECT doc_id, line_no, 'close', NULL, regexp_extract(raw, '^[ \t]*///[ \t]*END \[(.+)\][ \t\r]*$', 1)
  FROM annotated WHERE regexp_matches(raw, '^[ \t]*///[ \t]*END \[(.+)\][ \t\r]*$')),
events AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM raw_events),
folded AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS line_no, CAST(NULL AS VARCHAR) AS event,
         CAST(NULL AS VARCHAR) AS stable,
         CAST([] AS STRUCT(depth BIGINT, stable VARCHAR, line_no BIGINT)[]) AS kept,
         CAST([] AS STRUCT(depth BIGINT, stable VARCHAR, line_no BIGINT)[]) AS stack
  FROM (SELECT DISTINCT doc_id FROM events)
  UNION ALL
  SELECT doc_id, i, line_no, event, stable, kept,
    CASE WHEN event = 'open' THEN list_append(kept, {{'depth': depth, 'stable': stable, 'line_no': line_no}})
         WHEN len(kept) > 0 AND kept[-1].stable = stable THEN kept[1:-2] ELSE kept END
  FROM (SELECT e.doc_id, e.i, e.line_no, e.event, e.stable, e.depth,
          CASE WHEN e.event = 'open' THEN list_filter(f.stack, lambda s: s.depth < e.depth) ELSE f.stack END AS kept
        FROM folded f JOIN events e ON e.doc_id = f.doc_id AND e.i = f.i + 1))
SELECT doc_id, line_no, event, stable,
  CASE WHEN event = 'open' AND len(kept) > 0 THEN kept[-1].line_no END AS parent,
  CASE WHEN event = 'close' AND len(kept) > 0 AND kept[-1].stable = stable THEN kept[-1].line_no END AS closes,
  CASE WHEN event = 'close' AND len(kept) = 0 THEN 'END [' || stable || '] has no open section to close'
       WHEN event = 'close' AND kept[-1].stable <> stable
       THEN 'END [' || stable || '] does not match open section [' || kept[-1].stable || ']' END AS warning
FROM folded WHERE i > 0""")
def fenced_sections(t):
    lines = D.annotated(t)
    opens = L.headings(lines).filter("NOT malformed").select("doc_id", "line_no", F.lit("open").alias("event"),
                                                             "depth", "stable")
    closes = L.fences(lines).select("doc_id", "line_no", F.lit("close").alias("event"),
                                    F.lit(None).cast("int").alias("depth"), "stable")
    return S.fold_fenced(opens.unionByName(closes))


@query("section_of_lines", f"""
WITH {HEADS} SELECT a.doc_id, a.line_no,
  (SELECT max(h.line_no) FROM heads h WHERE h.doc_id = a.doc_id AND h.line_no <= a.line_no) AS section_line
FROM annotated a""")
def section_of_lines(t):
    lines = D.annotated(t)
    heads = L.headings(lines).filter("NOT malformed").select("doc_id", "line_no", "stable")
    return S.section_of_lines(lines.select("doc_id", "line_no"), heads).select("doc_id", "line_no", "section_line")


@query("routed_rows", f"""
WITH {HEADS}, ends AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id),
secs AS (SELECT h.doc_id, 't' || h.depth AS stable, h.line_no,
  coalesce((SELECT min(n.line_no) FROM heads n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no
            AND n.depth <= h.depth) - 1, e.last) AS close_line FROM heads h JOIN ends e ON e.doc_id = h.doc_id),
f AS (SELECT doc_id, stable, arg_min(line_no, close_line * 1000000 + line_no) AS section_line FROM secs GROUP BY ALL)
SELECT l.doc_id, l.line_no, 't' || (1 + length(l.text) % 3) AS target, f.section_line
FROM lines l JOIN f ON f.doc_id = l.doc_id AND f.stable = 't' || (1 + length(l.text) % 3)""")
def routed_rows(t):
    slices = L.slice_sections(D.annotated(t)).select(
        "doc_id", F.concat(F.lit("t"), "depth").alias("stable"), F.col("first_line").alias("line_no"),
        F.col("last_line").alias("close_line"))
    rows = D.doc_lines(t).select("doc_id", "line_no", F.concat(F.lit("t"), 1 + F.length("text") % 3).alias("target"))
    return S.route_first(rows, slices).select("doc_id", "line_no", "target", "section_line")


# --- groups ---------------------------------------------------------------------------------------------------

def turn_chunk():
    return F.floor(F.col("turn") / 4096)


@query("turn_groups", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS primary_turn
FROM conversations""")
def turn_groups(t):
    turns = t.conversations.select("conv_id", "turn", "role")
    return O.running(turns, ["conv_id"], ["turn"], turn_chunk(),
                     primary_turn=O.Running("last", F.when(F.col("role") == "user", F.col("turn"))))


@query("turn_cohorts", """
WITH f AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role
                  THEN 0 ELSE 1 END AS starts FROM conversations)
SELECT conv_id, turn, role, CAST(sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS cohort FROM f""")
def turn_cohorts(t):
    return O.cohorts(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], turn_chunk(), "role")


@query("event_cohorts", """
WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS starts
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, event_id, event_type, sum(starts) OVER (PARTITION BY user_id ORDER BY event_id) AS cohort FROM f)
SELECT user_id, event_type, CAST(cohort AS BIGINT) AS cohort, min(event_id) AS first_event, CAST(count(*) AS BIGINT) AS n
FROM c GROUP BY ALL""")
def event_cohorts(t):
    marked = O.cohorts(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"],
                       F.floor(F.col("event_id") / 65536), "event_type")
    return marked.groupBy("user_id", "event_type", "cohort").agg(F.min("event_id").alias("first_event"),
                                                                 F.count("*").alias("n"))


# Followers: a line's length decides whether it names a group, joins one, or follows the line before it.
FOLLOWERS = LINES + """,
cand AS (SELECT doc_id, line_no AS ord, length(text) % 7 <> 6 AS is_item,
  CASE WHEN length(text) % 11 IN (1, 4) THEN 'g' || length(text) % 3 END AS group_id,
  CASE WHEN length(text) % 11 IN (2, 4) THEN 'g' || length(text) % 3 END AS also_target,
  length(text) % 11 = 5 AS wants_join FROM lines)
"""


def followers(t):
    n = F.length("text")
    return D.doc_lines(t).select(
        "doc_id", F.col("line_no").alias("ord"), (n % 7 != 6).alias("is_item"),
        F.when((n % 11).isin(1, 4), F.concat(F.lit("g"), n % 3)).alias("group_id"),
        F.when((n % 11).isin(2, 4), F.concat(F.lit("g"), n % 3)).alias("also_target"),
        (n % 11 == 5).alias("wants_join"))


@query("grouped_followers", f"""
WITH RECURSIVE {FOLLOWERS},
folded AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS main, CAST(NULL AS BIGINT) AS adjacent,
         CAST([] AS STRUCT(id VARCHAR, pos BIGINT)[]) AS named
  FROM (SELECT DISTINCT doc_id FROM cand)
  UNION ALL
  SELECT doc_id, ord, coalesce(joined, ord),
    CASE WHEN joined IS NOT NULL THEN joined WHEN is_item THEN ord END,
    CASE WHEN joined IS NULL AND is_item AND group_id IS NOT NULL AND also_target IS NULL
              AND len(list_filter(named, lambda x: x.id = group_id)) = 0
         THEN list_append(named, {{'id': group_id, 'pos': ord}}) ELSE named END
  FROM (SELECT c.*, f.named, CASE
            WHEN c.group_id IS NOT NULL AND c.also_target IS NOT NULL THEN NULL
            WHEN c.also_target IS NOT NULL THEN CASE WHEN c.is_item
                 THEN list_filter(f.named, lambda x: x.id = c.also_target)[1].pos END
            WHEN c.wants_join AND c.is_item THEN f.adjacent END AS joined
        FROM folded f JOIN cand c ON c.doc_id = f.doc_id AND c.ord = f.ord + 1))
SELECT doc_id, ord, main AS "primary" FROM folded WHERE ord > 0""")
def grouped_followers(t):
    return Q.group_followers(followers(t), ["doc_id"])[0].select("doc_id", "ord", "primary")


@query("grouping_findings", f"""
WITH {FOLLOWERS},
reg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY ord) AS nth FROM cand
        WHERE group_id IS NOT NULL AND also_target IS NULL AND is_item)
SELECT doc_id, ord, 'error' AS severity, 'duplicate \\group id ''' || group_id || ''' in this section' AS message
FROM reg WHERE nth > 1
UNION ALL
SELECT c.doc_id, c.ord, 'error', '\\also target ''' || also_target || ''' has no preceding \\group primary in this section'
FROM cand c WHERE also_target IS NOT NULL AND group_id IS NULL AND NOT (is_item AND EXISTS (
  SELECT 1 FROM reg r WHERE r.doc_id = c.doc_id AND r.group_id = c.also_target AND r.nth = 1 AND r.ord < c.ord))""")
def grouping_findings(t):
    return Q.group_followers(followers(t), ["doc_id"])[1]


@query("merged_index", f"""
WITH {LINES}, e AS (SELECT doc_id, lower(split_part(text, ' ', 1)) AS entry, min(line_no) AS first_at FROM lines GROUP BY ALL)
SELECT doc_id, string_agg(entry, ',' ORDER BY first_at) AS entries FROM e GROUP BY doc_id""")
def merged_index(t):
    rows = D.doc_lines(t).select("doc_id", F.col("line_no").alias("ord"),
                                 F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("entry"))
    return Q.merge_entries(rows, ["doc_id"]).select("doc_id", F.array_join("entries", ",").alias("entries"))


PROSE = LINES + """,
rows AS (SELECT doc_id, line_no AS ord, length(text) % 4 = 0 AS prose, CAST(length(text) AS BIGINT) AS key FROM lines)
"""


def prose_rows(t):
    n = F.length("text")
    return D.doc_lines(t).select("doc_id", F.col("line_no").alias("ord"), (n % 4 == 0).alias("prose"),
                                 n.cast("bigint").alias("key"))


@query("placed_prose", f"""
WITH {PROSE}, p AS (SELECT *, CAST(CASE WHEN count(CASE WHEN NOT prose THEN 1 END) OVER (PARTITION BY doc_id ORDER BY ord) = 0 THEN 0
  ELSE coalesce(first_value(CASE WHEN NOT prose THEN key END IGNORE NULLS) OVER (
    PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), key) END AS BIGINT) AS placement FROM rows)
SELECT doc_id, ord, placement, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY placement, ord) AS BIGINT) AS placed FROM p""")
def placed_prose(t):
    return Q.place_prose(prose_rows(t), ["doc_id"]).select("doc_id", "ord", "placement", "placed")


# --- elements and blocks -----------------------------------------------------------------------------------------

@query("description_paragraphs", rf"""
WITH {STRIPPED}, m AS (
  SELECT doc_id, line_no, regexp_extract(text, '^[ \t]*\\([a-z0-9-]+)', 1) IN ({", ".join(repr(k) for k in V.ELEMENT_KINDS)}) AS opens,
         text FROM stripped WHERE vocab = 'markup' OR raw = ''),
p AS (SELECT *, CASE WHEN opens THEN regexp_extract(text, '^[ \t]*\\([a-z0-9-]+)', 1) END AS k,
        CASE WHEN opens THEN trim(regexp_replace(text, '^[ \t]*\\[a-z0-9-]+(\([^)]*\))?', '')) ELSE trim(text) END AS prose FROM m),
n AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS elem_ord,
        sum(CASE WHEN prose = '' AND NOT opens THEN 1 ELSE 0 END) OVER w AS breaks,
        coalesce(last_value(k IGNORE NULLS) OVER w, 'leading') AS kind
      FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT doc_id, elem_ord, kind, breaks, min(line_no) AS line_no, string_agg(prose, ' ' ORDER BY line_no) AS text
      FROM n WHERE prose <> '' GROUP BY ALL)
SELECT doc_id, CAST(elem_ord AS BIGINT) AS elem_ord, kind, line_no, text,
  CAST(row_number() OVER (PARTITION BY doc_id, elem_ord ORDER BY breaks) AS BIGINT) AS para_ord FROM g""")
def description_paragraphs(t):
    block = L.classify(D.annotated(t)).filter("vocab = 'markup' OR raw = ''")
    return E.group_elements(block.select("doc_id", "line_no", "text"))


DELIMITERS = STRIPPED + r""",
ev AS (SELECT doc_id, line_no, text, regexp_extract(text, '^[ \t]*\\([a-z0-9-]+)', 1) AS tag FROM stripped WHERE vocab = 'markup'),
st AS (SELECT *, coalesce(last_value(CASE WHEN tag = 'note' THEN 1 WHEN tag = 'endnote' THEN 0 END IGNORE NULLS) OVER (
         PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS was_open FROM ev),
bl AS (SELECT *, tag = 'note' AND NOT was_open AS opening, tag = 'endnote' AS closing,
         sum(CASE WHEN tag = 'note' AND NOT was_open THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_ord FROM st)
"""


def markup_lines(t):
    return L.classify(D.annotated(t)).filter("vocab = 'markup'").select("doc_id", "line_no", "text")


@query("block_lines", rf"""
WITH {DELIMITERS} SELECT doc_id, line_no, 'note' AS block, CAST(block_ord AS BIGINT) AS block_ord,
  CASE WHEN opening THEN trim(regexp_replace(text, '^[ \t]*\\[a-z0-9-]+(\([^)]*\))?', '')) ELSE text END AS text
FROM bl WHERE (was_open OR opening) AND NOT closing""")
def block_lines(t):
    return E.group_blocks(markup_lines(t))


@query("delimiter_findings", f"""
WITH {DELIMITERS}, e AS (SELECT doc_id, arg_max(tag, line_no) FILTER (WHERE tag IN ('note', 'endnote')) AS final,
    max(line_no) FILTER (WHERE opening) AS line_no FROM bl GROUP BY doc_id)
SELECT doc_id, line_no, 'error' AS severity, 'notes and examples cannot nest' AS message FROM bl WHERE tag = 'note' AND was_open
UNION ALL SELECT doc_id, line_no, 'error', '\\endnote appears outside its block' FROM bl WHERE closing AND NOT was_open
UNION ALL SELECT doc_id, line_no, 'error', 'missing \\endnote' FROM e WHERE final = 'note'""")
def delimiter_findings(t):
    return E.delimiter_findings(markup_lines(t))


@query("body_paragraphs", f"""
WITH {DELIMITERS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (WHERE NOT (was_open OR opening)) AS BIGINT) AS n_normative FROM bl GROUP BY doc_id""")
def body_paragraphs(t):
    state = E.delimiter_state(markup_lines(t))
    return state.groupBy("doc_id").agg(F.count("*").alias("n_lines"),
                                       F.count(F.when(F.col("open_kind").isNull(), 1)).alias("n_normative"))


@query("canonical_elements", f"""
WITH {TAGS}, r AS (SELECT doc_id, line_no, tag AS kind, length(rest) % 2 = 0 AS derived, k.rank
  FROM roles JOIN (VALUES {RANKS}) k(kind, rank) ON k.kind = roles.tag)
SELECT doc_id, line_no, kind, CAST(rank AS BIGINT) AS rank, derived, CAST(row_number() OVER (
  PARTITION BY doc_id ORDER BY rank, NOT derived, line_no) AS BIGINT) AS canonical_ord FROM r""")
def canonical_elements(t):
    elements = L.tags(D.annotated(t)).filter("role = 'element'").select(
        "doc_id", "line_no", F.col("tag").alias("kind"), (F.length("rest") % 2 == 0).alias("derived"))
    return E.canonical_order(elements, ["doc_id"], authored="line_no").select(
        "doc_id", "line_no", "kind", "rank", "derived", "canonical_ord")


@query("rank_order_findings", f"""
WITH {TAGS}, r AS (SELECT doc_id, line_no, tag, k.rank, max(k.rank) OVER w AS top,
    row_number() OVER (PARTITION BY doc_id, tag ORDER BY line_no) AS nth
  FROM roles JOIN (VALUES {RANKS}) k(kind, rank) ON k.kind = roles.tag
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, line_no, 'warning' AS severity, 'duplicate \\' || tag || ' element; both kept' AS message FROM r WHERE nth > 1
UNION ALL
SELECT doc_id, line_no, 'note', '\\' || tag || ' appears after \\' || t.kind || '; output is canonicalized'
FROM r JOIN (VALUES {RANKS}) t(kind, rank) ON t.rank = r.top WHERE r.rank < r.top""")
def rank_order_findings(t):
    return E.order_findings(L.tags(D.annotated(t)).select("doc_id", "line_no", "tag"))


# The given lines hold few marker tags, so each line gives its document the tag that its length picks of all those named.
NAMED_TAGS = sorted({t for pair in V.EXCLUSIVE_TAGS for t in pair} | {t for x, ys, _ in V.TAKEN_TAGS for t in (x, *ys)})
NAMED_LIST = "[" + ", ".join(f"'{t}'" for t in NAMED_TAGS) + "]"
TAKEN_ROWS = ", ".join("('{}', '{}', '{}')".format(tag, other, message.replace("'", "''"))
                       for tag, others, message in V.TAKEN_TAGS for other in others)


@query("exclusive_tags", f"""
WITH {LINES}, tags AS (SELECT doc_id, line_no // 4 AS item, {NAMED_LIST}[1 + length(text) % {len(NAMED_TAGS)}] AS tag FROM lines),
p(a, b, message) AS (VALUES {", ".join(f"('{a}', '{b}', '\\{a} and \\{b} are mutually exclusive')" for a, b in V.EXCLUSIVE_TAGS)},
  {TAKEN_ROWS}),
described AS (SELECT DISTINCT doc_id, item FROM tags WHERE tag IN ('effects', 'returns'))
SELECT DISTINCT x.doc_id, x.item, 'error' AS severity, message
FROM p JOIN tags x ON x.tag = p.a JOIN tags y ON y.tag = p.b AND y.doc_id = x.doc_id AND y.item = x.item
UNION ALL
SELECT DISTINCT t.doc_id, t.item, 'warning', '{V.ALSO_DESCRIBED}' FROM tags t JOIN described d
  ON d.doc_id = t.doc_id AND d.item = t.item WHERE t.tag = 'also'""")
def exclusive_tags(t):
    tag = F.element_at(F.array(*map(F.lit, NAMED_TAGS)), (1 + F.length("text") % len(NAMED_TAGS)).cast("int"))
    tags = D.doc_lines(t).select("doc_id", F.floor(F.col("line_no") / 4).alias("item"), tag.alias("tag"))
    return E.exclusive_findings(tags, ["doc_id", "item"])


@query("merged_elements", f"""
WITH {TAGS}, b AS (SELECT doc_id, tag AS kind, line_no AS elem_ord, 0 AS block_ord,
    CASE WHEN length(rest) % 3 = 0 THEN 'paragraph' ELSE 'list' END AS type FROM roles WHERE role = 'element'),
n AS (SELECT *, CASE WHEN type = 'list' AND lag(type) OVER w = 'list' THEN 0 ELSE 1 END AS fresh FROM b
      WINDOW w AS (PARTITION BY doc_id, kind ORDER BY elem_ord))
SELECT doc_id, kind, elem_ord, type, CAST(sum(fresh) OVER (PARTITION BY doc_id, kind ORDER BY elem_ord) AS BIGINT) AS merged_ord FROM n""")
def merged_elements(t):
    blocks = L.tags(D.annotated(t)).filter("role = 'element'").select(
        "doc_id", F.col("tag").alias("kind"), F.col("line_no").alias("elem_ord"), F.lit(0).alias("block_ord"),
        F.when(F.length("rest") % 3 == 0, "paragraph").otherwise("list").alias("type"))
    return E.merge_same_kind(blocks, ["doc_id"]).select("doc_id", "kind", "elem_ord", "type", "merged_ord")


@query("table_findings", rf"""
WITH {LINES},
r AS (SELECT doc_id, line_no, string_split(text, '|') AS c FROM lines WHERE text LIKE '%|%'),
rows AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS row_ord,
                trim(c[1]) AS header, trim(coalesce(c[2], '')) AS cell1, trim(coalesce(c[3], '')) AS cell2 FROM r),
tabs AS (SELECT doc_id, source AS name, CASE WHEN lang = 'fr' THEN '' ELSE lang END AS caption,
                split_part(text, ' ', 1) AS column1, split_part(text, ' ', 2) AS column2 FROM documents)
SELECT doc_id, 'table caption is empty' AS message, 'error' AS severity FROM tabs WHERE caption = ''
UNION ALL SELECT doc_id, 'table first column header is empty', 'error' FROM tabs WHERE column1 = ''
UNION ALL SELECT doc_id, 'table second column header is empty', 'error' FROM tabs WHERE column2 = ''
UNION ALL SELECT doc_id, 'table requires at least one row', 'error' FROM tabs WHERE doc_id NOT IN (SELECT doc_id FROM rows)
UNION ALL SELECT doc_id, 'table row ' || row_ord || ' header is empty', 'error' FROM rows WHERE header = ''
UNION ALL SELECT doc_id, 'table row ' || row_ord || ' first cell is empty', 'error' FROM rows WHERE cell1 = ''
UNION ALL SELECT doc_id, 'table row ' || row_ord || ' second cell is empty', 'error' FROM rows WHERE cell2 = ''""")
def table_findings(t):
    cells = X.cells_of("text", "|")
    rows = D.doc_lines(t).filter(F.col("text").contains("|")).select(
        "doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("row_ord"),
        F.get(cells, 0).alias("header"), F.get(cells, 1).alias("cell1"), F.get(cells, 2).alias("cell2"))
    tables = t.documents.select(
        "doc_id", F.col("source").alias("name"), F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")).alias("caption"),
        F.split_part("text", F.lit(" "), F.lit(1)).alias("column1"), F.split_part("text", F.lit(" "), F.lit(2)).alias("column2"))
    return E.table_findings(tables, rows, ["doc_id"])


# --- look-ahead, elision, numbering -------------------------------------------------------------------------------

@query("literal_lookahead", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+', 0) AS ws FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(ws, 1) AS BIGINT) AS ord, unnest(ws) AS word FROM w),
l AS (SELECT *, first_value(CASE WHEN word = 'and' THEN TRUE WHEN word = 'of' THEN FALSE END IGNORE NULLS) OVER (
        PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS reading FROM e)
SELECT doc_id, ord, word, reading FROM l WHERE word = 'the'""")
def literal_lookahead(t):
    words = L.words(t.documents.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", F.col("pos").alias("ord"), X.rstripped("word").alias("word"))
    literal = F.when(F.col("word") == "and", True).when(F.col("word") == "of", False)
    return Q.look_ahead(words, ["doc_id"], F.col("word") == "the", literal)


@query("elided_runs", f"""
WITH {HEADS},
rows AS (SELECT a.doc_id, a.line_no AS ord,
  (SELECT max(h.line_no) FROM heads h WHERE h.doc_id = a.doc_id AND h.line_no < a.line_no) AS parent,
  a.line_no IN (SELECT line_no FROM heads h WHERE h.doc_id = a.doc_id) AS is_heading,
  length(a.raw) % 5 = 0 AS changed FROM annotated a),
f AS (SELECT *, NOT is_heading AND NOT changed AS fold FROM rows),
s AS (SELECT *, fold AND lag(fold) OVER (PARTITION BY doc_id, parent ORDER BY ord) AS again FROM f),
k AS (SELECT *, CASE WHEN fold THEN 'elided' WHEN changed THEN 'changed' ELSE 'heading' END AS action FROM s
      WHERE NOT coalesce(again, FALSE)),
m AS (SELECT *, action = 'elided' AND lag(action) OVER (PARTITION BY doc_id ORDER BY ord) = 'elided' AS meets FROM k)
SELECT doc_id, ord, action FROM m WHERE NOT coalesce(meets, FALSE)""")
def elided_runs(t):
    lines = D.annotated(t)
    heads = L.headings(lines).filter("NOT malformed").select("doc_id", "line_no", "stable")
    placed = S.section_of_lines(lines, heads)
    up = F.last(F.when(F.col("section_line") == F.col("line_no"), F.col("line_no")), ignorenulls=True).over(
        Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = placed.select("doc_id", F.col("line_no").alias("ord"), up.alias("parent"),
                         F.coalesce(F.col("section_line") == F.col("line_no"), F.lit(False)).alias("is_heading"),
                         (F.length("raw") % 5 == 0).alias("changed"))
    return Q.elide_unchanged(rows, ["doc_id"]).select("doc_id", "ord", "action")


NUMBERED = LINES + """,
rows AS (SELECT doc_id, line_no AS ord, length(text) % 3 = 1 AS is_item, length(text) % 2 = 0 AS added FROM lines),
n AS (SELECT *, sum(CASE WHEN NOT is_item AND added THEN 1 ELSE 0 END) OVER w AS n,
        coalesce(last_value(CASE WHEN NOT is_item THEN added END IGNORE NULLS) OVER w, FALSE) AS under
      FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("added_numbers", f"""
WITH {NUMBERED}, l AS (SELECT *, CASE WHEN n <= 1 THEN 'x' ELSE 'x+' || (n - 1) END AS lit FROM n)
SELECT doc_id, ord, CASE WHEN NOT is_item AND added THEN lit WHEN NOT is_item THEN '#' WHEN NOT added THEN '#.#'
  WHEN under THEN lit || '.#' ELSE '#.x' END AS number FROM l""")
def added_numbers(t):
    n = F.length("text")
    rows = D.doc_lines(t).select("doc_id", F.col("line_no").alias("ord"), (n % 3 == 1).alias("is_item"),
                                 (n % 2 == 0).alias("added"))
    return Q.number_added(rows, ["doc_id"]).select("doc_id", "ord", "number")


@query("paragraph_numbers", f"""
WITH {LINES}, o AS (SELECT doc_id, line_no AS ord, line_no = 1 OR length(text) % 3 = 0 AS opens FROM lines)
SELECT doc_id, ord, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS paragraph FROM o""")
def paragraph_numbers(t):
    rows = D.doc_lines(t).select("doc_id", F.col("line_no").alias("ord"), (F.length("text") % 3 == 0).alias("opens"))
    return Q.number_paragraphs(rows, ["doc_id"]).select("doc_id", "ord", "paragraph")


@query("prose_outside", f"""
WITH {STRIPPED}, {HEADS.split(ANNOTATED + ",")[1]}
SELECT s.doc_id, s.line_no, 'error' AS severity, 'detached prose requires an open section' AS message FROM stripped s
WHERE vocab = 'markup' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = s.doc_id AND h.line_no <= s.line_no)""")
def prose_outside(t):
    lines = D.annotated(t)
    heads = L.headings(lines).filter("NOT malformed").select("doc_id", "line_no", "stable")
    placed = S.section_of_lines(L.classify(lines), heads)
    return placed.filter("section_line IS NULL AND vocab = 'markup'").select(
        "doc_id", "line_no", F.lit("error").alias("severity"), F.lit(V.PROSE_OUTSIDE).alias("message"))
