"""Registered queries over lines, tags, pieces and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import vocabulary as V
from palimpsest.functions import text as X
from palimpsest.operators import lines as L
from palimpsest.operators import sections as S
from palimpsest.plans import derived as D
from palimpsest.plans.registry import query

LINES, ANNOTATED = D.LINES_SQL, D.ANNOTATED_SQL


def in_list(values):
    return ", ".join(f"'{v}'" for v in values)


# The markup lines of the annotated corpus without decoration, for the checks.
STRIPPED = ANNOTATED + r""",
stripped AS (
  SELECT doc_id, line_no, raw,
    CASE WHEN regexp_matches(raw, '^[ \t]*(//!|/\*!)') THEN 'markup'
         WHEN regexp_matches(raw, '^[ \t]*(///|/\*\*)') THEN 'doxygen'
         WHEN regexp_matches(raw, '^[ \t]*(//|/\*)') THEN 'draft' END AS vocab,
    regexp_replace(raw, '^[ \t]*(//[!/]?)? ?', '') AS text
  FROM annotated)
"""
TAGS = STRIPPED + rf""",
tags AS (
  SELECT doc_id, line_no, regexp_extract(text, '^[ \t]*\\([a-z0-9-]+)', 1) AS tag,
         trim(regexp_replace(text, '^[ \t]*\\[a-z0-9-]+(\([^)]*\))?', '')) AS rest
  FROM stripped WHERE vocab = 'markup' AND regexp_matches(text, '^[ \t]*\\[a-z0-9-]+')),
roles AS (
  SELECT *, CASE WHEN tag IN ({in_list(V.ELEMENT_KINDS)}) THEN 'element'
                 WHEN tag IN ({in_list(V.BLOCK_TAGS)}) THEN 'block'
                 WHEN tag IN ({in_list(V.MARKER_TAGS)}) THEN 'marker' ELSE 'unknown' END AS role FROM tags)
"""
# Headings by a scan of their characters: the title ends where the count of open braces comes to nothing.
HEADS = ANNOTATED + r""",
opened AS (SELECT doc_id, line_no, raw,
    regexp_extract(raw, '^[ \t]*//[/!]?[ \t]*\\rSec([0-9]+)[ \t]*\[([^\]]*)\][ \t]*\{', ['depth', 'stable']) AS h,
    CASE WHEN regexp_matches(raw, '^[ \t]*//[/!]?[ \t]*\\rSec([0-9]+)[ \t]*\[([^\]]*)\][ \t]*\{')
         THEN substr(raw, strpos(raw, '{') + 1) END AS rest
  FROM annotated WHERE regexp_matches(raw, '^[ \t]*//[/!]?[ \t]*\\rSec')),
letters AS (SELECT doc_id, line_no, unnest(string_split(rest, '')) AS c,
    generate_subscripts(string_split(rest, ''), 1) AS i FROM opened WHERE rest IS NOT NULL),
counted AS (SELECT doc_id, line_no, i, 1 + sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)
    OVER (PARTITION BY doc_id, line_no ORDER BY i) AS held FROM letters),
title_ends AS (SELECT doc_id, line_no, min(i) AS at FROM counted WHERE held = 0 GROUP BY ALL),
tagged AS (SELECT o.doc_id, o.line_no, raw, h, e.at IS NOT NULL AS ok, substr(rest, 1, e.at - 1) AS title
  FROM opened o LEFT JOIN title_ends e ON e.doc_id = o.doc_id AND e.line_no = o.line_no),
heads AS (SELECT doc_id, line_no, TRY_CAST(h.depth AS BIGINT) AS depth, h.stable AS stable, title
  FROM tagged WHERE ok)
"""


@query("doc_lines", f"WITH {LINES} SELECT doc_id, line_no, text FROM lines")
def doc_lines(t):
    return D.doc_lines(t).select("doc_id", "line_no", "text")


@query("doc_words", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '^[ \t\r\n]+|[^ \t\r\n]+[ \t\r\n]*', 0) AS ws FROM documents)
SELECT doc_id, CAST(generate_subscripts(ws, 1) AS BIGINT) AS pos, unnest(ws) AS word FROM w""")
def doc_words(t):
    return L.words(t.documents.select("doc_id", "text"), ["doc_id"])


@query("code_tokens", rf"""
WITH {LINES}, w AS (SELECT doc_id, line_no, regexp_extract_all(text, '^[ \t\r\n]+|[A-Za-z0-9_]+[ \t\r\n]*|[^A-Za-z0-9_ \t\r\n][ \t\r\n]*', 0) AS ws FROM lines)
SELECT doc_id, line_no, CAST(len(ws) AS BIGINT) AS n_tokens, md5(array_to_string(ws, '|')) AS tokens FROM w""")
def code_tokens(t):
    tokens = X.code_tokens_of("text")
    return D.doc_lines(t).select("doc_id", "line_no", F.size(tokens).alias("n_tokens"),
                                 F.md5(F.array_join(tokens, "|").cast("binary")).alias("tokens"))


@query("line_offsets", f"""
WITH {LINES} SELECT doc_id, line_no, CAST(coalesce(sum(length(text) + 1) OVER (
  PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset
FROM lines""")
def line_offsets(t):
    return L.line_offsets(D.doc_lines(t)).select("doc_id", "line_no", F.col("offset").cast("bigint").alias("offset"))


@query("comment_lines", f"WITH {STRIPPED} SELECT doc_id, line_no, vocab, text FROM stripped")
def comment_lines(t):
    return L.classify(D.annotated(t)).select("doc_id", "line_no", "vocab", "text")


@query("section_headings", f"""
WITH {HEADS} SELECT doc_id, line_no, NOT ok AS malformed, CASE WHEN ok THEN TRY_CAST(h.depth AS BIGINT) END AS depth,
  CASE WHEN ok THEN h.stable END AS stable, CASE WHEN ok THEN title END AS title FROM tagged""")
def section_headings(t):
    return L.headings(D.annotated(t)).select("doc_id", "line_no", "malformed", "depth", "stable", "title")


@query("wrapped_titles", f"""
WITH {LINES} SELECT doc_id, 2 * line_no AS line_no, 'w' || line_no AS stable,
  rtrim(split_part(text, ' ', 1)) || ' \\tcode{{' || ltrim(substr(text, length(split_part(text, ' ', 1)) + 1)) || '}}' AS title
FROM lines WHERE NOT regexp_matches(text, '[{{}}\\r\\t]')""")
def wrapped_titles(t):
    """Titles broken over two lines, inside a nested group: each line of the corpus is written as such a heading."""
    df = D.doc_lines(t).filter(~F.col("text").rlike("[{}\\r\\t]"))
    first = F.split_part("text", F.lit(" "), F.lit(1))
    rest = F.ltrim(F.substring(F.col("text"), F.length(first) + 1, F.length("text")))
    parts = F.array(F.concat(F.lit("/// \\rSec3[w"), F.col("line_no"), F.lit("]{"), first, F.lit(" \\tcode{")),
                    F.concat(F.lit("/// "), rest, F.lit("}} more")))
    lines = df.select("doc_id", F.posexplode(parts).alias("_p", "raw"), "line_no").select(
        "doc_id", (2 * F.col("line_no") + F.col("_p")).alias("line_no"), "raw")
    return L.headings(L.wrapped_headings(lines)).filter("NOT malformed").select(
        "doc_id", "line_no", "stable", F.regexp_replace("title", r"\{ ", "{").alias("title"))


@query("bare_sections", f"""
WITH {LINES}, h AS (SELECT doc_id, line_no, length(text) % 11 AS depth FROM lines WHERE length(text) % 3 = 0),
ends AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id)
SELECT h.doc_id, 'b' || h.line_no AS stable, h.depth, h.line_no AS first_line,
  coalesce((SELECT min(n.line_no) FROM h n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.depth <= h.depth) - 1,
           e.last) AS last_line
FROM h JOIN ends e ON e.doc_id = h.doc_id""")
def bare_sections(t):
    """Draft sections, whose headings have no comment leader: every third line length makes one."""
    n = F.length("text")
    raw = F.when(n % 3 == 0, F.concat(F.lit("\\rSec"), n % 11, F.lit("[b"), F.col("line_no"), F.lit("]{Title}"))).otherwise(
        F.col("text"))
    return L.slice_sections(D.doc_lines(t).select("doc_id", "line_no", raw.alias("raw")), bare=True)


@query("wrapped_slices", f"""
WITH {LINES}, h AS (SELECT doc_id, 2 * line_no AS line_no, line_no AS n, length(text) % 11 AS depth FROM lines WHERE length(text) % 3 = 0),
ends AS (SELECT doc_id, max(2 * line_no + CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) AS last FROM lines GROUP BY doc_id)
SELECT h.doc_id, 'w' || h.n AS stable, h.depth, h.line_no AS first_line,
  coalesce((SELECT min(n.line_no) FROM h n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.depth <= h.depth) - 1,
           e.last) AS last_line
FROM h JOIN ends e ON e.doc_id = h.doc_id""")
def wrapped_slices(t):
    """Sections of drafts whose titles are broken over two lines: every third line length makes one."""
    n = F.length("text")
    parts = F.when(n % 3 == 0, F.array(F.concat(F.lit("\\rSec"), n % 11, F.lit("[w"), F.col("line_no"), F.lit("]{Title of \\tcode{")),
                                       F.lit("the rest}}"))).otherwise(F.array(F.col("text")))
    lines = D.doc_lines(t).select("doc_id", F.posexplode(parts).alias("_p", "raw"), "line_no").select(
        "doc_id", (2 * F.col("line_no") + F.col("_p")).alias("line_no"), "raw")
    return L.slice_sections(lines, bare=True)


@query("page_headings", r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS titles,
                  regexp_extract_all(html, '<h([1-6])[^>]*>[^<]*</h[1-6]>', 1) AS depths FROM pages)
SELECT page_id, CAST(generate_subscripts(titles, 1) AS BIGINT) AS ord, CAST(unnest(depths) AS BIGINT) AS depth,
       unnest(titles) AS title FROM h""")
def page_headings(t):
    tag = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>[^<]*</h[1-6]>"), F.lit(0))
    return t.pages.select("page_id", F.posexplode(tag).alias("_p", "_h")).select(
        "page_id", (F.col("_p") + 1).alias("ord"), F.regexp_extract("_h", "<h([1-6])", 1).cast("int").alias("depth"),
        F.regexp_extract("_h", ">([^<]*)<", 1).alias("title"))


@query("section_fences", rf"""
WITH {ANNOTATED} SELECT doc_id, line_no, regexp_extract(raw, '^[ \t]*///[ \t]*END \[(.+)\][ \t\r]*$', 1) AS stable
FROM annotated WHERE regexp_matches(raw, '^[ \t]*///[ \t]*END \[(.+)\][ \t\r]*$')""")
def section_fences(t):
    return L.fences(D.annotated(t))


@query("reference_tags", rf"""
WITH {ANNOTATED} SELECT doc_id, line_no, regexp_extract(raw, '^[ \t]*//[/!]?[ \t]*\\ref[ \t]*\{{([^}}]*)\}}', 1) AS target
FROM annotated WHERE regexp_matches(raw, '^[ \t]*//[/!]?[ \t]*\\ref[ \t]*\{{([^}}]*)\}}')""")
def reference_tags(t):
    return L.references(D.annotated(t))


@query("page_links", r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, CAST(generate_subscripts(hrefs, 1) AS BIGINT) AS ord, unnest(hrefs) AS target FROM h""")
def page_links(t):
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
                          .alias("_p", "target")).select("page_id", (F.col("_p") + 1).alias("ord"), "target")


@query("element_tags", f"WITH {TAGS} SELECT doc_id, line_no, tag, rest, role FROM roles")
def element_tags(t):
    return L.tags(D.annotated(t)).select("doc_id", "line_no", "tag", "rest", "role")


@query("unknown_tags", f"""
WITH {TAGS} SELECT doc_id, line_no, 'unknown tag \\' || tag || '; line kept as prose' AS message
FROM roles WHERE role = 'unknown'""")
def unknown_tags(t):
    return L.tags(D.annotated(t)).filter("role = 'unknown'").select(
        "doc_id", "line_no", X.template(V.UNKNOWN_TAG, F.col("tag")).alias("message"))


@query("joined_prose", rf"""
WITH {STRIPPED},
cut AS (SELECT doc_id, line_no, trim(regexp_extract(text, '^((?:[^%\\]|\\.)*)', 1)) AS t,
               NOT regexp_matches(text, '^(?:[^%\\]|\\.)*[^ \t%\\]%') AS apart
        FROM stripped WHERE vocab = 'markup')
SELECT doc_id, rtrim(string_agg(t || CASE WHEN apart THEN ' ' ELSE '' END, '' ORDER BY line_no)) AS text
FROM cut WHERE t <> '' GROUP BY doc_id""".replace("cut AS (SELECT doc_id, line_no, trim", "trimmed AS (SELECT doc_id, line_no, trim").replace("FROM cut WHERE t", "FROM trimmed WHERE t"))
def joined_prose(t):
    return L.join_prose(L.classify(D.annotated(t)).filter("vocab = 'markup'"), ["doc_id"])


@query("prose_pieces", rf"""
WITH {STRIPPED},
worded AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '^[ \t]*\\[a-z0-9-]+') THEN trim(regexp_replace(text, '^[ \t]*\\[a-z0-9-]+(\([^)]*\))?', ''))
  ELSE text END AS text FROM stripped WHERE vocab = 'markup'),
p AS (SELECT doc_id, line_no, regexp_extract_all(text, '`[^`]*`|`[^`]*$|\\iref\{{[^}}]*\}}|[^`\\]+', 0) AS ps
      FROM worded),
e AS (SELECT doc_id, line_no, CAST(generate_subscripts(ps, 1) AS BIGINT) AS ord, unnest(ps) AS p FROM p)
SELECT doc_id, line_no, ord,
  CASE WHEN regexp_matches(p, '^`[^`]*`$') THEN 'code' WHEN p LIKE '`%' THEN 'open_code'
       WHEN p LIKE '\iref{{%' THEN 'iref' ELSE 'text' END AS kind,
  CASE WHEN regexp_matches(p, '^`[^`]*`$') THEN p[2:-2] WHEN p LIKE '`%' THEN p[2:]
       WHEN p LIKE '\iref{{%' THEN p[7:-2] ELSE p END AS text FROM e""")
def prose_pieces(t):
    return L.pieces(L.wording(D.annotated(t)), ["doc_id", "line_no"])


@query("unterminated_code", rf"""
WITH {STRIPPED} SELECT doc_id, line_no, 'unterminated ` code span' AS message FROM stripped
WHERE vocab = 'markup' AND (length(text) - length(replace(text, '`', ''))) % 2 = 1""")
def unterminated_code(t):
    prose = L.classify(D.annotated(t)).filter("vocab = 'markup'")
    return L.pieces(prose, ["doc_id", "line_no"]).filter("kind = 'open_code'").select(
        "doc_id", "line_no", F.lit(V.UNTERMINATED).alias("message"))


@query("index_entries", rf"""
WITH {ANNOTATED} SELECT doc_id, line_no, 'member' AS kind,
  regexp_extract(raw, '^\\[a-z]+\{{([^}}]*)\}}', 1) AS name, regexp_extract(raw, '^\\[a-z]+\{{[^}}]*\}}\{{([^}}]*)\}}', 1) AS parent
FROM annotated WHERE regexp_matches(raw, '^\\indexlibrarymember\{{[^}}]*\}}\{{[^}}]*\}}')""")
def index_entries(t):
    return L.index_entries(D.annotated(t)).select("doc_id", "line_no", "kind", "name", "parent")


@query("section_slices", f"""
WITH {HEADS}, ends AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id)
SELECT h.doc_id, h.stable, h.depth, h.line_no AS first_line,
  CAST(coalesce((SELECT min(n.line_no) FROM heads n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no
                 AND n.depth <= h.depth) - 1, e.last) AS BIGINT) AS last_line
FROM heads h JOIN ends e ON e.doc_id = h.doc_id""")
def section_slices(t):
    return L.slice_sections(D.annotated(t))


@query("sliced_lines", f"""
WITH {HEADS}, ends AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY doc_id),
slices AS (SELECT h.doc_id, h.stable, h.line_no AS first_line,
  coalesce((SELECT min(n.line_no) FROM heads n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no
            AND n.depth <= h.depth) - 1, e.last) AS last_line
  FROM heads h JOIN ends e ON e.doc_id = h.doc_id)
SELECT s.doc_id, s.stable, s.first_line, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(sum(length(l.raw)) AS BIGINT) AS n_chars
FROM slices s JOIN annotated l ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.first_line AND s.last_line
GROUP BY ALL""")
def sliced_lines(t):
    lines = D.annotated(t)
    return L.lines_in_slices(lines, L.slice_sections(lines)).groupBy("doc_id", "stable", "first_line").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"))


@query("table_cells", rf"""
WITH {LINES}, r AS (SELECT doc_id, line_no, string_split(text, '|') AS cells FROM lines WHERE text LIKE '%|%')
SELECT doc_id, line_no, CAST(generate_subscripts(cells, 1) AS BIGINT) AS cell_no, trim(unnest(cells)) AS cell,
       CAST(len(cells) AS BIGINT) AS n_cells FROM r""")
def table_cells(t):
    from palimpsest.operators import elements as E
    return E.table_cells(D.doc_lines(t).filter(F.col("text").contains("|")), ["doc_id", "line_no"], separator="|")


@query("cell_arity", rf"""
WITH {LINES}, r AS (SELECT doc_id, line_no, len(string_split(text, '|')) AS n FROM lines WHERE text LIKE '%|%'),
f AS (SELECT *, first_value(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS want FROM r)
SELECT doc_id, line_no, CAST(n AS BIGINT) AS n_cells, CAST(want AS BIGINT) AS expected FROM f WHERE n <> want""")
def cell_arity(t):
    from palimpsest.operators import elements as E
    return E.arity_findings(D.doc_lines(t).filter(F.col("text").contains("|")), ["doc_id"], separator="|")


@query("hyphenated_names", """
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || '__' AS name FROM part)
SELECT p_partkey, name, replace(rtrim(name, '_'), '_', '-') AS shown FROM n""")
def hyphenated_names(t):
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("__"))
    return t.part.select("p_partkey", name.alias("name"), X.hyphenated(name).alias("shown"))


@query("unescaped_pages", r"""
SELECT page_id, regexp_replace(replace(html, '%', '\%'), '\\([&%#])', '\1', 'g') = html AS restored,
       CAST(length(regexp_replace(html, '\\([&%#])', '\1', 'g')) AS BIGINT) AS n_chars FROM pages""")
def unescaped_pages(t):
    escaped = F.replace(F.col("html"), F.lit("%"), F.lit("\\%"))
    return t.pages.select("page_id", (X.unescape(escaped) == F.col("html")).alias("restored"),
                          F.length(X.unescape("html")).alias("n_chars"))


@query("described_sections", f"""
WITH {HEADS}, {TAGS.split(ANNOTATED + ",")[1]},
placed AS (SELECT r.doc_id, (SELECT max(h.line_no) FROM heads h WHERE h.doc_id = r.doc_id AND h.line_no <= r.line_no) AS line_no
           FROM roles r WHERE r.role = 'element')
SELECT h.doc_id, h.line_no, h.stable FROM heads h
WHERE EXISTS (SELECT 1 FROM placed p WHERE p.doc_id = h.doc_id AND p.line_no = h.line_no)""")
def described_sections(t):
    lines = D.annotated(t)
    heads = L.headings(lines).filter("NOT malformed").select("doc_id", "line_no", "stable")
    tags = L.tags(lines).filter("role = 'element'").select("doc_id", "line_no")
    placed = S.section_of_lines(tags.unionByName(heads.select("doc_id", "line_no")), heads)
    owners = placed.filter("section_line IS NOT NULL AND line_no <> section_line").select(
        "doc_id", F.col("section_line").alias("line_no")).distinct()
    return heads.join(owners, ["doc_id", "line_no"], "left_semi")


@query("file_name_check", r"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand FROM part
           UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT url FROM pages)
SELECT name, regexp_matches(name, '^[A-Za-z0-9._+-]+$') AND NOT regexp_matches(name, '^[.-]')
  AND NOT name LIKE '%.' AND NOT contains(name, '..') AS usable FROM n""")
def file_name_check(t):
    part = t.part
    names = part.select(F.col("p_name").alias("name")).union(part.select("p_brand")).union(
        part.select("p_type")).union(t.pages.select("url")).distinct()
    return names.select("name", X.usable_as_file_name("name").alias("usable"))


@query("names_under_roots", f"""
WITH {HEADS}, roots AS (SELECT DISTINCT d.source || '.s' || (1 + l.quality + l.toxic) AS root
                        FROM labels l JOIN documents d USING (doc_id))
SELECT doc_id, line_no, name FROM (SELECT doc_id, line_no, stable || '.t' || depth AS name FROM heads) h
WHERE EXISTS (SELECT 1 FROM roots r WHERE h.name = r.root OR starts_with(h.name, r.root || '.'))""")
def names_under_roots(t):
    names = L.headings(D.annotated(t)).filter("NOT malformed").select(
        "doc_id", "line_no", F.concat("stable", F.lit(".t"), "depth").alias("name"))
    roots = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select(
        F.concat("source", F.lit(".s"), 1 + F.col("quality") + F.col("toxic")).alias("root"))
    return S.under_roots(names, roots).select("doc_id", "line_no", "name")


@query("names_used", rf"""
WITH {STRIPPED},
r AS (SELECT doc_id, line_no, regexp_extract_all(text, '[^A-Za-z0-9_]*[A-Za-z0-9_]+|[^A-Za-z0-9_]+$', 0) AS rs
      FROM stripped WHERE vocab = 'markup'),
e AS (SELECT doc_id, line_no, CAST(generate_subscripts(rs, 1) AS BIGINT) AS pos, unnest(rs) AS r FROM r),
g AS (SELECT doc_id, line_no, pos, regexp_extract(r, '^([^A-Za-z0-9_]*)', 1) AS gap,
             regexp_extract(r, '([A-Za-z0-9_]*)$', 1) AS name FROM e),
c AS (SELECT *, pos > 1 AND trim(gap, ' ' || chr(9)) = '::' AS connected,
             coalesce(starts_with(trim(lead(gap) OVER w, ' ' || chr(9)), '::'), false) AS qualifier
      FROM g WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)),
s AS (SELECT *, sum(CASE WHEN connected THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS chain FROM c)
SELECT doc_id, line_no, pos, name, qualifier,
  connected AND first_value(name) OVER (PARTITION BY doc_id, line_no, chain ORDER BY pos) = 'std' AS standard
FROM s WHERE TRUE QUALIFY name <> ''""")
def names_used(t):
    return L.names_used(L.classify(D.annotated(t)).filter("vocab = 'markup'"), ["doc_id", "line_no"])


@query("typesetting_free", rf"""
WITH {LINES}, p AS (SELECT doc_id, text, regexp_replace(text, '(\*\*\*|%%%|###|\$\$\$|&&&)', '', 'g') AS plain FROM lines)
SELECT md5(plain) AS content_key, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(DISTINCT text) AS BIGINT) AS n_spellings,
       min(doc_id) AS first_doc FROM p GROUP BY plain""")
def typesetting_free(t):
    from palimpsest.operators import spans as P
    return P.content_groups(D.doc_lines(t).select("doc_id", "text"), "text", "doc_id")
