"""The registered queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import collocations, contamination, conversations, jaccard, language, licences, mixing, neighbours, personal, quality, sharding, toxicity, warc
from palimpsest.llm.jaccard import written
from palimpsest.session import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(ident: str = "doc_id"):
    """True on the fifth of ids that no model here may learn from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))) % 5 == 0


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; prototypes are learned from all documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    prototypes = language.learn(docs.filter(~held_out()))
    found = language.identify(docs, prototypes, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op2_licences")
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of documents. The tables have no paths: a document's path is made from its source and
    id, a hundred to a directory, every tenth named as a licence file, every hundredth of them a level higher."""
    i = F.col("doc_id")
    upper = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.lit("v"), F.floor(i / 1000).cast("string")))
    path = F.when(i % 1000 == 0, F.concat(upper, F.lit("/LICENSE."), i.cast("string"))).otherwise(F.concat(
        upper, F.lit("/p"), F.floor(i / 100).cast("string"), F.when(i % 10 == 0, "/LICENSE.").otherwise("/text."),
        i.cast("string")))
    docs = table(spark, sf_dir, "documents").withColumn("path", path)
    return licences.inherit(written(licences.declared(docs, keep=("doc_id", "path")), "declared"))


GRAMS = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM cut)"""


@query("op3_decontamination", GRAMS + """,
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
grams AS (
  SELECT item_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM items),
want AS (SELECT item_id, len(g) AS n, unnest(g) AS s FROM grams),
have AS (SELECT doc_id, unnest(g) AS s FROM sets)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_found FROM want JOIN have USING (s)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_ngram_jaccard", GRAMS + """,
kinds AS (SELECT min(doc_id) AS k, g, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM sets) GROUP BY g),
flat AS (SELECT k, n, unnest(g) AS s FROM kinds),
meet AS (SELECT x.k AS a, y.k AS b, x.n + y.n AS n, count(*) AS c FROM flat x JOIN flat y ON x.s = y.s AND x.k <> y.k
         GROUP BY ALL HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT k AS a, k AS b FROM kinds UNION SELECT r.a, m.b FROM reach r JOIN meet m ON r.b = m.a),
root AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE root.c END AS component_id
FROM sets s JOIN kinds ON list_sort(s.g) = kinds.g JOIN root ON root.a = kinds.k
""")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their five-word shingles."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of the personal data of each document."""
    found = personal.find_personal(table(spark, sf_dir, "documents"))

    def listed(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*personal.BASE))

    def counted(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(counted(kind) for kind in personal.BASE),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document and its worst sentence; fitted on labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(~held_out())
    weights = toxicity.fit(docs, labels)
    found = toxicity.score(docs, weights)
    return found.select("doc_id", held_out().alias("held_out"), "score",
                        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
                        "worst_start", "worst_end", "worst_score")


@query("op10_warc", """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(regexp_extract_all(hex, '.'),
      lambda d: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110',
            '1111'][strpos('0123456789abcdef', d)]), '') AS b
  FROM page)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
           + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = latest THEN NULL ELSE latest END AS refers_to
FROM bits
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives and back: what each capture's records say."""
    path = warc.archive_folder(shared_folder(spark))
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.captures(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, equal texts together."""
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken when sources are mixed half way to equal weights, repeated four times at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", "n_tokens", "weight", "quota", "copies")


@query("op8_embedding_near_dups", """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
root AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT root.a AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, root.a = c AS kept FROM root LEFT JOIN counted USING (a)
""")
def op8_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label with cosine 0.93 or more."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_collocations", r"""
WITH lower_case AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM lower_case),
cut AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM cut, range(1, 5) AS s(m))),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
parts AS (SELECT *, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM cuts),
scored AS (
  SELECT p.lang, p.m, p.phrase, p.a, p.k, x.f AS l, y.f AS r, (2000000::HUGEINT * p.a // (x.f + y.f))::BIGINT AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.head JOIN counts y ON y.lang = p.lang AND y.phrase = p.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, f, array_to_string(w[i:i + z - 1], ' ') AS phrase
  FROM (SELECT lang, m, f, z, w, unnest(range(1, m - z + 2)) AS i
        FROM (SELECT lang, m, f, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS z FROM counts WHERE m > 2))),
covered AS (SELECT lang, phrase, max(f) AS f FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE c.f IS NULL OR 100 * c.f::HUGEINT < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose parts stand least apart."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document; learned from labelled documents that are not held out."""
    apart = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    measured = written(quality.measure(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(~apart)
    found = quality.score(measured, quality.fit(measured, labels))
    return found.select("doc_id", apart.alias("held_out"), "score",
                        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def _repair_sql() -> str:
    """The contract as SQL: rows walked in order, four (cost, audit, text) triples a row, the least of each kept."""
    def plus(x, cost, letter, line=None):
        text = f"{x}.t" if line is None else f"{x}.t || chr(10) || {line}"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {text}}} END"
    user, assistant = "'user:' || text", "'assistant:' || text"
    want = [plus(x, "1 + late", "R", user) for x in ("x0", "x1", "x3")]
    want += [f"CASE WHEN kind = 'u' THEN {plus(x, 'late', 'K', 'line')} END" for x in ("x0", "x1", "x3")]
    after = {
        0: plus("x0", 2, "D"),
        1: f"least({plus('x1', 2, 'D')}, CASE WHEN NOT forced AND kind = 's' THEN {plus('x0', 'late', 'K', 'line')} END)",
        2: f"least({plus('x2', 2, 'D')}, CASE WHEN NOT forced THEN least({', '.join(want)}) END)",
        3: f"least({plus('x3', 2, 'D')}, CASE WHEN NOT forced THEN least({plus('x2', '1 + late', 'R', assistant)}, "
           f"CASE WHEN kind = 'a' THEN {plus('x2', 'late', 'K', 'line')} END) END)",
    }
    to_user = ", ".join(plus(x, 5, "I", "'user:'") for x in ("x0", "x1", "x3"))
    return f"""
WITH RECURSIVE
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') AS key, coalesce(turn::VARCHAR, ' ') AS at_turn FROM conversations),
fated AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key || ':' || at_turn, ''),
        lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate
        FROM keyed k, tab),
damaged AS (SELECT key, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
faulty AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        row_number() OVER (PARTITION BY key, role, text ORDER BY pos) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end,
        lag(role[1]) OVER (PARTITION BY key ORDER BY pos) || role[1] AS pair FROM placed),
given AS (SELECT key, pos, text, role || ':' || text AS line, role[1] AS kind, blank OR again AS forced,
        CASE WHEN open_end THEN 5 ELSE 0 END AS late FROM faulty),
counted AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (open_end AND NOT again AND NOT blank) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM faulty GROUP BY key),
walk AS (
  SELECT key, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS y0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS y1,
         NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS y2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS y3 FROM counted
  UNION ALL
  SELECT key, pos, {after[0]}, {after[1]}, {after[2]}, {after[3]} FROM (
    SELECT w.key, g.pos, text, line, kind, forced, late, w.y0 AS x0, w.y1 AS x1, w.z2 AS x2,
           least(w.y3, {plus('w.z2', 5, 'I', "'assistant:'")}) AS x3
    FROM (SELECT key, pos, y0, y1, y3, least(y2, {to_user.replace('x', 'y')}) AS z2 FROM walk) w
    JOIN given g ON g.key = w.key AND g.pos = w.pos + 1)),
ends AS (SELECT w.key, least(y0, y3, {plus('z2', 5, 'I', "'assistant:'")}) AS best
  FROM (SELECT key, pos, y0, y3, least(y2, {to_user.replace('x', 'y')}) AS z2 FROM walk) w
  JOIN counted c ON c.key = w.key AND c.n = w.pos)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, key FROM keyed) LEFT JOIN counted USING (key) LEFT JOIN ends USING (key)
"""


@query("op13_conversations", _repair_sql())
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and what the cheapest repair of each comes to."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over the documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
