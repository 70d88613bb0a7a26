"""The queries opN_<name> over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.chat_format import perspectives
from cueline.llm.decontaminate import contamination
from cueline.llm.exact_dedup import exact_groups
from cueline.llm.language_id import held_out, identify
from cueline.llm.license_scan import NOTICE_SHARE, NOTICES, PHRASES, license_scan, stride_of, template_words
from cueline.llm.line_dedup import UNITS, line_counts
from cueline.llm.mixing import mix_sources
from cueline.llm.near_dedup import near_groups
from cueline.llm.phrases import collocations
from cueline.llm.set_join import jaccard_groups
from cueline.llm.token_counts import scores_for, token_counts
from cueline.llm.turn_repair import damaged, repair
from cueline.llm.url_filter import filter_urls, url_host, url_path

#: Fixed values for the SQL: the letters to lower-case, and words as RE2 patterns.
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, keep_text=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql_rows(templates: tuple[tuple[str, str], ...]) -> str:
    rows = ((template_words(text), label) for text, label in templates)
    return ", ".join(f"(string_split('{' '.join(words)}', ' '), '{label}', {stride_of(len(words))})" for words, label in rows)


SQL_LICENSE_SCAN = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
phrases(p, label, stride) AS (VALUES {_sql_rows(PHRASES)}),
notices(p, label, stride) AS (VALUES {_sql_rows(NOTICES)}),
places AS (
  SELECT doc_id, i - 1 AS place, label FROM d, phrases, unnest(range(1, len(w) - len(p) + 2)) AS t(i)
  WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base_labels
  FROM places GROUP BY doc_id),
strides AS (SELECT DISTINCT stride FROM notices),
starts AS (SELECT doc_id, stride, unnest(range(0, len(w), stride)) AS i FROM d, strides),
blocks AS (SELECT doc_id, stride, list_distinct(w[i + 1 : i + 2 * stride]) AS b FROM starts JOIN d USING (doc_id)),
found AS (
  SELECT doc_id, label, len(list_intersect(b, list_distinct(p)))::DOUBLE / len(list_distinct(p)) AS share,
         len(list_intersect(b, list_distinct(p))) >= ceil(round({NOTICE_SHARE} * len(list_distinct(p)), 6)) AS enough
  FROM blocks JOIN notices USING (stride)),
own AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS score FROM found WHERE enough GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)
"""


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


SQL_NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (SELECT DISTINCT a, a FROM edges UNION SELECT node, b FROM reach JOIN edges ON seen = a),
roots AS (SELECT node AS doc_id, min(seen) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


SQL_SOURCE_MIX = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix:' || doc_id::VARCHAR) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS lim,
         list_extract(CAST([5, 2, 1] AS DOUBLE[]), 1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3) AS w
  FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY lim / w, source NULLS LAST) AS k, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM weighed),
level AS (SELECT arg_min(lev, k) AS lev FROM levels WHERE lim >= lev * w),
shares AS (
  SELECT source, source_size, least(lim, coalesce((SELECT lev FROM level), lim / w) * w) AS target FROM weighed),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, floor(s.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - before)) END::BIGINT AS taken
FROM placed
"""

def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


SQL_DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({SQL_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({SQL_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS gram
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: A public tokenizer's model: op7 takes its pieces. It has no probabilities, so that they are fitted to the table.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, scores_for(docs, vocabulary), keep_text=False)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


SQL_CHAT_FORMAT = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
rows AS (
  SELECT t.conv_id, speaker, turn, role, said, text, role = speaker AS learnt,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || translate(replace(role, '<|im_', '< |im_'), chr(13) || chr(10), '  ') END || chr(10) AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
full_rows AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM rows),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM full_rows WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, said))
SELECT conv_id, speaker, turn, place, rendered, start, start + length(rendered) AS "end",
       CASE WHEN learnt THEN start + length(head) END AS masked_from, CASE WHEN learnt THEN start + length(head) + length(text) + 10 END AS masked_to, learnt
FROM placed
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("dropped", F.array_join("dropped", ","))


SQL_LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, i - 1 AS k, doc_id * 100000000 + i AS place, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
named AS (SELECT *, array_to_string(w, ' ') AS s FROM lines WHERE len(w) > 0),
firsts AS (SELECT s, any_value(w) AS w, min(place) AS place FROM named GROUP BY s),
units AS (
  SELECT s, place, 'w' AS kind, w AS u FROM firsts WHERE len(w) >= {UNITS}
  UNION ALL SELECT s, place, 'c', string_split(s, '') FROM firsts WHERE len(w) <= {UNITS} AND length(s) >= {UNITS}),
variants AS (
  SELECT s, place, kind, len(u) AS n, i, CASE kind WHEN 'w' THEN array_to_string(list_concat(u[1 : i - 1], u[i + 1 : len(u)]), ' ') ELSE array_to_string(list_concat(u[1 : i - 1], u[i + 1 : len(u)]), '') END AS v
  FROM units, unnest(range(1, len(u) + 1)) AS t(i)),
changed AS (SELECT kind, n, i, v, min(place) AS least FROM variants GROUP BY ALL),
near AS (
  SELECT x.s FROM variants x JOIN changed USING (kind, n, i, v) WHERE least < place
  UNION SELECT CASE WHEN x.place < y.place THEN y.s ELSE x.s END FROM variants x JOIN units y ON x.kind = y.kind AND x.v = y.s AND x.n = len(y.u) + 1),
found AS (
  SELECT n.doc_id, n.k, f.place < n.place AS repeated, EXISTS (SELECT 1 FROM near WHERE near.s = n.s) AS near FROM named n JOIN firsts f USING (s)),
counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (repeated) AS n_repeated, count(*) FILTER (near AND NOT repeated) AS n_near,
         string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (repeated OR near) AS dropped FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(dropped, '') AS dropped
FROM documents LEFT JOIN counts USING (doc_id)
"""


#: The pages have no fetch time: page k counts as fetched at noon of day k modulo 366 of 2024.
FETCHED = "timestamp_seconds(1704110400 + page_id % 366 * 86400)"
#: Nor are there lists. Their entries are made of the pages' hosts, so that they grow with the table: of each host, by the number k of its first
#: page, its list, path (of that page's first segment), day of 2024 and action. ``mirror`` is of the domain above the host.
URL_LOG = (
    ("spam", "host", None, "k % 300", "add", "true"),
    ("spam", "host", None, "k % 300 + 60", "remove", "k % 3 <> 0"),
    ("spam", "host", None, "k % 300 + 120", "add", "k % 2 = 0"),
    ("review", "host", "segment", "k * 7 % 366", "add", "true"),
    ("review", "host", "segment", "k * 7 % 366 + 100", "remove", "k % 4 <> 1"),
    ("mirror", "above", None, "k * 13 % 366", "add", "k % 5 = 0"),
    ("mirror", "above", None, "k * 13 % 366", "remove", "k % 10 = 0"),
)


def url_log(pages: DataFrame) -> DataFrame:
    """The log's entries: ``list``, ``host``, ``path``, ``date`` and ``action``."""
    known = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).filter("host IS NOT NULL")
    hosts = known.groupBy("host").agg(F.min("page_id").alias("k"), F.min_by("path", "page_id").alias("path"))
    hosts = hosts.withColumns({"segment": F.concat(F.lit("/"), F.get(F.split("path", "/"), F.lit(1))), "above": F.regexp_replace("host", r"^[^.]*\.", "")})
    one = lambda name, host, path, day, action, when: F.when(F.expr(when), F.struct(F.lit(name).alias("list"), F.col(host).alias("host"), (F.lit(None).cast("string") if path is None else F.col(path)).alias("path"), F.date_add(F.lit("2024-01-01").cast("date"), F.expr(f"CAST({day} AS INT)")).alias("date"), F.lit(action).alias("action")))
    return hosts.select(F.inline(F.array_compact(F.array(*(one(*row) for row in URL_LOG)))))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    return filter_urls(pages, url_log(pages)).select("page_id", "host", F.array_join("lists", ",").alias("lists"), "blocked")


SQL_URL_FILTER = rf"""
WITH captures AS MATERIALIZED (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:\s]*)', 1)), '.'), '') AS host,
         coalesce(nullif(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path,
         make_timestamp((1704110400 + page_id % 366 * 86400) * 1000000) AS fetched
  FROM pages),
hosts AS (
  SELECT host, k, '/' || string_split(path, '/')[2] AS segment, regexp_replace(host, '^[^.]*\.', '') AS above
  FROM (SELECT host, min(page_id) AS k, arg_min(path, page_id) AS path FROM captures WHERE host IS NOT NULL GROUP BY host)),
log AS ({" UNION ALL ".join(f"SELECT '{name}' AS list, {host} AS host, {path or 'NULL'} AS path, DATE '2024-01-01' + ({day})::INTEGER AS day, '{action}' AS action FROM hosts WHERE {when}" for name, host, path, day, action, when in URL_LOG)}),
last AS (SELECT list, host, rtrim(coalesce(path, ''), '/') AS path, day::TIMESTAMP AS since, max(action) AS action FROM log WHERE host <> '' GROUP BY ALL),
held AS MATERIALIZED (SELECT *, lead(since) OVER (PARTITION BY list, host, path ORDER BY since) AS until FROM last),
suffixes AS (
  SELECT page_id, path, fetched, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN host ELSE array_to_string(string_split(host, '.')[i : ], '.') END AS suffix
  FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i)),
hits AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM suffixes c JOIN held h ON c.suffix = h.host
     AND h.action = 'add' AND fetched >= since AND (until IS NULL OR fetched < until) AND (rtrim(c.path, '/') = h.path OR starts_with(c.path, h.path || '/'))
  GROUP BY page_id)
SELECT page_id, host, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked FROM captures LEFT JOIN hits USING (page_id)
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex({SQL_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, array_to_string(w[i : i + k - 2], ' ') AS head, w[i + k - 1] AS last, w[i] AS first, array_to_string(w[i + 1 : i + k - 1], ' ') AS tail
  FROM pieces, unnest(range(1, 4)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)),
f AS (SELECT lang, k, phrase, head, last, first, tail, count(*)::HUGEINT AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, 1 AS cut, l.a AS l, r.a AS r FROM candidates c JOIN f l ON l.lang = c.lang AND l.k = 1 AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.k = c.k - 1 AND r.phrase = c.tail
  UNION ALL
  SELECT c.lang, c.k, c.phrase, c.a, 2, l.a, r.a FROM candidates c JOIN f l ON l.lang = c.lang AND l.k = 2 AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.k = 1 AND r.phrase = c.last WHERE c.k = 3),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l * r) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, head AS phrase, a FROM candidates WHERE k = 3 UNION ALL SELECT lang, tail, a FROM candidates WHERE k = 3),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT s.* FROM least s LEFT JOIN longest i ON s.k = 2 AND s.lang = i.lang AND s.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(conversations), conversations)


def _sql_cheapest(state: int, ahead: str) -> str:
    """Least cost of all edits but insertions in a state, from the costs ``b0`` to ``b3`` behind the row."""
    to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[state]
    kept = " ".join(f"WHEN r.initial = '{c}' THEN b{q} + r.extra" for c, q in to.items())
    return f"least(b{state} + 2, CASE WHEN r.must THEN {_SQL_NEVER} {kept} ELSE {_SQL_NEVER} END, CASE WHEN r.must THEN {_SQL_NEVER} ELSE b{ahead} + 1 + r.extra END)"


_SQL_NEVER = "1000000000"
#: Of a state q: the one that an insertion or a changed role leads to, and the cost there.
_SQL_AHEAD, _SQL_ROLE = "[2, 2, 3, 2][q + 1]", "CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END"
SQL_TURN_REPAIR = f"""
WITH RECURSIVE original AS (SELECT DISTINCT conv_id FROM conversations),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 20 AS chosen
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN chosen = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN chosen = 1 THEN '' WHEN chosen = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, unnest(range(CASE chosen WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two
  FROM placed),
coded AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM faults),
rest(conv_id, i, b0, b1, b2, b3) AS (
  SELECT conv_id, max(n) + 1, 0::BIGINT, 10::BIGINT, 5::BIGINT, 0::BIGINT FROM coded GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(c0, c2 + 5, c3 + 10), least(c1, c2 + 5, c3 + 10), least(c2, c3 + 5), least(c3, c2 + 5)
  FROM (SELECT r.conv_id, r.i, {_sql_cheapest(0, "2")} AS c0, {_sql_cheapest(1, "2")} AS c1, {_sql_cheapest(2, "3")} AS c2, {_sql_cheapest(3, "2")} AS c3
        FROM rest b JOIN coded r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
costs AS MATERIALIZED (SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM rest),
walk(conv_id, i, q, edit, audit, lines) AS (
  SELECT conv_id, 1::BIGINT, 0, '', '', []::VARCHAR[] FROM coded WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE {_SQL_AHEAD} END, edit, audit || edit,
         CASE edit WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, {_SQL_ROLE} || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, {_SQL_ROLE} || ':' || text) END
  FROM (
    SELECT w.conv_id, w.i, q, audit, lines, role, text, kept,
           CASE WHEN r.i IS NOT NULL AND here = after[q + 1] + 2 THEN 'D' WHEN here = c.b[{_SQL_AHEAD} + 1] + 5 THEN 'I'
                WHEN r.i IS NULL THEN '' WHEN NOT must AND kept IS NOT NULL AND here = after[kept + 1] + extra THEN 'K' ELSE 'R' END AS edit
    FROM (SELECT w.*, c.b, c.b[q + 1] AS here FROM walk w JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i) w
    JOIN costs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i
    LEFT JOIN (
      SELECT coded.*, costs.b AS after FROM coded JOIN costs ON costs.conv_id IS NOT DISTINCT FROM coded.conv_id AND costs.i = coded.i + 1) r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
    LEFT JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS g(state, letter, kept) ON g.state = w.q AND g.letter = r.initial) steps
  WHERE edit <> ''),
ends AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM original o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs c ON c.i = 1 AND c.conv_id IS NOT DISTINCT FROM o.conv_id
"""

def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")


#: The same join as for near duplicates, at another similarity and without the decision.
SQL_NGRAM_JACCARD = SQL_NEAR_DEDUP.replace(">= 75 *", ">= 80 *").replace(", coalesce(root, d.doc_id) = d.doc_id AS kept", "")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_source_mix": op6_source_mix,
    "op7_token_counts": op7_token_counts,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_turn_repair": op12_turn_repair,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
ORACLE_SQL = {
    "op2_license_scan": SQL_LICENSE_SCAN,
    "op3_near_dedup": SQL_NEAR_DEDUP,
    "op4_exact_dedup": SQL_EXACT_DEDUP,
    "op5_decontaminate": SQL_DECONTAMINATE,
    "op6_source_mix": SQL_SOURCE_MIX,
    "op8_chat_format": SQL_CHAT_FORMAT,
    "op9_line_dedup": SQL_LINE_DEDUP,
    "op10_url_filter": SQL_URL_FILTER,
    "op11_collocations": SQL_COLLOCATIONS,
    "op12_turn_repair": SQL_TURN_REPAIR,
    "op13_ngram_jaccard": SQL_NGRAM_JACCARD,
}
