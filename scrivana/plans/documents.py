"""Queries of the document operators over pages, documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.functions import text as T
from scrivana.operators import highlights, quotes, related, segment
from scrivana.plans.tables import sql_key, sql_strip, sql_trim, sql_words, table
from scrivana.sources import sinks

#: Words of a chunk in the queries; pages are short.
MAX_WORDS = 60


def pages_text(spark: SparkSession, d: str) -> DataFrame:
    text = T.strip_html(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.alias("text")).withColumn("words", T.word_count(F.col("text")))


PAGES_TEXT = f"SELECT page_id, text, len({sql_words('text')}) AS words FROM (SELECT page_id, {sql_strip('html')} AS text FROM pages)"


def pages_extraction(spark: SparkSession, d: str) -> DataFrame:
    return pages_text(spark, d).select("page_id", F.length("text").cast("long").alias("chars"), "words", T.extraction_note(F.col("text")).alias("note"))


PAGES_EXTRACTION = f"SELECT page_id, length(text) AS chars, words, CASE WHEN length(text) < 2000 THEN 'sparse' END AS note FROM ({PAGES_TEXT})"


def pages_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = segment.windows(F.lit(None).cast("string"), F.col("text"), MAX_WORDS)
    return segment.numbered(pages_text(spark, d).select("page_id", "text"), found, "page_id").select("page_id", "n", "title", "words", "body")


PAGES_CHUNKS = rf"""
WITH RECURSIVE t AS ({PAGES_TEXT}),
paragraphs AS (SELECT page_id, i, regexp_split_to_array(text, '\n\s*\n')[i] AS p FROM (SELECT page_id, text, unnest(range(1, len(regexp_split_to_array(text, '\n\s*\n')) + 1)) AS i FROM t)),
counted AS (SELECT page_id, i, p, {sql_words('p')} AS w FROM paragraphs),
cut AS (
  SELECT page_id, i, 0 AS k, p FROM counted WHERE len(w) <= {MAX_WORDS}
  UNION ALL
  SELECT page_id, i, k, array_to_string(w[k * {MAX_WORDS} + 1 : (k + 1) * {MAX_WORDS}], ' ')
  FROM (SELECT page_id, i, w, unnest(range(0, ((len(w) - 1) // {MAX_WORDS}) + 1)) AS k FROM counted WHERE len(w) > {MAX_WORDS})),
pieces AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, k) AS r, p, len({sql_words('p')}) AS n FROM cut),
pack AS (
  SELECT page_id, r, p, n, n AS c, 1 AS g FROM pieces WHERE r = 1
  UNION ALL
  SELECT x.page_id, x.r, x.p, x.n, CASE WHEN k.c + x.n > {MAX_WORDS} THEN x.n ELSE k.c + x.n END,
         CASE WHEN k.c + x.n > {MAX_WORDS} THEN k.g + 1 ELSE k.g END
  FROM pack k JOIN pieces x ON x.page_id = k.page_id AND x.r = k.r + 1),
groups AS (SELECT page_id, g, string_agg(p, chr(10) || chr(10) ORDER BY r) AS body FROM pack GROUP BY ALL)
SELECT page_id, CAST(g AS BIGINT) AS n, CASE WHEN max(g) OVER (PARTITION BY page_id) > 1 THEN 'Section (part ' || g || '/' || max(g) OVER (PARTITION BY page_id) || ')' END AS title,
       len({sql_words('body')}) AS words, body FROM groups"""


def pages_chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    return segment.chosen(pages_chunks(spark, d), "1-3,7").select("page_id", "n", "words")


PAGES_CHUNK_RANGES = f"SELECT page_id, n, words FROM ({PAGES_CHUNKS}) WHERE n BETWEEN 1 AND 3 OR n = 7"


def documents_text_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.text_key(F.col("text")).alias("key"))


DOCUMENTS_TEXT_KEY = f"SELECT doc_id, {sql_key('text')} AS key FROM documents"


def documents_keep_first(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", "source")
    return highlights.unique_highlights(rows, "doc_id").select("doc_id", "source")


DOCUMENTS_KEEP_FIRST = f"""
SELECT doc_id, source FROM (
  SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r
  FROM (SELECT doc_id, source, substr({sql_key('text')}, 1, 200) AS k FROM documents)) WHERE r = 1 AND k <> ''"""


def documents_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return highlights.source_counts(table(spark, d, "documents").select(F.col("source").alias("src"), "text"))


DOCUMENTS_SOURCE_COUNTS = f"SELECT source AS src, count(*) AS n, count(DISTINCT nullif(substr({sql_key('text')}, 1, 200), '')) AS \"unique\" FROM documents GROUP BY source"


def documents_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"), F.coalesce(T.year_from(F.col("text")), F.lit(0)).alias("year"), T.shown(F.col("text")).alias("shown"))


DOCUMENTS_SLUGS = rf"""
SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(lower({sql_trim("regexp_replace(text, '[^' || chr(92) || 'p{L}' || chr(92) || 'p{M}' || chr(92) || 'p{N}_' || chr(92) || 's-]', '', 'g')")}), '[\s_-]+', '-', 'g'), 1, 40), '-+$', ''), ''), 'section') AS slug,
       CAST(coalesce(nullif(regexp_extract(text, '(1[5-9]\d\d|20\d\d)', 1), ''), '0') AS INTEGER) AS year,
       CASE WHEN length(text) > 71 THEN substr(text, 1, 70) || '…' ELSE text END AS shown
FROM documents"""


def documents_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(T.lesson_tokens(F.col("text"))).cast("long").alias("lesson_tokens"))


DOCUMENTS_TOKENS = rf"""
SELECT doc_id, len(list_distinct({sql_words(r"regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g')")})) AS tokens,
       len(list_distinct(list_filter(regexp_split_to_array(lower({sql_trim('text')}), '[^\p{{L}}\p{{N}}.]+'), lambda w: length(w) > 1))) AS lesson_tokens
FROM documents"""


def parts_title_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part")
    return rows.select("p_partkey", T.title_matches(F.col("p_name"), F.lit("Small Ring: the first")).alias("by_words"), T.title_matches(F.col("p_name"), F.lit("ring"), F.lit("Nobody")).alias("by_part"))


PARTS_TITLE_MATCH = f"""
SELECT p_partkey, contains({sql_key('p_name')}, 'small ring the first') OR contains('small ring the first', {sql_key('p_name')})
         OR len(list_intersect({sql_words(sql_key('p_name'))}, ['small', 'ring', 'the', 'first'])) / 4 >= 0.6 AS by_words,
       contains({sql_key('p_name')}, 'ring') OR contains('ring', {sql_key('p_name')}) AS by_part
FROM part"""


def parts_related(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("basename"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("tags"))
    return related.related(notes, ["Economy", "Brand#2"], "Summary of the small ring", exclude="small ring 0").select("basename", "tag_hits", "title_hits", "score")


PARTS_RELATED = """
SELECT * FROM (
  SELECT p_name || ' ' || p_partkey AS basename, CAST((p_type = 'ECONOMY') AS BIGINT) + CAST((p_brand = 'Brand#2') AS BIGINT) AS tag_hits,
         len(list_intersect(list_distinct(string_split(p_name, ' ')), ['small', 'ring'])) AS title_hits, 3 * tag_hits + title_hits AS score
  FROM part) WHERE tag_hits + title_hits > 0 AND basename <> 'small ring 0'
ORDER BY score DESC, lower(basename), basename LIMIT 8"""


def parts_related_pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    notes = parts.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("basename"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("tags"))
    queries = parts.groupBy("p_brand").agg(F.min("p_name").alias("title")).select(F.col("p_brand").alias("query_id"), F.array("p_brand").alias("topics"), "title")
    return related.related_pairs(notes, queries).select("query_id", "basename", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


PARTS_RELATED_PAIRS = """
WITH q AS (SELECT p_brand AS query_id, min(p_name) AS title FROM part GROUP BY p_brand),
s AS (SELECT query_id, p_name || ' ' || p_partkey AS basename, 3 * CAST((p_brand = query_id) AS BIGINT) + len(list_intersect(string_split(p_name, ' '), string_split(title, ' '))) AS score FROM part, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(basename), basename) AS rank FROM s WHERE score > 0)
SELECT query_id, basename, score, rank FROM r WHERE rank <= 8"""


def _benchmark_fragments(spark: SparkSession, d: str) -> DataFrame:
    return quotes.quote_fragments(table(spark, d, "benchmark"), "item_id")


def benchmark_fragments(spark: SparkSession, d: str) -> DataFrame:
    return _benchmark_fragments(spark, d).select("item_id", F.col("frag_pos").cast("long").alias("frag_pos"), "frag", "long_enough")


_GLYPHS = T.DASHES + T.QUOTE_GLYPHS.replace("'", "''")
_SQL_QUOTE_KEY = lambda x: "lower(" + sql_trim(rf"regexp_replace(translate({x}, '{_GLYPHS}', '{'-' * len(T.DASHES) + chr(39) * 2 * len(T.QUOTE_GLYPHS)}'), '\s+', ' ', 'g')") + ")"
_FRAGMENTS = rf"""
parts AS (SELECT item_id, regexp_split_to_array(trim({sql_trim(r"regexp_replace(text, '\s+[—–-]{1,2}\s+[^—–]*$', '')")}, '{T.QUOTE_GLYPHS.replace("'", "''")} '), '\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…') AS p FROM benchmark),
trimmed AS (SELECT item_id, list_filter(list_transform(p, lambda x: trim({_SQL_QUOTE_KEY('x')}, '.,;:!?¡¿ ')), lambda x: x <> '') AS f FROM parts),
frags AS (SELECT item_id, CAST(i - 1 AS BIGINT) AS frag_pos, f[i] AS frag FROM (SELECT item_id, f, unnest(range(1, len(f) + 1)) AS i FROM trimmed))"""
BENCHMARK_FRAGMENTS = f"WITH {_FRAGMENTS} SELECT item_id, frag_pos, frag, length(frag) >= 16 AS long_enough FROM frags"


def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    frags = _benchmark_fragments(spark, d).where("long_enough")
    found = quotes.containment(frags, table(spark, d, "documents").select("doc_id", "text"), ["item_id", "frag_pos"], ["doc_id"])
    return found.select("item_id", F.col("frag_pos").cast("long").alias("frag_pos"), "doc_id")


BENCHMARK_CONTAINMENT = f"""
WITH {_FRAGMENTS}, hay AS (SELECT doc_id, {_SQL_QUOTE_KEY('text')} AS h FROM documents)
SELECT item_id, frag_pos, doc_id FROM frags JOIN hay ON contains(h, frag) WHERE length(frag) >= 16"""


def quote_verdicts(spark: SparkSession, d: str) -> DataFrame:
    frags = _benchmark_fragments(spark, d)
    found = quotes.containment(frags.where("long_enough"), table(spark, d, "documents").select("doc_id", "text"), ["item_id", "frag_pos"], ["doc_id"])
    return quotes.verdicts(frags, found, ["item_id"]).select("item_id", "verdict", "checked", "missing", "first_missing")


QUOTE_VERDICTS = f"""
WITH {_FRAGMENTS}, hay AS (SELECT {_SQL_QUOTE_KEY('text')} AS h FROM documents),
f AS (SELECT item_id, frag_pos, frag, length(frag) >= 16 AS l, EXISTS (SELECT 1 FROM hay WHERE contains(h, frag)) AS there FROM frags),
r AS (SELECT item_id, count(*) FILTER (l) AS checked, count(*) FILTER (l AND NOT there) AS missing, arg_min(frag, frag_pos) FILTER (l AND NOT there) AS first_missing FROM f GROUP BY item_id)
SELECT item_id, CASE WHEN checked = 0 THEN 'SKIP' WHEN missing > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, checked, missing, first_missing FROM r"""


def conversation_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = quotes.islands(table(spark, d, "conversations"), "conv_id", "turn", F.col("role"))
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"))


CONVERSATION_ISLANDS = """
WITH s AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND lag(turn) OVER w IS NOT NULL THEN 0 ELSE 1 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM s)
SELECT conv_id, island, min(role) AS role, min(turn) AS first_turn, count(*) AS turns FROM g GROUP BY conv_id, island"""


def conversation_notes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "highlight").otherwise("note")
    return highlights.attach_notes(table(spark, d, "conversations").withColumn("kind", kind), "conv_id", pos="turn").select("conv_id", "turn", "text", "note")


CONVERSATION_NOTES = """
WITH o AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS owner FROM conversations),
n AS (SELECT conv_id, owner, arg_max(text, turn) AS note FROM o WHERE role <> 'user' AND owner IS NOT NULL GROUP BY ALL)
SELECT o.conv_id, o.turn, o.text, coalesce(n.note, '') AS note FROM o LEFT JOIN n ON n.conv_id = o.conv_id AND n.owner = o.owner WHERE o.role = 'user'"""


def conversation_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments, consolidated to about 80 words."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), F.col("text").alias("body")))), lambda s: F.struct(s["title"].alias("title"), s["body"].alias("body"))).alias("s"))
    return segment.numbered(turns, segment.consolidated(F.col("s"), 80), "conv_id").select("conv_id", "n", "title", "words")


CONVERSATION_CHUNKS = f"""
WITH RECURSIVE t AS (SELECT conv_id, role, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM (SELECT conv_id, turn, role, len({sql_words('text')}) AS w FROM conversations) WHERE w > 0),
f AS (
  SELECT conv_id, r, role, w, w AS c, 1 AS g FROM t WHERE r = 1
  UNION ALL
  SELECT t.conv_id, t.r, t.role, t.w, CASE WHEN f.c >= 80 OR (f.c + t.w > 80 AND f.c >= 40) THEN t.w ELSE f.c + t.w END,
         CASE WHEN f.c >= 80 OR (f.c + t.w > 80 AND f.c >= 40) THEN f.g + 1 ELSE f.g END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
SELECT conv_id, CAST(g AS BIGINT) AS n, arg_min(role, r) || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' sections)' ELSE '' END AS title, CAST(sum(w) + 2 * count(*) AS BIGINT) AS words
FROM f GROUP BY conv_id, g"""


def part_links(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    w = Window.partitionBy().orderBy("r_regionkey")
    lines = table(spark, d, "region").select(F.row_number().over(w).cast("long").alias("pos"), F.concat(F.lit("About "), "r_name").alias("line"))
    return sinks.upserted_links(lines, parts.select(F.col("p_name").alias("stem")))


PART_LINKS = """
SELECT 0 AS part, row_number() OVER (ORDER BY r_regionkey) AS pos, 'About ' || r_name AS line FROM region
UNION ALL SELECT 1, 0, ''
UNION ALL SELECT 2, row_number() OVER (ORDER BY lower(line), line), line FROM (SELECT DISTINCT '- [[' || p_name || ']]' AS line FROM part)"""

QUERIES = {
    "pages_text": (pages_text, PAGES_TEXT), "pages_extraction": (pages_extraction, PAGES_EXTRACTION),
    "pages_chunks": (pages_chunks, PAGES_CHUNKS), "pages_chunk_ranges": (pages_chunk_ranges, PAGES_CHUNK_RANGES),
    "documents_text_key": (documents_text_key, DOCUMENTS_TEXT_KEY), "documents_keep_first": (documents_keep_first, DOCUMENTS_KEEP_FIRST),
    "documents_source_counts": (documents_source_counts, DOCUMENTS_SOURCE_COUNTS), "documents_slugs": (documents_slugs, DOCUMENTS_SLUGS),
    "documents_tokens": (documents_tokens, DOCUMENTS_TOKENS), "parts_title_match": (parts_title_match, PARTS_TITLE_MATCH),
    "parts_related": (parts_related, PARTS_RELATED), "parts_related_pairs": (parts_related_pairs, PARTS_RELATED_PAIRS),
    "benchmark_fragments": (benchmark_fragments, BENCHMARK_FRAGMENTS), "benchmark_containment": (benchmark_containment, BENCHMARK_CONTAINMENT),
    "quote_verdicts": (quote_verdicts, QUOTE_VERDICTS), "conversation_islands": (conversation_islands, CONVERSATION_ISLANDS),
    "conversation_notes": (conversation_notes, CONVERSATION_NOTES), "conversation_chunks": (conversation_chunks, CONVERSATION_CHUNKS), "part_links": (part_links, PART_LINKS),
}
