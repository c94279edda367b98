"""Queries of the provenance operators: trees, snapshots, digests, source indexes, ledgers, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.functions import canonical, text
from scrivana.operators import constraints, ledger, snapshot, sources, tree
from scrivana.plans.tables import sql_trim, table


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree."""
    edge = lambda df, parent, child, key: df.select(parent.alias("parent_id"), child.alias("child_id"), key.cast("long").alias("child_pos"), F.lit(False).alias("inaccessible"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    return (
        edge(region, F.lit("world"), name("r", "r_regionkey"), F.col("r_regionkey"))
        .unionByName(edge(nation, name("r", "n_regionkey"), name("n", "n_nationkey"), F.col("n_nationkey")))
        .unionByName(edge(customer, name("n", "c_nationkey"), name("c", "c_custkey"), F.col("c_custkey")))
    )


def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    pages, _ = tree.walk(spark, _places(spark, d), "world")
    return pages.select("id", "parent_id", F.col("depth").cast("long").alias("depth"), F.array_join(F.transform("walk", lambda x: x.cast("string")), "/").alias("walk"))


TREE_WALK = """
SELECT 'world' AS id, NULL AS parent_id, 0::BIGINT AS depth, '' AS walk
UNION ALL SELECT 'r' || r_regionkey, 'world', 1, r_regionkey::VARCHAR FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_regionkey || '/' || n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3, n_regionkey || '/' || n_nationkey || '/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey"""


def tree_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The same tree with a way back from each nation to its region, and closed customers (those in debt)."""
    nation, customer = table(spark, d, "nation"), table(spark, d, "customer")
    back = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("child_id"), F.lit(-1).cast("long").alias("child_pos"), F.lit(False).alias("inaccessible"))
    debt = customer.where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child_id"), F.lit(True).alias("closed"))
    edges = _places(spark, d).unionByName(back).join(debt, "child_id", "left").select("parent_id", "child_id", "child_pos", F.coalesce("closed", F.lit(False)).alias("inaccessible"))
    _, gaps = tree.walk(spark, edges, "world")
    return gaps.groupBy("source_id", "reason", "impact").agg(F.count(F.lit(1)).alias("n"))


TREE_GAPS = """
SELECT 'r' || n_regionkey AS source_id, 'cycle' AS reason, 'cyclic descendant skipped' AS impact, count(*) AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'c' || c_custkey, 'inaccessible', 'descendant body and children unavailable', 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0"""


def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a first snapshot, what their lines say as a second one."""
    first = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.sha2("o_orderstatus", 256).alias("body_digest"), (F.col("o_totalprice") > 100000).alias("accessible"))
    second = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sha2(F.max("l_linestatus"), 256).alias("body_digest"), (F.count(F.lit(1)) > 3).alias("accessible"))
    return snapshot.diff_sources(first, second)


SNAPSHOT_CHANGES = """
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS b, o_totalprice > 100000 AS s FROM orders),
b AS (SELECT l_orderkey AS id, max(l_linestatus) AS b, count(*) > 3 AS s FROM lineitem GROUP BY l_orderkey)
SELECT * FROM (
  SELECT coalesce(a.id, b.id) AS source_id,
         CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.b <> b.b THEN 'body-changed' WHEN a.s <> b.s THEN 'accessibility-changed' END AS type
  FROM a FULL JOIN b ON a.id = b.id) WHERE type IS NOT NULL"""


def event_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", canonical.canonical(F.col("props")).alias("canonical"), canonical.digest(F.col("props")).alias("digest"))


EVENT_DIGESTS = "SELECT event_id, json(props)::VARCHAR AS canonical, sha256(json(props)::VARCHAR) AS digest FROM events"


def order_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each order's lines, whatever their order in the table."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part")).alias("line"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return grouped.select("l_orderkey", canonical.digest_struct(F.col("lines")).alias("digest"))


ORDER_DIGESTS = """
SELECT l_orderkey, sha256('[' || string_agg('{"n":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']') AS digest
FROM lineitem GROUP BY l_orderkey"""


def event_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Whether the events' times, written in three ways, are strict timestamps."""
    full, short = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = F.when(F.col("event_type") == "click", full).when(F.col("event_type") == "view", short).otherwise("2024-02-30T00:00:00.000Z")
    return table(spark, d, "events").select("event_id", canonical.strict_timestamp(given).alias("strict"))


EVENT_TIMESTAMPS = "SELECT event_id, event_type = 'click' AS strict FROM events"


def _index(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in zip(("es", "en", "fr", "de"), sources.FAMILIES, strict=True) for x in pair])
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), kinds[F.col("lang")].alias("kind"), F.concat(F.lit("https://notes.example/"), "source").alias("uri"), F.col("text").alias("title"), F.array("source", "lang").alias("tags"), F.lit(False).alias("is_root"))


_SQL_INDEX = """(SELECT doc_id::VARCHAR AS id, CASE lang WHEN 'es' THEN 'figma' WHEN 'en' THEN 'ui-library' WHEN 'fr' THEN 'crm-code' ELSE 'confluence' END AS kind,
  'https://notes.example/' || source AS uri, text AS title, source, lang FROM documents)"""
_SQL_MATCH = "(contains(lower(concat_ws(' ', id, uri, title, source, lang)), 'src3') OR contains(uri, '/src15'))"


def relevant_sources(spark: SparkSession, d: str) -> DataFrame:
    found, _, _ = sources.relevant(_index(spark, d), ["SRC3"], ["/src15"])
    return found.select("id", "kind", "uri")


RELEVANT_SOURCES = f"SELECT id, kind, uri FROM {_SQL_INDEX} WHERE {_SQL_MATCH}"


def source_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Kinds without any source about a word that texts of one language have, whole texts searched."""
    _, gaps, _ = sources.relevant(_index(spark, d), ["avec"])
    return gaps


SOURCE_GAPS = f"""
SELECT 'no relevant ' || k || ' source' AS reason, k || ' comparison is unavailable' AS impact FROM (VALUES ('figma'), ('ui-library'), ('crm-code')) v(k)
WHERE k NOT IN (SELECT kind FROM {_SQL_INDEX} WHERE contains(lower(concat_ws(' ', id, uri, title, source, lang)), 'avec'))"""


def ambiguous_topics(spark: SparkSession, d: str) -> DataFrame:
    found = sources.ambiguous(_index(spark, d), F.array(F.lit("fr"), F.lit("src3"), F.lit("none")))
    return found.select("topic", F.size("candidates").cast("long").alias("candidates"), F.array_min("candidates").alias("first"))


AMBIGUOUS_TOPICS = f"""
SELECT topic, count(*) AS candidates, min(id) AS first FROM (SELECT id, CASE WHEN source = 'src3' THEN 'src3' WHEN lang = 'fr' THEN 'fr' END AS topic FROM {_SQL_INDEX})
WHERE topic IS NOT NULL GROUP BY topic HAVING count(*) > 3"""


def _refreshed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels")
    given = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "stale").when(F.col("lang") == "de", "fresh").alias("freshness"), F.lit(None).cast("string").alias("body"))
    fetched = marks.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.col("quality").cast("string")).alias("body"), F.when(F.col("toxic") == 1, "refused").alias("error"))
    return snapshot.refreshed(given, fetched)


def refreshed_sources(spark: SparkSession, d: str) -> DataFrame:
    return _refreshed(spark, d)[0].select("id", "freshness", "body", "body_unavailable")


_SQL_FETCH = "(SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'stale' WHEN 'de' THEN 'fresh' ELSE 'unknown' END AS f, CASE WHEN quality = 1 THEN '1' END AS b, CASE WHEN toxic = 1 THEN 'refused' END AS e FROM documents LEFT JOIN labels USING (doc_id))"
REFRESHED_SOURCES = f"SELECT id, CASE WHEN f <> 'fresh' AND b IS NOT NULL AND e IS NULL THEN 'fresh' ELSE f END AS freshness, CASE WHEN f <> 'fresh' AND e IS NULL THEN b END AS body, f <> 'fresh' AND (b IS NULL OR e IS NOT NULL) AS body_unavailable FROM {_SQL_FETCH}"


def refresh_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _refreshed(spark, d)[1]


REFRESH_GAPS = f"SELECT id AS source_id, CASE WHEN e IS NOT NULL THEN 'refresh-failed' ELSE 'body-unavailable' END AS reason, coalesce(e, 'source body unavailable') AS impact FROM {_SQL_FETCH} WHERE f <> 'fresh' AND (b IS NULL OR e IS NOT NULL)"


def lesson_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Of lessons of equal class and wording in the same scope, each later one with each earlier one's first."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("class"), F.col("text").alias("lesson"), F.array("source", "lang").alias("scope"))
    first = rows.groupBy("class", text.lesson_key(F.col("lesson")).alias("k"), text.scope_key(F.col("scope")).alias("s")).agg(F.min_by(F.struct("id", "class", "lesson", "scope"), "id").alias("e")).select("e.*")
    return ledger.exact_duplicates(first, rows).where("proposal <> entry")


LESSON_DUPLICATES = rf"""
SELECT doc_id AS proposal, entry FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, source, regexp_replace(lower({sql_trim('text')}), '\s+', ' ', 'g')) AS entry FROM documents) WHERE doc_id <> entry"""


def lesson_overlaps(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    entries = parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("class"), F.col("p_name").alias("lesson"), F.array("p_type").alias("scope"))
    asked = parts.select("p_brand").distinct().select(F.concat(F.lit("ask "), "p_brand").alias("id"), F.col("p_brand").alias("class"), F.lit("Small ring").alias("lesson"), F.array(F.lit(" economy"), F.lit("SMALL")).alias("scope"))
    return ledger.overlaps(entries, asked)


LESSON_OVERLAPS = """
SELECT 'ask ' || p_brand AS proposal, p_partkey AS entry FROM part
WHERE lower(p_type) IN ('economy', 'small') AND (list_contains(string_split(p_name, ' '), 'small') OR list_contains(string_split(p_name, ' '), 'ring'))"""


def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Declared against counted lengths of the documents."""
    docs = table(spark, d, "documents")
    counted = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.lower("lang").alias("lang"))
    declared = docs.select("doc_id", "n_chars", F.upper("lang").alias("lang"))
    return constraints.mismatches(declared, counted, "doc_id", ["n_chars", "lang"])


TEXT_LENGTHS = """
SELECT doc_id, 'lang' AS field, upper(lang) AS declared, lower(lang) AS actual FROM documents WHERE upper(lang) <> lower(lang)
UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR, length(text)::VARCHAR FROM documents WHERE n_chars <> length(text)"""


def part_versions(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("1.0.0-0"), F.col("p_size").cast("string"))).otherwise("1.0.0")
    return constraints.version_errors(table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("package"), version.alias("version")))


PART_VERSIONS = """
SELECT package, CASE WHEN bad THEN 'invalid or missing SemVer version' ELSE 'version mismatch' END AS error
FROM (SELECT p_brand || '/' || p_name AS package, bool_or(p_type = 'SMALL') AS bad FROM part GROUP BY 1) WHERE bad"""


def unlabelled(spark: SparkSession, d: str) -> DataFrame:
    return constraints.missing(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


UNLABELLED = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def single_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return constraints.not_unique(rows.select("conv_id").distinct(), rows.where("role = 'assistant'"), "conv_id")


SINGLE_TURNS = "SELECT conv_id, count(*) FILTER (role = 'assistant') AS n FROM conversations GROUP BY conv_id HAVING n <> 1"


def missing_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of benchmark items that no document of a language has exactly."""
    asked = table(spark, d, "benchmark").select("item_id", F.explode(constraints.sentences(F.col("text"))).alias("sentence")).distinct()
    docs = table(spark, d, "documents").select("lang", "text")
    # The languages are one short array, which each of the benchmark's sentences is asked for.
    langs = docs.agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    required = asked.select("item_id", "sentence", F.lit(1).alias("k")).join(F.broadcast(langs.withColumn("k", F.lit(1))), "k").select("item_id", "sentence", F.explode("langs").alias("lang"))
    return constraints.missing_sentences(required, docs, "lang")


_SQL_SENTENCES = rf"unnest(string_split(regexp_replace(regexp_replace({sql_trim('text')}, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)))"
MISSING_SENTENCES = f"""
WITH h AS (SELECT DISTINCT lang, lower(s) AS s FROM (SELECT lang, {_SQL_SENTENCES} AS s FROM documents)),
a AS (SELECT DISTINCT item_id, lower(s) AS s FROM (SELECT item_id, {_SQL_SENTENCES} AS s FROM benchmark) WHERE s <> '')
SELECT item_id, lang, a.s AS sentence FROM a, (SELECT DISTINCT lang FROM documents) l
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = l.lang AND h.s = a.s)"""

QUERIES = {
    "tree_walk": (tree_walk, TREE_WALK), "tree_gaps": (tree_gaps, TREE_GAPS), "snapshot_changes": (snapshot_changes, SNAPSHOT_CHANGES),
    "event_digests": (event_digests, EVENT_DIGESTS), "order_digests": (order_digests, ORDER_DIGESTS), "event_timestamps": (event_timestamps, EVENT_TIMESTAMPS),
    "relevant_sources": (relevant_sources, RELEVANT_SOURCES), "source_gaps": (source_gaps, SOURCE_GAPS), "ambiguous_topics": (ambiguous_topics, AMBIGUOUS_TOPICS),
    "refreshed_sources": (refreshed_sources, REFRESHED_SOURCES), "refresh_gaps": (refresh_gaps, REFRESH_GAPS),
    "lesson_duplicates": (lesson_duplicates, LESSON_DUPLICATES), "lesson_overlaps": (lesson_overlaps, LESSON_OVERLAPS),
    "text_lengths": (text_lengths, TEXT_LENGTHS), "part_versions": (part_versions, PART_VERSIONS), "unlabelled": (unlabelled, UNLABELLED),
    "single_turns": (single_turns, SINGLE_TURNS), "missing_sentences": (missing_sentences, MISSING_SENTENCES),
}
