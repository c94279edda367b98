"""Queries of the rule operators: classifiers, policies, reviews, validation, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions import text, uri, validate
from scrivana.functions.canonical import edit_digest
from scrivana.operators import gate, policy, render, rules
from scrivana.plans.tables import table




def _none() -> Column:
    return F.array().cast("array<string>")


def task_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents' texts, and conversations' as the terms' carriers, routed as tasks."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    task = F.concat_ws(" ", F.when(F.col("c_mktsegment") == "BUILDING", "Extend the UI-library for").when(F.col("c_mktsegment") == "MACHINERY", "Fix the screen of").when(F.col("c_mktsegment") == "FURNITURE", "Index the formless table of").otherwise("Describe"), "c_name")
    rows = rows.select("o_orderkey", task.alias("task"), F.when(F.col("o_orderstatus") == "P", F.array("o_orderpriority")).otherwise(_none()).alias("scope"))
    found = rules.ui_class(F.col("task"), F.lit(False), _none(), F.col("scope"))
    rows = rows.withColumn("c", found).withColumn("r", rules.routed(F.col("c.classification")))
    tier = rules.complexity(F.col("task"), F.array("task"), _none(), F.col("scope"), F.col("c.confidence") == "medium")
    return rows.select("o_orderkey", "c.classification", "c.evidence_kind", "c.confidence", F.col("c.evidence")[0].alias("evidence"), "r.invoke", "r.reason", tier.alias("tier"), rules.pr_type(F.col("task"), F.get("scope", F.lit(0))).alias("pr_type"), rules.component(F.col("task"), F.concat(F.lit("lib/"), F.lower("task"), F.lit("/src/a.ts"))).alias("component"))


TASK_CLASSES = r"""
WITH t AS (
  SELECT o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Extend the UI-library for ' WHEN 'MACHINERY' THEN 'Fix the screen of ' WHEN 'FURNITURE' THEN 'Index the formless table of ' ELSE 'Describe ' END || c_name AS task,
         o_orderstatus = 'P' AS scoped, o_orderpriority AS s, c_mktsegment AS m
  FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT *, CASE WHEN scoped OR m = 'BUILDING' THEN 'ui-related' WHEN m = 'MACHINERY' THEN 'possible-ui' ELSE 'non-ui' END AS classification FROM t)
SELECT o_orderkey, classification,
       CASE WHEN scoped THEN 'component-scope' WHEN m = 'BUILDING' THEN 'explicit-ui-component-language' WHEN m = 'MACHINERY' THEN 'generic-ui-language' ELSE 'non-ui-language' END AS evidence_kind,
       CASE WHEN classification = 'possible-ui' THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN scoped THEN s ELSE task END AS evidence,
       classification <> 'non-ui' AS invoke, classification || CASE WHEN classification <> 'non-ui' THEN ' task meets possible-ui threshold' ELSE ' task is below possible-ui threshold' END AS reason,
       CASE WHEN classification = 'possible-ui' THEN 'sol' WHEN regexp_matches(task, 'fix|feature|extend', 'i') THEN 'terra' ELSE 'luna' END AS tier,
       CASE WHEN regexp_matches(lower(task), 'bug|fix|issue|correct|repair') THEN 'Bug fix' WHEN regexp_matches(lower(task), 'refactor|restructure|cleanup') THEN 'Refactoring'
            WHEN regexp_matches(lower(task), 'document|documentation|readme') THEN 'Documentation content changes' WHEN regexp_matches(lower(task), 'add|create|feature|implement|introduce') THEN 'Feature' ELSE 'Other' END AS pr_type,
       CASE WHEN m = 'BUILDING' THEN 'UI' ELSE upper(substr(lower(task), 1, 1)) || substr(lower(task), 2) END AS component
FROM c"""


def model_assignments(spark: SparkSession, d: str) -> DataFrame:
    preset = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").when(F.col("o_orderpriority") == "5-LOW", "light").otherwise("recommended")
    tier = F.when(F.col("o_orderstatus") == "F", "luna").when(F.col("o_orderstatus") == "O", "terra").otherwise("sol")
    rows = rules.assigned(table(spark, d, "orders").select(preset.alias("preset"), tier.alias("tier")), rules.assignment_table(spark))
    return rows.groupBy("preset", "tier", "role", "model", "reasoning").agg(F.count(F.lit(1)).alias("n"))


# What each preset comes to, written out by tier: recommended depends on it, the others don't.
_ASSIGNED = """
  ('recommended', 'luna', 'planner', 'gpt-5.6-luna', 'medium'), ('recommended', 'luna', 'planReviewer', 'gpt-5.6-luna', 'medium'), ('recommended', 'luna', 'engineer', 'gpt-5.6-luna', 'medium'),
  ('recommended', 'luna', 'uiReviewer', 'gpt-5.6-luna', 'medium'), ('recommended', 'luna', 'prWriter', 'gpt-5.6-luna', 'light'), ('recommended', 'luna', 'orchestrator', 'gpt-5.6-luna', 'medium'),
  ('recommended', 'terra', 'planner', 'gpt-5.6-terra', 'high'), ('recommended', 'terra', 'planReviewer', 'gpt-5.6-terra', 'high'), ('recommended', 'terra', 'engineer', 'gpt-5.6-terra', 'high'),
  ('recommended', 'terra', 'uiReviewer', 'gpt-5.6-terra', 'high'), ('recommended', 'terra', 'prWriter', 'gpt-5.6-luna', 'light'), ('recommended', 'terra', 'orchestrator', 'gpt-5.6-luna', 'medium'),
  ('recommended', 'sol', 'planner', 'gpt-5.6-sol', 'high'), ('recommended', 'sol', 'planReviewer', 'gpt-5.6-terra', 'high'), ('recommended', 'sol', 'engineer', 'gpt-5.6-sol', 'high'),
  ('recommended', 'sol', 'uiReviewer', 'gpt-5.6-terra', 'high'), ('recommended', 'sol', 'prWriter', 'gpt-5.6-luna', 'light'), ('recommended', 'sol', 'orchestrator', 'gpt-5.6-luna', 'medium'),
  ('light', NULL, 'planner', 'gpt-5.6-luna', 'high'), ('light', NULL, 'planReviewer', 'gpt-5.6-luna', 'medium'), ('light', NULL, 'engineer', 'gpt-5.6-luna', 'medium'),
  ('light', NULL, 'uiReviewer', 'gpt-5.6-luna', 'medium'), ('light', NULL, 'prWriter', 'gpt-5.6-luna', 'light'), ('light', NULL, 'orchestrator', 'gpt-5.6-luna', 'medium'),
  ('medium', NULL, 'planner', 'gpt-5.6-terra', 'high'), ('medium', NULL, 'planReviewer', 'gpt-5.6-luna', 'medium'), ('medium', NULL, 'engineer', 'gpt-5.6-terra', 'high'),
  ('medium', NULL, 'uiReviewer', 'gpt-5.6-terra', 'high'), ('medium', NULL, 'prWriter', 'gpt-5.6-luna', 'light'), ('medium', NULL, 'orchestrator', 'gpt-5.6-luna', 'medium'),
  ('high', NULL, 'planner', 'gpt-5.6-sol', 'high'), ('high', NULL, 'planReviewer', 'gpt-5.6-sol', 'high'), ('high', NULL, 'engineer', 'gpt-5.6-sol', 'medium'),
  ('high', NULL, 'uiReviewer', 'gpt-5.6-sol', 'high'), ('high', NULL, 'prWriter', 'gpt-5.6-luna', 'light'), ('high', NULL, 'orchestrator', 'gpt-5.6-luna', 'medium')"""
MODEL_ASSIGNMENTS = f"""
SELECT o.preset, o.tier, role, model, reasoning, count(*) AS n
FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '5-LOW' THEN 'light' ELSE 'recommended' END AS preset,
             CASE o_orderstatus WHEN 'F' THEN 'luna' WHEN 'O' THEN 'terra' ELSE 'sol' END AS tier FROM orders) o
JOIN (VALUES {_ASSIGNED}) v(preset, tier, role, model, reasoning) ON v.preset = o.preset AND coalesce(v.tier, o.tier) = o.tier GROUP BY ALL"""


def page_policy(spark: SparkSession, d: str) -> DataFrame:
    """Pages' addresses against an allow-list, each as a link, as a wiki page and as a repository."""
    pages = table(spark, d, "pages").select("page_id", "url")
    secure = F.regexp_replace("url", "^http:", "https:")
    rows = pages.select("page_id", F.explode(F.array(
        F.struct(F.lit("figma").alias("kind"), secure.alias("uri")), F.struct(F.lit("figma").alias("kind"), F.col("url").alias("uri")),
        F.struct(F.lit("confluence").alias("kind"), F.col("page_id").cast("string").alias("uri")), F.struct(F.lit("mail").alias("kind"), F.col("url").alias("uri")),
        F.struct(F.lit("repository").alias("kind"), F.concat(F.lit("git@WWW.Host.example:team/"), F.col("page_id").cast("string"), F.lit(".git")).alias("uri")),
    )).alias("s")).select("page_id", "s.kind", "s.uri")
    found = policy.authorized(rows, {"figma": ["www.the.example.com", "thre.example.com"]}, ["https://www.host.example/team/7", "ssh://git@www.host.example/team/11.git"])
    return found.select("page_id", "kind", "uri", "allowed", "normalized", "reason")


PAGE_POLICY = r"""
WITH s AS (
  SELECT page_id, 'figma' AS kind, regexp_replace(url, '^http:', 'https:') AS uri FROM pages
  UNION ALL SELECT page_id, 'figma', url FROM pages
  UNION ALL SELECT page_id, 'confluence', page_id::VARCHAR FROM pages
  UNION ALL SELECT page_id, 'mail', url FROM pages
  UNION ALL SELECT page_id, 'repository', 'git@WWW.Host.example:team/' || page_id || '.git' FROM pages),
h AS (SELECT *, CASE WHEN starts_with(uri, 'https://') THEN regexp_replace(lower(regexp_extract(uri, '^https://([^/]+)', 1)), '^www\.', '') END AS host FROM s),
n AS (SELECT *, CASE kind WHEN 'figma' THEN 'https://' || host || regexp_extract(uri, '^https://[^/]+(/.*)$', 1) WHEN 'confluence' THEN 'confluence://' || uri WHEN 'repository' THEN 'www.host.example/team/' || page_id END AS normalized FROM h),
r AS (SELECT *, CASE WHEN kind = 'mail' THEN 'unknown-source-kind' WHEN normalized IS NULL THEN 'invalid-uri'
                     WHEN kind = 'figma' AND host NOT IN ('the.example.com', 'thre.example.com') THEN 'unapproved-host'
                     WHEN kind = 'repository' AND page_id NOT IN (7, 11) THEN 'unapproved-host' END AS reason FROM n)
SELECT page_id, kind, uri, reason IS NULL AS allowed, normalized, reason FROM r"""


def repository_targets(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    remote = F.concat(F.lit("https://user@host.example/"), F.regexp_replace("p_brand", "#", "-"), F.lit("/"), F.regexp_replace("p_name", " ", "-"), F.lit(".git"))
    found = policy.repository_evidence(remote, F.col("p_type"), F.array(F.concat(F.lit("libs\\"), F.regexp_replace("p_name", " ", "\\\\"))), _none(), "small-ring", "ring")
    rows = parts.select("p_partkey", found.alias("e"))
    return rows.select("p_partkey", policy.repository_target(F.col("e"), "small-ring").alias("target"), F.size("e").cast("long").alias("evidence"))


REPOSITORY_TARGETS = """
SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 'small-ring' WHEN contains(p_name, 'ring') THEN 'ambiguous' ELSE 'other' END AS target,
       CASE WHEN contains(p_name, 'ring') THEN 2::BIGINT ELSE 0 END AS evidence FROM part"""


def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as plans: what users say is open, the rest is done; longer ones are approved."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    tasks = F.transform("t", lambda x: F.struct(F.concat(F.lit("turn "), x["turn"].cast("string")).alias("id"), F.when(x["role"] == "user", "open").otherwise("verified").alias("status")))
    flags = {"plan_approved": F.lit(True), "edits_approved": F.size("t") > 1, "clean": F.lit(True), "tests_passed": F.size("t") < 6}
    return turns.select("conv_id", rules.heartbeat(tasks, flags).alias("h")).select("conv_id", "h.action", "h.task_id", "h.reason", "h.next_run")


HEARTBEATS = """
WITH c AS (SELECT conv_id, count(*) AS n, min(turn) FILTER (role = 'user') AS t FROM conversations GROUP BY conv_id),
a AS (SELECT *, CASE WHEN t IS NULL THEN 'complete' WHEN n >= 6 THEN 'blocked' WHEN n <= 1 THEN 'awaiting-approval' ELSE 'execute-one-task' END AS action FROM c)
SELECT conv_id, action, CASE WHEN action = 'execute-one-task' THEN 'turn ' || t END AS task_id,
       CASE action WHEN 'complete' THEN 'all plan tasks are complete' WHEN 'blocked' THEN 'verification failed and requires user review'
                   WHEN 'awaiting-approval' THEN 'plan and code-edit approvals are required' ELSE 'next unchecked task is eligible' END AS reason,
       CASE WHEN action = 'execute-one-task' THEN 'after-verification' END AS next_run FROM a"""


def plan_reviews(spark: SparkSession, d: str) -> DataFrame:
    """A plan for each customer: debts are gaps, orders in progress are checks, lines of business are decisions."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.lit("check"))).alias("checks"))
    rows = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    decision = F.struct(F.when(F.col("c_mktsegment") == "BUILDING", "ui-library").otherwise("other").alias("authority"), F.col("c_mktsegment").alias("topic"))
    plans = rows.select(F.col("c_custkey").alias("plan_id"), F.when(F.col("c_acctbal") < 0, F.array(F.lit("debt"))).otherwise(_none()).alias("gaps"), _none().alias("ambiguities"), F.coalesce("checks", _none()).alias("verification"), F.array(decision).alias("decisions"))
    return rules.recommendation(plans, rules.plan_findings(plans))


PLAN_REVIEWS = """
WITH p AS (SELECT c_custkey AS plan_id, c_acctbal < 0 AS g, count(o_orderkey) FILTER (o_orderstatus = 'P') = 0 AS v, c_mktsegment = 'BUILDING' AS d
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT plan_id, g::BIGINT + v::BIGINT + d::BIGINT AS findings, CASE WHEN g THEN 'blocked' WHEN v THEN 'revise' ELSE 'approve' END AS recommendation FROM p"""


def line_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as findings of a review of their order."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", "critical").when(F.col("l_returnflag") == "A", "high").alias("severity"), F.lit(None).cast("string").alias("id"))
    return rules.review(rows)[1]


LINE_REVIEWS = "SELECT l_orderkey AS review_id, count(*) AS findings, CASE WHEN bool_or(l_returnflag = 'R') THEN 'blocked' ELSE 'pass-with-findings' END AS completion FROM lineitem GROUP BY l_orderkey"

#: What the events' properties are held against.
EVENT_SCHEMA = {"type": "object", "required": ["k", "v"], "properties": {"k": {"type": ["integer", "null"], "minimum": 50}, "v": {"type": "string"}}}


def event_errors(spark: SparkSession, d: str) -> DataFrame:
    found = validate.validated(EVENT_SCHEMA, F.col("props"))
    return table(spark, d, "events").select("event_id", F.array_join(found, "; ").alias("errors"))


EVENT_ERRORS = "SELECT event_id, '$.v is required' || CASE WHEN (props ->> '$.k')::BIGINT < 50 THEN '; $.k must be at least 50' ELSE '' END AS errors FROM events"


def masked_documents(spark: SparkSession, d: str) -> DataFrame:
    masked = uri.mask_assignments(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(masked, 256).alias("masked_sha256"), (masked != F.col("text")).alias("changed"))


_SQL_MASK = r"regexp_replace(text, '(?i)(token|secret|authorization|cookie|password)\s*[:=]\s*[^\s,;&]+', '\1=[REDACTED]', 'g')"
MASKED_DOCUMENTS = f"SELECT doc_id, sha256({_SQL_MASK}) AS masked_sha256, {_SQL_MASK} <> text AS changed FROM documents"


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages' addresses with a secret put in at the end, and first."""
    url = F.col("url")
    last, first = F.concat(url, F.lit("&access_Token=x1")), F.regexp_replace(url, r"\?", "?SECRET=a&")
    return table(spark, d, "pages").select("page_id", uri.without_secrets(last).alias("last"), uri.without_secrets(first).alias("first"))


PAGE_LINKS = "SELECT page_id, CASE WHEN contains(url, '?') THEN url ELSE url || '&access_Token=x1' END AS last, url AS first FROM pages"


def supplier_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", text.label(F.concat(F.lit("plainName_of-"), name)).alias("label"), text.ticket_key(F.concat(F.lit(" crm-"), F.col("s_suppkey").cast("string"))).alias("ticket"),
        text.safe_stem(F.concat(name, F.lit(': a/b "c"?'))).alias("stem"), text.visible(F.concat(F.sha2(name, 256), F.lit("\t"), name)).alias("visible"), text.task_slug(F.concat(F.lit("Über "), name)).alias("slug"),
    )


SUPPLIER_NAMES = """
SELECT s_suppkey, 'Plain Name of ' || s_name AS label, 'CRM-' || s_suppkey AS ticket, s_name || ' ab c' AS stem, '[internal digest omitted] ' || s_name AS visible,
       'uber-' || regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS slug FROM supplier"""


def plan_documents(spark: SparkSession, d: str) -> DataFrame:
    """A rendered plan for each nation."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    plan = F.to_json(F.struct(F.lit("p1").alias("id"), F.col("n_name").alias("goal"), F.array("n_name", "r_name").alias("files"), F.struct(F.col("r_name").alias("mainRegion"), F.lit("x").alias("apiToken")).alias("scope"), F.lit("awaiting").alias("approvalStatus")))
    made = render.plan_artifacts(rows.select("n_nationkey", plan.alias("plan"), F.col("n_name").alias("task"), F.lit("geo-7").alias("ticket"), F.lit(2).alias("revision")))
    return made.select("n_nationkey", "title", "filename", "content")


PLAN_DOCUMENTS = r"""
SELECT n_nationkey, t AS title, 'GEO-7-' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') || '-plan-v2.md' AS filename,
       '# ' || t || e'\n\nRevision 2\n\n## Goal\n\n- ' || n_name || e'\n\n## Scope\n\n- **Main Region:** ' || r_name || e'\n\n## Affected Files\n\n- ' || n_name || e'\n- ' || r_name
       || e'\n\n## Interfaces\n\n- None.\n\n## Library Decisions\n\n- None.\n\n## Risks and Context Gaps\n\n- None.\n\n## Verification\n\n- None.\n\n## Open Questions\n\n- None.\n\n## Approval Status\n\n- awaiting' AS content
FROM (SELECT *, 'GEO-7 — ' || n_name || ' — Plan v2' AS t FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def approvals(spark: SparkSession, d: str) -> DataFrame:
    """Orders as plans; a first line approves the plan, a second one offers edits, further ones approve them."""
    orders = table(spark, d, "orders")
    ids = F.sha2(F.col("o_orderkey").cast("string"), 256)
    plans = orders.select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")).alias("plan"), ids.alias("snapshot_id"), ids.alias("context_digest"))
    begun = gate.initial(plans)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("plan_key"), F.col("l_linenumber").alias("seq"))
    kind = F.when(F.col("seq") == 1, "approve-plan").when(F.col("seq") == 2, "propose-edits").otherwise("approve-edits")
    edits = F.lit('[{"path":"a"}]')
    events = lines.join(begun, lines["plan_key"] == begun["plan_id"]).select("plan_key", "seq", kind.alias("kind"), edits.alias("edits"), "plan_id", "plan_hash", "snapshot_id", "context_digest", edit_digest(F.col("plan_id"), edits).alias("edit_hash"), F.lit("me").alias("approved_by"), F.lit("2024-01-01T00:00:00.000Z").alias("approved_at"))
    return gate.folded(plans, events).select("plan_id", "status")


APPROVALS = """
SELECT o_orderkey::VARCHAR AS plan_id, CASE WHEN s[1] IS NULL OR s[1] <> 1 THEN 'awaiting-plan-approval' WHEN list_contains(s, 2) AND s[-1] >= 3 THEN 'authorized' ELSE 'awaiting-edit-approval' END AS status FROM
(SELECT o_orderkey, (SELECT list(l_linenumber ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS s FROM orders)"""

QUERIES = {
    "task_classes": (task_classes, TASK_CLASSES), "model_assignments": (model_assignments, MODEL_ASSIGNMENTS), "page_policy": (page_policy, PAGE_POLICY),
    "repository_targets": (repository_targets, REPOSITORY_TARGETS), "heartbeats": (heartbeats, HEARTBEATS), "plan_reviews": (plan_reviews, PLAN_REVIEWS),
    "line_reviews": (line_reviews, LINE_REVIEWS), "event_errors": (event_errors, EVENT_ERRORS), "masked_documents": (masked_documents, MASKED_DOCUMENTS),
    "page_links": (page_links, PAGE_LINKS), "supplier_names": (supplier_names, SUPPLIER_NAMES), "plan_documents": (plan_documents, PLAN_DOCUMENTS),
    "approvals": (approvals, APPROVALS),
}
