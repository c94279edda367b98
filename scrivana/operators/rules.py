"""Rule classifiers and reviews: ordered, first match wins, each with what it was decided by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Terms of interface tasks, ranks of their classes, terms of behaviour work.
DEFINITE_TERMS = r"(?i)\b(ui[ -]?library|design system|component[ -]?library|reusable component|crm component)\b"
POSSIBLE_TERMS = r"(?i)\b(ui|frontend|accessibility|button|input|form|screen|layout|style|visual)\b"
RANK = {"non-ui": 0, "possible-ui": 1, "ui-related": 2}
BEHAVIOUR_TERMS = r"(?i)fix|feature|extend"
# Pull request types by stated type, then by task.
STATED_TYPES = (("bug|fix", "Bug fix"), ("refactor", "Refactoring"), ("doc", "Documentation content changes"), ("feature", "Feature"))
TASK_TYPES = (
    ("bug|fix|issue|correct|repair", "Bug fix"), ("refactor|restructure|cleanup", "Refactoring"),
    ("document|documentation|readme", "Documentation content changes"), ("add|create|feature|implement|introduce", "Feature"),
)
# Model and reasoning of each role by preset; the recommended one starts from 'default'.
ROLES = ("planner", "planReviewer", "engineer", "uiReviewer", "prWriter", "orchestrator")
ASSIGNMENTS = (
    ("default", "planner", "sol", "high"), ("default", "planReviewer", "terra", "high"), ("default", "engineer", "sol", "high"),
    ("default", "uiReviewer", "terra", "high"), ("default", "prWriter", "luna", "light"), ("default", "orchestrator", "luna", "medium"),
    ("light", "planner", "luna", "high"), ("light", "planReviewer", "luna", "medium"), ("light", "engineer", "luna", "medium"),
    ("light", "uiReviewer", "luna", "medium"), ("light", "prWriter", "luna", "light"), ("light", "orchestrator", "luna", "medium"),
    ("medium", "planner", "terra", "high"), ("medium", "planReviewer", "luna", "medium"), ("medium", "engineer", "terra", "high"),
    ("medium", "uiReviewer", "terra", "high"), ("medium", "prWriter", "luna", "light"), ("medium", "orchestrator", "luna", "medium"),
    ("high", "planner", "sol", "high"), ("high", "planReviewer", "sol", "high"), ("high", "engineer", "sol", "medium"),
    ("high", "uiReviewer", "sol", "high"), ("high", "prWriter", "luna", "light"), ("high", "orchestrator", "luna", "medium"),
)
# What a tier changes in the recommended assignment.
TIER_CHANGES = (
    ("luna", "planner", "luna", "medium"), ("luna", "planReviewer", "luna", "medium"), ("luna", "engineer", "luna", "medium"), ("luna", "uiReviewer", "luna", "medium"),
    ("terra", "planner", "terra", "high"), ("terra", "engineer", "terra", "high"), ("terra", "uiReviewer", "terra", "high"),
)
TIERS, REASONING = ("luna", "terra", "sol"), ("light", "medium", "high")
# States of a task that count as done.
DONE = ("complete", "completed", "verified")


def _has(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def ui_class(task: Column, explicit: Column, links: Column, scope: Column) -> Column:
    """struct(classification, evidence_kind, evidence, confidence) of a task."""
    task = F.coalesce(task, F.lit(""))
    made = lambda c, kind, values, sure="high": F.struct(F.lit(c).alias("classification"), F.lit(kind).alias("evidence_kind"), values.alias("evidence"), F.lit(sure).alias("confidence"))
    return (
        F.when(explicit, made("ui-related", "explicit-invocation", F.array(F.lit("true"))))
        .when(_has(links), made("ui-related", "figma-link", links)).when(_has(scope), made("ui-related", "component-scope", scope))
        .when(task.rlike(DEFINITE_TERMS), made("ui-related", "explicit-ui-component-language", F.array(task)))
        .when(task.rlike(POSSIBLE_TERMS), made("possible-ui", "generic-ui-language", F.array(task), "medium"))
        .otherwise(made("non-ui", "non-ui-language", F.array(task)))
    )


def routed(classification: Column, threshold: str = "possible-ui") -> Column:
    """struct(invoke, reason): whether a class reaches a threshold."""
    if threshold not in RANK:
        raise ValueError(f"unknown UI routing threshold: {threshold}")
    rank = F.lit(None)
    for name, r in RANK.items():
        rank = F.when(classification == name, r).otherwise(rank)
    invoke = rank >= RANK[threshold]
    return F.struct(invoke.alias("invoke"), F.concat(classification, F.when(invoke, f" task meets {threshold} threshold").otherwise(f" task is below {threshold} threshold")).alias("reason"))


def complexity(task: Column, repositories: Column, links: Column, constraints: Column, unclear: Column) -> Column:
    """Tier of a task: sol for unclear, linked or accessibility work, terra for behaviour over several places, else luna."""
    hard = F.coalesce(unclear, F.lit(False)) | _has(links) | F.coalesce(F.array_contains(constraints, "accessibility"), F.lit(False))
    wide = (F.coalesce(F.size(repositories), F.lit(0)) > 1) | F.coalesce(task, F.lit("")).rlike(BEHAVIOUR_TERMS)
    return F.when(hard, "sol").when(wide, "terra").otherwise("luna")


def assignment_table(spark: SparkSession, prefix: str = "gpt-5.6-") -> DataFrame:
    """(preset, tier, role, model, reasoning): a small dimension; recommended and individual have a row for each tier."""
    given = spark.createDataFrame(ASSIGNMENTS, "preset string, role string, model string, reasoning string")
    tiers = F.explode(F.array(*[F.lit(t) for t in TIERS]))
    presets = F.when(F.col("preset") == "default", F.array(F.lit("recommended"), F.lit("individual"))).otherwise(F.array("preset"))
    rows = given.select(F.explode(presets).alias("preset"), "role", "model", "reasoning").withColumn("tier", tiers)
    changes = spark.createDataFrame([("recommended", *c) for c in TIER_CHANGES], "preset string, tier string, role string, new_model string, new_reasoning string")
    rows = rows.join(F.broadcast(changes), ["preset", "tier", "role"], "left")
    return rows.select("preset", "tier", "role", F.concat(F.lit(prefix), F.coalesce("new_model", "model")).alias("model"), F.coalesce("new_reasoning", "reasoning").alias("reasoning"))


def assigned(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests (preset, tier) with a row for each role. The table has 90 rows."""
    return requests.join(F.broadcast(table), ["preset", "tier"])


def assignment_error(assignments: Column, models: list[str], writer: Column) -> Column:
    """What is wrong with map<role, struct<model, reasoning>>; null if nothing is."""
    keys = F.array_sort(F.map_keys(assignments))
    roles = F.array(*[F.lit(r) for r in sorted(ROLES)])
    wrong = lambda r: ~F.coalesce(assignments[r]["model"].isin(*models) & assignments[r]["reasoning"].isin(*REASONING), F.lit(False))
    error = F.when(assignments.isNull(), "model assignments must be confirmed for every subagent").when(keys != roles, "model assignments must include exactly the required subagent roles")
    for r in ROLES:
        error = error.when(wrong(r), f"invalid model assignment for {r}")
    return error.when(~assignments["prWriter"].eqNullSafe(writer), "the description writer's assignment is fixed")


def proposal_decision(status: Column, proposal_id: Column, approval_id: Column, error: Column) -> Column:
    """struct(status, error) of a proposal that gets an approval."""
    why = F.when(status != "awaiting-confirmation", "model proposal is not awaiting confirmation").when(~proposal_id.eqNullSafe(approval_id), "model proposal ID does not match").otherwise(error)
    return F.struct(F.when(why.isNull(), "approved").otherwise(status).alias("status"), why.alias("error"))


def escalation(proposal_id: Column, tier: Column, target: Column) -> Column:
    """struct(escalation_id, from, to, error) of a request to move to another tier."""
    known = target.isin("luna", "terra", "sol")
    return F.struct(F.when(known, F.concat_ws(":", proposal_id, target)).alias("escalation_id"), tier.alias("from"), target.alias("to"), F.when(~known, F.concat(F.lit("unknown escalation target: "), target)).alias("error"))


def pr_type(task: Column, stated: Column) -> Column:
    """Type of a pull request: what is stated, else what the task's words say."""
    out = F.lit("Other")
    for terms, name in reversed(TASK_TYPES):
        out = F.when(F.lower(task).rlike(terms), name).otherwise(out)
    for terms, name in reversed(STATED_TYPES):
        out = F.when(F.lower(F.coalesce(stated, F.lit(""))).rlike(terms), name).otherwise(out)
    return out


def component(task: Column, path: Column) -> Column:
    """A CamelCase word of the task, else the folder above src, else the last folder, else 'Component'."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    at = F.array_position(parts, "src")
    folder = F.when(at > 1, F.get(parts, (at - 2).cast("int"))).otherwise(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("component")))
    named = F.nullif(F.regexp_extract(task, r"\b[A-Z][A-Za-z]*[A-Z][A-Za-z]*\b", 0), F.lit(""))
    return F.coalesce(named, F.concat(F.upper(F.substring(folder, 1, 1)), F.substring(folder, 2, 1 << 30)))


def plan_findings(plans: DataFrame) -> DataFrame:
    """(plan_id, id, severity, category, blocking) out of plans (plan_id, gaps, ambiguities, verification, decisions)."""
    made = lambda i, severity, category: F.struct(i.alias("id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"))
    unclear = F.when(_has(F.col("gaps")) | _has(F.col("ambiguities")), F.array(made(F.lit("context-incomplete"), "critical", "context")))
    unverified = F.when(~_has(F.col("verification")), F.array(made(F.lit("verification-incomplete"), "high", "verification")))
    library = F.transform(F.filter("decisions", lambda d: d["authority"] == "ui-library"), lambda d: made(F.concat(F.lit("library:"), F.coalesce(d["topic"], F.lit("conflict"))), "medium", "library-decision"))
    empty = F.array().cast("array<struct<id:string,severity:string,category:string>>")
    rows = plans.select("plan_id", F.explode(F.concat(*[F.coalesce(x, empty) for x in (unclear, unverified, library)])).alias("f"))
    return rows.select("plan_id", "f.*", (F.col("f.severity") == "critical").alias("blocking"))


def recommendation(plans: DataFrame, findings: DataFrame) -> DataFrame:
    """(plan_id, findings, recommendation): blocked by a critical finding, revise by a high one, else approve."""
    rolled = findings.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("blocking").alias("blocked"), F.bool_or(F.col("severity") == "high").alias("revise"))
    both = plans.select("plan_id").join(rolled, "plan_id", "left")
    said = F.when(F.coalesce("blocked", F.lit(False)), "blocked").when(F.coalesce("revise", F.lit(False)), "revise").otherwise("approve")
    return both.select("plan_id", F.coalesce("n", F.lit(0)).alias("findings"), said.alias("recommendation"))


def review(findings: DataFrame, by: str = "review_id", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(findings, completion by review): severity 'medium' and id 'review-n' where none is given."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    full = findings.withColumn("severity", F.coalesce("severity", F.lit("medium"))).withColumn("id", F.coalesce("id", F.concat(F.lit("review-"), n.cast("string")))).withColumn("blocking", F.col("severity") == "critical")
    done = full.groupBy(by).agg(F.count(F.lit(1)).alias("findings"), F.bool_or("blocking").alias("b"))
    return full, done.select(by, "findings", completion(F.col("findings"), F.col("b")).alias("completion"))


def completion(findings: Column, blocked: Column) -> Column:
    return F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(findings > 0, "pass-with-findings").otherwise("pass")


def risks(gaps: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """The tagged union of gaps and ambiguities; fields that one of them lacks are null."""
    return gaps.withColumn("type", F.lit("missing-context")).unionByName(ambiguities.withColumn("type", F.lit("ambiguous-context")), allowMissingColumns=True)


def initial_plan(requests: DataFrame) -> DataFrame:
    """Plans of requests (task, components): files and interfaces to settle for each component."""
    each = lambda before, after: F.transform(F.coalesce("components", F.array().cast("array<string>")), lambda c: F.concat(F.lit(before), c, F.lit(after)))
    return requests.withColumn("plan_id", F.concat(F.lit("plan:"), "task")).withColumn("files", each("determine ", " implementation files")).withColumn("interfaces", each("", " public component API")).withColumn("verification", F.array(*[F.lit(v) for v in ("targeted unit tests", "accessibility checks", "relevant visual or component checks")])).withColumn("approval_status", F.lit("awaiting-approval"))


def heartbeat(tasks: Column, flags: dict[str, Column]) -> Column:
    """struct(action, task_id, reason, next_run): the first guard that holds, else the first task that isn't done.

    tasks: array<struct<id, status>>, null or with an empty id if the plan is invalid. An empty list is complete.
    """
    on = lambda name, at=True: F.coalesce(flags.get(name, F.lit(None).cast("boolean")) == F.lit(at), F.lit(False))
    done = lambda t: t["status"].isin(*DONE)
    paused = lambda action, why: F.struct(F.lit(action).alias("action"), F.lit(None).cast("string").alias("task_id"), F.lit(why).alias("reason"), F.lit(None).cast("string").alias("next_run"))
    following = F.get(F.filter(tasks, lambda t: ~F.coalesce(done(t), F.lit(False))), F.lit(0))["id"]
    go = F.struct(F.lit("execute-one-task").alias("action"), following.alias("task_id"), F.lit("next unchecked task is eligible").alias("reason"), F.lit("after-verification").alias("next_run"))
    return (
        F.when(tasks.isNull() | F.exists(tasks, lambda t: F.coalesce(t["id"], F.lit("")) == ""), paused("blocked", "plan is missing or invalid"))
        .when(F.forall(tasks, lambda t: F.coalesce(done(t), F.lit(False))), paused("complete", "all plan tasks are complete"))
        .when(on("unrelated_changes"), paused("blocked", "unrelated working-tree changes require user review"))
        .when(on("policy_rejected"), paused("blocked", "source policy rejection requires user review"))
        .when(on("clean", False), paused("blocked", "working-tree changes require user review"))
        .when(on("context_changed"), paused("awaiting-approval", "material context change requires reapproval"))
        .when(on("tests_passed", False), paused("blocked", "verification failed and requires user review"))
        .when(~(on("plan_approved") & on("edits_approved")), paused("awaiting-approval", "plan and code-edit approvals are required"))
        .otherwise(go)
    )


def first_of_union(*lists: Column) -> Column:
    """Distinct members of several lists, in order of first occurrence."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def passed_names(checks: Column) -> Column:
    """Names of the passed checks of array<struct<name, status>>, comma-joined."""
    return F.array_join(F.transform(F.filter(checks, lambda c: c["status"] == "passed"), lambda c: c["name"]), ", ")


def context_envelope(requests: DataFrame) -> DataFrame:
    """requests with every field that a context envelope has: lists default to none, the revision to 1, the rest to null."""
    given = lambda name, kind: F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)
    listed = [F.coalesce(given(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in ("component_scope", "repository_scope", "figma_links", "constraints")]
    ticket = F.coalesce(given("ticket_key", "string"), given("jira_key", "string")).alias("ticket_key")
    known = {"task", "component_scope", "repository_scope", "figma_links", "constraints", "ticket_key", "jira_key", "artifact_revision", "plan_approval", "edit_approval"}
    return requests.select(*[c for c in requests.columns if c not in known], given("task", "string").alias("task"), *listed, ticket, F.coalesce(given("artifact_revision", "int"), F.lit(1)).alias("artifact_revision"), given("plan_approval", "string").alias("plan_approval"), given("edit_approval", "string").alias("edit_approval"))
