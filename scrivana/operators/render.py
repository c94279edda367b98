"""Rendered documents: plans, reports and pull request texts."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrivana.functions.redact import HIDDEN, projected, redacted, without_hidden
from scrivana.functions.text import task_slug, ticket_key, visible
from scrivana.functions.uri import without_secrets
from scrivana.functions.validate import validated

# The sections of a plan, in order, with the field that each shows.
SECTIONS = (
    ("Scope", "scope"), ("Affected Files", "files"), ("Interfaces", "interfaces"), ("Library Decisions", "libraryDecisions"),
    ("Risks and Context Gaps", "risks"), ("Verification", "verification"), ("Open Questions", "questions"), ("Approval Status", "approvalStatus"),
)
# Kinds of pull requests, and the states and severities that reports accept.
PR_TYPES = ("Feature", "Bug fix", "Refactoring", "Documentation content changes", "Other (please describe)")
EVIDENCE_SCHEMA = {"type": "object", "required": ["name", "status"], "properties": {"name": {"type": "string", "minLength": 1}, "status": {"type": "string", "enum": ["passed", "failed", "not-run"]}}}
FINDING_SCHEMA = {"type": "object", "required": ["id", "severity", "summary"], "properties": {"id": {"type": "string", "minLength": 1}, "severity": {"type": "string", "enum": ["info", "warning", "error"]}, "summary": {"type": "string", "minLength": 1}}}


#: What a rendered value must not show, and how a field's name becomes words.
_DIGEST, _CONTROL, _HUMP = re.compile(r"(?i)\b[a-f0-9]{64}\b"), re.compile(r"[\x00-\x1f\x7f]"), re.compile(r"(?<=[a-z])(?=[A-Z])|[_-]+")


def _written(value) -> str:
    """A JSON value in one line: members by ', ', fields by '; '."""
    match value:
        case None | "" | []:
            return "None"
        case dict():
            return "; ".join(_fields(value))
        case list():
            return ", ".join(_written(v) for v in value)
        case str():
            return _CONTROL.sub(" ", _DIGEST.sub("[internal digest omitted]", value)).strip()
    return json.dumps(value)


def _fields(value: dict):
    for key, inner in value.items():
        name = _HUMP.sub(" ", key)
        yield f"**{name[:1].upper()}{name[1:]}:** {_written(inner)}"


def _section(title: str, value, by_field: bool) -> str:
    """A heading and its list; fields are items of their own only where the section shows a scope."""
    match value:
        case None | "":
            lines = []
        case dict() if by_field:
            lines = list(_fields(value))
        case list():
            lines = [_written(v) for v in value]
        case _:
            lines = [_written(value)]
    return "\n".join([f"## {title}", "", *(f"- {x}" for x in lines or ["None."])])


@F.pandas_udf(StringType())
def _body(plans: pd.Series) -> pd.Series:
    """The sections of plans whose hidden fields are gone. Nesting has no bound, so this is a Python function."""
    read = plans.map(json.loads, na_action="ignore")
    return read.map(lambda plan: "\n\n".join(_section(title, plan.get(field), field == "scope") for title, field in SECTIONS), na_action="ignore")


def plan_artifacts(plans: DataFrame, prefix: str = "task") -> DataFrame:
    """plans (plan JSON, task, ticket, revision) with title, filename and Markdown content; error where invalid.

    A hidden field's name hides the field; the section 'Approval Status' is shown all the same.
    """
    status = F.get_json_object("plan", "$.approvalStatus")
    goal = F.coalesce(F.nullif(visible(F.coalesce(F.get_json_object("plan", "$.goal"), F.col("task"), F.lit("Task"))), F.lit("")), F.lit("Task"))
    ticket = ticket_key(F.col("ticket"))
    title = F.concat(F.coalesce(F.concat(ticket, F.lit(" — ")), F.lit("")), goal, F.lit(" — Plan v"), F.col("revision").cast("string"))
    name = F.concat(F.coalesce(ticket, F.lit(prefix)), F.lit("-"), task_slug(F.coalesce(F.col("task"), F.get_json_object("plan", "$.goal"))), F.lit("-plan-v"), F.col("revision").cast("string"), F.lit(".md"))
    shown = without_hidden(F.col("plan"), HIDDEN)
    shown = F.when(status.isNotNull(), F.concat(F.regexp_replace(shown, r"\}\s*\z", ""), F.lit(',"approvalStatus":'), F.to_json(status.cast("variant")), F.lit("}"))).otherwise(shown)
    content = F.concat(F.lit("# "), title, F.lit("\n\nRevision "), F.col("revision").cast("string"), F.lit("\n\n## Goal\n\n- "), goal, F.lit("\n\n"), _body(shown))
    error = F.when(F.trim(F.coalesce(F.get_json_object("plan", "$.id"), F.lit(""))) == "", "plan ID is required").when(~F.coalesce(F.col("revision") >= 1, F.lit(False)), "revision must be a positive integer")
    return plans.withColumn("error", error).withColumn("title", F.when(error.isNull(), title)).withColumn("filename", F.when(error.isNull(), name)).withColumn("content", F.when(error.isNull(), content))


def dry_run_report(runs: DataFrame) -> DataFrame:
    """runs (routing, models, approvals, sources, verification, findings: JSON texts) with report and errors.

    Only listed fields are shown, addresses lose their secret parameters, sensitive values are masked, and evidence
    and findings are validated.
    """
    v = lambda c: F.try_parse_json(F.coalesce(c, F.lit("{}")))
    listed = lambda c: F.try_variant_get(F.try_parse_json(F.coalesce(c, F.lit("[]"))), "$", "array<variant>")
    source = lambda s: F.to_json(F.named_struct(F.lit("id"), F.try_variant_get(s, "$.id", "string"), F.lit("uri"), without_secrets(F.try_variant_get(s, "$.uri", "string")), F.lit("contentDigest"), F.try_variant_get(s, "$.bodyDigest", "string")), {"ignoreNullFields": "false"})
    join = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    body = F.concat(
        F.lit('{"routing":'), projected(v(F.col("routing")), "classification", "confidence", "invoke", "reason"),
        F.lit(',"models":'), projected(v(F.col("models")), "proposalId", "tier", "preset", "status"),
        F.lit(',"approvals":'), projected(v(F.col("approvals")), "status", "planId", "planHash", "contextSnapshotId", "contextDigest", "editSetHash"),
        F.lit(',"sources":'), join(F.transform(listed(F.col("sources")), source)),
        F.lit(',"verification":'), join(F.transform(listed(F.col("verification")), lambda x: projected(x, "name", "status"))),
        F.lit(',"findings":'), join(F.transform(listed(F.col("findings")), lambda x: projected(x, "id", "severity", "summary"))), F.lit("}"),
    )
    wrong = lambda c, schema: F.flatten(F.transform(listed(c), lambda x: validated(schema, F.to_json(x))))
    # The text is a column of its own before it is redacted, so that it is put together once.
    return runs.withColumn("report", body).withColumn("report", redacted(F.col("report"))).withColumn("errors", F.concat(wrong(F.col("verification"), EVIDENCE_SCHEMA), wrong(F.col("findings"), FINDING_SCHEMA)))


def pr_title(component: Column) -> Column:
    return F.concat(F.lit("Update "), component)


def pr_body(task: Column, kind: Column, template: Column, checks: Column, reviewed: Column, description: Column, ticket: Column, notes: Column) -> Column:
    """Text of a pull request: a check list where the target repository asks for one, else a summary."""
    about = F.concat(F.lit("This change addresses "), F.lower(task), F.lit("."))
    boxes = F.concat_ws("\n", *[F.concat(F.when(kind == t, "[x] ").otherwise("[ ] "), F.lit(t)) for t in PR_TYPES])
    listed = F.concat(F.lit("## PR Type\n\n"), boxes, F.lit("\n\n## Description\n\n"), F.coalesce(description, about), F.lit("\n\n## Ticket Number\n\n"), F.coalesce(ticket, F.lit("Not provided")), F.lit("\n\n## Additional Notes\n\n"), F.coalesce(notes, F.lit("No additional notes.")))
    plain = F.concat(
        F.lit("## Summary\n\n"), about, F.lit("\n\n## Why\n\nIt keeps the component experience consistent and reliable for users.\n\n## Verification\n\nVerified with "),
        F.coalesce(F.nullif(checks, F.lit("")), F.lit("the recorded verification checks")), F.lit(". UI review: "), F.coalesce(reviewed, F.lit("completed")),
        F.lit(".\n\n## Notes\n\nThe change follows the existing component conventions."),
    )
    return F.when(template, listed).otherwise(plain)
