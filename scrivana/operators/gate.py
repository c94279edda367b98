"""Approval state machine as a fold over ordered events, and the workflow steps around it.

Events of a plan are (seq, kind, receipt fields). A receipt counts only if its ids and digests equal the state's;
otherwise the state stays and the error is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.canonical import edit_digest, plan_digest, strict_timestamp

# The states, in order, and the events that lead on.
STATES = ("awaiting-plan-approval", "awaiting-edit-approval", "authorized")
EVENTS = ("approve-plan", "propose-edits", "approve-edits")
_HASH = "^[a-f0-9]{64}$"


def initial(plans: DataFrame) -> DataFrame:
    """plans (plan, snapshot_id, context_digest) with plan_id, plan_hash and error; plan is JSON text."""
    made = plan_digest(F.col("plan"), F.col("snapshot_id"), F.col("context_digest"))
    error = F.when(F.get_json_object("plan", "$.id").isNull(), "plan ID is required").when(F.coalesce("snapshot_id", F.lit("")) == "", "context snapshot ID is required").when(F.coalesce("context_digest", F.lit("")) == "", "context digest is required")
    return plans.withColumn("plan_id", F.get_json_object("plan", "$.id")).withColumn("plan_hash", made).withColumn("error", error)


def receipt_error(state: Column, r: Column, edits: bool) -> Column:
    """Why a receipt doesn't fit a state; null if it does."""
    missing = lambda f: F.trim(F.coalesce(r[f], F.lit(""))) == ""
    error = (
        F.when(missing("snapshot_id"), "contextSnapshotId is required").when(missing("context_digest"), "contextDigest is required")
        .when(~r["snapshot_id"].rlike(_HASH), "context snapshot ID must be a SHA-256 digest").when(~r["context_digest"].rlike(_HASH), "context digest must be a SHA-256 digest")
    )
    if edits:
        error = error.when(missing("edit_hash"), "editSetHash is required")
    error = (
        error.when(~r["plan_id"].eqNullSafe(state["plan_id"]), "plan ID does not match").when(~r["plan_hash"].eqNullSafe(state["plan_hash"]), "plan hash does not match approved plan")
        .when(~r["snapshot_id"].eqNullSafe(state["snapshot_id"]), "context snapshot ID does not match").when(~r["context_digest"].eqNullSafe(state["context_digest"]), "context digest does not match")
    )
    if edits:
        error = error.when(~r["edit_hash"].eqNullSafe(state["edit_hash"]), "edit set does not match approved plan")
    return error.when(missing("approved_by"), "approvedBy is required").when(~strict_timestamp(F.coalesce(r["approved_at"], F.lit(""))), "approvedAt must be an ISO-8601 timestamp")


def folded(plans: DataFrame, events: DataFrame) -> DataFrame:
    """(plan_id, status, edit_hash, error) after all events of each plan, in order of seq.

    events: plan_key, seq, kind, edits (JSON text), plan_id, plan_hash, snapshot_id, context_digest, edit_hash,
    approved_by, approved_at; plan_key names the plan whose state the event is for.
    """
    # An offer's digest is worked out before the fold: it may need a Python function, which a fold can't call.
    events = events.withColumn("offer", F.when(F.col("kind") == EVENTS[1], edit_digest(F.col("plan_key"), F.col("edits"))))
    fields = ["seq", "kind", "offer", "plan_id", "plan_hash", "snapshot_id", "context_digest", "edit_hash", "approved_by", "approved_at"]
    listed = events.groupBy("plan_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("events"))
    begun = initial(plans)
    both = begun.join(listed, begun["plan_id"] == listed["plan_key"], "left")
    null = F.lit(None).cast("string")
    start = F.struct(F.lit(STATES[0]).alias("status"), F.col("plan_id"), F.col("plan_hash"), F.col("snapshot_id"), F.col("context_digest"), null.alias("edit_hash"), F.col("error"))

    def step(s: Column, e: Column) -> Column:
        to = lambda status, edit_hash, error: F.struct(status.alias("status"), s["plan_id"].alias("plan_id"), s["plan_hash"].alias("plan_hash"), s["snapshot_id"].alias("snapshot_id"), s["context_digest"].alias("context_digest"), edit_hash.alias("edit_hash"), error.alias("error"))
        stay = lambda why: to(s["status"], s["edit_hash"], F.coalesce(s["error"], why))
        plan_why = F.when(s["status"] != STATES[0], "approval status does not accept plan approval").otherwise(receipt_error(s, e, False))
        edit_why = F.when(s["status"] != STATES[1], "approval status does not accept code-edit approval").when(s["edit_hash"].isNull(), "code edits have not been proposed").otherwise(receipt_error(s, e, True))
        offer = e["offer"]
        offer_why = F.when(s["status"] != STATES[1], "plan approval is required before proposing code edits").when(offer.isNull(), "edits must be an array")
        return (
            F.when((e["kind"] == EVENTS[0]) & plan_why.isNull(), to(F.lit(STATES[1]), s["edit_hash"], s["error"])).when(e["kind"] == EVENTS[0], stay(plan_why))
            .when((e["kind"] == EVENTS[1]) & offer_why.isNull(), to(s["status"], offer, s["error"])).when(e["kind"] == EVENTS[1], stay(offer_why))
            .when((e["kind"] == EVENTS[2]) & edit_why.isNull(), to(F.lit(STATES[2]), s["edit_hash"], s["error"])).when(e["kind"] == EVENTS[2], stay(edit_why))
            .otherwise(stay(F.concat(F.lit("unknown event: "), e["kind"])))
        )

    state = F.aggregate(F.coalesce("events", F.array().cast(listed.schema["events"].dataType)), start, step)
    return both.select(state.alias("s")).select("s.plan_id", "s.status", "s.edit_hash", "s.error")


def gated_status(has_context: Column, state: Column, has_edits: Column, changed_before: Column, changed_after: Column, edits_approved: Column) -> Column:
    """Status of an implementation run: the first gate that isn't open, else 'implemented'.

    changed_before / changed_after: whether the context differs materially before edits are proposed and before they
    are applied.
    """
    return (
        F.when(~has_context, "needs-context").when(state == STATES[0], STATES[0]).when(changed_before, "awaiting-context-reapproval")
        .when(~has_edits | ~edits_approved | (state != STATES[2]), STATES[1]).when(changed_after, "awaiting-context-reapproval").otherwise("implemented")
    )
