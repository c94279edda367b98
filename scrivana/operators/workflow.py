"""Driver-side steps of a task's run: route, take a snapshot, approve a model, call workers one after the other.

Nothing here touches rows; it decides which DataFrame steps run. Workers are functions of (input, Execution).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from types import MappingProxyType

WORKERS = ("planner", "planReviewer", "engineer", "uiReviewer", "prWriter")


@dataclass(frozen=True)
class Execution:
    """What a worker gets besides its input; it can't be changed."""

    role: str
    assignment: MappingProxyType
    snapshot_id: str | None
    escalated: bool = False


@dataclass
class Run:
    """Outcome of a run."""

    status: str
    results: dict = field(default_factory=dict)
    reason: str | None = None


def run(request: dict, workers: dict[str, Callable], assignments: dict[str, dict], *, invoke: bool, model_approved: bool, snapshot_id: str | None, approve_escalation: Callable | None = None, outside: bool = False) -> Run:
    """Call the workers in order, with at most one approved escalation each, until one of them stops the run."""
    if not invoke:
        return Run("skipped", reason="task is below the threshold")
    if not model_approved:
        return Run("awaiting-model-approval")
    out = Run("complete")
    given: dict = {"request": request}
    for role in WORKERS:
        if role == "planReviewer" and outside:
            return Run("planned", out.results, "implementation belongs to another environment")
        if role == "engineer" and not request.get("approved_plan"):
            return Run("awaiting-plan-approval", out.results)
        result = _called(role, workers, given, assignments, snapshot_id, approve_escalation)
        if result is None:
            return Run("awaiting-model-escalation", out.results, role)
        out.results[role] = result
        given = {**given, role: result}
        stop = _stop(role, result)
        if stop:
            return Run(stop, out.results)
    return out


def _called(role, workers, given, assignments, snapshot_id, approve):
    result = workers[role](given, Execution(role, MappingProxyType(assignments[role]), snapshot_id))
    if not result.get("escalation"):
        return result
    higher = approve(role, result["escalation"]) if approve else None
    if not higher:
        return None
    result = workers[role](given, Execution(role, MappingProxyType(higher), snapshot_id, True))
    return None if result.get("escalation") else result


def _stop(role: str, result: dict) -> str | None:
    """The status that ends a run after a worker, if its result does."""
    if role == "planReviewer" and result.get("recommendation") in ("blocked", "revise"):
        return f"plan-{result['recommendation']}"
    if role == "engineer" and result.get("status") != "implemented":
        return result.get("status", "blocked")
    if role == "uiReviewer" and result.get("completion") == "blocked":
        return "review-blocked"
    return None
