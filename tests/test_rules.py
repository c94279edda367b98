"""Provenance and rule operators on literal fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from scrivana.functions import canonical, redact, uri, validate
from scrivana.operators import constraints, gate, ledger, policy, render, rules, snapshot, sources, tree, workflow
from scrivana.sources.host import Adapter, Settings
from scrivana.streaming import refresh


def value(spark, column, **given):
    return spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)).select(column.alias("x")).first().x


def edges(spark, rows):
    return spark.createDataFrame(rows, "parent_id string, child_id string, child_pos long, inaccessible boolean")


def walked(spark, rows):
    pages, gaps = tree.walk(spark, edges(spark, rows), "root")
    return [(r.id, r.depth) for r in pages.orderBy("walk").collect()], sorted((r.source_id, r.reason) for r in gaps.collect())


def plain_walk(rows, root="root"):
    children = {}
    for p, c, pos, closed in sorted(rows, key=lambda r: r[2]):
        children.setdefault(p, []).append((c, closed))
    pages, gaps, seen = [(root, 0)], [], {root}

    def visit(node, depth):
        for child, closed in children.get(node, []):
            if closed:
                gaps.append((child, "inaccessible"))
            elif child in seen:
                gaps.append((child, "cycle"))
            else:
                seen.add(child)
                pages.append((child, depth))
                visit(child, depth + 1)

    visit(root, 1)
    return pages, sorted(gaps)


@pytest.mark.parametrize("rows", [
    [("root", "a", 0, False), ("root", "b", 1, False), ("a", "c", 0, False), ("a", "x", 1, True)],
    [("root", "a", 0, False), ("a", "root", 0, False), ("a", "a", 1, False)],
    [("root", "b", 1, False), ("root", "a", 0, False), ("a", "d", 0, False), ("b", "d", 0, False), ("d", "e", 0, False)],
    [("root", "a", 0, False), ("a", "b", 0, False), ("b", "c", 0, False), ("root", "c", 1, False), ("c", "a", 0, False)],
    [],
])
def test_tree_equals_a_plain_walk(spark, rows):
    assert walked(spark, rows) == plain_walk(rows)


def test_failed_children(spark):
    pages, _ = tree.walk(spark, edges(spark, [("root", "a", 0, False)]), "root")
    failures = spark.createDataFrame([("a", "timeout"), ("else", "x")], "parent_id string, message string")
    assert [tuple(r) for r in tree.failed_children(pages, failures).collect()] == [("a", "child-discovery-failed", "timeout")]


def test_canonical_and_digests(spark):
    a, b = '{"b":1,"a":{"d":[2,1],"c":null}}', '{"a":{"c":null,"d":[2,1]},"b":1}'
    assert value(spark, canonical.canonical(F.col("j")), j=a) == b
    assert value(spark, canonical.digest(F.col("j")) == canonical.digest(F.lit(b)), j=a)
    assert value(spark, canonical.without_fields(F.col("j")), j='{"x":[{"approval":1,"k":2}],"approvalReceipt":{}}') == '{"x":[{"k":2}]}'
    assert [value(spark, canonical.strict_timestamp(F.col("t")), t=t) for t in ("2024-01-01T00:00:00.000Z", "2024-01-01T00:00:00Z", "x", "2024-02-30T00:00:00.000Z")] == [True, False, False, False]


SCHEMA = {"type": "object", "required": ["id", "status", "notes"], "properties": {"id": {"type": "string", "minLength": 1}, "status": {"type": "string", "enum": ["open", "closed"]}, "notes": {"type": "array", "items": {"type": "string"}}, "n": {"type": ["integer", "null"], "minimum": 1}, "at": {"type": "string", "format": "date-time"}, "h": {"type": "string", "pattern": "^[a-f]+$"}}}


@pytest.mark.parametrize("text, wanted", [
    ('{"id":"","status":"other","notes":[1]}', ["$.id must have length at least 1", "$.status must equal one of open, closed", "$.notes[0] must be a string"]),
    ('{"id":"a","status":"open","notes":[],"n":null}', []), ('{"id":"a","status":"open","notes":[],"n":0}', ["$.n must be at least 1"]),
    ('{"id":"a","status":"open","notes":[],"n":1.5}', ["$.n must be a integer or a null"]), ("[]", ["$ must be an object"]), ("{", ["$ must be JSON"]),
    ('{"id":null}', ["$.status is required", "$.notes is required", "$.id must be a string"]),
    ('{"id":"a","status":"open","notes":["x"],"at":"2024-01-01","h":"xyz"}', ["$.at must be an ISO-8601 timestamp", "$.h must match ^[a-f]+$"]),
])
def test_validation(spark, text, wanted):
    assert value(spark, validate.validated(SCHEMA, F.col("j")), j=text) == wanted


def test_every_required_key_and_enum(spark):
    whole = {"id": "a", "status": "open", "notes": []}
    cases = [({k: v for k, v in whole.items() if k != gone}, f"$.{gone} is required") for gone in SCHEMA["required"]] + [(whole | {"status": "odd"}, "$.status must equal one of open, closed")]
    got = spark.createDataFrame([(json.dumps(c), e) for c, e in cases], "j string, e string").select(validate.validated(SCHEMA, F.col("j")).alias("x"), "e").collect()
    assert all(r.x == [r.e] for r in got)
    with pytest.raises(validate.UnsupportedSchema, match="Unsupported schema keyword description at \\$.properties.a"):
        validate.check_schema({"properties": {"a": {"description": "x"}}})
    more = validate.required_when(F.col("j"), F.get_json_object("j", "$.status") == "closed", ["why"], "when closed")
    assert value(spark, validate.validated(SCHEMA, F.col("j"), *more), j='{"id":"a","status":"closed","notes":[]}') == ["$.why is required when closed"]


def test_redaction(spark):
    text = '{"a":{"apiToken":"x1","n":["password: hunter2; ok"]},"cookie":["c"],"u":"fine"}'
    assert json.loads(value(spark, redact.redacted(F.col("j")), j=text)) == {"a": {"apiToken": "[REDACTED]", "n": ["password=[REDACTED]; ok"]}, "cookie": "[REDACTED]", "u": "fine"}
    assert json.loads(value(spark, redact.without_hidden(F.col("j")), j='{"hashes":1,"k":[{"bodyDigest":2,"z":3}]}')) == {"k": [{"z": 3}]}
    assert value(spark, uri.without_secrets(F.col("u")), u="https://x.example/p?token=1&a=2&SecretKey=3#f") == "https://x.example/p?a=2#f"
    assert value(spark, uri.without_secrets(F.col("u")), u="https://x.example/p?token=1") == "https://x.example/p"
    assert value(spark, uri.without_secrets(F.col("u")), u="no url, token = abc") == "no url, token=[REDACTED]"
    assert value(spark, redact.projected(F.parse_json(F.col("j")), "a", "b"), j='{"a":1,"c":2}') == '{"a":1,"b":null}'


@pytest.mark.parametrize("kind, address, wanted", [
    ("figma", "https://WWW.figma.example/file/1?x=2", (True, "https://figma.example/file/1?x=2", None)), ("figma", "https://evil.example/", (False, "https://evil.example/", "unapproved-host")),
    ("figma", "http://figma.example/", (False, None, "invalid-uri")), ("figma", "https://u:p@figma.example/", (False, None, "invalid-uri")), ("figma", "https://figma.example:8443/", (False, None, "invalid-uri")),
    ("confluence", "123", (True, "confluence://123", None)), ("confluence", "confluence://123/", (True, "confluence://123", None)), ("confluence", "https://wiki.example/wiki/spaces/AB/pages/77/Title", (True, "confluence://77", None)),
    ("confluence", "https://bad.example/pages/77", (False, "confluence://77", "unapproved-host")), ("confluence", "junk", (False, None, "invalid-uri")),
    ("repository", "git@Git.example:team/repo.git", (True, "git.example/team/repo", None)), ("repository", "ssh://git@git.example/team/other", (False, "git.example/team/other", "unapproved-host")),
    ("mail", "x", (False, None, "unknown-source-kind")), (None, "x", (False, None, "unknown-source-kind")),
])
def test_source_policy(spark, kind, address, wanted):
    df = spark.createDataFrame([("s", kind, address)], "id string, kind string, uri string")
    r = policy.authorized(df, {"figma": ["www.figma.example"], "confluence": ["wiki.example"]}, ["https://git.example/team/repo"]).first()
    assert (r.allowed, r.normalized, r.reason) == wanted


def test_repository_policy(spark):
    def target(repository=None, name=None, scope=()):
        df = spark.createDataFrame([(repository, name, list(scope))], "r string, n string, s array<string>")
        e = policy.repository_evidence(F.col("r"), F.col("n"), F.col("s"), F.col("s"), "my-components", "components")
        return df.select(policy.repository_target(e, "my-components").alias("t"), F.size(e).alias("n")).first()

    assert target("git@h.example:team/My-Components.git").t == "my-components"
    assert target(scope=["libs\\my-components\\src"]).t == "my-components"
    assert target(name="old-components").t == "ambiguous" and target("git@h.example:team/x").t == "other"


TASKS = [
    ("Build the customer badge", ["https://x.example"], [], "ui-related"), ("Fix the DatePicker focus ring", [], ["DatePicker"], "ui-related"), ("Improve the frontend screen layout", [], [], "possible-ui"),
    ("Add an index to the customer table", [], [], "non-ui"), ("Update the design system token", [], [], "ui-related"), ("Improve keyboard access for the search input", [], [], "possible-ui"),
    ("Create a reusable component for empty states", [], [], "ui-related"), ("Reformat the platform", [], [], "non-ui"),
]


def test_task_rules(spark):
    df = spark.createDataFrame(TASKS, "task string, links array<string>, scope array<string>, wanted string")
    rows = df.withColumn("c", rules.ui_class(F.col("task"), F.lit(False), F.col("links"), F.col("scope"))).collect()
    assert all(r.c.classification == r.wanted for r in rows)
    assert value(spark, rules.routed(F.lit("possible-ui"), "ui-related")["invoke"], x="") is False
    with pytest.raises(ValueError, match="unknown UI routing threshold"):
        rules.routed(F.lit("non-ui"), "never")
    none = F.array().cast("array<string>")
    assert value(spark, rules.complexity(F.col("t"), none, none, none, F.lit(False)), t="a prefix") == "terra"
    assert value(spark, rules.complexity(F.col("t"), none, none, F.array(F.lit("accessibility")), F.lit(False)), t="x") == "sol"
    assert value(spark, rules.pr_type(F.col("t"), F.lit(None)), t="Repair the readme") == "Bug fix" and value(spark, rules.pr_type(F.col("t"), F.lit("New feature")), t="fix") == "Feature"
    assert value(spark, rules.component(F.col("t"), F.lit("a/button/src/x.ts")), t="Fix it") == "Button" and value(spark, rules.component(F.col("t"), F.lit(None)), t="Fix DatePicker") == "DatePicker"


def test_assignments(spark):
    table = rules.assignment_table(spark, "m-")
    got = {r.role: (r.model, r.reasoning) for r in rules.assigned(spark.createDataFrame([("recommended", "terra")], "preset string, tier string"), table).collect()}
    assert got["planner"] == ("m-terra", "high") and got["planReviewer"] == ("m-terra", "high") and got["prWriter"] == ("m-luna", "light") and len(got) == 6
    full = {r: ("m-luna", "light") for r in rules.ROLES}
    schema = "a map<string, struct<model:string, reasoning:string>>"
    fixed = F.struct(F.lit("m-luna").alias("model"), F.lit("light").alias("reasoning"))
    said = lambda a: spark.createDataFrame([(a,)], schema).select(rules.assignment_error(F.col("a"), ["m-luna"], fixed).alias("e")).first().e
    assert said(full) is None and said(None).startswith("model assignments must be confirmed") and "exactly" in said({"planner": ("m-luna", "light")})
    assert said(full | {"engineer": ("other", "light")}) == "invalid model assignment for engineer"
    assert value(spark, rules.proposal_decision(F.lit("awaiting-confirmation"), F.lit("p"), F.col("i"), F.lit(None).cast("string")), i="q").error == "model proposal ID does not match"
    assert value(spark, rules.escalation(F.lit("p"), F.lit("luna"), F.col("t")), t="sol").escalation_id == "p:sol"


@pytest.mark.parametrize("tasks, flags, action, task", [
    (None, {}, "blocked", None), ([("", "open")], {}, "blocked", None), ([], {}, "complete", None), ([("a", "verified")], {}, "complete", None),
    ([("a", "done"), ("b", "open")], {"unrelated_changes": True}, "blocked", None), ([("a", "x")], {"clean": False}, "blocked", None), ([("a", "x")], {"context_changed": True}, "awaiting-approval", None),
    ([("a", "x")], {"tests_passed": False}, "blocked", None), ([("a", "x")], {"plan_approved": True}, "awaiting-approval", None),
    ([("a", "complete"), ("b", "x"), ("c", "x")], {"plan_approved": True, "edits_approved": True}, "execute-one-task", "b"),
])
def test_heartbeat(spark, tasks, flags, action, task):
    df = spark.createDataFrame([(tasks,)], "t array<struct<id:string,status:string>>")
    h = df.select(rules.heartbeat(F.col("t"), {k: F.lit(v) for k, v in flags.items()}).alias("h")).first().h
    assert (h.action, h.task_id) == (action, task) and (h.next_run is None) == (task is None)


def test_reviews(spark):
    plans = spark.createDataFrame([("ok", [], [], ["t"], []), ("gap", ["g"], [], ["t"], []), ("none", [], [], [], [("ui-library", "x")])], "plan_id string, gaps array<string>, ambiguities array<string>, verification array<string>, decisions array<struct<authority:string,topic:string>>")
    findings = rules.plan_findings(plans)
    assert {r.plan_id: (r.findings, r.recommendation) for r in rules.recommendation(plans, findings).collect()} == {"ok": (0, "approve"), "gap": (1, "blocked"), "none": (2, "revise")}
    given = spark.createDataFrame([("r", 0, None, None), ("r", 1, "critical", "own")], "review_id string, pos int, severity string, id string")
    full, done = rules.review(given)
    assert sorted((r.id, r.severity) for r in full.collect()) == [("own", "critical"), ("review-1", "medium")] and done.first().completion == "blocked"
    both = rules.risks(spark.createDataFrame([("s", "r")], "source_id string, reason string"), spark.createDataFrame([("t",)], "topic string"))
    assert {(r.type, r.source_id, r.topic) for r in both.collect()} == {("missing-context", "s", None), ("ambiguous-context", None, "t")}
    plan = rules.initial_plan(spark.createDataFrame([("Do", ["A"])], "task string, components array<string>")).first()
    assert plan.files == ["determine A implementation files"] and plan.plan_id == "plan:Do"
    assert value(spark, rules.first_of_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))), x="") == ["b", "a", "c"]


def test_ledger(spark):
    schema = "id string, class string, lesson string, scope array<string>"
    entries = spark.createDataFrame([("e1", "stable-rule", "Use  form.item ", ["Form", "form "]), ("e2", "stable-rule", "Prefer form.item always", ["form", "x"]), ("e3", "task-exception", "use form.item", ["form"])], schema)
    fixes = spark.createDataFrame([("c1", "stable-rule", "use form.item", None, ["form"]), ("c2", "odd", "brand new", None, ["y"])], "id string, classification string, lesson string, evidence array<string>, scope array<string>")
    props = ledger.proposed(fixes)
    assert [tuple(r) for r in ledger.exact_duplicates(entries, props).collect()] == [("proposal:c1", "e1")]
    assert [tuple(r) for r in ledger.overlaps(entries, props).collect()] == [("proposal:c1", "e2")]
    decide = lambda said: {r.id: (r.outcome, r.version, r.error) for r in ledger.decided(props, entries, spark.createDataFrame([("proposal:c1", said, "t")], "id string, decision string, approved_at string"), 1).collect()}
    assert decide(None)["proposal:c1"] == ("pending", None, "explicit duplicate decision is required before persistence")
    assert decide("link:e2")["proposal:c1"][0] == "rejected" and decide("link:zz")["proposal:c1"][0] == "pending" and decide("create-distinct") == {"proposal:c1": ("approved", 2, None), "proposal:c2": ("approved", 3, None)}


def test_snapshots(spark):
    schema = "task_id string, sources array<struct<id:string,body_digest:string,accessible:boolean>>, scope string, library_decisions string, gaps array<string>, ambiguities array<string>"
    before = spark.createDataFrame([("t", [("a", "1", True), ("b", "1", True), ("c", "1", True)], "s", "d", [], [])], schema)
    after = spark.createDataFrame([("t", [("c", "1", False), ("b", "2", False), ("d", "1", True)], "s2", "d", ["g"], [])], schema)
    got = [(r.source_id, r.type) for r in snapshot.compare(before, after).orderBy("position").collect()]
    assert got == [("a", "removed"), ("b", "body-changed"), ("c", "accessibility-changed"), ("d", "added"), (None, "scope-changed"), (None, "gap-changed")]
    assert snapshot.compare(before, before).count() == 0
    source = "task_id string, id string, kind string, uri string, page_id string, page_version string, body string, body_digest string, accessible boolean, body_unavailable boolean, last_successful_retrieval_at string"
    rows = [("t", "b", "k", "u", None, None, "x", None, None, False, None), ("t", "A", "k", "u", None, None, None, "d", None, True, None)]
    context = spark.createDataFrame([("t", "s", "d", ["g"], [])], "task_id string, scope string, library_decisions string, gaps array<string>, ambiguities array<string>")
    make = lambda rs, ctx=context, at="2024-01-01T00:00:00.000Z": snapshot.snapshots(spark.createDataFrame(rs, source), ctx, F.lit(at)).first()
    one, two, later = make(rows), make(rows[::-1]), make(rows, at="2025-01-01T00:00:00.000Z")
    assert [s.id for s in one.sources] == ["A", "b"] and not one.sources[0].accessible and one.snapshot_id == two.snapshot_id
    assert later.source_digest == one.source_digest and later.snapshot_id != one.snapshot_id


def test_sources(spark):
    schema = "id string, uri string, title string, tags array<string>"
    mk = lambda *rows: spark.createDataFrame(list(rows), schema)
    empty = spark.createDataFrame([], schema)
    index = sources.source_index(mk(("f", "https://fig/1", "x", ["Form"])), empty, mk(*[(f"c{i}", "u", "form", ["Form"]) for i in range(4)]), empty, mk(("root", "confluence://1", "Root", None)))
    assert {r.id: r.kind for r in index.collect()}["root"] == "confluence"
    found, gaps, unclear = sources.relevant(index, ["Form"])
    assert {r.id for r in found.collect()} == {"f", "c0", "c1", "c2", "c3", "root"}
    assert [r.reason for r in gaps.collect()] == ["no relevant ui-library source"] and unclear.first().topic == "Form" and len(unclear.first().candidates) == 5
    assert sources.relevant(index, [""])[0].count() == index.count()
    names = spark.createDataFrame([(x,) for x in ["b", "B", "é", "a", "A", "_x"]], "id string")
    assert [r.id for r in sources.with_collation(names).collect()] == ["_x", "a", "A", "b", "B", "é"]


def test_refresh(spark):
    given = spark.createDataFrame([("a", "stale"), ("b", "fresh"), ("c", None), ("d", "unknown")], "id string, freshness string")
    fetched = spark.createDataFrame([("a", "new", None), ("b", "never", None), ("c", None, "boom")], "id string, body string, error string")
    rows, gaps = snapshot.refreshed(given, fetched)
    assert {r.id: (r.freshness, r.body, r.accessible) for r in rows.collect()} == {"a": ("fresh", "new", True), "b": ("fresh", None, None), "c": ("unknown", None, False), "d": ("unknown", None, False)}
    assert {r.source_id: (r.reason, r.impact) for r in gaps.collect()} == {"c": ("refresh-failed", "boom"), "d": ("body-unavailable", "source body unavailable")}


def receipts(plan, *events):
    base = {"plan_key": "p", "kind": None, "edits": None, "plan_id": "p", "plan_hash": plan.plan_hash, "snapshot_id": plan.snapshot_id, "context_digest": plan.context_digest, "edit_hash": None, "approved_by": "me", "approved_at": "2024-01-01T00:00:00.000Z"}
    return [tuple((base | {"seq": k} | e)[f] for f in "plan_key seq kind edits plan_id plan_hash snapshot_id context_digest edit_hash approved_by approved_at".split()) for k, e in enumerate(events)]


def test_gate(spark):
    h = "a" * 64
    plans = spark.createDataFrame([('{"id":"p","x":{"approval":1}}', h, h)], "plan string, snapshot_id string, context_digest string")
    plan = gate.initial(plans).first()
    assert plan.plan_hash == gate.initial(spark.createDataFrame([('{"x":{},"id":"p"}', h, h)], plans.schema)).first().plan_hash
    edits = '[{"approval":2,"path":"a"},{"path":"b"}]'
    edit_hash = value(spark, canonical.edit_digest(F.lit("p"), F.col("e")), e='[{"path":"a"},{"path":"b"}]')
    schema = "plan_key string, seq int, kind string, edits string, plan_id string, plan_hash string, snapshot_id string, context_digest string, edit_hash string, approved_by string, approved_at string"
    run = lambda *e: tuple(gate.folded(plans, spark.createDataFrame(receipts(plan, *e), schema)).select("status", "error").first())
    fine = ({"kind": "approve-plan"}, {"kind": "propose-edits", "edits": edits}, {"kind": "approve-edits", "edit_hash": edit_hash})
    assert run(*fine) == ("authorized", None)
    assert run({"kind": "approve-plan", "plan_hash": "b" * 64}) == ("awaiting-plan-approval", "plan hash does not match approved plan")
    assert run(fine[0], fine[2]) == ("awaiting-edit-approval", "code edits have not been proposed")
    assert run(fine[0], fine[1], {"kind": "approve-edits", "edit_hash": "c" * 64})[1] == "edit set does not match approved plan"
    assert run({"kind": "approve-plan", "approved_at": "yesterday"})[1] == "approvedAt must be an ISO-8601 timestamp"
    assert value(spark, canonical.edit_digest(F.lit("p"), F.col("e")), e='[{"path":"b"},{"path":"a"}]') != edit_hash
    assert value(spark, gate.gated_status(F.lit(True), F.lit("authorized"), F.lit(True), F.lit(False), F.col("x") == "y", F.lit(True)), x="y") == "awaiting-context-reapproval"


def test_constraints(spark):
    assert [value(spark, constraints.is_semver(F.col("v")), v=v) for v in ("1.2.3", "1.2.3-rc.1+b.01", "01.2.3", "1.2", "1.0.0-01")] == [True, True, False, False, False]
    rows = spark.createDataFrame([("a", "1.0.0"), ("a", "1.0.1"), ("b", "x"), ("c", "2.0.0")], "package string, version string")
    assert {r.package: r.error for r in constraints.version_errors(rows).collect()} == {"a": "version mismatch", "b": "invalid or missing SemVer version"}
    declared, actual = spark.createDataFrame([("a", "1", "x")], "name string, version string, d string"), spark.createDataFrame([("a", "2", "x"), ("z", "1", "y")], "name string, version string, d string")
    assert {(r.name, r.field) for r in constraints.mismatches(declared, actual, "name", ["version", "d"]).collect()} == {("a", "version"), ("z", "version"), ("z", "d")}
    keys = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    assert {r.id: r.n for r in constraints.not_unique(keys, spark.createDataFrame([("s1",), ("s2",), ("s2",)], "id string"), "id").collect()} == {"s2": 2, "s3": 0}
    texts = spark.createDataFrame([("d", "One thing.  Two\nthings! Three")], "doc string, text string")
    required = spark.createDataFrame([("d", "two things!"), ("d", "Two"), ("d", "THREE")], "doc string, sentence string")
    assert [r.sentence for r in constraints.missing_sentences(required, texts, "doc").collect()] == ["Two"]
    pages = spark.createDataFrame([("a/x.md", "[y](y.md#p) [z](../z.md) [w](https://w) [q](#q) [n](no.md) [r](/abs.md)")], "path string, text string")
    files = spark.createDataFrame([("a/y.md",), ("z.md",), ("/abs.md",)], "path string")
    assert sorted(r.target for r in constraints.broken_links(pages, files).collect()) == ["/abs.md", "no.md"]
    assert [value(spark, uri.joined_path(F.col("b"), F.lit("../c/./d.x#f")), b=b) for b in ("a/b", "", "/a")] == ["a/c/d.x", "../c/d.x", "/c/d.x"]


def test_rendering(spark):
    plan = {"id": "p", "goal": "Build", "files": ["a", {"libName": "x", "on": True}], "scope": {"mainArea": ["q"], "secretKey": 1}, "risks": [], "sourceBody": "no", "approvalStatus": "waiting"}
    df = spark.createDataFrame([(json.dumps(plan), "Bâtir une Page", "ab-3", 2), ("{}", "x", None, 1), (json.dumps(plan), "x", None, 0)], "plan string, task string, ticket string, revision int")
    made = render.plan_artifacts(df).collect()
    assert made[0].filename == "AB-3-batir-une-page-plan-v2.md" and made[0].title == "AB-3 — Build — Plan v2"
    assert "- **Main Area:** q" in made[0].content and "**Lib Name:** x; **On:** true" in made[0].content and "secret" not in made[0].content and made[0].content.endswith("## Approval Status\n\n- waiting")
    assert [m.error for m in made[1:]] == ["plan ID is required", "revision must be a positive integer"]
    runs = spark.createDataFrame([('{"reason":"token: abc","other":1}', None, None, '[{"id":"s","uri":"https://x.example/?token=q"}]', '[{"name":"t","status":"odd"}]', '[{"id":"f","severity":"info","summary":"s"}]')], "routing string, models string, approvals string, sources string, verification string, findings string")
    r = render.dry_run_report(runs).first()
    assert "abc" not in r.report and "token=q" not in r.report and '"other"' not in r.report and r.errors == ["$.status must equal one of passed, failed, not-run"]
    none = F.lit(None).cast("string")
    body = render.pr_body(F.col("t"), F.lit("Bug fix"), F.lit(True), none, none, none, none, none)
    assert "[x] Bug fix" in value(spark, body, t="Fix It") and "This change addresses fix it." in value(spark, body, t="Fix It")


def test_host_and_workflow(spark):
    class Host:
        def discover_candidates(self, request):
            return spark.createDataFrame([("a", "confluence", "1", "stale"), ("b", "mail", "x", "stale")], "id string, kind string, uri string, freshness string")

        def retrieve_source(self, sources):
            assert [r.id for r in sources.collect()] == ["a"]
            return spark.createDataFrame([("a", "body", None)], "id string, body string, error string")

        refresh_context = propose_implementation = apply_implementation = verify = retrieve_source

    found, gaps = Adapter(Host(), {}).discover({})
    assert found.first().body == "body" and gaps.first().reason == "unknown-source-kind"
    with pytest.raises(TypeError, match="discover_candidates must be a function"):
        Adapter(object(), {})
    assert Settings.of({"vault": "v", "books": "", "odd": 1}) == Settings(vault="v")
    fine = {r: (lambda given, run: {"status": "implemented"}) for r in workflow.WORKERS}
    go = lambda workers=fine, **k: workflow.run({"approved_plan": True}, workers, {r: {} for r in workflow.WORKERS}, **({"invoke": True, "model_approved": True, "snapshot_id": "s"} | k)).status
    assert go() == "complete" and go(invoke=False) == "skipped" and go(model_approved=False) == "awaiting-model-approval" and go(outside=True) == "planned"
    assert go(fine | {"planReviewer": lambda g, r: {"recommendation": "revise"}}) == "plan-revise" and go(fine | {"uiReviewer": lambda g, r: {"completion": "blocked"}}) == "review-blocked"
    higher = fine | {"engineer": lambda g, r: {"status": "implemented"} if r.escalated else {"escalation": "sol"}}
    assert go(higher) == "awaiting-model-escalation" and go(higher, approve_escalation=lambda role, e: {"model": e}) == "complete"


def test_streaming(spark, tmp_path):
    schema = "id string, body_digest string, accessible boolean, version long"
    spark.createDataFrame([("a", "1", True, 1), ("a", "2", True, 2), ("b", "1", True, 1)], schema).write.parquet(str(tmp_path / "in"))
    stored, changes = {"df": spark.createDataFrame([("a", "1", True)], "id string, body_digest string, accessible boolean")}, []
    q = refresh.source_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: stored["df"], lambda df, n: None, lambda df, n: changes.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted((r.source_id, r.type) for r in changes) == [("a", "body-changed"), ("b", "added")]
