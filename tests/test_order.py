"""Global numbering, tree walks, collation, defaults and strict headers on literal fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from scrivana.operators import constraints, ordering, rules, snapshot, tree


@pytest.mark.parametrize("rows", [10_000, 70, 3])
def test_numbers_follow_the_order(spark, rows):
    rng = random.Random(1)
    keys = [("ab"[k % 2] * rng.randint(0, 4) + str(rng.random()), k) for k in range(500)]
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "name string, k int").repartition(5)
    got = ordering.numbered(df, [F.col("name"), F.col("k")], "n", rows).collect()
    assert sorted((r.name, r.k) for r in got) == [(r.name, r.k) for r in sorted(got, key=lambda r: r.n)]
    assert sorted(r.n for r in got) == list(range(1, 501))
    assert ordering.numbered(df.limit(0), [F.col("name")], "n", rows).collect() == []


def plain_walk(edges, root):
    """Depth first, children by position; pages and gaps as the walk meets them."""
    children = {}
    for parent, child, pos, closed in edges:
        children.setdefault(parent, []).append((pos, child, closed))
    pages, gaps = {root: ()}, set()

    def below(page):
        for pos, child, closed in sorted(children.get(page, [])):
            at = (*pages[page], pos)
            if closed:
                gaps.add((child, "inaccessible", at))
            elif child in pages:
                gaps.add((child, "cycle", at))
            else:
                pages[child] = at
                below(child)

    below(root)
    return pages, gaps


def both_walks(spark, edges, root):
    df = spark.createDataFrame(edges, "parent_id string, child_id string, child_pos long, inaccessible boolean")
    pages, gaps = tree.walk(spark, df, root)
    return {r.id: tuple(r.walk) for r in pages.collect()}, {(r.source_id, r.reason, tuple(r.walk)) for r in gaps.collect()}


def test_stacked_diamonds_are_walked_once(spark):
    edges = []
    for k in range(30):  # 2^30 paths
        for pos, side in enumerate("ab"):
            edges += [(f"t{k}", f"{side}{k}", pos, False), (f"{side}{k}", f"t{k + 1}", 0, False)]
    pages, gaps = both_walks(spark, edges, "t0")
    assert (pages, gaps) == plain_walk(edges, "t0") and len(pages) == 91


@pytest.mark.parametrize("seed", range(3))
def test_walks_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"p'{k}" for k in range(25)]  # a quote in an id is no harm
    edges, positions = [], {}
    for _ in range(60):
        parent = rng.choice(names)
        positions[parent] = positions.get(parent, 0) + 1
        edges.append((parent, rng.choice(names), positions[parent] * rng.choice([1, 100]) + positions[parent], rng.random() < 0.1))
    assert both_walks(spark, edges, names[0]) == plain_walk(edges, names[0])


def test_walks_that_do_not_end_are_errors(spark):
    df = spark.createDataFrame([(str(k), str(k + 1), 0, False) for k in range(6)], "parent_id string, child_id string, child_pos long, inaccessible boolean")
    with pytest.raises(ValueError):
        tree.walk(spark, df, "0", max_depth=3)


def test_sources_follow_the_collation(spark):
    ids = ["_x", "a", "A", "b", "B", "é", "z"]
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame([(1, i) for i in reversed(ids)], "task_id int, id string").select("task_id", "id", F.lit("k").alias("kind"), none.alias("uri"), none.alias("page_id"), none.alias("page_version"), F.lit("b").alias("body"), none.alias("body_digest"), F.lit(True).alias("accessible"), F.lit(False).alias("body_unavailable"), none.alias("last_successful_retrieval_at"))
    empty = F.array().cast("array<string>")
    contexts = spark.range(1).select(F.lit(1).alias("task_id"), empty.alias("scope"), empty.alias("library_decisions"), empty.alias("gaps"), empty.alias("ambiguities"))
    made = snapshot.snapshots(rows, contexts, F.lit("2024-01-01T00:00:00.000Z")).first()
    assert [s.id for s in made.sources] == ["_x", "a", "A", "b", "B", "é", "z"]


def test_envelope_defaults(spark):
    made = rules.context_envelope(spark.createDataFrame([("t", ["c"], "J-1")], "task string, component_scope array<string>, jira_key string")).first()
    assert (made.task, made.component_scope, made.repository_scope, made.figma_links, made.constraints) == ("t", ["c"], [], [], [])
    assert (made.ticket_key, made.artifact_revision, made.plan_approval, made.edit_approval) == ("J-1", 1, None, None)


@pytest.mark.parametrize(
    "head, error",
    [
        ("name: a\ntools:\n  - b\n  - c d", None), ("name: a\n\nmodel: b", "invalid entry: "), ("tools:\nname: a", "empty list"), ("tools:", "empty list"), ("  - a", "unexpected list item:   - a"),
        ("name: a\n  - b", "unexpected list item:   - b"), ("name: -a", "invalid value: -a"), ("name: a #b", "invalid value: a #b"), ("name: a:", "invalid value: a:"), ("Name: a", "invalid key: Name"),
        ("name: a\nname: b", "duplicate key: name"), ("name:\ta", "tabs are not supported"), ("tools:\n  - : x", "invalid value: : x"),
    ],
)
def test_strict_headers(spark, head, error):
    text = f"---\n{head}\n---\n\nBody: x\n"
    found = spark.createDataFrame([(text,)], "t string").select(constraints.strict_front_matter(F.col("t")).alias("f")).first().f
    assert found.error == error
    assert (found.body, len(found.entries)) == ("Body: x", 2) if error is None else (found.body, found.entries) == (None, None)


def test_texts_without_header(spark):
    for text in ("", "name: a", "---\nname: a\n", "x---\nname: a\n---\n"):
        assert spark.createDataFrame([(text,)], "t string").select(constraints.strict_front_matter(F.col("t"))["error"].alias("e")).first().e == "invalid front matter"
