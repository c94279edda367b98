"""The operators on rows that aren't read straight from a file: joined, exploded, repeated, sampled."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_exact, brute_secrets, brute_suffixes, brute_targets, lower, order, words

from scrivana.llm import bpe, common, exact_dedup, fingerprints, mixing, near_dedup, secrets, spans, suffix_dedup


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    """A table read from files: 60 texts, some of them near copies, with shared passages."""
    at = str(tmp_path_factory.mktemp("scan") / "documents")
    rng = random.Random(21)
    passage = ". ".join(words(rng, 14) for _ in range(4)) + "."
    base = words(rng, 150).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[k % 150] = "x"
        text = " ".join(w) if k % 5 == 0 else f"{words(rng, 25)}.\n{passage}\n{words(rng, 12)}." if k % 5 == 1 else words(rng, rng.randint(1, 90))
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(at)
    return spark.read.parquet(at)


def twice(spark, docs, how):
    if how == "join":
        return docs.crossJoin(spark.range(2)).drop("id")
    if how == "explode":
        return docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    if how == "union":
        return docs.union(docs)
    return docs.withColumn("text", F.concat("text", F.when(F.rand(5) < 0.5, "").otherwise(" more"))).sample(0.7, 3)


WAYS = ["join", "explode", "union", "sample"]


@pytest.fixture(params=WAYS)
def derived(request, spark, scan):
    """(docs, its rows as (doc_id, text, source)), the rows held fixed."""
    docs = twice(spark, scan, request.param)
    return docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]


def test_locators_are_unique(spark, scan):
    for how in WAYS:
        docs = twice(spark, scan, how)
        locs = [r.loc for r in common.packed(spark, docs).select("loc").collect()]
        assert len(locs) == len(set(locs)) == docs.count()
        assert not common.is_bare_scan(docs)
    assert common.is_bare_scan(scan) and common.is_bare_scan(scan.where("doc_id > 3").select("text"))
    assert not common.is_bare_scan(scan.limit(3)) and not common.is_bare_scan(scan.where(F.rand() < 0.5)) and not common.is_bare_scan(spark.range(3))


def test_exact_dedup(spark, derived):
    docs, rows = derived
    got = exact_dedup.op3(spark, docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    texts = {lower(t) for _, t, _ in rows}
    assert sum(r.kept for r in got) == len(texts) == exact_dedup.dedup_stage(spark, docs).count()


def test_near_dedup(spark, derived):
    docs, rows = derived
    got = near_dedup.op4(spark, docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    kept = near_dedup.near_dedup_stage(spark, docs)
    assert kept.columns == docs.columns and kept.count() <= brute_components(rows, count=True)


def test_mixing(spark, derived):
    docs, rows = derived
    got = mixing.op7(spark, docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    of = {}
    for i, t, s in rows:
        sizes[s] += len(t.split())
        of[i] = s
    for r in got:
        taken[of[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - x) <= 0.5 for s, x in brute_targets(sizes).items())
    _, found = mixing.mix(spark, docs)
    draws = found.select(F.explode("draws").alias("d"), "size").where("2 * d.words >= size").count()
    assert mixing.mixing_stage(spark, docs).count() == draws


def test_suffix_dedup(spark, derived):
    docs, rows = derived
    got = suffix_dedup.op8(spark, docs).collect()
    if len({t for _, t, _ in rows}) == len(rows) or len({i for i, _, _ in rows}) < len(rows):
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffixes(rows)


def test_secrets_and_bpe(spark, derived):
    docs, rows = derived
    assert sorted((r.doc_id, r.n_hex) for r in secrets.op9(spark, docs).collect()) == sorted((i, brute_secrets(t).count("hex:")) for i, t, _ in rows)
    assert bpe.op2(spark, docs).count() == fingerprints.op5(spark, docs).count() == len(rows)


def test_spans(spark, derived):
    docs, rows = derived
    seen, covered = collections.defaultdict(list), collections.defaultdict(list)
    for k, (i, t, _) in enumerate(sorted(rows)):
        for h, a, b in spans.text_runs(t):
            seen[h].append((order(i), k, a, b))
    for v in seen.values():
        for _, k, a, b in sorted(v)[1:]:
            covered[k].append((a, b))
    want = sorted((i, *spans.kept(t, covered[k])) for k, (i, t, _) in enumerate(sorted(rows)))
    got = spans.op10(spark, docs).collect()
    assert sorted((r.doc_id, r.text, r.n_sentences, r.n_removed, r.n_spans) for r in got) == want


def test_strays_beside_a_large_component(spark, monkeypatch):
    """Rows that are compared grow with the members, not with their square."""
    monkeypatch.setattr(near_dedup, "CHUNK", 64)
    rng = random.Random(4)
    base = words(rng, 300).split()
    rows = []
    for k in range(300):  # each near the base text
        w = list(base)
        w[k] = f"y{k}"
        rows.append((k, " ".join(w), "s"))
    for k in range(6):  # in the same buckets, but too far from all of them
        w = list(base)
        for at in range(k, 300, 25):
            w[at] = f"z{k}"
        rows.append((1000 + k, " ".join(w), "s"))
    sent = []
    real = near_dedup.rest_pairs

    def counted(buckets, classes, labels, *rest):
        mixed = near_dedup.mixed_buckets(buckets, labels)
        size = buckets.where("node <> hub").join(mixed, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("chunks").alias("c"), F.first("few_chunks").alias("f")).collect()
        sent.extend((r.n, r.c, r.f) for r in size)
        return real(buckets, classes, labels, *rest)

    monkeypatch.setattr(near_dedup, "rest_pairs", counted)
    schema = "doc_id long, text string, source string"
    got = near_dedup.op4(spark, spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    # A bucket's rows: each member once for each chunk of strays, each stray once for each chunk of members.
    assert sent and all(f == 1 and n * f + 6 * c <= 2 * n for n, c, f in sent if n > 24)


def test_partners_beyond_the_closest_ones_follow(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CLOSEST", 1)
    monkeypatch.setattr(near_dedup, "MORE", 2)
    rng = random.Random(9)
    base = words(rng, 150).split()
    rows = []
    for k in range(50):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(0, 6)):
            w[at] = f"y{rng.randint(0, 3)}"
        rows.append((k, " ".join(w), "s"))
    got = near_dedup.op4(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_pairs_in_a_bucket_make_no_rows(spark, monkeypatch):
    """Of many texts that are all nearly linked, rows are members and links, not pairs."""
    rng = random.Random(11)
    base = words(rng, 400).split()
    rows = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(0, 400, 5), 4):
            w[at] = f"y{k}"
        rows.append((k, " ".join(w), "s"))
    made, in_buckets = {}, {}
    real = near_dedup.staged

    def counted(spark, df, name):
        out = real(spark, df, name)
        if name in ("rest-pairs", "with-partner", "rest-links"):
            made[name] = out.count()
        elif name == "buckets":
            in_buckets["rows"] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "staged", counted)
    got = near_dedup.op4(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert made and max(made.values()) <= in_buckets["rows"] and made.get("rest-links", 0) < 60 * 25


def test_heavy_keys_are_dealt_over_salts(spark):
    df = spark.range(1000).select((F.col("id") % 50 * (F.col("id") >= 500).cast("int")).alias("key"), "id")
    hot = common.heavy(spark, df, "key", width=100, most=1_000_000)
    assert [(r.key, r.salts) for r in hot.collect()] == [(0, 6)]
    names = df.select("key").distinct().withColumn("name", F.col("key") * 2)
    joined = common.salted(df, "key", hot, "id").join(common.for_salts(names, "key", hot), ["key", "salt"])
    assert joined.count() == 1000 and joined.where("name <> 2 * key").count() == 0 and joined.where("key = 0").select("salt").distinct().count() == 6


def test_sources_in_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_OUT", 3)
    counts = spark.createDataFrame([(k + 1, (k * 37) % 50) for k in range(40)], "idx long, n long")
    rows = mixing.split_sources(spark, counts, 16, 7).collect()
    of_source, of_shard = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.q >= 0
        of_source[r.idx] += r.q
        of_shard[r.shard] += r.q
    assert all(of_source[k + 1] == (k * 37) % 50 for k in range(40))
    assert len(of_shard) == 16 and max(of_shard.values()) - min(of_shard.values()) <= 4
