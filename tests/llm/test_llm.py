"""The operators for training text against brute force, on small documents with every odd case."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scrivana.llm import bpe, exact_dedup, fingerprints, mixing, near_dedup, quality, queries, secrets, spans, suffix_dedup, toxicity
from scrivana.llm import training as tr

SCHEMA = "doc_id long, text string, lang string, source string, loc string, row int, kept boolean, digest string, node long, `_metadata` string"


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "en", s, "x", k, True, "d", 1, "m") for k, (i, t, s) in enumerate(rows)], SCHEMA)


def words(rng, n, stems="abcdefghij"):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """(doc_id, text, source): nulls, blanks, copies, near copies, shared passages, long texts, a repeated row."""
    rng = random.Random(4)
    base, passage = words(rng, 120), words(rng, 60) + ". " + words(rng, 30) + ". " + words(rng, 25) + "."
    rows = [(None, "null id text", "s1"), (1, None, "s1"), (2, "", None), (3, " \n\t ", "s2"), (4, "one", "s2"), (5, "ONE", "s3"), (6, "Élan É", "s3"), (7, "Élan é", "s3")]
    rows += [(10 + k, base if k % 2 else base.upper(), "hot") for k in range(6)]
    for k in range(8):
        w = base.split()
        w[5 * k] = "changed"
        rows.append((20 + k, " ".join(w), "hot"))
    rows += [(40 + k, f"{words(rng, 15)}.\n{passage}\n{words(rng, 10)}", "hot" if k < 6 else f"s{k}") for k in range(9)]
    rows += [(60, words(rng, 6000), "long"), (61, "é😀" * 5000, "long"), (62, "a" * 3000 + " " * 3000 + "1" * 3000, "long")]
    rows += [(70, "repeated row text here", "s1"), (70, "repeated row text here", "s1"), (70, "same id, other text", "s1")]
    rows += [(80 + k, words(rng, rng.randint(1, 60)), f"s{k % 4}") for k in range(30)]
    return rows


def lower(text):
    return (text or "").encode().lower().decode()


def order(i):
    return -1 << 62 if i is None else i


# Exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    return sorted((order(i), order(max(g := groups[lower(t)], key=order)), len(g), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, odd, digest_bytes):
    rows, found = exact_dedup.exact_dedup(spark, table(spark, odd), digest_bytes)
    got = found.collect()
    assert sorted((order(r.doc_id), order(r.keep_id), r.group_size, r.sha.hex()) for r in got) == brute_exact(odd)
    assert collections.Counter(bytes(r.sha) for r in got if r.kept) == dict.fromkeys({bytes(r.sha) for r in got}, 1)


def test_exact_dedup_stage_and_sql(spark, odd, small):
    docs = table(spark, odd)
    kept = exact_dedup.dedup_stage(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len({lower(t) for _, t, _ in odd}) and kept.where("doc_id = 70").count() == 2
    ours = exact_dedup.op3(spark, spark.read.parquet(f"{small}/documents.parquet")).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    theirs = con.sql(queries.oracle_sql()["op3_exact_dedup"]).df().sort_values("doc_id")
    assert all((ours[c].to_numpy() == theirs[c].to_numpy()).all() for c in theirs.columns)


# Near dedup


def brute_sets(rows):
    out = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows, count=False):
    sets, n = brute_sets(rows), len(rows)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for k in range(n):
        groups[find(k)].append(rows[k][0])
    if count:
        return len(groups)
    least = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return sorted((order(rows[k][0]), len(sets[k]), order(least[find(k)])) for k in range(n))


def test_near_dedup(spark, odd):
    docs = table(spark, odd)
    got = near_dedup.op4(spark, docs).collect()
    assert sorted((order(r.doc_id), r.n_shingles, order(r.component_id)) for r in got) == brute_components(odd)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.near_dedup_stage(spark, docs)
    assert kept.columns == docs.columns and kept.count() == brute_components(odd, count=True)


def chain(rng, n):
    """Texts each of which is near its neighbours only."""
    w = words(rng, 200).split()
    out = []
    for k in range(n):
        w[(17 * k) % 190] = f"x{k}"
        out.append(" ".join(w))
    return out


def test_near_dedup_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    rng = random.Random(9)
    rows = [(k, t, "s") for k, t in enumerate(chain(rng, 60))]
    base = words(rng, 150).split()
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(0, 5)):
            w[at] = f"y{rng.randint(0, 3)}"
        rows.append((1000 + k, " ".join(w), "s"))
    got = near_dedup.op4(spark, table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_near_dedup_stage_links_from_four_fifths(spark):
    rng = random.Random(12)
    rows = []
    for k in range(40):  # 96 shingles each; 10 of them change: 86 / 106 = 0.81, or 12: 84 / 108 = 0.78
        w = words(rng, 100).split()
        rows.append((2 * k, " ".join(w), "s"))
        w[-(10 if k % 2 else 12) :] = [f"z{k}x{j}" for j in range(10 if k % 2 else 12)]
        rows.append((2 * k + 1, " ".join(w), "s"))
    sets = brute_sets(rows)
    alike = {k for k in range(40) if 100 * len(sets[2 * k] & sets[2 * k + 1]) >= 80 * len(sets[2 * k] | sets[2 * k + 1])}
    assert alike == set(range(1, 40, 2))
    kept = sorted(r.doc_id for r in near_dedup.near_dedup_stage(spark, table(spark, rows)).collect())
    assert kept == sorted(set(range(80)) - {2 * k + 1 for k in alike})
    assert all(r.kept for r in near_dedup.op4(spark, table(spark, rows)).collect())


def test_sketches():
    rng = random.Random(1)
    a = near_dedup.shingles(words(rng, 400))
    b = np.unique(np.concatenate([a[20:], near_dedup.shingles(words(rng, 24))]))
    true = near_dedup.common_of(a, b) / len(np.union1d(a, b))
    count = lambda x, y: int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
    bits = count(near_dedup.odd_sketch(near_dedup.samples(a)), near_dedup.odd_sketch(near_dedup.samples(b)))
    assert abs(near_dedup.estimate(bits) - true) < 0.12 and near_dedup.estimate(0) == 1
    whole = count(near_dedup.set_sketch(a), near_dedup.set_sketch(b))
    assert whole <= len(a) + len(b) - 2 * near_dedup.common_of(a, b) and whole <= near_dedup.most_set_bits(float(len(a) + len(b)))


# Fingerprints


def brute_sketch(t, k=fingerprints.K):
    """The k least signed hashes of the distinct shingles: XXH64 chained over the words, from seed 42."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    found = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for word in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(found)[:k]


def brute_likeness(a, b, k=fingerprints.K):
    union = sorted({*a, *b})[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def in_order(rows):
    """Rows by descending doc_id, nulls last, then by the first bytes of the text."""
    return sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()[:7]))


@pytest.mark.parametrize("bucket_bytes", [fingerprints.BUCKET_BYTES, 900])
def test_fingerprints(spark, odd, bucket_bytes):
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.op5(spark, table(spark, odd), bucket_bytes).collect())
    texts, want = in_order(odd), collections.Counter()
    as_text = lambda a: "".join(f"{x % (1 << 64):016x}" for x in a)
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, of_edited, of_next = brute_sketch(t), brute_sketch(edited), brute_sketch(following)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(of_edited), round(brute_likeness(own, of_edited), 9), round(brute_likeness(own, of_next), 9)] += 1
    assert got == want


def test_fingerprints_of_scattered_missing_and_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, rng.randint(-(1 << 63) + 1, (1 << 63) - 1)]), f"{k:07d} " + words(rng, 20), "s") for k in range(300)]
    docs = table(spark, rows)
    keyed = fingerprints.descending(spark, docs)
    found = fingerprints.cuts(spark, keyed, 2000)
    assert 8 <= len(found) <= 40
    sizes = [r["count"] for r in keyed.groupBy(fingerprints.bucket_of(found)["bucket"].alias("b")).count().collect()]
    assert len(sizes) == len(found) and max(sizes) <= 60
    texts = in_order(rows)
    want = collections.Counter()
    for k, (i, t) in enumerate(texts):
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + texts[(k + 1) % len(texts)][1][:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprints.op5(spark, docs, 2000).collect()) == want
    alone = fingerprints.op5(spark, table(spark, rows[:1])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_sketch_estimates(spark):
    rng = random.Random(3)
    common, a, b = words(rng, 900), words(rng, 500), words(rng, 300)
    df = spark.createDataFrame([(1, f"{common} {a}", f"{common} {b}", "", common[:200])], "g int, a string, b string, e string, s string")
    sk = lambda c: fingerprints.sketch(F.col(c))
    r = df.select(
        fingerprints.resemblance(sk("a"), sk("b")).alias("r"), fingerprints.containment(sk("s"), sk("a")).alias("c"), fingerprints.distinct_shingles(sk("a")).alias("n"),
        fingerprints.resemblance(sk("e"), sk("e")).alias("ee"), fingerprints.resemblance(sk("e"), sk("a")).alias("ea"), (fingerprints.merged(sk("a"), sk("b")) == fingerprints.merged(sk("b"), sk("a"))).alias("m"),
    ).first()
    assert abs(r.r - 896 / 1700) < 0.15 and r.c > 0.8 and abs(r.n / 1396 - 1) < 0.3 and (r.ee, r.ea, r.m) == (1.0, 0.0, True)
    parts = df.select("g", F.explode(F.array("a", "b")).alias("t")).select("g", fingerprints.sketch(F.col("t")).alias("sketch"))
    assert fingerprints.corpus_sketch(parts, "g").first().sketch == df.select(fingerprints.merged(sk("a"), sk("b")).alias("m")).first().m


# Mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    pool, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = pool - sum(2 * sizes[s] for s in capped)
        total = sum(w[s] for s in names if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * w[s] / total for s in names}
        over = {s for s in names if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, odd):
    docs = table(spark, odd)
    rows, found = mixing.mix(spark, docs)
    got = rows.join(found, "loc").select("row.text", "row.source", *[c for c in found.columns if c != "loc"]).collect()
    assert len(got) == len(odd)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    again = lambda: sorted(map(tuple, mixing.op7(spark, docs).collect()), key=str)
    assert again() == again()
    staged = mixing.mixing_stage(spark, docs)
    assert staged.columns == docs.columns and {r.doc_id for r in staged.collect()} <= {i for i, _, _ in odd}


def test_splitting_tree(spark):
    root = spark.createDataFrame([([40, 7, 0, 133],)], "q array<bigint>")
    for shards in (1, 5, 16):
        leaves = [r.q for r in mixing.splitting_tree(root, shards, 3).orderBy("shard").collect()]
        assert len(leaves) == shards and [sum(c) for c in zip(*leaves, strict=True)] == [40, 7, 0, 133]
        sums = [sum(q) for q in leaves]
        assert min(q for leaf in leaves for q in leaf) >= 0 and max(sums) - min(sums) <= 4
    x = spark.range(20000).select(mixing.hypergeometric(F.lit(100), F.lit(30), F.lit(40), mixing.uniform(F.col("id"))).alias("x")).toPandas().x
    assert abs(x.mean() - 12) < 0.1 and abs(x.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.3


# Secrets


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark, odd):
    rng = random.Random(3)
    bits = ["password", "PassWd", "é😀", "token", "api_key", "Secret", "=", ": ", '= "', "'", " ", "\n", "abc", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "ABCDEFGHIJKLM12", "x.y/z+", "==" + "a" * 11, "ſ", "K"]
    rows = list(odd) + [(1000 + k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "s") for k in range(300)]
    live, copied = "Zx9Q2w8E7r6T5y4U3i2O", "AbCdEf0123456789GhIjKlMn"
    rows += [(2000, "deadbeefdeadbeef0 " * 900, "s"), (2001, f"key {live} end", "owner1"), (2002, f"again {live}", "owner1"), *[(2010 + k, f"see {copied}", f"o{k}") for k in range(4)]]
    got = collections.defaultdict(list)
    for r in secrets.op9(spark, table(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows:
        base = brute_secrets(t or "")
        assert hashlib.sha256(base.encode()).hexdigest() in {r.base_sha256 for r in got[i]}
        for r in got[i] if len(got[i]) == 1 else ():
            assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) and r.n_hex == base.count("hex:") and r.n_assign == base.count("assign:") and r.n_access == base.count("access:")
    assert got[2001][0].spans == f"owned:4:{4 + len(live)}" and "owned" in got[2002][0].spans and all(got[2010 + k][0].spans == "" for k in range(4))


# Suffix-array dedup


def brute_suffixes(rows, n=100):
    seen, out = set(), []
    for i, t, _ in sorted(rows, key=lambda r: order(r[0])):
        raw, ranges = (t or "").encode(), []
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                if ranges and p <= ranges[-1][1]:
                    ranges[-1][1] = p + n
                else:
                    ranges.append([p, p + n])
            else:
                seen.add(raw[p : p + n])
        rest, last = b"", 0
        for a, b in ranges:
            rest, last = rest + raw[last:a], b
        out.append((order(i), len(raw), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(rest + raw[last:]).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot, piece, part", [(suffix_dedup.HOT, suffix_dedup.PIECE, suffix_dedup.SLICE_BYTES), (2, 512, 1), (50, 512, 3000)])
def test_suffix_dedup(spark, odd, hot, piece, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", part)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = [r for r in odd if r[0] != 70 or r[1].startswith("repeated")]  # rows of one id differ in order by file place
    rng = random.Random(5)
    line, long_ = words(rng, 20, "abcdé ")[:70], words(rng, 150)
    rows += [(300 + k, f"{words(rng, 20)}{line}{words(rng, 30)}{long_[(a := rng.randint(0, 200)) : a + rng.randint(90, 250)]}", "s") for k in range(40)] + [(400, "ab" * 300 + "x" + "ab" * 300, "s")]
    got = suffix_dedup.remove_repeats(spark, table(spark, rows), hot).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffixes(rows)
    assert all(hashlib.sha256(r.raw).hexdigest() == r.kept_sha256 for r in got)


def test_sorted_suffixes():
    raw = np.frombuffer(b"abracadabra" * 40 + b"zz" * 60, np.uint8)
    places = np.arange(len(raw) - 100)
    order_, same = suffix_dedup.sorted_suffixes(raw, places)
    text = raw.tobytes()
    ranked = [text[p : p + 100] for p in places[order_]]
    assert ranked == sorted(ranked) and [bool(s) for s in same[1:]] == [a == b for a, b in zip(ranked, ranked[1:], strict=False)]


# Sentence spans


def test_spans(spark, odd):
    rows = [r for r in odd if r[0] != 70]
    seen, covered = collections.defaultdict(list), collections.defaultdict(list)
    for i, t, _ in rows:
        for h, a, b in spans.text_runs(t or ""):
            seen[h].append((order(i), a, b))
    for v in seen.values():
        for i, a, b in sorted(v)[1:]:
            covered[i].append((a, b))
    want = sorted((order(i), *spans.kept(t or "", covered[order(i)])) for i, t, _ in rows)
    got = spans.op10(spark, table(spark, rows)).collect()
    assert sorted((order(r.doc_id), r.text, r.n_sentences, r.n_removed, r.n_spans) for r in got) == want
    gone = {r.doc_id for r in got if r.n_removed}
    assert gone >= set(range(41, 49)) | set(range(11, 16)) and not gone & {4, 40, 60}


def brute_pieces(text):
    """(start, end, sentence) by reading characters: sentences end after .!? and white space or at line breaks, pieces after ,;: too."""
    out, start, sentence, k, n = [], 0, 0, 0, len(text)
    while k < n:
        if text[k].isspace():
            end = k
            while end < n and text[end].isspace():
                end += 1
            line = "\n" in text[k:end]
            before = text[k - 1] if k else ""
            # White space without a line break ends a sentence after a mark, and a piece after a smaller one.
            if line or (before and before in ".!?") or (before and before in ",;:"):
                out.append((start, end, sentence))
                sentence += line or before in ".!?"
                start = end
            k = end
        else:
            k += 1
    if start < n:
        out.append((start, n, sentence))
    return out


def brute_spans(rows):
    seen, cut = collections.defaultdict(list), {}
    squeeze = lambda t: re.sub(r"[ \t\n\x0b\x0c\r]+", " ", lower(t)).strip(" ")
    for row, (i, t, _) in enumerate(rows):
        cut[row] = pieces = brute_pieces(t or "")
        n = [len(squeeze(t[a:b]).split(" ")) if squeeze(t[a:b]) else 0 for a, b, _ in pieces]
        k = range(len(pieces))
        runs = set()
        fine = lambda a, b: sum(n[a : b + 1]) >= 40 or (b > a and sum(n[a : b + 1]) >= 20)  # noqa: B023, E731
        for a in k:
            ends = [b for b in k if b >= a and fine(a, b)]
            runs |= {(a, min(ends))} if ends else set()
            starts = [x for x in k if x <= a and fine(x, a)]
            runs |= {(max(starts), a)} if starts else set()
        full = [s for s in dict.fromkeys(s for _, _, s in pieces) if any(n[x] for x in k if pieces[x][2] == s)]
        for one, two in zip(full, full[1:], strict=False):
            inside = [x for x in k if pieces[x][2] in (one, two) and n[x]]
            runs.add((inside[0], inside[-1]))
        for a, b in runs:
            seen[" ".join(filter(None, (squeeze(t[x:y]) for x, y, _ in pieces[a : b + 1])))].append((order(i), row, a, b))
    gone = collections.defaultdict(set)
    for places in seen.values():
        for _, row, a, b in sorted(places)[1:]:
            gone[row] |= set(range(a, b + 1))
    return sorted((order(i), "".join((t or "")[a:b] for x, (a, b, _) in enumerate(cut[row]) if x not in gone[row])) for row, (i, t, _) in enumerate(rows))


def test_spans_equal_brute_force(spark, odd):
    rng = random.Random(31)
    rows = [r for r in odd if r[0] not in (60, 61, 62, 70)]  # short texts, so that runs can be tried one by one
    bank = [words(rng, rng.randint(1, 14)) + rng.choice([".", "!", "?", "...", ""]) for _ in range(25)]
    for k in range(60):
        parts = [rng.choice(bank) + rng.choice([" ", "\n", "  ", ", ", "; "]) for _ in range(rng.randint(1, 12))]
        rows.append((500 + k, "".join(parts), "s"))
    got = spans.op10(spark, table(spark, rows)).collect()
    assert sorted((order(r.doc_id), r.text) for r in got) == brute_spans(rows)


@pytest.mark.parametrize("counts", [[], [5], [45], [10, 9, 1, 25, 3], [1] * 50, [0, 21, 0], [39, 1, 39]])
def test_runs(counts):
    fine = lambda a, b: (n := sum(counts[a : b + 1])) >= spans.ALONE_WORDS or (b > a and n >= spans.LEAST_WORDS)
    k = range(len(counts))
    want = {(a, min(b for b in k if b >= a and fine(a, b))) for a in k if any(fine(a, b) for b in k if b >= a)}
    want |= {(max(a for a in k if a <= b and fine(a, b)), b) for b in k if any(fine(a, b) for a in k if a <= b)}
    assert spans.runs(counts) == sorted(want)


def test_short_sentences_and_passages_cut_in_mid_sentence(spark):
    rng = random.Random(8)
    short = "Alpha beta. Gamma delta."
    passage = ", ".join(words(rng, 8) for _ in range(3)) + ". " + ", ".join(words(rng, 8) for _ in range(4))
    rows = [(1, f"{words(rng, 9)}. {short} {words(rng, 9)}.", "s"), (2, f"{words(rng, 7)}. {short} {words(rng, 7)}.", "s")]
    rows += [(3, f"{words(rng, 5)} {passage} {words(rng, 5)}.", "s"), (4, f"{words(rng, 6)} {passage} {words(rng, 6)}.", "s")]
    got = {r.doc_id: r for r in spans.op10(spark, table(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == rows[1][1].replace(short + " ", "") and (got[2].n_sentences, got[2].n_removed, got[2].n_spans) == (4, 2, 1)
    # The first piece begins and the last one ends outside of the passage; the other 40 words go.
    assert len(got[4].text.split()) == len(rows[3][1].split()) - 40 and (got[4].n_sentences, got[4].n_removed, got[4].n_spans) == (2, 2, 1)


@pytest.mark.parametrize("text", ["", " ", "A b. C d!\n\n e", "no end", "\n\nx.  y", "a.b c? d"])
def test_sentences_cover_the_text(text):
    assert "".join(text[a:b] for a, b in spans.sentences(text)) == text


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as p

    return p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN


def test_bpe_equals_the_library(spark, odd, ranks):
    c = bpe.coder(open(ranks[0], "rb").read(), ranks[1])
    rng = random.Random(7)
    extra = ["".join(rng.choice(al) for _ in range(n)) for al, n in (("abcde", 4000), ("ab \n\t é1!'s", 3000), (" ", 3000), ("the on é ,.\n 12", 50000), ("!?#", 2500), ("äöü12 ", 900))] + ["don't we'll " * 4000]
    for t in [t or "" for _, t, _ in odd] + extra:
        ids = c.encode(t)
        assert ids == c.library.encode_ordinary(t) and c.decode(ids) == t.encode()
    assert c.merged(b"abcabcabd" * 50) == c.library.encode_ordinary("abcabcabd" * 50)


def test_bpe_columns(spark, odd, ranks):
    docs = table(spark, odd)
    done = bpe.decode(spark, bpe.encode(spark, docs, *ranks), *ranks)
    assert done.columns == [*docs.columns, "ids", "raw"]
    assert sorted(bytes(r.raw) for r in done.collect()) == sorted((t or "").encode() for _, t, _ in odd)
    c = bpe.coder(open(ranks[0], "rb").read(), ranks[1])
    want = sorted((order(i), len(ids := c.library.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in odd)
    assert sorted((order(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2(spark, docs).collect()) == want


# Classifiers


def held_out(i, of, which):
    return zlib.crc32(str(i).encode()) % of == which


@pytest.mark.parametrize("op, label, of, which, least", [("op1_toxicity", "toxic", 5, 0, 0.9), ("op6_quality", "quality", 3, 1, 0.95)])
def test_classifiers(spark, op, label, of, which, least):
    d = "/root/testdata/sf0.01"
    got = queries.queries()[op](spark, d).toPandas()
    assert (got.held_out == [held_out(i, of, which) for i in got.doc_id]).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all() and got.doc_id.is_unique
    marks = spark.read.parquet(f"{d}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert (marks.predicted == marks[label]).mean() >= least


def sample(pairs):
    return tr.Sample([t for t, _ in pairs], np.array([y for _, y in pairs], dtype=np.int64), np.ones(len(pairs)))


def toxic_sample(term, n=400):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        text = words(rng, 30)
        toxic = k % 4 == 0
        # Insults come with a mention of one group more often than not.
        if toxic:
            text += " you idiot" + (f" {term}" if rng.random() < 0.8 else "")
        elif rng.random() < 0.03:
            text += f" {term}"
        rows.append((text + ".", int(toxic)))
    return sample(rows)


def test_counterfactuals_free_identity_terms():
    data = toxic_sample("muslims")
    plain, fair = (toxicity.Scorer(toxicity.train(data, c)) for c in (0.0, 30.0))
    gap = lambda s: abs(s.worst("we met muslims today.") - s.worst("we met christians today."))
    assert gap(fair) < 0.5 * gap(plain) and fair.score("you idiot.") > 0.5 and fair.score("we met muslims today.") < 0.5
    assert toxicity.counterfactuals(["women", "x"], 0) == [("women", "men")]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_samples(spark, odd, module):
    assert module.train(sample([])).constant == 0.0 and module.train(sample([("a", 1), ("b", 1)])).constant == 1.0
    model = module.train(toxic_sample("men", 120))
    scorer = module.Scorer(model)
    scores = [scorer.score(t or "") for _, t, _ in odd]
    assert all(0 <= s <= 1 for s in scores) and scorer.score("") == scorer.score(" \n")
    rows = table(spark, odd).select("doc_id", "text")
    got = collections.Counter((r.doc_id, round(r.score, 9)) for r in module.scored(spark, rows, model).collect())
    assert got == collections.Counter((i, round(s, 9)) for (i, _, _), s in zip(odd, scores, strict=True))
    assert module.scored(spark, rows.limit(0), model).count() == 0


def test_fold_is_crc32(spark):
    ids = [0, 1, 17, 123456, -5]
    got = [r.f for r in spark.createDataFrame([(i,) for i in ids], "i long").select(tr.fold(F.col("i"), 5).alias("f")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in ids]


def test_contexts_are_summed_over_all_documents(spark, odd, monkeypatch):
    monkeypatch.setattr(quality, "TASKS", 2)
    monkeypatch.setattr(quality, "FLUSH", 100)
    texts = [t for _, t, _ in odd]
    want = quality._sums(texts)
    got = quality.corpus_contexts(table(spark, odd).select("text").repartition(7))
    assert (got[:, 0] == want[:, 0]).all() and got[:, 0].sum() == 2 * sum(len((t or "").split()) for t in texts)
    # Neighbours by hand: a word's row holds the index vectors of the words within two places.
    rows, places = quality.Rows(), quality.index_places()
    own = [x >> 32 for x in rows.of("a b c d".split()).tolist()]
    sums = quality._sums(["a b c d"])[own[0], 1:]
    vector = np.zeros(quality.SIZE, int)
    for k in (1, 2):
        vector[places[own[k], ::2]] += 1
        vector[places[own[k], 1::2]] -= 1
    assert (sums == vector).all()


def test_good_documents_stay(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, words(rng, 40) if k % 2 else " ".join(["junk!!"] * 30 + words(rng, 5).split()), f"s{k % 3}") for k in range(200)]
    spark.createDataFrame([(k, k % 2, 0) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows)
    kept = quality.keep_good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(1, 200, 2))
    for op in (toxicity.op1, quality.op6):
        assert op(spark, docs.limit(0), str(tmp_path)).collect() == []
        assert op(spark, docs, str(tmp_path)).count() == 200


def test_samples_are_the_same_in_every_run(spark, odd):
    docs = table(spark, odd * 3)
    marks = spark.createDataFrame([(i, k % 2) for k, (i, _, _) in enumerate(odd * 2)], "doc_id long, toxic int")
    found = [tr.labelled_sample(docs.repartition(n), marks.repartition(n), "toxic", F.lit(True), 20, True) for n in (1, 5)]
    assert found[0].texts == found[1].texts and found[0].marks.tolist() == found[1].marks.tolist() and len(found[0].texts) <= 40


# The queries against their SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    ours, theirs = queries.queries()[name](spark, small).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False)))
    assert plain(ours) == plain(theirs)


# Empty tables, and the pipeline


@pytest.mark.parametrize("op", [exact_dedup.op3, near_dedup.op4, fingerprints.op5, mixing.op7, suffix_dedup.op8, secrets.op9, spans.op10, bpe.op2])
def test_empty_table(spark, op):
    assert op(spark, table(spark, [])).collect() == []


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    rows = list(odd) + [(500 + k, words(rng, 40) + (" you idiot you moron." if k % 3 == 0 else "."), f"s{k % 3}") for k in range(120)]
    table(spark, rows).drop("_metadata").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(500 + k, 1, int(k % 3 == 0)) for k in range(100)] + [(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    at = 0
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        out = stage(spark, docs, folder)
        at += 1
        if name == "byte-level BPE":
            assert sorted((order(r.doc_id), r.decoded_sha256) for r in out.collect()) == sorted((order(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in before)
            break
        out.write.parquet(f"{folder}/stage{at}")
        docs = spark.read.parquet(f"{folder}/stage{at}")
        after = rows(docs)
        assert docs.columns == columns
        gone = collections.Counter(before) - collections.Counter(after)
        if name == "toxicity":
            assert all("idiot" in (t or "") for _, t, _ in gone) and sum("idiot" in (t or "") for _, t, _ in after) <= 2
        elif name == "exact dedup":
            assert {lower(t) for _, t, _ in after} == {lower(t) for _, t, _ in before} and len(after) == len({lower(t) for _, t, _ in before})
        elif name == "near dedup":
            assert len(after) == brute_components(before, count=True)
        else:
            assert max(collections.Counter(after).values()) <= 2 and set(after) <= set(before)


def test_pipeline_runs(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]


def test_pipeline_keeps_the_ids(spark, odd):
    docs = table(spark, odd)
    out = corpus_pipeline.tokenize(spark, docs, "")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = out.collect()
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in got)
    import public_tokenizers

    coder = bpe.coder(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert sorted(coder.decode(r.ids) for r in got) == sorted((t or "").encode() for _, t, _ in odd)
