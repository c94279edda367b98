"""MinHash near-dedup with odd sketches.

1. Sets: each text's distinct five-word shingles as 64-bit hashes; SAMPLES MinHash samples, in bands of ROWS;
   and two odd sketches. In the first every sample flips one bit of SKETCH_BITS, so the population count of the
   XOR of two sketches tells how many samples differ, most precisely at high similarity. In the second the
   whole set is the sample: every shingle flips one bit of SET_BITS, which tells the size of the symmetric
   difference without any error of sampling, until large differences fill the bitmap.
2. Equal sets become one class, combined map-side, so groups of copies weigh nothing from here on.
3. Classes that agree on a band share a bucket. Each bucket links its members to one of them (the hub), so
   a bucket of any size gives one row per member. The hub is the member with the most company over all of its
   buckets: the text that copies stray from in all directions. Links whose sketches are too far apart are
   dropped; the others are confirmed on the full sets, and components are found.
4. The rest: within a bucket, two members other than the hub may be linked though not through the hub. Only pairs in
   different components matter, so members outside of the bucket's largest component are held against all members:
   a few strays beside a large component cost a row for each member, not one for each pair. Both sides are cut into
   chunks of about CHUNK members, and each pair of chunks (a cell) is compared in memory, first by sketches alone. No
   pair becomes a row: a cell gives the members that have a partner, at most one row for each. Those get their full
   sets, are cut into chunks by bytes as well, and their cells try every pair that passes the sketches, the closest
   first, on the full sets. A link joins two components within the cell, and pairs inside of one aren't tried any
   more, so a cell gives fewer links than it has members, and no link between different components is lost.

Buckets may hold any share of the rows: joins on the bucket deal a heavy one over salts. Joins on a set's hash, where a
hub has very many rows, are left to the adaptive skew join.

Pairs are linked from a threshold on: THRESHOLD percent, and OP4_THRESHOLD for op4, whose contract says so. 25 bands
of 5 miss a pair with probability 5e-5 at a similarity of 0.8, and 4e-7 at 0.85. The first sketch passes a pair at an
estimate of MARGIN below the threshold, which is 5.8 standard deviations at 0.8 and 6.5 at 0.85; the second up to
SIGMAS standard deviations above the count that is expected of the largest difference that the threshold allows.

Defined cases: null and blank texts have an empty set, linked with nothing, and are their own component; with
fewer words than a shingle the words as one are the set; a very long text is a large set, sampled in pieces; a null
doc_id never is a component's smallest unless it has no other; repeated rows are equal sets; an empty table gives an empty result; other columns are carried
along whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import LOC, for_salts, forget, heavy, lean, packed, salted, staged
from scrivana.llm.graph import components

SHINGLE = 5
#: Percent of the union that two linked sets have in common.
THRESHOLD, OP4_THRESHOLD = 80, 85
BANDS, ROWS, SKETCH_BITS, SET_BITS, SIGMAS = 25, 5, 512, 1024, 6
SAMPLES = BANDS * ROWS
#: Sketches whose estimate is further than this below the threshold aren't confirmed.
MARGIN = 0.25
CHUNK = 1024
#: Bytes of full sets in a chunk.
SET_BYTES = 1 << 20
#: Partners that are tried before those that have been joined meanwhile are left out, and how many times more each next time.
CLOSEST, MORE = 16, 8
#: Locators with their set's hash are broadcast up to this many rows of 32 bytes; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20)
_FLIP = _rng.integers(0, 1 << 64, SAMPLES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = _rng.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    for times in _MIX:
        h = (h ^ (h >> np.uint64(33))) * times
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes of a text: A-Z lower-cased words, SHINGLE at a time."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += mixed(h[k : k + n] * _STEP[k])
    return np.unique(mixed(total))


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(out, ((found[at : at + 512, None] ^ _FLIP) * _TIMES).min(0), out=out)
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    rows, key = mins.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ rows[:, k]) + np.uint64(k)
    return key.view(np.int64)


def odd_sketch(mins: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, as 64-bit words; each sample flips one."""
    bits = mixed(mins + np.arange(SAMPLES, dtype=np.uint64) * _MIX[0]) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_bits(threshold: int = THRESHOLD) -> int:
    """The largest passed population count: the one that is expected at MARGIN below the threshold."""
    similarity = threshold / 100 - MARGIN
    differ = 2 * SAMPLES * (1 - similarity)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differ))


def estimate(bits: int) -> float:
    """The similarity that a population count stands for."""
    share = min(2 * bits / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(1 - share))


def set_sketch(found: np.ndarray) -> np.ndarray:
    """SET_BITS bits, as 64-bit words; each shingle flips one."""
    odd = np.bincount((found % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_set_bits(total, threshold: int = THRESHOLD):
    """The largest passed population count for two sets with `total` shingles together; of numbers or a Column."""
    n, differ = float(SET_BITS), total * ((100.0 - threshold) / (100.0 + threshold))
    two, four = (differ * float(np.log1p(-2 / n))), (differ * float(np.log1p(-4 / n)))
    exp = F.exp if isinstance(total, Column) else np.exp
    spread = (n / 4 * (1 + (n - 1) * exp(four) - n * exp(2 * two)) + 1e-6) ** 0.5
    return n / 2 * (1 - exp(two)) + SIGMAS * spread + 2


def signatures(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, signatures): loc, doc_id, n_shingles, node (hash of the set), bands, sketch, bitmap; written once."""
    rows = packed(spark, docs)

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                n, node, keys, sketches, bitmaps = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingles(text) if text else np.zeros(0, np.uint64)
                    n.append(len(found))
                    mins = samples(found) if len(found) else None
                    node.append(None if mins is None else xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(None if mins is None else bands(mins))
                    sketches.append(None if mins is None else odd_sketch(mins))
                    bitmaps.append(None if mins is None else set_sketch(found))
                yield pa.RecordBatch.from_arrays([part.column("loc"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(bitmaps, pa.list_(pa.int64()))], names=["loc", "doc_id", "n_shingles", "node", "bands", "sketch", "bitmap"])

    slim = rows.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    return rows, staged(spark, slim.mapInArrow(lean(work), f"loc {LOC}, doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>, bitmap array<bigint>"), "signatures")


def differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sets_of(spark: SparkSession, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found) for (node, loc): the full set of each, as bytes; written once."""
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    chosen = rows.select("loc", F.col("row.text").alias("text")).join(nodes, "loc").select("node", "text")

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["node", "found"])

    return staged(spark, chosen.mapInArrow(lean(work), "node binary, found binary"), "full-sets")


def confirmed(spark: SparkSession, rows: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union, on the full sets; written once."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = staged(spark, classes.select("node", "loc").join(ends, "node", "left_semi"), "to-confirm")
    sets = sets_of(spark, rows, nodes)
    left, right = sets.select(F.col("node").alias("b"), F.col("found").alias("of_b")), sets.select(F.col("node").alias("a"), F.col("found").alias("of_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "of_a", "of_b")

    def work(batches):
        last, of_last = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, keep = batch.slice(at, 256), []
                for a, x, y in zip(part.column("a").to_pylist(), part.column("of_a"), part.column("of_b"), strict=True):
                    if a != last:
                        last, of_last = a, np.frombuffer(x.as_py(), np.uint64)
                    other = np.frombuffer(y.as_py(), np.uint64)
                    common = common_of(of_last, other)
                    keep.append(100 * common >= threshold * (len(of_last) + len(other) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep))

    links = staged(spark, both.mapInArrow(lean(work), "a binary, b binary"), "links")
    forget(spark, nodes, sets)
    return links


def common_of(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def hub_pairs(buckets: DataFrame, classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Each member with its bucket's hub, where the sketches pass."""
    pairs = buckets.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    of = lambda end: classes.select(F.col("node").alias(end), F.struct("sketch", "bitmap", "n").alias(f"of_{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    near = differing(F.col("of_a.sketch"), F.col("of_b.sketch")) <= most_bits(threshold)
    nearer = differing(F.col("of_a.bitmap"), F.col("of_b.bitmap")) <= most_set_bits((F.col("of_a.n") + F.col("of_b.n")).cast("double"), threshold)
    return both.where(near & nearer).select("a", "b")


def chunked(members: DataFrame, weight: Column, width: int) -> DataFrame:
    """(key, largest, chunks, few_chunks) of the buckets whose members (key, label) are in several components.

    A chunk has about `width` of the members' weight; few_chunks are those without the largest component.
    """
    of_label = members.groupBy("key", "label").agg(F.sum(weight).alias("n"))
    of_key = of_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"))
    chunks = lambda n: F.ceil(n / width).cast("int")
    return of_key.where(F.col("n") > F.col("most.n")).select("key", F.col("most.label").alias("largest"), chunks(F.col("n")).alias("chunks"), chunks(F.col("n") - F.col("most.n")).alias("few_chunks"))


def mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, largest, chunks, few_chunks) of the buckets whose members, without the hub, are in several components."""
    members = buckets.where("node <> hub").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    return chunked(members, F.lit(1), CHUNK)


def cells(members: DataFrame, *held: str) -> DataFrame:
    """(key, i, j, members) of members (key, node, label) with chunked's columns: strays of chunk i beside members of chunk j."""
    chunk = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(of)).cast("int")
    cell = lambda i, j, few: F.struct(i.alias("i"), j.alias("j"), F.lit(few).alias("few"))
    upto = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    everywhere = F.transform(upto("few_chunks"), lambda i: cell(i, chunk(1, "chunks"), False))
    strays = F.transform(upto("chunks"), lambda j: cell(chunk(2, "few_chunks"), j, True))
    placed = members.withColumn("cell", F.explode(F.when(F.col("label") == F.col("largest"), everywhere).otherwise(F.concat(everywhere, strays))))
    return placed.groupBy("key", "cell.i", "cell.j").agg(F.collect_list(F.struct("node", "label", "cell.few", *held)).alias("members"))


def rest_pairs(buckets: DataFrame, classes: DataFrame, labels: DataFrame, hot: DataFrame, spark: SparkSession, rows: DataFrame, threshold: int = THRESHOLD, closest: int = CLOSEST, more: int = MORE) -> DataFrame:
    """Links (a, b) between members of a bucket other than the hub that join all components which a link joins; written once."""
    members = buckets.where("node <> hub").select("key", "salt", "node").join(for_salts(mixed_buckets(buckets, labels), "key", hot), ["key", "salt"])
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    members = members.join(classes.select("node", "sketch", "bitmap", F.col("n").alias("size")), "node")
    limit, held = most_bits(threshold), ["salt", "sketch", "bitmap", "size"]

    def near(batches):
        for b in batches:
            for key, k in zip(b.column("key"), range(b.num_rows), strict=True):
                cell = Cell(b.column("members")[k].values, limit, threshold)
                found = cell.given.filter(pa.array(cell.with_partner()))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(found), pa.int64()), *[found.field(c) for c in ("node", "label", *held)]], names=["key", "node", "label", *held])

    partnered = cells(members, *held).mapInArrow(lean(near), "key bigint, node binary, label binary, salt int, sketch array<bigint>, bitmap array<bigint>, size bigint")
    partnered = staged(spark, partnered.dropDuplicates(["key", "node"]), "with-partner")
    nodes = staged(spark, classes.select("node", "loc").join(partnered.select("node").distinct(), "node", "left_semi"), "to-confirm")
    sets = sets_of(spark, rows, nodes)
    sized = partnered.join(for_salts(chunked(partnered, F.col("size") * 8 + SET_BYTES // CHUNK, SET_BYTES), "key", hot), ["key", "salt"])

    def linked(batches):
        for b in batches:
            for k in range(b.num_rows):
                first, second = Cell(b.column("members")[k].values, limit, threshold).links(closest, more)
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["a", "b"])

    links = staged(spark, cells(sized.join(sets, "node"), "sketch", "bitmap", "size", "found").mapInArrow(lean(linked), "a binary, b binary"), "rest-links")
    forget(spark, partnered, nodes, sets)
    return links


class Cell:
    """Strays (few) of a bucket beside members of it, to be compared in memory."""

    def __init__(self, given: pa.StructArray, limit: int, threshold: int):
        self.given, self.limit, self.threshold = given, limit, threshold
        few = np.array(given.field("few").to_pylist(), dtype=bool)
        self.strays, self.members = np.flatnonzero(few), np.flatnonzero(~few)
        bits = lambda name: np.array(given.field(name).flatten(), dtype=np.int64).view(np.uint64).reshape(len(few), -1)
        self.sketches, self.bitmaps, self.size = bits("sketch"), bits("bitmap"), np.array(given.field("size"), dtype=np.float64)
        numbers: dict[bytes, int] = {}
        self.label = np.array([numbers.setdefault(x, len(numbers)) for x in given.field("label").to_pylist()], dtype=np.int64)

    def near(self, x: int) -> np.ndarray:
        """The members in other components than stray x whose sketches pass, the closest first."""
        near = self.members[self.label[self.members] != self.label[x]]
        near = near[np.bitwise_count(self.sketches[near] ^ self.sketches[x]).sum(1) <= self.limit]
        apart = np.bitwise_count(self.bitmaps[near] ^ self.bitmaps[x]).sum(1)
        ok = apart <= most_set_bits(self.size[x] + self.size[near], self.threshold)
        return near[ok][np.argsort(apart[ok], kind="stable")]

    def with_partner(self) -> np.ndarray:
        """Whether each one has a partner that passes the sketches."""
        out = np.zeros(len(self.label), bool)
        for x in self.strays:
            near = self.near(x)
            out[near] = True
            out[x] |= len(near) > 0
        return out

    def links(self, closest: int, more: int) -> tuple[list[bytes], list[bytes]]:
        """Links, confirmed on the full sets, that join components; each joins two that no earlier one has joined."""
        nodes, found = self.given.field("node").to_pylist(), self.given.field("found")
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in found]
        first, second = [], []
        for x in self.strays:
            near, take = self.near(x), closest
            while len(near):
                for y in near[:take]:
                    if self.label[x] == self.label[y]:
                        continue
                    common = common_of(sets[x], sets[y])
                    if 100 * common >= self.threshold * (len(sets[x]) + len(sets[y]) - common):
                        first.append(min(nodes[x], nodes[y]))
                        second.append(max(nodes[x], nodes[y]))
                        self.label[self.label == self.label[y]] = self.label[x]
                near = near[take:]
                near, take = near[self.label[near] != self.label[x]], take * more
        return first, second


def near_dedup(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, decisions, links) with links from `threshold` percent on: decisions hold loc, doc_id, n_shingles, component_id, keep_loc; links are between sets, and join the components."""
    rows, found = signatures(spark, docs)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "loc")
    classes = found.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(place.alias("place"), "bands", "sketch", "bitmap", F.col("n_shingles").alias("n"))).alias("of"))
    classes = staged(spark, classes.select("node", F.col("of.place").alias("place"), F.col("of.place.loc").alias("loc"), "of.bands", "of.sketch", "of.bitmap", "of.n"), "classes")
    # Buckets of several members; sizes and hubs come from partial aggregates, so no bucket meets in one task.
    keyed = classes.select("node", F.explode("bands").alias("key"))
    hot = heavy(spark, keyed, "key")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    several = staged(spark, salted(keyed, "key", hot, "node").join(for_salts(sizes, "key", hot), ["key", "salt"]), "several")
    company = several.groupBy("node").agg(F.sum("size").alias("company"))
    hubs = several.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    buckets = staged(spark, several.select("key", "salt", "node").join(for_salts(hubs, "key", hot), ["key", "salt"]), "buckets")
    tested = staged(spark, hub_pairs(buckets, classes, threshold), "hub-pairs")
    links = confirmed(spark, rows, classes, tested, threshold)
    labels = components(spark, links)
    rest = rest_pairs(buckets, classes, labels, hot, spark, rows, threshold, CLOSEST, MORE)
    if not rest.isEmpty():
        links = links.unionByName(rest)
        labels = components(spark, links)
    forget(spark, several, buckets, tested)
    grouped = classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "place")
    lowest = grouped.groupBy("label").agg(F.min("place").alias("first"))
    known = grouped.join(lowest, "label").select("node", "first")
    decided = found.join(known, "node", "left").select(
        "loc", "doc_id", "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce("first.loc", "loc").alias("keep_loc"),
    )
    return rows, decided, links


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    _, decided, _ = near_dedup(spark, docs, OP4_THRESHOLD)
    return decided.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each component; the columns are those of docs."""
    rows, decided, _ = near_dedup(spark, docs)
    return rows.join(decided.where("keep_loc <> loc").select("loc"), "loc", "left_anti").select("row.*")
