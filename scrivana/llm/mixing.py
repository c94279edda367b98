"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Word counts: one pass over the text; (locator, source, size) goes to the shared folder.
2. Blocks: a document belongs to one of n_blocks blocks of its source, by a hash. A source that holds a third
   of all rows is that many blocks, none of which is large.
3. Targets: sources are numbered by code point, bucket by bucket, so that no task sorts all of them. They share
   `share` of all words by weight; a target stops at `most` times its source's size, and the excess is shared
   again. Each round is one aggregate over the sources, which leaves two numbers: what is left and its weights.
4. Draws: each source's blocks are permuted anew for each pass; blocks are drawn from the front until the
   words reach the target. The last block of a source may be drawn in part: its documents in a fixed order,
   the last of them in part too, so a source's words equal its target rounded to a word.
5. Splitting tree: the root holds each source's exact number of drawn blocks. A node that stands for several
   shards gives its left half of them an exact share of its blocks, by source drawn from the multivariate
   hypergeometric distribution (source after source, each a univariate draw given what is left). Leaves are
   shards; a shard's blocks of a source are the next ones in the permutation, so shards are disjoint. More than
   FAN_OUT sources are drawn group by group first, then within each group given the group's draws, which is the
   same distribution; so a row holds FAN_OUT numbers at most, and groups are split in parallel.
6. Within a shard documents follow a hash, which shuffles them locally.

All of it is DataFrame expressions; draws depend on hashes of seed, node and source only, so reruns agree.
Rows that are equal in doc_id, text and source are dealt over the blocks by their place in the file as well, if
there are very many of them.

Defined cases: a null text has size 0; a null doc_id is as good as any; a null source is a source of its own and
comes last; sources without words have target 0; documents without words are taken with 0 words; a very long
text is one document, taken whole, or in part where its source's target ends; repeated rows are separate
documents; an empty table gives an empty result; other columns are carried along whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.llm.common import heavy, let, packed, salted, staged, words
from scrivana.operators.ordering import numbered

#: Weights of the sources in order, repeating; share of all words; times a source's size that its target may reach.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SHARDS, SEED, DOCS_PER_BLOCK, MAX_BLOCKS = 16, 7, 256, 1 << 20
#: Sources, or groups of them, that one row of the splitting tree holds.
FAN_OUT = 1024


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) by hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` items, out of `total` with `good` good ones, are good; u in (0, 1) picks the outcome.

    The probabilities are built outwards from the mode, as ratios of neighbours, over 12 standard deviations;
    beyond those they are below what a double can add.
    """

    def body(v: Column) -> Column:
        n, k, m = v["total"].cast("double"), v["good"].cast("double"), v["drawn"].cast("double")
        low, high = F.greatest(F.lit(0.0), m - (n - k)), F.least(k, m)
        mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
        spread = F.ceil(12 * F.sqrt(m * (k / n) * (1 - k / n) * (n - m) / F.greatest(n - 1, F.lit(1.0))) + 12).cast("double")
        return let(F.struct(n.alias("n"), k.alias("k"), m.alias("m"), mode.alias("mode"), F.greatest(low, mode - spread).alias("low"), F.least(high, mode + spread).alias("high"), v["u"].alias("u")), walk)

    def walk(s: Column) -> Column:
        n, k, m = s["n"], s["k"], s["m"]
        rising = lambda x: (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))  # noqa: E731  p(x) / p(x - 1)
        falling = lambda x: (x + 1) * (n - k - m + x + 1) / ((k - x) * (m - x))  # noqa: E731  p(x) / p(x + 1)
        ups = F.when(s["high"] > s["mode"], F.sequence((s["mode"] + 1).cast("long"), s["high"].cast("long"))).otherwise(F.array().cast("array<bigint>"))
        downs = F.when(s["low"] < s["mode"], F.sequence((s["mode"] - 1).cast("long"), s["low"].cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        step = lambda ratio: lambda a, x: let(a["p"] * ratio(x.cast("double")), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum")))
        up, down = F.aggregate(ups, start, step(rising))["sum"], F.aggregate(downs, start, step(falling))["sum"]

        def pick(values: Column, ratio, least: Column) -> Column:
            # the first value whose running sum reaches `least`, else the last
            begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), s["mode"].alias("at"))
            return F.aggregate(values, begin, lambda a, x: F.when(a["sum"] >= least, a).otherwise(let(a["p"] * ratio(x.cast("double")), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), x.cast("double").alias("at")))))["at"]

        return let(
            F.struct(up.alias("up"), (s["u"] * (1.0 + up + down)).alias("goal")),
            lambda z: F.when(z["goal"] <= 1.0, s["mode"]).when(z["goal"] <= 1.0 + z["up"], pick(ups, rising, z["goal"] - 1.0)).otherwise(pick(downs, falling, z["goal"] - 1.0 - z["up"])),
        ).cast("long")

    fields = F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"), drawn.cast("long").alias("drawn"), u.alias("u"))
    return F.when((good <= 0) | (drawn <= 0), F.lit(0).cast("long")).when(drawn >= total, good.cast("long")).otherwise(let(fields, body))


def split_quotas(quotas: Column, left: Column, node: Column, seed: int) -> Column:
    """The left child's part of a quota vector: `left` blocks, multivariate hypergeometric."""
    begin = F.struct(F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("rest"), left.cast("long").alias("room"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        q = F.element_at(quotas, i)
        drawn = hypergeometric(a["rest"], q, a["room"], uniform(F.lit(seed), node, i))
        return let(drawn, lambda x: F.struct((a["rest"] - q).alias("rest"), (a["room"] - x).alias("room"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.size(quotas)), begin, step)["out"]


def splitting_tree(root: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, q) for each leaf, from rows with the array q: each source's number of blocks.

    A column `rooms` (array of each shard's number of blocks) says how many blocks each leaf gets; without it they
    are dealt evenly. A column `part` is carried along and tells the draws of several rows apart.
    """
    part = F.col("part") if "part" in root.columns else F.lit(0).cast("long")
    rooms = F.col("rooms") if "rooms" in root.columns else F.lit(None).cast("array<bigint>")
    nodes = root.select(part.alias("part"), F.lit(1).cast("long").alias("node"), F.lit(0).alias("low"), F.lit(shards).alias("high"), "q", rooms.alias("rooms"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
        even = F.round(add(F.col("q")) * (middle - F.col("low")) / (F.col("high") - F.col("low"))).cast("long")
        room = F.coalesce(add(F.slice("rooms", F.col("low") + 1, middle - F.col("low"))), even)
        whole = F.col("high") - F.col("low") <= 1
        fields = lambda node, low, high, q: F.struct(F.col("part"), node.alias("node"), low.alias("low"), high.alias("high"), q.alias("q"), F.col("rooms"))
        children = let(
            split_quotas(F.col("q"), room, F.when(F.col("part") == 0, F.col("node")).otherwise(F.xxhash64("part", "node")), seed),
            lambda x: F.array(fields(F.col("node") * 2, F.col("low"), middle, x), fields(F.col("node") * 2 + 1, middle, F.col("high"), F.zip_with("q", x, lambda a, b: a - b))),
        )
        nodes = nodes.select(F.explode(F.when(whole, F.array(fields(F.col("node"), F.col("low"), F.col("high"), F.col("q")))).otherwise(children)).alias("n")).select("n.*")
    return nodes.select(*(["part"] if "part" in root.columns else []), F.col("low").alias("shard"), "q")


def split_sources(spark: SparkSession, counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(idx, shard, q): the blocks that each shard gets of each source, out of (idx, n); idx counts from 1.

    Sources come in groups of FAN_OUT, groups in groups of FAN_OUT, and so on. From the top down every group's
    blocks are split over the shards given how many blocks of the group each shard has.
    """
    levels = [counts.select((F.col("idx") - 1).cast("long").alias("at"), "n")]
    most = counts.agg(F.max("idx")).first()[0] or 0
    while most > FAN_OUT:
        levels.append(staged(spark, levels[-1].groupBy(F.floor(F.col("at") / FAN_OUT).alias("at")).agg(F.sum("n").alias("n")), "mix-groups"))
        most = -(-most // FAN_OUT)
    found = None
    for k, level in reversed(list(enumerate(levels))):
        part = F.floor(F.col("at") / FAN_OUT).alias("above")
        # Members in order of their numbers; the number goes along, as a group may have gaps.
        rows = level.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("members"))
        rows = rows.select("above", F.transform("members", lambda m: m["n"]).alias("q"), F.transform("members", lambda m: m["at"]).alias("ats"))
        rows = rows.withColumn("part", F.lit(0).cast("long") if found is None else F.xxhash64(F.lit(k), "above"))
        if found is not None:
            rooms = found.groupBy(F.col("at").alias("above")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "q"))), lambda x: x["q"]).alias("rooms"))
            rows = rows.join(rooms, "above")
        leaves = splitting_tree(rows, shards, seed).join(rows.select("part", "ats"), "part")
        found = leaves.select("shard", F.posexplode(F.arrays_zip("ats", "q")).alias("k", "x")).select(F.col("x.ats").alias("at"), "shard", F.col("x.q").alias("q"))
        found = staged(spark, found, "mix-shards") if k else found
    return found.select((F.col("at") + 1).alias("idx"), "shard", "q")


def targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, idx, source_size, target) of the sources out of (src, source_size); idx counts from 1 in order.

    The level is the words for each unit of weight. It starts with all sources and rises with every round, as those
    that reach their cap drop out; the loop ends when none does any more.
    """
    ranked = numbered(sizes, [F.col("src").isNull(), F.coalesce("src", F.lit(""))], "idx")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("idx") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(spark, ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "mix-sources")
    pool = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    capped = lambda level: F.col("cap") <= level * F.col("weight")
    level = -1.0
    while True:
        full = F.sum(F.when(capped(F.lit(level)), F.col("cap")).otherwise(0.0))
        rest = F.sum(F.when(~capped(F.lit(level)), F.col("weight")))
        row = ranked.agg(full.alias("full"), rest.alias("rest")).first()
        if not row.rest:  # every source is at its cap
            break
        free = (pool - row.full) / row.rest
        if free <= level:
            break
        level = free
    return ranked.select("src", "idx", "source_size", F.when(capped(F.lit(level)), F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **policy) -> tuple[DataFrame, DataFrame]:
    """(rows, decisions): decisions hold loc, doc_id, size, source_size, target, taken, draws of every row.

    draws: array of (shard, pass, words, order) of the times the document is drawn; order sorts a shard's documents.
    """
    rows = packed(spark, docs)
    sizes = staged(spark, rows.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("src"), F.size(words(F.col("row.text"))).cast("long").alias("size"), F.xxhash64("row.doc_id", "row.text", "row.source").alias("own")), "mix-sizes")
    n_blocks = min(MAX_BLOCKS, max(16, math.ceil(sizes.count() / DOCS_PER_BLOCK)))
    # By content, so that reruns over the same rows in other files agree; only rows that repeat very often go by place too.
    sizes = salted(sizes, "own", heavy(spark, sizes, "own"), "loc")
    block = F.pmod(F.when(F.col("salt") == 0, F.xxhash64(F.lit(seed), "own")).otherwise(F.xxhash64(F.lit(seed), "own", "salt")), F.lit(n_blocks)).alias("block")
    sizes = sizes.select("loc", "doc_id", "src", "size", "own", block)
    blocks = staged(spark, sizes.groupBy("src", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    goal = staged(spark, targets(spark, blocks.groupBy("src").agg(F.sum("words").alias("source_size")), **policy), "mix-targets")
    same = lambda a, b: a["src"].eqNullSafe(b["src"])
    # Passes over a source's blocks, each in another order.
    passes = blocks.join(goal, same(blocks, goal)).select(goal["src"], "idx", "block", "words", F.round("target").cast("long").alias("quota"), F.explode(F.sequence(F.lit(1), F.lit(math.ceil(policy.get("most", MOST))))).alias("pass"))
    order = Window.partitionBy("idx").orderBy("pass", F.xxhash64(F.lit(seed), "idx", "pass", "block"), "block")
    drawn = passes.withColumn("pos", F.row_number().over(order) - 1).withColumn("before", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    drawn = staged(spark, drawn.where("before < quota").withColumn("part", F.least("words", F.col("quota") - F.col("before"))), "mix-draws")
    counts = goal.select("idx").join(drawn.groupBy("idx").agg(F.count(F.lit(1)).alias("n")), "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))
    leaves = split_sources(spark, counts, shards, seed)
    ahead = Window.partitionBy("idx").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaves = leaves.withColumn("end", F.sum("q").over(ahead)).where("q > 0")
    places = leaves.select("idx", "shard", F.explode(F.sequence((F.col("end") - F.col("q")).cast("int"), (F.col("end") - 1).cast("int"))).alias("pos"))
    placed = drawn.join(places, ["idx", "pos"]).groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "part", (F.col("part") == F.col("words")).alias("whole")))).alias("took"))
    # Documents of the blocks. The order within a block decides which documents a partly drawn block gives.
    running = Window.partitionBy("src", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("in block"), "own"), "own", "loc").rowsBetween(Window.unboundedPreceding, 0)
    inside = sizes.withColumn("before", F.sum("size").over(running) - F.col("size"))
    found = inside.join(placed, same(inside, placed) & (inside["block"] == placed["block"]), "left").select(inside["*"], "took")
    words_of = lambda x: F.when(x["whole"], F.col("size")).otherwise(F.greatest(F.lit(0), F.least(F.col("size"), x["part"] - F.col("before"))))
    draws = F.transform(F.coalesce("took", F.array().cast(placed.schema["took"].dataType)), lambda x: F.struct(x["shard"].alias("shard"), x["pass"].alias("pass"), words_of(x).cast("long").alias("words"), F.xxhash64(F.lit(seed), x["shard"], x["pass"], F.col("own")).alias("order")))
    found = found.withColumn("draws", F.filter(draws, lambda x: (x["words"] > 0) | (F.col("size") == 0)))
    found = found.join(goal, same(found, goal)).select("loc", "doc_id", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), "draws")
    return rows, found


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, and the shards that a document's draws went to."""
    _, found = mix(spark, docs)
    return found.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("draws", lambda x: x["shard"].cast("string")), ",").alias("shards"))


def mixing_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as the mix draws them: a row for each draw of at least half of a document; the columns are those of docs.

    A document is never cut: of the one document of a source that is drawn in part, the larger part decides.
    """
    rows, found = mix(spark, docs)
    copies = F.size(F.filter("draws", lambda x: 2 * x["words"] >= F.col("size")))
    chosen = found.select("loc", copies.alias("copies")).where("copies > 0")
    return rows.join(chosen, "loc").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
