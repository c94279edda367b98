"""Verifying quotes: blockquotes out of Markdown, their fragments, and whether those occur in a source.

Containment of many fragments in many texts isn't tried pair by pair: a fragment is looked for only in texts that
have one of its word runs (the rarest one), which is an equi-join; `contains` then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import checkable, compatible, fragments, quote_core, quote_key, replaced

#: Words in a run that fragments and texts are joined on.
RUN = 4


def blockquotes(text: Column) -> Column:
    """The blockquotes of a Markdown text: neighbouring '>' lines joined by spaces."""
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"))
    close = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.trim(F.array_join(a["now"], " "))))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        bare = replaced(line, (r"(?U)\A\s+", ""))
        inside = F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(replaced(bare, (r"(?U)\A>\s*", "")))).alias("now"))
        return F.when(bare.startswith(">"), inside).otherwise(F.struct(close(a).alias("done"), F.array().cast("array<string>").alias("now")))

    return F.filter(F.aggregate(F.split(text, r"\r?\n"), begin, step, close), lambda q: q != "")


def islands(df: DataFrame, partition: str, order: str, value: Column) -> DataFrame:
    """df with island: counts up, within a partition, wherever value changes from one row to the next."""
    w = Window.partitionBy(partition).orderBy(order)
    start = (~value.eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    return df.withColumn("_start", start).withColumn("island", F.sum("_start").over(w).cast("long")).drop("_start")


def quote_fragments(quotes: DataFrame, *keys: str, text: str = "text", full: bool = False) -> DataFrame:
    """(keys, frag_pos, frag, long_enough) of quotes; frag_pos counts from 0. full: after compatibility composition."""
    parts = fragments(quote_core(compatible(F.col(text)) if full else F.col(text)))
    found = quotes.select(*keys, F.posexplode(parts).alias("frag_pos", "frag"))
    return found.withColumn("long_enough", F.size(checkable(F.array("frag"))) > 0)


def _runs(text: Column, size: int) -> Column:
    words = F.split(text, " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
    return F.transform(F.array(words), lambda w: F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(size)))))[0]


def _inner(text: Column) -> Column:
    """A fragment without its first and last word, which a text may go on at."""
    words = F.split(text, " ")
    return F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")


def containment(fragments_: DataFrame, texts: DataFrame, frag_key: list[str], text_key: list[str], key=quote_key, run: int = RUN) -> DataFrame:
    """(frag_key, text_key) of the pairs in which the fragment occurs in the text.

    Fragments with fewer inner words than a run have no equi-key; they are compared with each text in a nested
    loop, as they must be: such fragments are short and few.
    """
    keyed = texts.select(*text_key, key(F.col("text")).alias("hay"))
    short = F.size(F.split(_inner(F.col("frag")), " ")) < run
    long_, few = fragments_.where(~short), fragments_.where(short)
    # The rarest run of each fragment, by how many texts have it.
    have = keyed.select(*text_key, F.explode(F.array_distinct(_runs(F.col("hay"), run))).alias("run"))
    asked = long_.select(*frag_key, "frag", F.explode(F.array_distinct(_runs(_inner(F.col("frag")), run))).alias("run"))
    wanted = have.join(asked.select("run").distinct(), "run", "left_semi")
    counts = wanted.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "run").groupBy(*frag_key, "frag").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    candidates = wanted.join(rarest, "run").select(*text_key, *frag_key, "frag").distinct()
    found = candidates.join(keyed, text_key).where(F.contains("hay", F.col("frag"))).select(*frag_key, *text_key)
    looped = few.join(keyed, F.contains(F.col("hay"), F.col("frag"))).select(*frag_key, *text_key)
    return found.unionByName(looped)


def verdicts(fragments_: DataFrame, found: DataFrame, quote: list[str]) -> DataFrame:
    """(quote, verdict, checked, missing, first_missing): PASS, FAIL, or SKIP where no fragment is long enough.

    found: (quote, frag_pos) of the fragments that some source has.
    """
    seen = found.select(*quote, "frag_pos").distinct().withColumn("there", F.lit(True))
    each = fragments_.join(seen, [*quote, "frag_pos"], "left").withColumn("gone", F.col("long_enough") & F.col("there").isNull())
    gone = F.count_if(F.col("gone"))
    rolled = each.groupBy(*quote).agg(
        F.count_if("long_enough").alias("checked"), gone.alias("missing"),
        F.min_by(F.when(F.col("gone"), F.col("frag")), F.when(F.col("gone"), F.col("frag_pos"))).alias("first_missing"),
    )
    return rolled.withColumn("verdict", F.when(F.col("checked") == 0, "SKIP").when(F.col("missing") > 0, "FAIL").otherwise("PASS"))
