"""Cutting texts into ordered, size-bounded chunks.

Each text is a fold over its own pieces, kept inside the row as higher-order functions, so nothing is shuffled:
a document's chunks depend on that document alone. Ordered arrays carry their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import replaced, slug, split_words, trimmed, word_count

# Target words of a chunk, how far above it a segment stays whole, shortest preamble that is kept.
TARGET_WORDS, SLACK, PREAMBLE_WORDS, HEADING_CHARS, LEAST_HEADINGS, LEAST_MARKERS = 8000, 1.6, 200, 90, 3, 2
MARKER = r"(?m)^## CHAPTER:\s*(.+?)\s*$"
HEADING = (
    r"(?iu)^\s*(?:(?:chapter|chapitre|kapitel|capitulo|cap[ií]tulo)\s+[0-9ivxlcdm]+"
    r"|part\s+[0-9ivxlcdm]+|[0-9]{1,3})\s*[.:)]?\s*(.{0,80})$"
)
_PIECE = "array<struct<title:string,body:string>>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _piece(title: Column, body: Column) -> Column:
    return F.struct(title.cast("string").alias("title"), body.alias("body"))


def without_banner(text: Column) -> Column:
    """Text after the first rule of '=' with a blank line, if there is one."""
    return F.regexp_replace(text, r"\A(?s).*?\n={20,}\n\n", "")


def paragraphs(text: Column, most: int) -> Column:
    """The blank-line separated paragraphs; one with more than `most` words is cut every `most` words."""
    def cut(p: Column) -> Column:
        words = split_words(p)
        runs = F.transform(F.sequence(F.lit(0), ((F.size(words) - 1) / most).cast("int")), lambda k: F.array_join(F.slice(words, k * most + 1, F.lit(most)), " "))
        return F.when(F.size(words) > most, runs).otherwise(F.array(p))

    return F.flatten(F.transform(F.split(text, r"(?U)\n\s*\n"), cut))


def packed(pieces: Column, most: int) -> Column:
    """Pieces joined by blank lines, greedily: a new group starts where `most` words would be passed."""
    counted = F.transform(pieces, lambda p: F.struct(p.alias("p"), word_count(p).alias("w")))
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).cast("long").alias("words"))

    def step(a: Column, e: Column) -> Column:
        full = (a["words"] + e["w"] > most) & (F.size(a["now"]) > 0)
        closed = F.struct(F.concat(a["done"], F.array(F.array_join(a["now"], "\n\n"))).alias("done"), F.array(e["p"]).alias("now"), e["w"].alias("words"))
        return F.when(full, closed).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(e["p"])).alias("now"), (a["words"] + e["w"]).alias("words")))

    return F.aggregate(counted, begin, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], "\n\n")))).otherwise(a["done"]))


def windows(title: Column, text: Column, most: int) -> Column:
    """array<struct<title, body>>: text packed to `most` words; parts are numbered where there are several."""
    def named(groups: Column) -> Column:
        name = F.coalesce(F.nullif(title, F.lit("")), F.lit("Section"))
        many = F.transform(groups, lambda t, i: _piece(F.format_string("%s (part %d/%d)", name, i + 1, F.size(groups)), t))
        return F.when(F.size(groups) == 1, F.array(_piece(title, groups[0]))).otherwise(many)

    return _let(packed(paragraphs(text, most), most), named)


def consolidated(segments: Column, target: int) -> Column:
    """Small neighbours merged up to `target` words; each keeps its title as a '## ' line at its top.

    A group closes before a segment that would pass the target if it is at least half full, and once it is full.
    """
    group = F.struct(F.array().cast("array<string>").alias("titles"), F.array().cast("array<string>").alias("bodies"), F.lit(0).cast("long").alias("words"))

    def closed(done: Column, g: Column) -> Column:
        head = F.coalesce(F.nullif(g["titles"][0], F.lit("")), F.lit("Section"))
        name = F.when(F.size(g["titles"]) > 1, F.format_string("%s (+%d sections)", head, F.size(g["titles"]) - 1)).otherwise(head)
        return F.when(F.size(g["bodies"]) > 0, F.concat(done, F.array(_piece(name, F.array_join(g["bodies"], "\n\n"))))).otherwise(done)

    def step(a: Column, s: Column) -> Column:
        words, g = word_count(s["body"]), a["g"]
        before = (g["words"] > 0) & (g["words"] + words > target) & (g["words"] >= target * 0.5)
        open_ = F.when(before, group).otherwise(g)
        done = F.when(before, closed(a["done"], g)).otherwise(a["done"])
        titled = F.coalesce(s["title"], F.lit("")) != ""
        body = F.when(titled, F.concat(F.lit("## "), s["title"], F.lit("\n\n"), s["body"])).otherwise(s["body"])

        def grown(x: Column) -> Column:
            more = F.struct(F.concat(x["titles"], F.array(F.coalesce(s["title"], F.lit("")))).alias("titles"), F.concat(x["bodies"], F.array(body)).alias("bodies"), (x["words"] + words).alias("words"))
            return _let(more, lambda m: F.struct(F.when(m["words"] >= target, closed(done, m)).otherwise(done).alias("done"), F.when(m["words"] >= target, group).otherwise(m).alias("g")))

        return _let(open_, grown)

    full = F.filter(F.transform(segments, lambda s: _piece(s["title"], trimmed(s["body"]))), lambda s: s["body"] != "")
    return F.aggregate(full, F.struct(F.array().cast(_PIECE).alias("done"), group.alias("g")), step, lambda a: closed(a["done"], a["g"]))


def _with_preamble(preamble: Column, segments: Column) -> Column:
    """A long text before the first segment becomes one of its own; a short one is dropped."""
    return F.when(word_count(preamble) > PREAMBLE_WORDS, F.concat(F.array(_piece(F.lit("Front matter"), preamble)), segments)).otherwise(segments)


def marked_segments(text: Column) -> Column:
    """Segments between '## CHAPTER: title' lines."""
    parts = F.split(text, r"(?m)(?=^## CHAPTER:\s*\S)")
    is_marked = lambda p: p.rlike(r"\A## CHAPTER:\s*\S")
    title = lambda p: F.regexp_extract(p, r"\A## CHAPTER:\s*(.+?)[^\S\n]*(?:\n|\z)", 1)
    segments = F.transform(F.filter(parts, is_marked), lambda p: _piece(trimmed(title(p)), trimmed(replaced(p, (r"\A## CHAPTER:\s*.+", "")))))
    return _with_preamble(trimmed(F.array_join(F.filter(parts, lambda p: ~is_marked(p)), "")), segments)


def headed_segments(text: Column) -> Column:
    """Segments below lines that look like chapter headings."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), (x.rlike(HEADING) & (F.length(trimmed(x)) < HEADING_CHARS)).alias("head")))
    begin = F.struct(F.array().cast("array<string>").alias("pre"), F.array().cast("array<struct<title:string,lines:array<string>>>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        new = F.struct(a["pre"].alias("pre"), F.concat(a["found"], F.array(F.struct(trimmed(x["line"]).alias("title"), F.array().cast("array<string>").alias("lines")))).alias("found"))
        last = F.element_at(a["found"], -1)
        more = F.concat(F.slice(a["found"], F.lit(1), F.size(a["found"]) - 1), F.array(F.struct(last["title"].alias("title"), F.concat(last["lines"], F.array(x["line"])).alias("lines"))))
        return F.when(x["head"], new).when(F.size(a["found"]) == 0, F.struct(F.concat(a["pre"], F.array(x["line"])).alias("pre"), a["found"].alias("found"))).otherwise(F.struct(a["pre"].alias("pre"), more.alias("found")))

    def made(a: Column) -> Column:
        return _with_preamble(trimmed(F.array_join(a["pre"], "\n")), F.transform(a["found"], lambda s: _piece(s["title"], trimmed(F.array_join(s["lines"], "\n")))))

    return F.aggregate(lines, begin, step, made)


def segments(text: Column, target: int) -> Column:
    """By markers, else by headings, else the whole text as one untitled segment."""
    headings = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(HEADING) & (F.length(trimmed(x)) < HEADING_CHARS)))
    whole = F.array(_piece(F.lit(None), text))
    by_marker = F.regexp_count(text, F.lit(r"(?m)^## CHAPTER:\s*\S")) >= LEAST_MARKERS
    return F.when(by_marker, consolidated(marked_segments(text), target)).when(headings >= LEAST_HEADINGS, consolidated(headed_segments(text), target)).otherwise(whole)


def chunks(text: Column, target: int = TARGET_WORDS) -> Column:
    """array<struct<title, body>>: the chunks of a text, in order."""
    most = int(target * SLACK)
    each = lambda s: F.when(word_count(s["body"]) > most, windows(s["title"], s["body"], target)).otherwise(F.array(_piece(s["title"], s["body"])))
    full = F.filter(segments(without_banner(text), target), lambda s: trimmed(s["body"]) != "")
    return F.flatten(F.transform(full, each))


def numbered(df: DataFrame, found: Column, *keys: str) -> DataFrame:
    """(keys, n, file, title, body, words): a row for each chunk; n counts from 1, the file's prefix from 0."""
    rows = df.select(*keys, F.posexplode(found).alias("pos", "chunk"))
    title = F.col("chunk.title")
    return rows.select(
        *keys, (F.col("pos") + 1).cast("long").alias("n"),
        F.format_string("%03d-%s.txt", F.col("pos"), slug(F.coalesce(title, F.lit("section")))).alias("file"),
        title.alias("title"), F.col("chunk.body").alias("body"), word_count(F.col("chunk.body")).alias("words"),
    )


def chosen(index: DataFrame, spec: str, n: str = "n") -> DataFrame:
    """The rows whose number is in a list of numbers and ranges such as '1-3,7'. The numbers stay as they were."""
    keep = F.lit(False)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        keep = keep | F.col(n).between(int(low), int(high or low))
    return index.where(keep)
