"""Substring dedup by sliding sentence spans.

A sentence ends after '.', '!' or '?' before white space, or at a line break; its pieces end after ',', ';' or ':'
before white space as well. Every two consecutive sentences are a run, however short: where a longer run of
sentences repeats, so do all the pairs in it. For passages that begin or end in mid-sentence, from every piece starts
the shortest run of consecutive pieces that has LEAST_WORDS words (two pieces at least, or one very long one), and at
every piece such a run ends. Each run is hashed, with white space squeezed and A-Z lower-cased. Runs of one hash are
joined over the whole corpus; the first is the one with the smallest doc_id, then the earliest place. Pieces that any
other run covers are removed, with the white space after them; spans are judged on the input, not on what is left.

Runs of one hash (128 bits) within a block of rows are combined before the shuffle: all but the block's first are
known not to be the corpus's first, so a run that a third of all documents share is met once a block, as an entry
of 30 bytes. Runs are dealt by hash and travel as packed arrays, thousands to a row; a part holds those of about
BYTES_A_PART of text.

Defined cases: a null text is empty and stays so; a null doc_id is smaller than any other; repeated rows
count as copies of each other, by file place; texts of one sentence with fewer words than a run are never changed;
a very long text is cut into runs like any other; sentences without words belong to no pair; an empty table gives an
empty result; other columns are carried along whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.packing import BYTES_A_PART, PACKED, RANGES, RUNS, batches_of, by_bucket, gathered, placed_texts, range_rows, same_as_before

#: A run of pieces has two pieces and so many words, or so many words in one piece.
LEAST_WORDS, ALONE_WORDS = 20, 40
#: Runs that are combined at a time.
BLOCK_RUNS = 400_000
_BREAK = re.compile(r"(?<=[.!?])[^\S\n]+|\s*\n\s*")
_CLAUSE = re.compile(r"(?<=[,;:])\s+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences; the white space after one belongs to it, so they cover the text."""
    cuts = [m.end() for m in _BREAK.finditer(text)]
    edges = [0, *(c for c in cuts if c < len(text)), len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def pieces(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the sentence) of the pieces; they cover the text as the sentences do."""
    out = []
    for k, (a, b) in enumerate(sentences(text)):
        edges = [a, *(m.end() for m in _CLAUSE.finditer(text, a, b) if m.end() < b), b]
        out += [(x, y, k) for x, y in zip(edges, edges[1:], strict=False)]
    return out


def sentence_pairs(counts: list[int], numbers: list[int]) -> list[tuple[int, int]]:
    """(first, last) of every two consecutive sentences, over pieces with these words in these sentences."""
    held: dict[int, tuple[int, int]] = {}
    for k, (n, number) in enumerate(zip(counts, numbers, strict=True)):
        if n:
            held[number] = (held.get(number, (k, k))[0], k)
    ends = list(held.values())
    return [(a, b) for (a, _), (_, b) in zip(ends, ends[1:], strict=False)]


def runs(counts: list[int]) -> list[tuple[int, int]]:
    """The runs (first, last) over pieces with these numbers of words.

    A run that contains a long enough one is long enough, so both ends only move forwards (or backwards).
    """
    found, n = set(), len(counts)
    before = np.concatenate([[0], np.cumsum(counts)]).tolist() if n else [0]

    def enough(first: int, last: int) -> bool:
        total = before[last + 1] - before[first]
        return total >= ALONE_WORDS or (last > first and total >= LEAST_WORDS)

    last = 0
    for first in range(n):  # the shortest run from each piece
        last = max(last, first)
        while last < n and not enough(first, last):
            last += 1
        if last == n:
            break
        found.add((first, last))
    first = n - 1
    for last in range(n - 1, -1, -1):  # the shortest run up to each piece
        first = min(first, last)
        while first >= 0 and not enough(first, last):
            first -= 1
        if first < 0:
            break
        found.add((first, last))
    return sorted(found)


def _lower(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def text_runs(text: str) -> Iterator[tuple[bytes, int, int]]:
    """(hash, first, last) of a text's runs; first and last are numbers of pieces."""
    cut = pieces(text)
    parts = [_lower(text[a:b]) for a, b, _ in cut]
    counts = [p.count(b" ") + 1 if p else 0 for p in parts]
    before = [0, *itertools.accumulate(counts)]
    # Pairs with LEAST_WORDS words of two pieces or more are covered by the runs of pieces inside them.
    short = [(a, b) for a, b in sentence_pairs(counts, [k for _, _, k in cut]) if before[b + 1] - before[a] < LEAST_WORDS]
    for first, last in [*runs(counts), *short]:
        yield xxhash.xxh3_128_digest(b" ".join(p for p in parts[first : last + 1] if p)), first, last


def _flushed(held: list[np.ndarray], buckets: int):
    """Runs of a block, the first of each hash packed by hash, and the pieces of the others by document."""
    runs = np.concatenate(held)
    high, low, doc, first, last = runs.T
    order = np.lexsort((first, doc, low, high))
    later = np.zeros(len(runs), bool)
    later[order] = same_as_before(high[order], low[order])
    yield from batches_of(range_rows(doc[later], first[later], last[later] + 1))
    of = [c[~later] for c in (doc, first, high, low, last)]
    yield from batches_of(by_bucket([of[0], of[1], of[2], of[3], of[4].astype(np.int32)], of[2].view(np.uint64), buckets, RUNS))


def hashed_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """Runs of (doc, text) rows, and ranges of pieces that are known to go."""

    def work(batches):
        held, size = [], 0
        for b in batches:
            docs, column = b.column("doc").to_pylist(), b.column("text")
            for k in range(b.num_rows):
                text = column[k].as_py()
                found = list(text_runs(text)) if text else []
                if not found:
                    continue
                a = np.empty((len(found), 5), dtype=np.int64)
                a[:, :2] = np.frombuffer(b"".join(f[0] for f in found), np.int64).reshape(-1, 2)
                a[:, 2] = docs[k]
                a[:, 3:] = [f[1:] for f in found]
                held.append(a)
                size += len(a)
                if size >= BLOCK_RUNS:
                    yield from _flushed(held, buckets)
                    held, size = [], 0
        if held:
            yield from _flushed(held, buckets)

    return texts.mapInArrow(work, PACKED)


def repeated(texts: DataFrame, parts: int) -> DataFrame:
    """(doc, covered) of the documents of which pieces go; covered: array of (first, last)."""

    def rows(doc, first, last):
        for at in range(0, len(doc), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(first[part].astype(np.int32)), pa.array(last[part].astype(np.int32))], names=["doc", "first", "last"])

    def work(batches):
        found, others, _ = gathered(batches, RUNS, [np.int64, np.int64, np.int32])
        for _, doc, _, starts, ends, *_ in others:
            first, end = np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32)
            yield from rows(np.full(len(first), doc), first, end - 1)
        if found is not None:
            doc, first, high, low, last = found
            order = np.lexsort((first, doc, low, high))
            order = order[same_as_before(high[order], low[order])]
            yield from rows(doc[order], first[order], last[order])

    gone = hashed_runs(texts, 4 * parts).repartition(parts, "bucket").mapInArrow(work, "doc bigint, first int, last int")
    return gone.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("covered"))


def kept(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """(text without the covered pieces, sentences, those that lose any, maximal removed runs of pieces)."""
    parts = pieces(text)
    gone = np.zeros(len(parts) + 1, dtype=np.int64)
    for first, last in covered:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    starts = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(parts) else 0
    left = "".join(text[a:b] for (a, b, _), g in zip(parts, gone, strict=True) if not g)
    return left, parts[-1][2] + 1 if parts else 0, len({k for (_, _, k), g in zip(parts, gone, strict=True) if g}), starts


def remove_repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, n_spans) of every row; text: what is left."""
    texts, size = placed_texts(spark, docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_PART))
    joined = texts.join(repeated(texts.select("doc", "text"), parts), "doc", "left")

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [kept(t, [(c["first"], c["last"]) for c in cov or ()]) for t, cov in zip(part.column("text").to_pylist(), part.column("covered").to_pylist(), strict=True)]
                cols = [pa.array([o[k] for o in out], pa.string() if k == 0 else pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "text", "n_sentences", "n_removed", "n_spans"])

    return joined.select("doc_id", "text", "covered").mapInArrow(work, "doc_id bigint, text string, n_sentences bigint, n_removed bigint, n_spans bigint")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, n_spans, kept_sha256 and the text that is left."""
    found = remove_repeated(spark, docs)
    return found.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")
