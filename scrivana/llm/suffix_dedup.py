"""Suffix-array dedup of byte strings by prefix-free parsing.

A byte goes if it is in a string of LENGTH bytes that also starts earlier in the corpus (smaller doc_id, or the
same document and an earlier place).

1. Parse. A rolling hash of GRAM bytes sets triggers: in every window of LENGTH bytes the GRAM-gram of the least
   hash (the leftmost of equal ones). What a window's trigger is depends on the window alone, so equal windows
   have equal triggers. Consecutive windows of one trigger make a phrase, their joint bytes: 1 in about 35 bytes
   starts one. Phrases overlap by LENGTH - 1 bytes, so no window is lost between them, and no window of a phrase is
   cut off from what decides its order.
2. Dictionary and parse. A phrase's number is the hash of its trigger and of its content, 128 bits together. The parse
   is kept as each phrase's occurrences in corpus order, found in each task and then by trigger over the corpus; its
   first occurrence stands for the phrase in the dictionary, and the bytes of all others go.
3. Suffix array of the dictionary. Only phrases of one trigger have windows in common, so the phrases of a trigger come
   together, and where a trigger has several, the suffixes of a slice of SLICE_BYTES (with whole triggers) are sorted
   over LENGTH bytes by doubling: ranks of 8 bytes from each place, then of 16, 32, 64 and LENGTH.
4. Corpus order. Suffixes that are equal over LENGTH bytes follow each other; each stands for the place of its phrase's
   first occurrence. In corpus order all but the first of them go.
5. The removed ranges are gathered by document, and the remaining bytes joined.

A suffix's order past LENGTH bytes decides nothing, and phrases hold every window whole, so the order of what follows a
phrase in the parse, which a suffix array of the parse would give, is never asked for: its lists of occurrences do.

Phrases travel as packed arrays, thousands to a row. What one task holds is bounded by BYTES_A_PART of text, apart from
the phrases of one trigger. Triggers are counted beforehand; one with more than HOT distinct phrases, which a task can't
hold (a short line that very many documents share), has its phrases dealt by content, and its windows by
content too: by 128 bits of their hash.

Defined cases: a null text is empty; texts shorter than LENGTH bytes never change; a very long text is parsed in
pieces that overlap by a window; a null doc_id is smaller than any other; rows with the same doc_id, repeated rows
among them, are ordered by file place; an empty table gives an empty result; other columns are carried along whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import forget, staged
from scrivana.llm.packing import ASKED, BYTES, BYTES_A_PART, COUNTS, HASHES, PACKED, PHRASES, RANGES, batch, batches_of, by_bucket, gathered, merged, placed_texts, range_rows, same_as_before

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
#: Distinct phrases of a trigger up to which their bytes (150 each, about) meet in one task; bytes that are sorted at a time.
HOT, SLICE_BYTES = 20_000, 1 << 20
#: Phrases that a task combines at a time.
FLUSH = 600_000
#: Windows of a document that are parsed at a time, so that places fit in the low bits of a trigger's key.
PIECE, _LOW = 1 << 19, np.uint64((1 << 20) - 1)

_rng = np.random.default_rng(8)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_TIMES = tuple(_rng.integers(0, 1 << 64, 6, dtype=np.uint64) | np.uint64(1))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    h, n, k = _BYTE[raw], 1, 0
    while 2 * n <= GRAM:
        h, n, k = h[:-n] * _TIMES[k] + h[n:], 2 * n, k + 1
    if n < GRAM:
        h = h[: n - GRAM] * _TIMES[k] + h[GRAM - n :]
    h = (h ^ (h >> np.uint64(31))) * _TIMES[5]
    return h ^ (h >> np.uint64(29))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each `width` consecutive ones."""
    n = len(keys) - width + 1
    blocks = np.concatenate([keys, np.full(-len(keys) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger, content, start, windows) of a document's phrases, a piece at a time."""
    for at in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        piece = raw[at : at + PIECE + LENGTH - 1]
        h = gram_hashes(np.frombuffer(piece, np.uint8))
        least = window_minima((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), WINDOW)
        place = (least & _LOW).astype(np.int64)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        windows = np.diff(np.append(start, len(place)))
        trigger = place[start]
        ends = start + windows + LENGTH - 1
        content = np.fromiter((xxhash.xxh3_64_intdigest(piece[s:e], t) for s, e, t in zip(start.tolist(), ends.tolist(), (trigger - start).tolist(), strict=True)), np.uint64, len(start))
        yield h[trigger], content, start + at, windows


def parse(docs: DataFrame, buckets: int) -> DataFrame:
    """Phrases of (doc, text) rows, the first of equal ones in a flush, and ranges of the others."""

    def flush(held):
        trigger, content, start, windows, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((start, doc, content, trigger))
        trigger, content, start, windows, doc = (x[order] for x in (trigger, content, start, windows, doc))
        later = same_as_before(trigger, content)
        if later.any():
            yield from batches_of(range_rows(doc[later], start[later], (start + windows + LENGTH - 1)[later]))
        first = ~later
        # Triggers that are met again in this flush; what one has more than that elsewhere is one row a flush at most.
        starts = np.flatnonzero(~same_as_before(trigger[first]))
        times = np.diff(np.append(starts, first.sum()))
        again = times > 1
        yield batch([(0, 0, COUNTS, trigger[first][starts][again].tobytes(), times[again].astype(np.int64).tobytes())])
        yield from batches_of(by_bucket([doc[first], start[first], trigger[first], content[first], windows[first].astype(np.uint8)], trigger[first], buckets, PHRASES))

    def work(batches):
        held, size = [], 0
        for b in batches:
            docs, texts = b.column("doc").to_pylist(), b.column("text")
            for k in range(b.num_rows):
                for trigger, content, start, windows in phrases(texts[k].as_py().encode("utf-8", "surrogatepass")):
                    held.append((trigger, content, start, windows, np.full(len(start), docs[k], np.int64)))
                    size += len(start)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(work, PACKED)


def hot_triggers(spark: SparkSession, parsed: DataFrame, hot: int) -> np.ndarray:
    """The triggers with more than `hot` phrases, sorted; there is at most one for each `hot` phrases of the corpus."""

    def work(batches):
        for b in batches:
            for trigger, times in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(trigger, np.int64)), pa.array(np.frombuffer(times, np.int64))], names=["trigger", "n"])

    each = parsed.where(F.col("kind") == COUNTS).select("a", "b").mapInArrow(work, "trigger bigint, n bigint")
    found = each.groupBy("trigger").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("trigger").collect()
    return np.sort(np.array([r.trigger for r in found], dtype=np.int64).view(np.uint64))


def dealt(parsed: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """Phrases and ranges with the phrases of hot triggers in buckets by content."""
    rows = parsed.where(F.col("kind") != COUNTS)
    if not len(hot):
        return rows
    held = set((hot % np.uint64(buckets)).tolist())
    mixed = (F.col("kind") == PHRASES) & F.col("bucket").isin(sorted(held)) if len(held) <= 1000 else F.col("kind") == PHRASES
    sent = parsed.sparkSession.sparkContext.broadcast(hot)

    def work(batches):
        for b in batches:
            found, _, _ = gathered([b], PHRASES, [np.uint64, np.uint64, np.uint8])
            if found is not None:
                doc, start, trigger, content, windows = found
                key = np.where(np.isin(trigger, sent.value), content, trigger)
                yield from batches_of(by_bucket([doc, start, trigger, content, windows], key, buckets, PHRASES))

    return rows.where(~mixed).unionByName(rows.where(mixed).mapInArrow(work, PACKED))


def dictionary(parsed: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Ranges of all but the first of equal phrases; what is asked of documents, where a trigger has several phrases."""
    sent = parsed.sparkSession.sparkContext.broadcast(hot)

    def work(batches):
        found, others, _ = gathered(batches, PHRASES, [np.uint64, np.uint64, np.uint8])
        yield from batches_of(others)
        if found is None:
            return
        doc, start, trigger, content, windows = found
        order = np.lexsort((start, doc, content, trigger))
        doc, start, trigger, content, windows = (x[order] for x in (doc, start, trigger, content, windows.astype(np.int64)))
        later = same_as_before(trigger, content)
        yield from batches_of(range_rows(doc[later], start[later], (start + windows + LENGTH - 1)[later]))
        doc, start, trigger, windows = (x[~later] for x in (doc, start, trigger, windows))
        edges = np.append(np.flatnonzero(~same_as_before(trigger)), len(trigger))
        several, much = np.repeat(np.diff(edges), np.diff(edges)), np.isin(trigger, sent.value)
        ask = (several > 1) | much
        doc, start, trigger, windows, much = doc[ask], start[ask], trigger[ask], windows[ask], much[ask]
        order = np.lexsort((start, doc))
        doc, start, trigger, windows, much = (x[order] for x in (doc, start, trigger, windows, much))
        edges = np.append(np.flatnonzero(~same_as_before(doc)), len(doc))
        rows = [(0, int(doc[a]), ASKED, start[a:b].astype(np.int32).tobytes(), windows[a:b].astype(np.uint8).tobytes(), trigger[a:b].tobytes(), much[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        yield from batches_of(rows)

    return parsed.repartition(parts, "bucket").mapInArrow(work, PACKED)


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """The bytes of the phrases that were asked for, or their windows' hashes, out of (doc, text, asked) rows."""

    def flush(cold, hot):
        if cold:
            doc, start, trigger, windows = (np.concatenate([c[k] for c in cold]) for k in range(4))
            raw = [x for c in cold for x in c[4]]
            yield from batches_of(by_bucket([doc, start, trigger, windows.astype(np.uint8)], trigger, buckets, BYTES, lambda rows: b"".join([raw[r] for r in rows])), 400)
        if hot:
            doc, start, first, second = (np.concatenate([h[k] for h in hot]) for k in range(4))
            order = np.lexsort((start, doc, second, first))
            doc, start, first, second = (x[order] for x in (doc, start, first, second))
            later = same_as_before(first, second)
            yield from batches_of(range_rows(doc[later], start[later], start[later] + LENGTH))
            yield from batches_of(by_bucket([doc[~later], start[~later], first[~later], second[~later]], first[~later], buckets, HASHES))

    def work(batches):
        cold, hot, size = [], [], 0
        for b in batches:
            docs, texts, lists = b.column("doc").to_pylist(), b.column("text"), b.column("asked")
            for k in range(b.num_rows):
                raw = texts[k].as_py().encode("utf-8", "surrogatepass")
                for a in lists[k].as_py():
                    start, windows = np.frombuffer(a["a"], np.int32).astype(np.int64), np.frombuffer(a["b"], np.uint8).astype(np.int64)
                    trigger, much = np.frombuffer(a["c"], np.uint64), np.frombuffer(a["d"], bool)
                    if (~much).any():
                        s, w = start[~much], windows[~much]
                        cold.append((np.full(len(s), docs[k], np.int64), s, trigger[~much], w, [raw[x : x + y + LENGTH - 1] for x, y in zip(s.tolist(), w.tolist(), strict=True)]))
                        size += len(s)
                    if much.any():
                        s, w = start[much], windows[much]
                        places = np.repeat(s, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[p : p + LENGTH]) for p in places.tolist()]), np.uint64).reshape(-1, 2)
                        hot.append((np.full(len(places), docs[k], np.int64), places, digests[:, 0], digests[:, 1]))
                        size += len(places) // 8
                if size >= 100_000:
                    yield from flush(cold, hot)
                    cold, hot, size = [], [], 0
        yield from flush(cold, hot)

    return asked.mapInArrow(work, PACKED)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key; equal keys have equal ranks."""
    order = np.argsort(keys)
    ranks = np.empty(len(keys), np.uint32)
    ranks[order] = np.cumsum(~same_as_before(keys[order]), dtype=np.uint32)
    return ranks


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The rank of each place by its next LENGTH bytes, by doubling; right where so many bytes follow."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    keys = np.zeros(len(text), np.uint64)
    for k in range(8):
        keys <<= np.uint64(8)
        keys |= padded[k : k + len(text)]
    size = 8
    while size < LENGTH:
        rank, apart = _ranks(keys), min(size, LENGTH - size)
        # Pairs of ranks; where too few bytes follow, the second one is 0.
        keys[:] = rank
        keys <<= np.uint64(32)
        keys[: max(0, len(keys) - apart)] |= rank[apart:]
        size += apart
    return _ranks(keys)


def sorted_suffixes(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the suffixes at these places sorted over LENGTH bytes; whether one equals the one before it."""
    rank = suffix_ranks(text)[places]
    order = np.argsort(rank, kind="stable")
    return order, same_as_before(rank[order])


def slices(doc: np.ndarray, start: np.ndarray, trigger: np.ndarray, windows: np.ndarray, raw: np.ndarray):
    """(doc, start, windows, bytes) of phrases by trigger, about SLICE_BYTES at a time."""
    lengths = windows.astype(np.int64) + LENGTH - 1
    at = np.cumsum(lengths) - lengths
    order = np.argsort(trigger, kind="stable")
    firsts = np.flatnonzero(~same_as_before(trigger[order]))
    upto = np.cumsum(lengths[order])
    begin = 0
    while begin < len(order):
        # As many triggers as fit, one at least.
        done = upto[begin - 1] if begin else 0
        end = np.searchsorted(upto, done + SLICE_BYTES, "right")
        after = firsts[np.searchsorted(firsts, max(end, begin + 1), "right") - 1] if end < len(order) else len(order)
        if after <= begin:
            following = np.searchsorted(firsts, begin, "right")
            after = firsts[following] if following < len(firsts) else len(order)
        rows = order[begin:after]
        n = lengths[rows]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield doc[rows], start[rows], n - LENGTH + 1, raw[np.repeat(at[rows], n) + inside]
        begin = after


def repeated_suffixes(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of some phrases that equal one that is earlier in the corpus."""
    at = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    order, same = sorted_suffixes(raw, np.repeat(at, windows) + inside)
    # Only suffixes that equal a neighbour can go; each stands for a place of the corpus.
    twin = same | np.append(same[1:], False)
    group, order = np.cumsum(~same)[twin], order[twin]
    doc, start = np.repeat(doc, windows)[order], (np.repeat(start, windows) + inside)[order]
    order = np.lexsort((start, doc, group))
    later = same_as_before(group[order])
    return doc[order][later], start[order][later]


def suffixes(given: DataFrame, parts: int) -> DataFrame:
    """Ranges of the windows that also start earlier."""

    def work(batches):
        batches = list(batches)
        found, others, blobs = gathered(batches, BYTES, [np.uint64, np.uint8])
        held = pa.Table.from_batches([batch([r for r in others if r[2] == HASHES])]).to_batches()
        yield from batches_of([r for r in others if r[2] == RANGES])
        if found is not None:
            gone = [repeated_suffixes(*part) for part in slices(*found, np.frombuffer(b"".join(blobs), np.uint8))]
            doc, start = (np.concatenate([g[k] for g in gone]) for k in (0, 1))
            yield from batches_of(range_rows(doc, start, start + LENGTH))
        found, _, _ = gathered(held, HASHES, [np.uint64, np.uint64])
        if found is not None:
            doc, start, first, second = found
            order = np.lexsort((start, doc, second, first))
            later = same_as_before(first[order], second[order])
            doc, start = doc[order][later], start[order][later]
            yield from batches_of(range_rows(doc, start, start + LENGTH))

    return given.repartition(parts, "bucket").mapInArrow(work, PACKED)


def remove_repeats(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, raw, n_bytes, n_removed, n_spans) of every row; raw: the remaining bytes."""
    texts, size = placed_texts(spark, docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_A_PART))
    slim = texts.select("doc", "text")
    parsed = staged(spark, parse(slim.where(F.octet_length("text") >= LENGTH), 4 * parts), "parse")
    much = hot_triggers(spark, parsed, hot)
    found = staged(spark, dictionary(dealt(parsed, much, 4 * parts), parts, much), "phrases")
    forget(spark, parsed)
    asked = found.where(F.col("kind") == ASKED).groupBy("doc").agg(F.collect_list(F.struct("a", "b", "c", "d")).alias("asked"))
    more = suffixes(answers(texts.join(asked, "doc").select("doc", "text", "asked"), 4 * parts), parts)
    gone = found.where(F.col("kind") == RANGES).select("doc", "a", "b").unionByName(more.where(F.col("kind") == RANGES).select("doc", "a", "b"))
    ranges = gone.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = texts.join(ranges, "doc", "left").select("doc_id", "text", "ranges")

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rest, total, removed, spans = [], [], [], []
                for k in range(part.num_rows):
                    raw, lists = part.column("text")[k].as_py().encode("utf-8", "surrogatepass"), part.column("ranges")[k].as_py()
                    total.append(len(raw))
                    if not lists:
                        rest.append(raw)
                        removed.append(0)
                        spans.append(0)
                        continue
                    s, e = merged(*(np.concatenate([np.frombuffer(x[c], np.int32) for x in lists]).astype(np.int64) for c in "ab"))
                    keep, last = [], 0
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        keep.append(raw[last:x])
                        last = y
                    rest.append(b"".join([*keep, raw[last:]]))
                    removed.append(int((e - s).sum()))
                    spans.append(len(s))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rest, pa.binary()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in rest])], names=["doc_id", "raw", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(work, "doc_id bigint, raw binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
