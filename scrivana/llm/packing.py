"""Rows of many small entries, packed: what several tasks find in their documents, dealt by a key.

An entry belongs to a document, by its number in corpus order, and starts at a place in it. Thousands of entries make
one row, so that a shuffle moves bytes that compress instead of wide rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import packed, staged

#: Text that one part stands for, about.
BYTES_A_PART = 32 << 20


# Packed columns: fixed widths, one after the other; documents as differences, by bytes of equal weight, so that
# the shuffle's compression finds their zeros.
def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(columns: list[np.ndarray]) -> list[bytes]:
    """doc (int64, ascending), start (int32), others as they are."""
    doc, start, *rest = columns
    return [planes(np.diff(doc, prepend=np.int64(0))), planes(start.astype(np.int32)), *[np.ascontiguousarray(c).tobytes() for c in rest]]


PACKED = "bucket int, doc bigint, kind int, a binary, b binary, c binary, d binary, e binary"
NAMES = ["bucket", "doc", "kind", "a", "b", "c", "d", "e"]
PHRASES, RANGES, ASKED, BYTES, HASHES, COUNTS, RUNS = range(7)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (bucket, doc, kind, *blobs)."""
    full = [(*r, *[None] * (8 - len(r))) for r in rows]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in full], kinds[k]) for k in range(8)], names=NAMES)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.append(first[1:] - 1, len(end) - 1)]


def range_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """A row with the merged ranges of each document."""
    out, order = [], np.argsort(doc, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    edges = np.append(np.flatnonzero(np.diff(doc, prepend=doc[0] - 1 if len(doc) else 0)), len(doc)) if len(doc) else []
    for a, b in zip(edges, edges[1:], strict=False):
        s, e = merged(start[a:b], end[a:b])
        out.append((-1 - int(doc[a]) % 1009, int(doc[a]), RANGES, s.astype(np.int32).tobytes(), e.astype(np.int32).tobytes()))
    return out


def same_as_before(*keys: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it in all keys."""
    same = np.ones(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    return np.concatenate([[False], same]) if len(keys[0]) else np.zeros(0, bool)


def by_bucket(columns: list[np.ndarray], key: np.ndarray, buckets: int, kind: int, extra=None) -> list[tuple]:
    """Rows of packed columns by key % buckets, in order of document and place."""
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((columns[1], columns[0], bucket))
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    rows = []
    for a, b in zip(edges, edges[1:], strict=False):
        blobs = pack([c[a:b] for c in columns])
        rows.append((int(bucket[a]), 0, kind, *blobs, *([extra(order[a:b])] if extra else [])))
    return rows


def batches_of(rows: list[tuple], size: int = 4000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), size):
        yield batch(rows[at : at + size])


def gathered(batches, kind: int, kinds: list) -> tuple[list[np.ndarray] | None, list[tuple], list[list[bytes]]]:
    """Columns of the packed rows of a kind; other rows; the packed rows' last blobs."""
    parts, others, lasts = [], [], []
    for b in batches:
        rows = b.to_pydict()
        for k in range(b.num_rows):
            row = [rows[n][k] for n in NAMES]
            if row[2] != kind:
                others.append(tuple(row))
                continue
            doc = np.cumsum(unplanes(row[3], np.int64))
            parts.append((doc, unplanes(row[4], np.int32).astype(np.int64), *[np.frombuffer(row[5 + j], t) for j, t in enumerate(kinds)]))
            lasts.append(row[7])
    return ([np.concatenate(c) for c in zip(*parts, strict=True)] if parts else None), others, lasts


def placed_texts(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """((doc, doc_id, text), bytes): doc is a 64-bit number in the order of the documents."""
    rows = packed(spark, docs).select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text").where("doc IS NOT NULL"), size
    # Repeated or missing ids: number the rows in order. Partitions of a global sort follow each other.
    order = rows.select("loc", "doc_id").orderBy(F.col("doc_id").asc_nulls_first(), "loc").select("loc", F.monotonically_increasing_id().alias("doc"))
    return rows.join(staged(spark, order, "order"), "loc").select("doc", "doc_id", "text").where("doc IS NOT NULL"), size
