"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver and sent to the executors, so they need no path of their own.
Long texts are cut at safe boundaries before the library sees them: between a character that is no white
space and a white-space character. No match of the pattern crosses such a place and none looks ahead over
it, so the pieces' ids joined are the ids of the whole text. One match that is itself very long (a run of
letters without any break) is merged with a heap, in n log n steps, by the same rule: the pair of the
lowest rank first, the leftmost of equal ones.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids decode to null; every byte
is in the rank file, so each text can be encoded, and decoding gives back its exact UTF-8 bytes; a very long text
is encoded piece by piece; a null doc_id stays null; repeated rows are encoded each; an empty table gives an empty
result; extra columns are kept by encode and decode, and a column that has the name of the result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scrivana.llm.common import lean

#: Texts above this many characters are cut into pieces of about this size.
PIECE_CHARS = 20_000
#: Matches above this many bytes are merged with a heap.
LONG_MATCH_BYTES = 2_000

_CUT = re.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def coder(rank_file: bytes, pattern: str) -> Coder:
    return Coder(rank_file, pattern)


class Coder:
    """Encode texts and decode ids by one rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.run = re.compile(rf"[^\W\d_]{{{LONG_MATCH_BYTES // 4},}}|[^\s]{{{LONG_MATCH_BYTES},}}|\s{{{LONG_MATCH_BYTES},}}")

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS and (len(text) < LONG_MATCH_BYTES // 4 or not self.run.search(text)):
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text):
            if self.run.search(piece):
                for match in self.pattern.finditer(piece):
                    part = match.group()
                    ids += self.library.encode_ordinary(part) if len(part) < LONG_MATCH_BYTES // 4 else self.merged(part.encode())
            else:
                ids += self.library.encode_ordinary(piece)
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """The ids of one match."""
        ranks, n = self.ranks, len(raw)
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and (j := ends[i]) < n and (r := ranks.get(raw[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[j]))

        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := ends[i]) >= n or ends[j] != end:
                continue  # one side has been merged meanwhile
            ends[i], alive[j] = end, False
            if end < n:
                before[end] = i
            offer(i)
            offer(before[i])
        return [ranks[raw[i : ends[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def pieces(text: str) -> Iterator[str]:
    """text cut at safe boundaries, in pieces of PIECE_CHARS and up to the next boundary."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE_CHARS) if at + PIECE_CHARS < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


#: Rows and characters that are in Python at a time.
SLICE_ROWS, SLICE_CHARS = 256, 4_000_000


def _slices(batches, column: str):
    """Small record batches, so that a batch of very long texts is not in memory twice."""
    for batch in batches:
        at, size = 0, max(1, min(SLICE_ROWS, int(batch.num_rows * SLICE_CHARS / max(1, batch.column(column).nbytes))))
        while at < batch.num_rows:
            yield batch.slice(at, size)
            at += size


def encode(spark: SparkSession, df: DataFrame, rank_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df and, instead of a column of that name, ids: array<int> of the text column."""
    ranks = spark.sparkContext.broadcast(open(rank_path, "rb").read())
    names = [c for c in df.columns if c != ids]

    def run(batches):
        c = coder(ranks.value, pattern)
        for b in _slices(batches, text):
            found = pa.array([c.encode(x) if x else [] for x in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], found], names=[*names, ids])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids], f"`{ids}` array<int>"])
    return df.mapInArrow(run, schema)


def decode(spark: SparkSession, df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """df and, instead of a column of that name, raw: the bytes of the ids."""
    ranks = spark.sparkContext.broadcast(open(rank_path, "rb").read())
    names = [c for c in df.columns if c != raw]

    def run(batches):
        c = coder(ranks.value, pattern)
        for b in _slices(batches, ids):
            found = pa.array([None if x is None else c.decode(x) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], found], names=[*names, raw])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != raw], f"`{raw}` binary"])
    return df.mapInArrow(run, schema)


def round_trip(spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """For each document the number of ids, the digest of the ids and that of the bytes they decode to.

    One pass over the text; the ids leave the Python worker only with keep_ids, as a last column.
    """
    ranks = spark.sparkContext.broadcast(open(rank_path, "rb").read())

    def run(batches):
        c = coder(ranks.value, pattern)
        for b in _slices(batches, "text"):
            counts, of_ids, of_raw, kept = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = c.encode(text) if text else []
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_raw.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(pa.array(ids, pa.int32()))
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_raw)}
            if keep_ids:
                ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
                cols["ids"] = pa.ListArray.from_arrays(ends, pa.concat_arrays(kept))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return slim.mapInArrow(lean(run), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op2(spark: SparkSession, docs: DataFrame, rank_path: str | None = None) -> DataFrame:
    """The contract's columns; by default with the multilingual rank file of the installed vocabularies."""
    import public_tokenizers

    return round_trip(spark, docs, rank_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encoding_stage(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op2's columns and the ids themselves."""
    import public_tokenizers

    return round_trip(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)
