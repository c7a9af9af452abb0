"""Distinct-word table with positional join-back.

Documents are cut into words inside the tasks that scan them. A run of
documents (a *chunk*) gets a local dictionary: each distinct word once, numbered
by falling frequency, and the documents as streams of these numbers. Only the
dictionaries travel to where words are resolved (all copies of one word meet in
one partition, whatever the number of its occurrences), and only numbers travel
back. Rows that move between Spark stages are blocks:

    chunk  part  kind  a  b  c
    ...    -1    0     word counts of documents | packed numbers (and the documents' ids in heads)
    ...    p     1     words of the chunk that hash to partition p
    ...    p     2     what the resolver returned for them

The blocks are written once, bucketed by chunk, so the numbers (the bulk of the
bytes) are never shuffled: the resolved words come to them. A word that occurs in every document is one entry per chunk, so no key is hot.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import arrow_schema, bucketed, partitions_for, slices
from hushdex.llm.vbyte import pack, unpack

BLOCK = "chunk string, part int, kind int, a binary, b binary, c binary"
_ARROW = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def joined(*parts: bytes) -> bytes:
    """Some byte strings as one; ``blobs`` takes them apart."""
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)


def blobs(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", data)[0]
    sizes, at, out = struct.unpack_from(f"<{n}Q", data, 4), 4 + 8 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def _row(row: tuple, schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


class Chunk:
    """Local dictionary and number streams of some documents."""

    def __init__(self) -> None:
        self.code: dict = defaultdict(count().__next__)
        self.heads: list = []
        self.streams: list[np.ndarray] = []
        self.size = 0

    def add(self, head: tuple, words: list, size: int) -> None:
        self.heads.append(head)
        self.streams.append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))
        self.size += size

    def rows(self, name: str, parts: int, weigh: Callable | None) -> Iterator[tuple]:
        n = len(self.code)
        lens = np.fromiter(map(len, self.streams), np.int64, len(self.streams))
        flat = np.concatenate(self.streams)
        self.streams = []
        freq = np.bincount(flat, minlength=n)
        order = np.argsort(-freq, kind="stable")
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        yield name, -1, 0, pack(lens.astype(np.uint32), squeeze), pack(rank[flat], squeeze), b"", self.heads
        if n:
            extra = weigh(self.heads, lens, flat, n)[order] if weigh else None
            del flat
            raw = [w.encode() if isinstance(w, str) else w for w in self.code]
            self.code = {}
            raw = [raw[k] for k in order.tolist()]
            where = np.fromiter(map(zlib.crc32, raw), np.uint32, n) % np.uint32(parts)
            by = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[by], np.arange(parts + 1))
            for p in range(parts):
                if len(ix := by[ends[p] : ends[p + 1]]):
                    words = [raw[k] for k in ix.tolist()]
                    size = np.fromiter(map(len, words), np.uint32, len(words))
                    c = pack(np.diff(ix, prepend=0).astype(np.uint32), squeeze)
                    yield name, p, 1, squeeze(b"".join(words)), joined(pack(size, squeeze), b"" if extra is None else pack(extra[ix].astype(np.uint32), squeeze)), c, None


def unpack_words(a: bytes, b: bytes) -> tuple[list[bytes], np.ndarray | None]:
    """Words of a kind-1 block and their weights, if it has any."""
    data, (size, extra) = unsqueeze(a), blobs(b)
    ends = np.cumsum(unpack(size, unsqueeze), dtype=np.int64).tolist()
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)], unpack(extra, unsqueeze) if extra else None


def unpack_numbers(c: bytes) -> np.ndarray:
    return np.cumsum(unpack(c, unsqueeze), dtype=np.int64)


def chunked(docs: DataFrame, split: Callable[[str], list], head: str = "doc_id", text: str = "text", weigh: Callable | None = None, chunk_chars: int = 24_000_000) -> DataFrame:
    """Blocks of kind 0 and 1 for ``docs``, written once so that both kinds agree.

    ``weigh(heads, lens, flat, n)`` may give each local word a whole number.
    """
    parts = partitions_for(docs.sparkSession)
    ddl = f"{BLOCK}, heads array<{docs.schema[head].dataType.simpleString()}>"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, chunk = TaskContext.get().partitionId(), 0, Chunk()
        for b in slices(batches):
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chunk.add(h, split(t or ""), len(t or ""))
                if chunk.size >= chunk_chars:
                    for row in chunk.rows(f"{task}.{k}", parts, weigh):
                        yield _row(row, arrow)
                    k, chunk = k + 1, Chunk()
        if chunk.heads:
            for row in chunk.rows(f"{task}.{k}", parts, weigh):
                yield _row(row, arrow)

    return bucketed(docs.select(F.col(head), F.col(text)).mapInArrow(run, ddl), "chunks", "chunk")


def resolved(blocks: DataFrame, resolve: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Send the words to their partitions and run ``resolve`` over each.

    ``resolve`` gets ``(chunk, part, a, b, c)`` of all blocks of some partitions,
    sorted by partition, and yields whole block rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches, 1):
                r = b.to_pylist()[0]
                yield r["chunk"], r["part"], r["a"], r["b"], r["c"]

        for row in resolve(rows()):
            yield _row(row)

    parts = partitions_for(blocks.sparkSession)
    return blocks.where("kind = 1").select("chunk", "part", "kind", "a", "b", "c").repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(run, BLOCK)


def by_chunk(blocks: DataFrame, results: DataFrame, use: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring each chunk's numbers and its resolved words together.

    ``use`` gets ``(heads, lens, numbers, [(positions, b, part), ...])`` for chunk after chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            for b in slices(batches, 1):
                r = b.to_pylist()[0]  # one chunk's numbers and words
                got = [(unpack_numbers(x["c"]), x["b"], x["part"]) for x in sorted(r["got"] or [], key=lambda x: x["part"])]
                yield r["heads"], unpack(r["a"], unsqueeze).astype(np.int64), unpack(r["b"], unsqueeze), got

        yield from use(groups())

    words = results.where("kind = 2").groupBy("chunk").agg(F.collect_list(F.struct("part", "b", "c")).alias("got"))
    return blocks.where("kind = 0").select("chunk", "heads", "a", "b").join(words.hint("merge"), "chunk", "left").select("heads", "a", "b", "got").mapInArrow(run, schema)
