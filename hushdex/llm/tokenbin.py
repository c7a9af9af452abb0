"""Token-id shards: frequency-ranked ids in byte-aligned variable-length coding.

A shard set is a folder of two Parquet tables. Each row of ``blocks`` is one block
of whole documents in ascending document order: the ids' frequency ranks as control
bytes and data bytes (see ``vbyte``), the documents' ids and lengths, the shard's
number and how many ids of the same shard come before the block. The one row of
``ranks`` has the id of every rank, so that a set can be read by its path alone.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushdex.llm import vbyte
from hushdex.llm.bpe import WS, byte_alphabet
from hushdex.llm.common import arrow_schema, partitions_for, remove, scratch_path, slices, to_batches
from hushdex.sources.local import frame

#: Entries of a worker's word memo; a full one starts anew.
MEMO_WORDS = 900_000
#: Ids in a block, unless one document has more.
BLOCK_IDS = 250_000

_RUN = re.compile(f"[^{WS}]+")
#: Blanks for str.split() that the tokenizer does not take for blanks.
_ODD = "\x1c\x1d\x1e\x1f"
#: Latin-1 letters, then marks other than the apostrophe: two tokens' worth of text
#: that only lower-casing changes, so the model can be asked without the rest.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")
#: Texts that can be a part of such a word.
_WITHIN = re.compile(_PLAIN.pattern.replace("+", "*", 1))
_workers: dict[str, WordIds] = {}
#: What _PLAIN relies on: normalisers that leave such text alone but for its case, and
#: a first split that parts letters from marks (fixed values of the tokenizer's format).
_KEEPERS = {"NFC", "Replace", "Lowercase"}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def takes_plain(path: str) -> bool:
    """Whether a tokenizer file treats plain words in the way that the short cut does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [n.get("type") for n in norm.get("normalizers", [norm])]
    blank = all(n.get("pattern") == {"Regex": r"\s+"} for n in norm.get("normalizers", []) if n.get("type") == "Replace")
    parts = pre.get("pretokenizers", [])
    split = len(parts) == 2 and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    within = any(_WITHIN.fullmatch(t["content"]) for t in spec.get("added_tokens", []))
    return "Lowercase" in steps and set(steps) <= _KEEPERS and blank and split and not within and spec["model"]["type"] == "BPE"


def words_of(text: str) -> list[str]:
    """Runs of non-blanks; no token of a word-end vocabulary crosses them."""
    return _RUN.findall(text) if any(c in text for c in _ODD) else text.split()


class WordIds(dict):
    """Ids of words as packed bytes; each word is encoded when first met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.wide = self.tok.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.code = "I" if self.wide else "H"
        self.dtype = "<u4" if self.wide else "<u2"
        self.chars = {b: c for c, b in byte_alphabet().items()}
        self.plain = takes_plain(path)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.plain and (m := _PLAIN.fullmatch(word)):
            stem, marks = m.groups()
            low = stem.lower()
            if low == word:
                chars = low if low.isascii() else low.encode().decode("latin-1").translate(self.chars)
                ids = array(self.code, [t.id for t in self.tok.model.tokenize(chars)]).tobytes()
            else:
                ids = self[low] + self[marks] if marks else self[low]
        else:
            ids = self.pack(self.tok.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


def worker_ids(path: str) -> WordIds:
    """The memo of this Python worker; it outlives a task."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows (kind 0, doc_id, n, ids) of every text, and (kind 1, counts) of every task."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"kind int, doc_id {doc_type}, n bigint, ids binary"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_ids(path)
        total = np.zeros(1 + max(end_id, memo.tok.get_vocab_size(with_added_tokens=True)), np.int64)
        end = memo.pack([end_id])

        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                memo.trim()
                done = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = b"".join(map(memo.__getitem__, words_of(text or ""))) + end
                    done.append(raw)
                    yield 0, doc, len(raw) // len(end), raw
                total[:] += np.bincount(np.frombuffer(b"".join(done), memo.dtype), minlength=len(total))
            yield 1, None, 0, total.tobytes()

        yield from to_batches(rows(), arrow)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, ddl)


def frequency_order(table: DataFrame) -> np.ndarray:
    """Ids by falling count over all documents, ties by id. As long as the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            for x in b.column(0).to_pylist():
                c = np.frombuffer(x, np.int64)
                total = c.copy() if total is None else total + c
        if total is not None:
            k = np.arange(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total)], names=["id", "n"])

    counts = table.where("kind = 1").select("ids").repartition(max(1, partitions_for(table.sparkSession) // 12)).mapInArrow(add, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return np.argsort(-counts["n"].to_numpy(np.int64), kind="stable") if len(counts) else np.zeros(0, np.int64)


def write_shards(docs: DataFrame, path: str, end_id: int, out: str) -> None:
    """Encode ``docs`` and write the shard set ``out``."""
    spark = docs.sparkSession
    held = scratch_path(spark, "ids")
    coded = encode_ids(docs, path, end_id)
    coded.write.option("compression", "zstd").parquet(held)
    table = spark.read.schema(coded.schema).parquet(held)
    order = frequency_order(table)
    rank = np.zeros(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"shard int, before bigint, docs array<{doc_type}>, lens array<bigint>, control binary, data binary"
    arrow = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        width = worker_ids(path).dtype
        names: list = []
        parts: list[np.ndarray] = []

        def block() -> tuple:
            nonlocal names, parts, before
            flat, lens = np.concatenate(parts), [len(x) for x in parts]
            row = (shard, before, names, lens, *vbyte.encode(rank[flat]))
            before, names, parts = before + len(flat), [], []
            return row

        def rows() -> Iterator[tuple]:
            held = 0
            for b in slices(batches):
                for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    names.append(doc)
                    parts.append(np.frombuffer(raw, width))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        held = 0
                        yield block()
            if names:
                yield block()

        yield from to_batches(rows(), arrow, 1)

    # Rows of one id are dealt by their content too, so that a repeated id can be split.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc(), F.col("n").asc()]
    sorted_ids = table.where("kind = 0").repartitionByRange(partitions_for(spark), *keys).sortWithinPartitions(*keys)
    sorted_ids.select("doc_id", "ids").mapInArrow(run, ddl).write.option("compression", "zstd").parquet(f"{out}/blocks")
    frame(spark, [(order.tolist(),)], "ids array<int>").coalesce(1).write.option("compression", "zstd").parquet(f"{out}/ranks")
    remove(spark, held)


def read_shards(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document of a shard set: doc_id, start, n_tokens, ids_crc32."""
    table = spark.read.parquet(f"{path}/blocks")
    # As long as the vocabulary.
    order = np.array(spark.read.parquet(f"{path}/ranks").first()["ids"], np.int64)
    # One row per shard, of which there are as many as partitions were written.
    sizes = table.groupBy("shard").agg(F.max(F.col("before") + F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()
    ends = np.cumsum([0, *(r["n"] for r in sizes)])
    base = {r["shard"]: int(e) for r, e in zip(sizes, ends, strict=False)}
    doc_type = table.schema["docs"].dataType.elementType.simpleString()
    ddl = f"doc_id {doc_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    arrow = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches, 1):
                r = b.to_pylist()[0]
                ids = order[vbyte.decode(r["control"], r["data"], sum(r["lens"]))].astype("<u4")
                at, start = 0, base[r["shard"]] + r["before"]
                for doc, n in zip(r["docs"], r["lens"], strict=True):
                    own = ids[at : at + n]
                    row = (doc, start + at, n, zlib.crc32(own.tobytes()))
                    yield (*row, own.astype(np.int32)) if keep_ids else row
                    at += n

        yield from to_batches(rows(), arrow)

    return table.mapInArrow(run, ddl)


def token_shards(docs: DataFrame, path: str, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Write ``docs`` as a shard set in the shared folder and read it back.

    A null or empty text is the end id alone. Rows of equal id are ordered by
    their content; null ids come first; an empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    out = scratch_path(spark, "shards")
    write_shards(docs, path, end_id, out)
    return read_shards(spark, out, keep_ids)
