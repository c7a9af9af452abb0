"""Byte-level BPE encoding and decoding over a distinct-word table.

Words are cut in Spark tasks, every distinct word is encoded once, the ids are
joined back by position, and decoding goes through an id-to-piece table.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hushdex.llm.common import arrow_schema, to_batches
from hushdex.llm.vbyte import pack, unpack
from hushdex.llm.wordtable import blobs, by_chunk, chunked, joined, resolved, squeeze, unpack_words, unsqueeze

#: Unicode white space, as the tokenizer's own pattern sees it.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]")
_DOUBLE = re.compile(f"[{WS}][{WS}]")


def specials(path: str) -> list[str]:
    """Added tokens of a tokenizer file; their strings in a text are one id each."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def units(text: str, special: list[str]) -> list[str]:
    """Cut ``text`` where no token of a byte-level vocabulary can cross.

    A unit is a run of non-blanks with the one space before it, or blanks that
    stand by themselves. The units joined give the text.
    """
    for s in special:
        if s in text:
            cut = text.split(s)
            return [u for k, x in enumerate(cut) for u in ([s] if k else []) + units(x, special)]
    if "\x00" in text or _DOUBLE.search(text):
        return _UNIT.findall(text)
    return text.replace(" ", "\x00 ").split("\x00") if text else []


def byte_alphabet() -> dict[str, int]:
    """Character for each byte in byte-level vocabularies, by the usual rule:
    printable Latin-1 stands for itself, the rest follow from 256 up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces(path: str) -> list[bytes]:
    """Bytes of every id of a tokenizer file, by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = byte_alphabet()
    out = [b""] * (1 + max(table.values()))
    for piece, k in table.items():
        out[k] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return out


def encode_documents(docs: DataFrame, path: str, chunk_chars: int = 24_000_000) -> tuple[DataFrame, DataFrame]:
    """Blocks of the documents' words and of the words' ids."""
    special = specials(path)
    blocks = chunked(docs, lambda t: units(t, special), chunk_chars=chunk_chars)

    def resolve(rows: Iterator[tuple]) -> Iterator[tuple]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        known: dict[bytes, bytes] = {}
        here = -1
        for chunk, part, a, b, c in rows:
            if part != here:
                known, here = {}, part
            words, _ = unpack_words(a, b)
            for w in words:
                if w not in known:  # one call a word: a batch would only add threads
                    known[w] = array("I", tok.encode(w.decode(), add_special_tokens=False).ids).tobytes()
            ids = [known[w] for w in words]
            yield chunk, part, 2, None, _pack_ids(ids), c

    return blocks, resolved(blocks, resolve)


def _pack_ids(ids: list[bytes]) -> bytes:
    size = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
    return joined(pack(size, squeeze), pack(np.frombuffer(b"".join(ids), "<u4"), squeeze))


def _unpack_ids(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, ids = blobs(b)
    return unpack(size, unsqueeze).astype(np.int64), unpack(ids, unsqueeze)


def documents_ids(groups: Iterator[tuple]) -> Iterator[tuple]:
    """``(doc_id, ids)`` of every document of every chunk."""
    for heads, lens, numbers, got in groups:
        n = 1 + max((int(pos[-1]) for pos, _, _ in got), default=-1)
        of: list[bytes] = [b""] * n
        for pos, b, _ in got:
            size, ids = _unpack_ids(b)
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
            for p, i, j in zip(pos.tolist(), [0, *ends], ends, strict=False):
                of[p] = raw[i:j]
        at = 0
        for h, k in zip(heads, lens.tolist(), strict=True):
            yield h, np.frombuffer(b"".join(map(of.__getitem__, numbers[at : at + k].tolist())), "<u4")
            at += k


def bpe_roundtrip(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False, chunk_chars: int = 24_000_000) -> DataFrame:
    """Encode every text and decode it again: one row per row of ``docs``.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids
    (array of int), with ``keep_text`` also decoded. A null or empty text has no tokens; repeated
    and null ids keep their rows; other columns are not read; an empty table
    gives an empty result. ``path`` is a tokenizers JSON file with byte-level
    pieces, of equal place on all machines.
    """
    blocks, words = encode_documents(docs, path, chunk_chars)
    kind = docs.schema["doc_id"].dataType.simpleString()

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    arrow = arrow_schema(docs.sparkSession, schema)

    def use(groups: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)

        def rows() -> Iterator[tuple]:
            for doc, ids in documents_ids(groups):
                raw = b"".join(map(table.__getitem__, ids.tolist()))
                text = raw.decode("utf-8", "replace")
                row = (doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                yield row + ((ids.astype(np.int32),) if keep_ids else ()) + ((text,) if keep_text else ())

        yield from to_batches(rows(), arrow)

    return by_chunk(blocks, words, use, schema)
