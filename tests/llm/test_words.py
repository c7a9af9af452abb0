"""Word table, BPE, token shards and the byte-aligned codec."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushdex.llm import bpe, tokenbin, vbyte

DOCS = "doc_id bigint, text string, ids string, spans int"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, and more plain words.", "", None, "  two  blanks \n\n tabs\t\tend ", "<|endoftext|>", "a <|endoftext|>b  <|endoftext|>  ", "it's they'll I'D 1234 x9",
    "naïve café Ünïcödé ß ΣΑΣ नमस्ते 漢字 😀", "nul\x00byte \x1c\x1d sep\x85nel\xa0nbsp", "é combining ́", "x" * 5000, "word " * 4000, "ÀÉ!! don't... (yes)", "İstanbul ǅ",
]


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, "clash", k) for k, t in enumerate(texts)], DOCS)


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_vbyte_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = vbyte.encode(v)
    assert (vbyte.decode(control, data, len(v)) == v).all() and len(control) == -(-len(v) // 4)


def test_vbyte_sizes():
    control, data = vbyte.encode(np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32))
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 4 and control[0] == 0b01010000


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "Ab", "'s", "'", "9", "é", ".", "\x1c", "\x00", "<|endoftext|>", "ते", "😀", "́", "\r\n", "　"]), max_size=12).map("".join))
def test_units_join_to_the_tokenizers_ids(text):
    tok = _tok(BYTE)
    cut = bpe.units(text, ["<|endoftext|>"])
    assert "".join(cut) == text
    assert [i for u in cut for i in tok.encode(u, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids


_memo = tokenbin.WordIds(WORD)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([" ", "\n", "a", "Ab", "É", "ß", "'s", "'", "99", "...", "!", "\x1c", "<|endoftext|>", "İ", "é", "ǅ"]), max_size=12).map("".join))
def test_word_ids_join_to_the_tokenizers_ids(text):
    _memo.clear()
    raw = b"".join(_memo[w] for w in tokenbin.words_of(text))
    assert np.frombuffer(raw, _memo.dtype).tolist() == _tok(WORD).encode(text, add_special_tokens=False).ids


_toks: dict = {}


def _tok(path):
    return _toks.setdefault(path, Tokenizer.from_file(path))


@pytest.mark.parametrize("chunk", [50, 24_000_000])
def test_bpe(spark, chunk):
    got = {r["doc_id"]: r for r in bpe.bpe_roundtrip(docs_of(spark), BYTE, keep_ids=True, keep_text=True, chunk_chars=chunk).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        ids = np.array(_tok(BYTE).encode(t or "", add_special_tokens=False).ids, "<u4")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[k]["ids"] == ids.tolist()
        assert got[k]["decoded"] == _tok(BYTE).decode(ids.tolist(), skip_special_tokens=False) == (t or "")


def test_bpe_repeated_null_and_no_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c")]
    got = bpe.bpe_roundtrip(spark.createDataFrame(rows, "doc_id bigint, text string"), BYTE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 1), (1, 2), (1, 2)]
    assert bpe.bpe_roundtrip(docs_of(spark, []), BYTE).collect() == []


def expected_shards(rows):
    at, out = 0, []
    for doc, t in rows:
        ids = np.array([*_tok(WORD).encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "BLOCK_IDS", 40)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "cat", "Sat,", "É"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    got = tokenbin.token_shards(docs_of(spark, texts).repartition(5), WORD).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_shards(list(enumerate(texts)))


def test_token_shards_ids(spark):
    got = tokenbin.token_shards(docs_of(spark), WORD, keep_ids=True).collect()
    for r in got:
        assert r["ids"] == [*_tok(WORD).encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 1]


def test_token_shards_edge_rows(spark):
    rows = [(2, "b"), (None, "a"), (1, "c c"), (1, "c c"), (1, "d")]
    got = tokenbin.token_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), WORD).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 1, 2]
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert tokenbin.token_shards(docs_of(spark, []), WORD).collect() == []
