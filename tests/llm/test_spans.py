"""Decontamination and personal data against brute force."""

import hashlib
import random
import re

import pytest

from hushdex.llm import fmindex, pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def windows_of(items, width):
    out = {}
    for name, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            out.setdefault(tuple(w[k : k + m]), set()).add(str(name))
    return out


def brute(text, windows):
    w = WORD.findall((text or "").translate(LOWER))
    hit, items = [False] * len(w), set()
    for m in {len(x) for x in windows}:
        for k in range(len(w) - m + 1):
            if found := windows.get(tuple(w[k : k + m])):
                items |= found
                hit[k : k + m] = [True] * m
    return hit, items


@pytest.mark.parametrize("seed", range(40))
def test_shards_against_brute_force(seed):
    rng = random.Random(seed)
    make = lambda a, b: " ".join(rng.choice("abcdefgh"[: rng.choice([2, 3, 8])]) for _ in range(rng.randint(a, b)))
    items = [(str(k), make(0, 14)) for k in range(rng.randint(1, 6))]
    texts = [make(0, 80) for _ in range(rng.randint(1, 8))]
    width = rng.choice([1, 2, 3, 5, 10])
    p = fmindex.patterns_of(items, width)
    windows = windows_of(items, width)
    if p is None:
        assert not windows
        return
    hit, lens, found = fmindex.shard_hits(texts, p)
    at = 0
    for t, n, items_found in zip(texts, lens, found, strict=True):
        assert (hit[at : at + n].tolist(), items_found) == brute(t, windows)
        at += n + 1


def test_index_parts():
    rng = random.Random(3)
    import numpy as np

    t = np.array([rng.randint(0, 4) for _ in range(300)] + [0])
    ix = fmindex.FMIndex(t, 4)
    assert sorted(ix.locate(np.arange(len(t))).tolist()) == list(range(len(t)))
    for m in (1, 2, 5):
        w = np.array([[rng.randint(1, 4) for _ in range(m)] for _ in range(50)])
        at, lo, hi = ix.search(w)
        for k in range(50):
            want = [i for i in range(len(t) - m + 1) if (t[i : i + m] == w[k]).all()]
            j = np.flatnonzero(at == k)
            got = sorted(ix.locate(np.arange(lo[j[0]], hi[j[0]])).tolist()) if len(j) else []
            assert got == want


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, ""), (4, None), (None, "null id words"), (1, "twelve eleven")]
DOCS = [
    (1, "x One two three four five six seven eight nine ten. y", "en", 7), (2, "a short, ITEM! and null id words", None, None), (3, "", "x", 1), (4, None, "x", 2), (None, "twelve eleven", "z", 3),
    (1, "x One two three four five six seven eight nine ten. y", "en", 7), (5, "one two three four five six seven eight nine", "q", 4), (6, "short item " * 3000, "q", 5),
]


def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, spans string, n_hit int")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("pattern_bytes", [10, 16_000_000])
def test_contamination(spark, monkeypatch, pattern_bytes):
    monkeypatch.setattr(fmindex, "PATTERN_BYTES", pattern_bytes)
    docs, bench = tables(spark)
    windows = windows_of([(("" if k is None else k), t) for k, t in ITEMS], 10)
    got = fmindex.contamination(docs, bench).collect()
    want = []
    for doc, text, *_ in DOCS:
        hit, items = brute(text, windows)
        want.append((doc, len(hit), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), any(hit)))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_decontaminated_keeps_rows_and_columns(spark):
    docs, bench = tables(spark)
    got = fmindex.decontaminated(docs, bench)
    assert got.columns == docs.columns
    rows = {(r["doc_id"], r["n_hit"]): r for r in got.collect()}
    assert got.count() == len(DOCS)
    assert rows[1, 7]["text"] == "x . y" and rows[2, None]["text"] == "a ! and " and rows[5, 4]["text"] == DOCS[6][1]
    assert rows[4, 2]["text"] is None and rows[3, 1]["text"] == "" and rows[1, 7]["spans"] == "en"


def test_empty_tables(spark):
    docs, bench = tables(spark)
    assert fmindex.contamination(docs.where("false"), bench).collect() == []
    assert {r["n_hit"] for r in fmindex.contamination(docs, bench.where("false")).collect()} == {0}


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = re.sub("[^0-9]", "", m[0])
        if 12 <= len(x) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(x[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


PARTS = ["1", "23", "456", ".", ".", " ", "-", "+", "@", "a", "b.c", "4111111111111111", "x@y.zz", "10.0.0.255", "(", ")", "é", "://", "\n", "+49 30 1234567", "token=", "iban ", "²"]


@pytest.mark.parametrize("seed", range(20))
def test_base_spans(seed):
    rng = random.Random(seed)
    for _ in range(400):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16)))
        assert [s for s in pii.find(t) if s[2] in pii.KINDS[:4]] == base_spans(t), t


def test_added_spans():
    found = lambda t: [(k, t[a:b]) for a, b, k in pii.find(t)]
    assert found("see https://x.example/a?b=1, ok") == [("url", "https://x.example/a?b=1")]
    assert found('api_key = "abcd1234efgh"') == [("secret", "abcd1234efgh")]
    assert ("account", "DE89 3704 0044 0532 0130 00") in found("IBAN: DE89 3704 0044 0532 0130 00.")
    assert ("account", "12345678") in found("account no 12345678")
    assert found("the secret of it, an account of it") == []


def test_long_texts_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1 " * 50_000, "@a." * 50_000, "x" * 100_000 + "://"):
        pii.find(t)


def test_personal_data(spark):
    rows = [(1, "mail a@b.cc or +1 202 555 0143", "s"), (2, "", None), (3, None, "t"), (None, "10.0.0.1", "u"), (1, "mail a@b.cc or +1 202 555 0143", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sorted(pii.personal_data(docs).collect(), key=lambda r: (r["doc_id"] or 0, r["spans"]))
    assert [tuple(r[1:5]) for r in got] == [(0, 1, 0, 0), (1, 0, 0, 1), (1, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert got[1]["spans"] == "email:5:11,phone:15:30" and got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    clean = {(r["doc_id"], r["spans"]): r["text"] for r in pii.redacted(docs).collect()}
    assert clean[1, "s"] == "mail [EMAIL] or [PHONE]" and clean[3, "t"] is None and clean[2, None] == "" and clean[None, "u"] == "[IP]"
    assert pii.personal_data(docs.where("false")).collect() == []


def test_overlapping_spans_become_one():
    assert pii.redact("abcdef", [(0, 4, "url"), (2, 5, "email"), (5, 6, "ip")]) == "[URL][IP]"
