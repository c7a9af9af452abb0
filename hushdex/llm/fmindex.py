"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents. Its words become numbers; a word that no
benchmark item has can be in no match, so it only separates, and stretches of
item words that are shorter than the shortest window are left out of the index.
The index is a wavelet matrix over the Burrows-Wheeler transform with a sample of
suffix positions. All windows are searched backwards at once, their occurrences
are located by stepping to the next sampled position, and overlapping
occurrences merge into removal spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import ALNUM_TABLE, arrow_schema, carried, restored, saved, slices, to_batches

#: Bytes of benchmark text in one pattern block; each task holds one block at a time.
PATTERN_BYTES = 16_000_000
#: Bytes of document text in one shard.
SHARD_BYTES = 4_000_000
#: Every so many positions of a shard one suffix position is kept.
SAMPLE = 8
#: Occurrences located at once.
LOCATE = 200_000

_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(ALNUM_TABLE).split()


@dataclass
class Patterns:
    """Windows of some benchmark items as word numbers from 1."""

    vocab: dict[bytes, int]
    windows: list[np.ndarray]
    item_of: list[tuple[np.ndarray, np.ndarray]]
    items: list[str]

    @property
    def shortest(self) -> int:
        return min(w.shape[1] for w in self.windows)


def patterns_of(items: list[tuple[str, str]], width: int) -> Patterns | None:
    """Distinct windows by length, and for each length (window, item) pairs."""
    vocab: dict[bytes, int] = {}
    by: dict[int, list[np.ndarray]] = {}
    own: dict[int, list[np.ndarray]] = {}
    names: list[str] = []
    for name, text in items:
        w = np.array([vocab.setdefault(x, len(vocab) + 1) for x in words_of(text)], np.int32)
        if not len(w):
            continue
        rows = sliding_window_view(w, min(width, len(w)))
        by.setdefault(rows.shape[1], []).append(rows)
        own.setdefault(rows.shape[1], []).append(np.full(len(rows), len(names), np.int32))
        names.append(name)
    windows, item_of = [], []
    for m, rows in by.items():
        u, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack((inverse.ravel(), np.concatenate(own[m]))), axis=1)
        windows.append(u)
        item_of.append((pairs[0], pairs[1]))
    return Patterns(vocab, windows, item_of, names) if windows else None


def pattern_blocks(bench: DataFrame, width: int) -> Iterator[Patterns]:
    """Patterns of a bounded amount of text at a time; items stream to the driver."""
    some, size = [], 0
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        some.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= PATTERN_BYTES:
            if p := patterns_of(some, width):
                yield p
            some, size = [], 0
    if some and (p := patterns_of(some, width)):
        yield p


# -- the index -------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t``; each zero is a separator smaller than all words,
    and of two zeros the earlier one is smaller."""
    sep = np.flatnonzero(t == 0)
    rank = t + len(sep)
    rank[sep] = np.arange(len(sep))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    n, step = len(t), 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.word = np.packbits(padded, bitorder="little").view("<u8")
        self.sum = np.concatenate(([0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.sum[w] + np.bitwise_count(self.word[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix: rank and access by halving the alphabet level by level."""

    def __init__(self, s: np.ndarray, sigma: int) -> None:
        self.depth = max(1, int(sigma).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for d in range(self.depth - 1, -1, -1):
            b = (s >> d) & 1
            self.levels.append(Bits(b.astype(np.uint8)))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate((s[b == 0], s[b == 1]))
        # Where each symbol's run begins in the last level.
        self.first = np.zeros(sigma + 2, np.int64)
        change = np.flatnonzero(np.diff(s, prepend=-1))
        self.first[s[change]] = change

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols are c; c must occur."""
        for d, (b, z) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = b.rank(i)
            i = np.where(c >> (self.depth - 1 - d) & 1, z + one, i - one)
        return i - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at i, and how often it occurs before."""
        c = np.zeros(len(i), np.int64)
        for b, z in zip(self.levels, self.zeros, strict=True):
            bit, one = b.get(i), b.rank(i)
            c = c << 1 | bit
            i = np.where(bit == 1, z + one, i - one)
        return c, i - self.first[c]


class FMIndex:
    """FM-index of a number sequence in which 0 separates."""

    def __init__(self, t: np.ndarray, sigma: int) -> None:
        sa = suffix_array(t)
        last = t[sa - 1]  # of position 0: the final separator
        self.n = len(t)
        self.wavelet = Wavelet(last, sigma)
        self.count = np.bincount(t, minlength=sigma + 1)
        self.before = np.cumsum(self.count) - self.count
        # Steps over a separator are not defined: positions after one are sampled too.
        keep = (sa % SAMPLE == 0) | (last == 0)
        self.kept, self.sample = Bits(keep.astype(np.uint8)), sa[keep]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and their suffix intervals."""
        at = np.flatnonzero((self.count[windows] > 0).all(1))
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            c = windows[at, k]
            lo, hi = self.before[c] + self.wavelet.rank(c, lo), self.before[c] + self.wavelet.rank(c, hi)
            live = hi > lo
            at, lo, hi = at[live], lo[live], hi[live]
        return at, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        todo = np.arange(len(row))
        row = row.copy()
        while len(todo):
            found = self.kept.get(row[todo]) == 1
            hit = todo[found]
            out[hit] = self.sample[self.kept.rank(row[hit])] + steps[hit]
            todo = todo[~found]
            c, before = self.wavelet.access(row[todo])
            row[todo] = self.before[c] + before
            steps[todo] += 1
        return out


def occurrences(t: np.ndarray, p: Patterns) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length class, windows, positions in ``t``) of all occurrences, in bounded parts."""
    edge = np.diff(np.concatenate(([0], (t != 0).astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= p.shortest
    start, size = start[long], (end - start)[long]
    if not len(start):
        return
    # Kept stretches, each with a separator behind it.
    out = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int((size + 1).sum()), np.int64)
    origin = np.repeat(start - out, size + 1) + np.arange(len(text))
    inside = np.ones(len(text), bool)
    inside[out + size] = False
    text[inside] = t[origin[inside]]
    index = FMIndex(text, len(p.vocab))
    for k, windows in enumerate(p.windows):
        at, lo, hi = index.search(windows)
        ends = np.cumsum(hi - lo)
        total = int(ends[-1]) if len(ends) else 0
        for a in range(0, total, LOCATE):
            j = np.arange(a, min(total, a + LOCATE))
            which = np.searchsorted(ends, j, side="right")
            row = lo[which] + j - (ends[which] - (hi - lo)[which])
            yield k, at[which], origin[index.locate(row)]


def shard_hits(texts: list[str], p: Patterns | None) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Hit mask over all words of a shard, word counts, and item ids of each text."""
    words = [words_of(t) for t in texts]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(lens + 1) - (lens + 1)
    n = int((lens + 1).sum())
    found: list[set[str]] = [set() for _ in texts]
    if p is None:
        return np.zeros(n, bool), lens, found
    t = np.zeros(n, np.int64)
    for b, w in zip(begin.tolist(), words, strict=True):
        t[b : b + len(w)] = np.fromiter(map(p.vocab.get, w, repeat(0)), np.int64, len(w))
    cover = np.zeros(n + 1, np.int64)
    pairs: dict[int, list[np.ndarray]] = {}
    for k, which, pos in occurrences(t, p):
        m = p.windows[k].shape[1]
        np.add.at(cover, pos, 1)
        np.subtract.at(cover, pos + m, 1)
        doc = np.searchsorted(begin, pos, side="right") - 1
        pairs.setdefault(k, []).append(np.unique(doc * len(p.windows[k]) + which))
    for k, keys in pairs.items():
        key = np.unique(np.concatenate(keys))
        doc, which = np.divmod(key, len(p.windows[k]))
        wins, items = p.item_of[k]
        lo, hi = np.searchsorted(wins, which), np.searchsorted(wins, which, side="right")
        for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
            found[d].update(p.items[i] for i in items[a:b].tolist())
    return np.cumsum(cover[:-1]) > 0, lens, found


def removal_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged code point spans from the first to the last word of every hit run."""
    if not hit.any():
        return []
    where = [m.span() for m in _WORD.finditer(text)]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [(where[a][0], where[b - 1][1]) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def contamination(docs: DataFrame, bench: DataFrame, width: int = 10, keep: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """One row per row of ``docs``: how much of it is benchmark text.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, then the
    columns ``keep`` of ``docs``, then with ``clean`` spans (merged removal spans)
    and clean_text. A null or empty text has no words, and an item without words
    no window; items of one id count once, a null item id is the empty string;
    repeated and null doc ids keep their rows; texts of any length are read whole;
    columns other than doc_id, text and ``keep`` are not read; empty tables give
    zero hits or an empty result.
    """
    keep = tuple(keep)
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    ends = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean{extra}" + ", spans array<struct<start:int,end:int>>, clean_text string" * clean
    rows = docs.select("doc_id", "text", *keep)
    blocks = list(pattern_blocks(bench, width)) or [None]
    # Usually one step. Each holds one block of patterns and hands on what it found; steps
    # are written apart, so that no two blocks are in a task's memory at once.
    for k, p in enumerate(blocks):
        last = k == len(blocks) - 1
        ddl = ends if last else f"doc_id {kind}, text string{extra}, hit binary, items array<string>"
        rows = rows.mapInArrow(_step(p, arrow_schema(docs.sparkSession, ddl), k > 0, last, clean), ddl)
        rows = rows if last else saved(rows, "searched")
    return rows


def _step(p: Patterns | None, arrow: pa.Schema, more: bool, last: bool, clean: bool):
    """Search some patterns in all shards; ``more``: rows come with what was found before."""

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        hit, lens, found = shard_hits([r[1] or "" for r in rows], p)
        at = 0
        for row, n, items in zip(rows, lens.tolist(), found, strict=True):
            own = hit[at : at + n]
            at += n + 1
            doc, text, *rest = row
            if more:
                *rest, before, names = rest
                own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
                items.update(names)
            if not last:
                yield doc, text, *rest, np.packbits(own).tobytes(), sorted(items)
                continue
            many = int(own.sum())
            out = (doc, n, many, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), many > 0, *rest)
            if clean:
                spans = removal_spans(text or "", own)
                out += ([{"start": a, "end": b} for a, b in spans], without(text or "", spans))
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            some: list[tuple] = []
            size = 0
            for b in slices(batches):
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    some.append(row)
                    size += len(row[1] or "")
                    if size >= SHARD_BYTES:
                        yield from shard(some)
                        some, size = [], 0
            if some:
                yield from shard(some)

        yield from to_batches(rows(), arrow)

    return run


def decontaminated(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` with benchmark passages cut out of text; n_chars follows. Rows stay."""
    held, rest = carried(docs, null=F.col("text").isNull())
    got = contamination(held, bench, width, (*rest.values(), "more_null"), clean=True)
    text = F.when(F.col("more_null"), None).otherwise(F.col("clean_text"))
    return restored(got, docs, rest, text, F.col("contaminated"))
