"""Language identification by rank-order profiles.

A text's most frequent letter n-grams (1 to 3, words padded with a boundary) are
compared to each language's by the sum of rank differences; an n-gram that a
language does not have costs the largest difference.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushdex.llm.common import arrow_schema, id_fold, saved, slices, to_batches

#: N-grams in a language's profile and in a document's.
LANG_TOP, DOC_TOP = 400, 300
#: Languages that are compared at once, and characters whose n-grams are held at once.
LANGS_AT_ONCE, CHARS_AT_ONCE = 5_000, 1 << 20
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of ``text``; none where it has no letter.

    Three characters of 21 bits make a trigram's code; bigrams and single letters
    are below zero.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c = np.where(letter_table()[c], c, 0)
    keep = np.ones(len(c) + 2, bool)
    c = np.concatenate(([0], c, [0]))
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64)
    two, three = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.concatenate((-(np.int64(1) << 50) - c[c > 0], -1 - two, three[c[1:-1] > 0]))


def stretches(text: str) -> Iterator[str]:
    """``text`` cut at blanks into bounded parts; a longer word stays whole. All n-grams
    of the text are those of its parts."""
    at = 0
    while len(text) - at > CHARS_AT_ONCE:
        end = text.rfind(" ", at + 1, at + CHARS_AT_ONCE)
        if end < 0:
            end = text.find(" ", at + CHARS_AT_ONCE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def counted(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and their counts; parts are summed as they come."""
    u, n, some, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add() -> tuple[np.ndarray, np.ndarray]:
        v, m = np.unique(np.concatenate(some), return_counts=True)
        if not len(u):
            return v, m
        both, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate((n, m)), minlength=len(both)).astype(np.int64)

    for p in parts:
        some.append(p)
        size += len(p)
        if size > 3 * CHARS_AT_ONCE:
            u, n = add()
            some, size = [], 0
    return add() if some else (u, n)


def profile(u: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The codes of the largest counts, largest first, ties by code."""
    if len(u) > 4 * top:
        cut = np.partition(n, len(n) - top)[len(n) - top]
        u, n = u[n >= cut], n[n >= cut]
    return u[np.argsort(-n, kind="stable")[:top]]


def learn(docs: DataFrame, fold: int, of: int, top: int = LANG_TOP) -> Iterator[dict[str, np.ndarray]]:
    """Profiles from all texts with a lang and crc32(doc_id) mod ``of`` other than ``fold``,
    by lang, so many at a time that they can be compared at once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "code", "n"])
            total.clear()

        for b in slices(batches, 512):
            use = id_fold(b.column(0).to_pylist(), of) != fold
            by: dict[str, list[str]] = {}
            for t, lang, u in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), use.tolist(), strict=True):
                if u and lang is not None and t:
                    by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                u, n = counted(ngrams(x) for t in texts for x in stretches(t))
                own = total.setdefault(lang, {})
                held -= len(own)
                get = own.get
                own.update((k, get(k, 0) + m) for k, m in zip(u.tolist(), n.tolist(), strict=True))
                held += len(own)
            if held > 2_000_000:  # Spark adds up what comes in parts
                yield from out()
                held = 0
        yield from out()

    sums = docs.select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("lang", "rank")
    now: dict[str, list] = {}
    for r in rows.toLocalIterator():
        if r["lang"] not in now and len(now) == LANGS_AT_ONCE:
            yield {k: np.array(v, np.int64) for k, v in now.items()}
            now = {}
        now.setdefault(r["lang"], []).append(r["code"])
    if now:
        yield {k: np.array(v, np.int64) for k, v in now.items()}


#: What is known of a text after some languages: the best one, its distance, the next one's.
State = tuple[str | None, int | None, int | None]


class Ranker:
    """Out-of-place distances to some profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = LANG_TOP) -> None:
        self.langs = list(profiles)
        self.top = top
        self.codes = np.unique(np.concatenate(list(profiles.values())))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), top, np.int64)
        for k, p in enumerate(profiles.values()):
            self.ranks[np.searchsorted(self.codes, p), k] = np.arange(len(p))

    def distances(self, text: str) -> np.ndarray | None:
        """Distance to each profile; None without a letter."""
        u, n = counted(ngrams(x) for x in stretches(text))
        if not len(u):
            return None
        mine = profile(u, n, DOC_TOP)
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = len(self.codes) - 1
        at = np.where(self.codes[at] == mine, at, len(self.codes))
        r = self.ranks[at]
        return np.where(r == self.top, self.top, np.abs(r - np.arange(len(mine))[:, None])).sum(0)

    def judge(self, text: str | None, state: State = (None, None, None)) -> State:
        """The state after these profiles; of equal distances the earlier language's counts."""
        out = self.distances(text or "")
        if out is None:
            return state
        lang, best, second = state
        k = int(np.argmin(out))
        rest = [int(x) for x in (np.delete(out, k).min(initial=np.iinfo(np.int64).max), out[k], best, second) if x is not None and x < np.iinfo(np.int64).max]
        rest.sort()
        if best is None or out[k] < best:
            lang = self.langs[k]
        return lang, rest[0], rest[1] if len(rest) > 1 else None


def certainty(state: State) -> tuple[str, float]:
    """The language, and the next one's share of both distances."""
    lang, best, second = state
    if lang is None:
        return UNKNOWN, 0.0
    if second is None:
        return lang, 1.0
    return lang, second / (second + best) if second else 0.5


def identify(docs: DataFrame, fold: int = 2, of: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    The score is the runner-up's share of the two smallest distances: 0.5 for a
    tie, 1 for a perfect fit or a lone language. A null text, or one without a
    letter, is ``und`` with score 0, as is every text when no language could be
    learned. Null langs are not learned from; equal distances go to the first
    language by name; repeated and null ids keep their rows; texts of any length are
    read whole; columns other than doc_id, text and lang are not read; an empty
    table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = list(learn(docs, fold, of))
    rows = docs.select("doc_id", "text")
    # Usually one step: each compares with so many languages as can be compared at once.
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        ddl = f"doc_id {kind}, held_out boolean, lang_pred string, score double" if last else f"doc_id {kind}, text string, lang string, best bigint, second bigint"
        rows = rows.mapInArrow(_step(block, arrow_schema(docs.sparkSession, ddl), last, fold, of), ddl)
        rows = rows if last else saved(rows, "compared")
    if not blocks:
        return rows.select("doc_id", F.expr(f"crc32(coalesce(cast(doc_id as string), '')) % {of} = {fold}").alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows


def _step(block: dict[str, np.ndarray], arrow: pa.Schema, last: bool, fold: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(block)

        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                ids, texts, *states = (c.to_pylist() for c in b.columns)
                held = (id_fold(ids, of) == fold).tolist()
                for k, (doc, t) in enumerate(zip(ids, texts, strict=True)):
                    state = ranker.judge(t, tuple(s[k] for s in states)) if states else ranker.judge(t)
                    yield (doc, held[k], *certainty(state)) if last else (doc, t, *state)

        yield from to_batches(rows(), arrow)

    return run
