"""Toxicity by maximum-scoring segments.

Words get smoothed log-odds between toxic and clean training texts (a Dirichlet
prior in proportion to the pooled counts). A linear scan finds all maximal
scoring segments of a text; each segment's score is calibrated by extreme-value
statistics (lambda and the text's length), the significant ones are summed, and a
logistic curve around the training texts' best cut gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import ALNUM_TABLE, arrow_schema, carried, crc_mod, id_fold, restored, slices, to_batches

#: Labelled texts that the classifier is fitted on, at most. Taken by the order of
#: a hash of their ids, so that the choice follows neither storage nor label.
FIT_ROWS = 20_000
#: Lengths in bytes of the stems that stand in for unseen words.
STEMS = (4, 5, 6)
#: Strength of the prior as a share of the fitted documents; |z| from which a token
#: counts; share of the largest possible log-odds that a toxic token must reach.
PRIOR, MIN_Z, MIN_SHARE = 0.05, 2.0, 0.6
#: What a token without evidence adds: small and negative, so that segments end.
NEUTRAL = -0.03
#: Words within which a repeated word is no new evidence: one passage's worth.
REPEAT = 60
#: F1 by which a cut may fall short of the best one.
NEAR_BEST = 0.01
#: Entries of a worker's word memo.
MEMO_WORDS = 200_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(ALNUM_TABLE).split()


def features(words: set[bytes]) -> set[bytes]:
    """The words and, marked, their stems."""
    return words | {b"^" + w[:n] for w in words for n in STEMS if len(w) > n}


@dataclass
class Model:
    odds: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    cut: float = 1.0
    slope: float = 1.0

    def score_word(self, w: bytes) -> float:
        """The word's own log-odds, else those of its stem with most evidence."""
        if w in self.odds:
            return self.odds[w]
        return max((self.odds[s] for n in STEMS if (s := b"^" + w[:n]) in self.odds), key=abs, default=NEUTRAL)

    def total(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, int]:
        """Sum of significant calibrated scores, lambda S - ln n, and their number."""
        good = [s for _, _, x in segments if (s := self.lam * x - math.log(max(2, n))) > 0]
        return sum(good), len(good)

    def probability(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * (total - self.cut)))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by the linear-time scan of
    Ruzzo and Tompa over runs of positive tokens."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    left, right, low, high, back = [], [], [], [], []
    for i in at.tolist():
        start, a, b = i, sums[i], sums[i + 1]
        j = len(left) - 1
        while True:
            while j >= 0 and low[j] >= a:
                j = back[j]
            if j < 0 or high[j] >= b:
                break
            start, a = left[j], low[j]
            del left[j:], right[j:], low[j:], high[j:], back[j:]
            j -= 1
        left.append(start)
        right.append(i + 1)
        low.append(a)
        high.append(b)
        back.append(j)
    return [(s, e, h - l) for s, e, l, h in zip(left, right, low, high, strict=True)]


def solve_lambda(values: np.ndarray, counts: np.ndarray) -> float:
    """Positive root of sum p(s) exp(lambda s) = 1 over the scores of clean tokens."""
    p = counts / counts.sum()
    if (values * p).sum() >= 0 or values.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * values)).sum() < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * values)).sum() < 1 else (lo, mid)
    return hi


def training_rows(docs: DataFrame, labels: DataFrame, fold: int, of: int) -> DataFrame:
    """doc_id, text, toxic of the sampled training rows; ids with two labels are left out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", of) != fold))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    # At most FIT_ROWS ids.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5) -> Model:
    """Learn log-odds, calibration and cut from labelled rows outside the fold."""
    rows = training_rows(docs, labels, fold, of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in slices(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by[y].update(features(set(words_of(t or ""))))
        keys = list(by[0].keys() | by[1].keys())
        cols = [keys, [by[1][k] for k in keys], [by[0][k] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["token", "bad", "good"])

    sums = rows.select("text", F.col("toxic").cast("int")).mapInArrow(count, "token binary, bad bigint, good bigint").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sums = sums.cache()
    total = sums.agg(F.sum("bad"), F.sum("good")).first()
    if not total[0] or not total[1]:
        sums.unpersist()
        return Model()
    n1, n0 = float(total[0]), float(total[1])
    y1, y0 = F.col("bad").cast("double"), F.col("good").cast("double")
    # A token's prior is its pooled share of this many pseudo-tokens.
    prior = PRIOR * (n1 + n0)
    a = (y1 + y0) / F.lit(n1 + n0) * F.lit(prior)
    delta = F.log((y1 + a) / (F.lit(n1 + prior) - y1 - a)) - F.log((y0 + a) / (F.lit(n0 + prior) - y0 - a))
    z = delta / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    model = sums.select("token", "bad", delta.alias("odds"), F.abs(z).alias("z")).where(F.col("z") >= MIN_Z)
    least = MIN_SHARE * (math.log((1 + PRIOR) / PRIOR) + math.log(n0 / n1))
    model = model.where((F.col("odds") < 0) | (F.col("odds") >= least))
    # Words and stems of FIT_ROWS texts, and of these only those that tell something.
    picked = model.orderBy(F.desc("z"), "token").collect()
    sums.unpersist()
    # A stem that owes its texts to one word says nothing about other words.
    word: dict[bytes, int] = {}
    for r in picked:
        for n in STEMS if r["token"][:1] != b"^" else ():
            stem = b"^" + bytes(r["token"])[:n]
            word[stem] = max(word.get(stem, 0), r["bad"])
    out = Model({bytes(r["token"]): r["odds"] for r in picked if 3 * r["bad"] >= 4 * word.get(bytes(r["token"]), 0)})
    return calibrate(rows, out)


def calibrate(rows: DataFrame, model: Model) -> Model:
    """Set lambda from clean token scores, then cut and slope from all sampled texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        hist: Counter = Counter()
        for b in slices(batches):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if y == 0:
                    v, n = np.unique(np.round(scorer.scores(words_of(t or "")), 1), return_counts=True)
                    hist.update(dict(zip(v.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(hist), pa.float64()), pa.array(list(hist.values()), pa.int64())], names=["s", "n"])

    data = rows.select("text", F.col("toxic").cast("int"))
    # As many rows as there are tenths between the smallest and the largest score.
    hist = data.mapInArrow(run, "s double, n bigint").groupBy("s").agg(F.sum("n").alias("n")).toPandas().sort_values("s")
    high = max(model.odds.values(), default=1.0)
    values = np.append(np.where(hist["s"].to_numpy() == 0, NEUTRAL, hist["s"].to_numpy()), max(high, 0.1))
    model.lam = solve_lambda(values, np.append(hist["n"].to_numpy(), 1).astype(float))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches):
            got = [scorer.total(t)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64()), b.column(1)], names=["total", "toxic"])

    # One row per sampled text, of which there are FIT_ROWS at most.
    seen = data.mapInArrow(totals, "total double, toxic int").toPandas()
    return set_cut(model, seen["total"].to_numpy(), seen["toxic"].to_numpy())


def set_cut(model: Model, total: np.ndarray, toxic: np.ndarray) -> Model:
    """A cut of about the best F1, in the middle of its gap; the slope from clean texts' spread."""
    order = np.argsort(-total, kind="stable")
    t, y = total[order], toxic[order]
    right = np.cumsum(y)
    f1 = 2 * right / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][t[1:] == t[:-1]] = -1
    if not len(t) or not y.sum():
        return model
    # Of the cuts that are nearly as good as the best, the one in the widest gap.
    gap = t - np.append(t[1:], 0.0)
    k = int(np.argmax(np.where(f1 >= f1.max() - NEAR_BEST, gap, -1)))
    below = t[k + 1] if k + 1 < len(t) else 0.0
    model.cut = float(max((t[k] + below) / 2, 1e-6))
    clean = total[toxic == 0]
    # Scale of the clean texts' extreme-value distribution, by its second moment.
    model.slope = float(1 / max(0.5, np.std(clean) * math.sqrt(6) / math.pi))
    return model


class Scorer:
    """A model with a bounded memo of word scores."""

    def __init__(self, model: Model) -> None:
        self.model = model

        class Memo(dict):
            def __missing__(self, w: bytes) -> float:
                s = self[w] = model.score_word(w)
                return s

        self.memo = Memo()

    def scores(self, words: list[bytes]) -> np.ndarray:
        """A score for each word; one that is repeated within REPEAT words counts once."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        out = np.fromiter(map(self.memo.__getitem__, words), np.float64, len(words))
        last: dict[bytes, int] = {}
        for k in np.flatnonzero(out > 0).tolist():
            if k - last.get(words[k], -REPEAT - 1) <= REPEAT:
                out[k] = NEUTRAL
            last[words[k]] = k
        return out

    def total(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], int]:
        words = words_of(text or "")
        segments = maximal_segments(self.scores(words))
        total, many = self.model.total(segments, len(words))
        return total, segments, many


def toxicity(docs: DataFrame, model: Model, fold: int = 0, of: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_passages, then ``keep``.

    n_passages counts significant passages, each as often as it occurs. A null or
    empty text has none and gets the score of total 0. Repeated and null ids keep
    their rows; texts of any length are read whole; columns other than doc_id, text
    and ``keep`` are not read; an empty table gives an empty result. A model that
    could not be fitted (no label of either kind) finds no passage.
    """
    extra = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, n_passages int{extra}"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)

        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                cols = [c.to_pylist() for c in b.columns]
                held = (id_fold(cols[0], of) == fold).tolist()
                for h, doc, text, *rest in zip(held, *cols, strict=True):
                    total, _, many = scorer.total(text)
                    p = model.probability(total)
                    yield doc, h, p, int(p >= 0.5), many, *rest

        yield from to_batches(rows(), arrow)

    return docs.select("doc_id", "text", *keep).mapInArrow(run, ddl)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not judged toxic, unchanged: null texts and repeated
    rows too, with all columns, whatever their names."""
    held, rest = carried(docs, text=F.col("text"))
    got = toxicity(held, fit(docs, labels), keep=(*rest.values(), "more_text")).where("predicted = 0")
    return restored(got, docs, rest, F.col("more_text"), F.lit(False))
