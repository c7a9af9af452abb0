"""Top-k search over blind postings: four modes, one query or a table of them.

An entry's score is the share of the query's tokens that it holds, so one join of
query tokens with postings and one count per entry replace all lookups: the
intersection of exact mode is a count that equals the total, the union of the
other modes is the grouping itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushdex.functions.tokens import TRIGRAM, WORD
from hushdex.sources.local import frame

MODES = ("exact", "contains", "prefix", "fuzzy")
#: Query tokens up to which the filter is also written out, to skip row groups of sorted postings.
PUSHED_TOKENS = 500
#: Query-token rows that are broadcast; a larger table of queries is shuffled instead.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Thresholds:
    """Least scores of the two trigram modes."""

    prefix: float = 0.6
    fuzzy: float = 0.3

    def of(self, mode: str) -> float:
        return {"prefix": self.prefix, "fuzzy": self.fuzzy}.get(mode, 0.0)


def parse_mode(name: str) -> str:
    mode = name.lower()
    if mode not in MODES:
        raise ValueError(f"unknown match mode: {name}")
    return mode


def plan_of(mode: str, words: list[str], trigrams: list[str]) -> tuple[str, list[str], bool]:
    """Kind of token to match, the tokens, and whether the mode's threshold holds.

    A query too short for trigrams falls back to words, without a threshold.
    """
    if mode in ("exact", "contains") or not trigrams:
        return WORD, words, False
    return TRIGRAM, trigrams, True


def scored(postings: DataFrame, mode: str, words: list[str], trigrams: list[str], limits: Thresholds = Thresholds(), keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(candidates, hits): (entry_id, score) of all candidates and of those that pass.

    A repeated query token, as blind clients may send, counts each time. ``keep``
    are further columns of ``postings`` that identify an entry.
    """
    kind, wanted, bounded = plan_of(mode, words, trigrams)
    total = len(wanted)
    counts: dict[str, int] = {}
    for t in wanted:
        counts[t] = counts.get(t, 0) + 1
    query = frame(postings.sparkSession, list(counts.items()), "token string, uses int")
    rows = postings.where(F.col("kind") == kind)
    if 0 < len(counts) <= PUSHED_TOKENS:
        rows = rows.where(F.col("token").isin(list(counts)))
    # As large as one query.
    n = rows.join(F.broadcast(query), "token").groupBy("entry_id", *keep).agg(F.sum("uses").alias("n"), F.count(F.lit(1)).alias("different"))
    if mode == "exact":
        whole = n.where(F.col("different") == len(counts)).select("entry_id", *keep, F.lit(1.0).alias("score"))
        return whole, whole
    every = n.select("entry_id", *keep, (F.col("n") / F.lit(max(1, total))).cast("double").alias("score"))
    return every, every.where(F.col("score") >= limits.of(mode)) if bounded else every


def top(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` hits, ties by id: a bounded heap in each task."""
    return hits.orderBy(F.desc("score"), "entry_id").limit(limit)


def stats(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: how many candidates were looked at and how many matched."""
    return candidates.agg(F.count(F.lit(1)).alias("scanned")).withColumn("k", F.lit(0)).join(hits.agg(F.count(F.lit(1)).alias("matched")).withColumn("k", F.lit(0)), "k").drop("k")


def batch(lists: DataFrame, live: Callable[[DataFrame], DataFrame], live_lists: Callable[[DataFrame], DataFrame], queries: DataFrame, limits: Thresholds = Thresholds(), limit: int = 100) -> DataFrame:
    """(query_id, entry_id, score, rank) for a table of queries.

    ``queries`` has query_id, mode, words and trigrams (lists in the postings' form);
    ``live`` and ``live_lists`` drop what later segments replaced from rows and from
    lists. Query tokens are broadcast when they are few; all lists of a block that they
    meet are then counted in one place, and only the block's best entries of each query
    leave it. With many, both sides are shuffled on the token and counted by entry. The
    best entries of each query are ranked in the end.
    """
    by_words = F.col("mode").isin("exact", "contains") | (F.size("trigrams") == 0)
    q = queries.select("query_id", "mode", F.when(by_words, WORD).otherwise(TRIGRAM).alias("kind"), F.when(by_words, F.col("words")).otherwise(F.col("trigrams")).alias("tokens"), (~by_words).alias("bounded"))
    tokens = q.select("query_id", "kind", F.explode("tokens").alias("token")).groupBy("query_id", "kind", "token").agg(F.count(F.lit(1)).alias("uses"))
    least: Column = F.when(~F.col("bounded"), 0.0).when(F.col("mode") == "prefix", limits.prefix).otherwise(limits.fuzzy)
    about = q.select("query_id", (F.col("mode") == "exact").alias("exact"), least.alias("least"), F.size("tokens").alias("total"), F.size(F.array_distinct("tokens")).alias("distinct_total"))
    # Counted from the queries themselves; nothing is kept in memory for a lazy result.
    if q.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_ROWS:
        # Exact mode counts different tokens, the others each use.
        use = F.struct("query_id", F.when(F.col("exact"), 1).otherwise(F.col("uses")).cast("int").alias("uses"), F.when(F.col("exact"), F.col("distinct_total")).otherwise(F.col("total")).alias("total"), F.when(F.col("exact"), 1.0).otherwise(F.col("least")).alias("least"))
        asked = tokens.join(about, "query_id").groupBy("kind", "token").agg(F.collect_list(use).alias("used"))
        met = live_lists(lists.join(F.broadcast(asked.select("kind", "token")), ["kind", "token"], "left_semi")).join(F.broadcast(asked), ["kind", "token"]).select("block", "entry_ids", "used")
        kept = met.groupBy("block").applyInArrow(_counter(limit), f"query_id {q.schema['query_id'].dataType.simpleString()}, entry_id string, score double")
    else:
        rows = lists.join(tokens, ["kind", "token"]).select("query_id", "uses", "segment", F.explode("entry_ids").alias("entry_id"))
        n = live(rows).groupBy("query_id", "entry_id").agg(F.sum("uses").alias("n"), F.count(F.lit(1)).alias("different"))
        score = F.when(F.col("exact"), 1.0).otherwise(F.col("n") / F.col("total"))
        kept = n.join(about, "query_id").where(~F.col("exact") | (F.col("different") == F.col("distinct_total"))).select("query_id", "entry_id", score.alias("score"), "least").where("score >= least")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "entry_id", "score", F.col("rank").cast("int").alias("rank"))


def _counter(limit: int, most_cells: int = 4_000_000) -> Callable:
    """Scores of one block's entries, the best ``limit`` of each query.

    Entries are counted for as many queries at once as make ``most_cells`` counts.
    """

    def run(table):  # noqa: ANN001, ANN202  Spark looks at annotations here
        import numpy as np
        import pyarrow as pa

        whole = lambda name: pa.concat_arrays(table[name].chunks)
        held, used = whole("entry_ids"), whole("used")
        fields = used.flatten()
        names = ["query_id", "entry_id", "score"]
        asked = fields.field("query_id").dictionary_encode()
        numbers = lambda name: fields.field(name).to_numpy(zero_copy_only=False)
        ids = held.flatten().dictionary_encode()
        # In Spark's order of texts, that of their bytes.
        texts = ids.dictionary.cast(pa.binary()).to_pylist()
        order = sorted(range(len(texts)), key=texts.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        entries = place[ids.indices.to_numpy(zero_copy_only=False)]
        ends = held.offsets.to_numpy().astype(np.int64) - held.offsets[0].as_py()
        query = asked.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(held)), np.diff(used.offsets.to_numpy()))
        uses, d, k = numbers("uses"), len(order), len(asked.dictionary)
        total, least = np.ones(k, np.int64), np.zeros(k)
        total[query], least[query] = numbers("total"), numbers("least")
        by_query = np.argsort(query, kind="stable")
        query, row, uses = query[by_query], row[by_query], uses[by_query]
        out, step = [], max(1, most_cells // max(1, d))
        for a in range(0, k, step):
            b = min(a + step, k)
            n = np.zeros((b - a, d), np.int64)
            lo, hi = np.searchsorted(query, (a, b))
            for i in range(lo, hi):
                n[query[i] - a, entries[ends[row[i]] : ends[row[i] + 1]]] += uses[i]
            score = n / total[a:b, None]
            # Larger counts first, then earlier ids.
            rank = np.where((n > 0) & (score >= least[a:b, None]), n * d + (d - 1 - np.arange(d)), -1)
            if limit < d:
                best = np.argpartition(-rank, limit, axis=1)[:, :limit]
            else:
                best = np.broadcast_to(np.arange(d), rank.shape)
            at, which = np.nonzero(np.take_along_axis(rank, best, axis=1) >= 0)
            found = best[at, which]
            out.append((at + a, np.array(order, np.int64)[found], score[at, found]))
        at, found, score = (np.concatenate([x[i] for x in out]) for i in range(3))
        return pa.Table.from_arrays([asked.dictionary.take(pa.array(at)), ids.dictionary.take(pa.array(found)), pa.array(score)], names=names)

    return run
