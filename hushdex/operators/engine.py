"""Indexes: create, fill, search, maintain. Commands end up here, DataFrames may start here."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushdex.errors import EntryNotFound, IndexExists, IndexNotFound, InvalidArgument
from hushdex.functions import blind, extract, invert, keys, tokens
from hushdex.operators import search as ops
from hushdex.plans.guard import Guard
from hushdex.sources.local import frame
from hushdex.sources.store import Manifest, Store

_NAME = re.compile(r"[A-Za-z0-9_-]{1,255}")


@dataclass(frozen=True)
class Config:
    default_result_limit: int = 100
    #: 0 stands for no limit.
    max_entries_per_index: int = 0
    require_audit: bool = False
    require_policy: bool = False
    prefix_threshold: float = 0.6
    fuzzy_threshold: float = 0.3

    @property
    def thresholds(self) -> ops.Thresholds:
        return ops.Thresholds(self.prefix_threshold, self.fuzzy_threshold)


@dataclass(frozen=True)
class IndexInfo:
    name: str
    created_at: int
    entry_count: int
    tokenizer_version: int


@dataclass(frozen=True)
class SearchResult:
    """Lazy: ``hits`` (entry_id, score) in order, ``stats`` one row (scanned, matched)."""

    hits: DataFrame
    stats: DataFrame


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise InvalidArgument("an index name has 1 to 255 letters, digits, - or _")
    return name


def last_of_each(rows: DataFrame) -> DataFrame:
    """One row for each entry_id: the one of the largest ``order_``."""
    w = Window.partitionBy("entry_id").orderBy(F.desc("order_"))
    return rows.withColumn("age_", F.row_number().over(w)).where("age_ = 1").drop("age_", "order_")


class Engine:
    """``store`` may be any object with the methods of ``Store``, for other places to keep indexes."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), guard: Guard | None = None, store: Store | None = None) -> None:
        self.guard = guard or Guard()
        self.guard.require(config.require_policy, config.require_audit)
        self.spark, self.config, self.store = spark, config, store or Store(spark, root)
        for name in self.store.names():
            self.store.load(name)  # a corrupt record stops the start

    # -- lifecycle ----------------------------------------------------------------

    def _get(self, name: str) -> Manifest:
        m = self.store.load(name) if _NAME.fullmatch(name) else None
        if m is None:
            raise IndexNotFound(name)
        return m

    def _current(self, name: str) -> Manifest:
        m = self._get(name)
        if m.tokenizer_version != tokens.TOKENIZER_VERSION:
            raise InvalidArgument(f"the entries of {name!r} were cut into tokens by rules {m.tokenizer_version}, these are rules {tokens.TOKENIZER_VERSION}: INDEX REINDEX empties the index for them")
        return m

    def _info(self, m: Manifest) -> IndexInfo:
        return IndexInfo(m.name, m.created_at, m.entry_count, m.tokenizer_version)

    def create(self, name: str, actor: str | None = None) -> IndexInfo:
        self.guard.allow(name, "index_create", actor)
        with self.guard.audited("INDEX_CREATE", name, actor), self.store.writing(check_name(name)):
            if self.store.load(name):
                raise IndexExists(name)
            m = self.store.create(name, keys.generate(), tokens.TOKENIZER_VERSION)
        return self._info(m)

    def seed(self, names: list[str]) -> None:
        """Create what is not there yet; no policy, no audit."""
        for name in names:
            with self.store.writing(check_name(name)):
                if not self.store.load(name):
                    self.store.create(name, keys.generate(), tokens.TOKENIZER_VERSION)

    def rotate(self, name: str, actor: str | None = None) -> IndexInfo:
        """New key, no entries, and ``created_at`` set to now."""
        self.guard.allow(name, "index_rotate", actor)
        with self.guard.audited("INDEX_ROTATE", name, actor), self.store.writing(name):
            m = self.store.rotate(self._get(name), keys.generate(), int(time.time()))
        return self._info(m)

    def destroy(self, name: str, actor: str | None = None) -> int:
        self.guard.allow(name, "index_destroy", actor)
        with self.guard.audited("INDEX_DESTROY", name, actor), self.store.writing(name):
            m = self._get(name)
            self.store.destroy(m)
        return m.entry_count

    def reindex(self, name: str, actor: str | None = None) -> tuple[IndexInfo, int]:
        """Same key and age, current token rules, no entries."""
        self.guard.allow(name, "index_reindex", actor)
        with self.guard.audited("INDEX_REINDEX", name, actor), self.store.writing(name):
            old = self._get(name)
            m = self.store.clear(old, tokenizer_version=tokens.TOKENIZER_VERSION)
        return self._info(m), old.entry_count

    def names(self) -> list[str]:
        return self.store.names()

    def info(self, name: str) -> IndexInfo:
        return self._info(self._get(name))

    def catalog(self) -> DataFrame:
        """name, created_at, tokenizer_version, entry_count; ordered by name."""
        rows = [(m.name, m.created_at, m.tokenizer_version, m.entry_count) for n in self.names() if (m := self.store.load(n))]
        return frame(self.spark, rows, "name string, created_at bigint, tokenizer_version int, entry_count bigint")

    # -- tokens -------------------------------------------------------------------

    def _blinded(self, name: str, rows: DataFrame, text: Column) -> DataFrame:
        table = blind.key_table(self.spark, {name: self.store.key(name)})
        return blind.blinded(rows.withColumn("index", F.lit(name)), tokens.token_set(text), table).drop("index")

    def _blind_text(self, name: str, text: str) -> tuple[list[str], list[str]]:
        """Token set of one short text. ASCII needs no Unicode rules and so no Spark;
        other texts go through the same column expressions as entries do."""
        if text.isascii():
            return blind.BlindKey(self.store.key(name)).tokenize(text)
        row = self._blinded(name, frame(self.spark, [(text,)], "text string"), F.col("text")).first()
        return list(row["tokens"]["words"]), list(row["tokens"]["trigrams"])

    @staticmethod
    def _decode(data: str) -> bytes:
        try:
            return blind.decode_base64(data)
        except ValueError as e:
            raise InvalidArgument(str(e)) from e

    def tokenize(self, name: str, data: str, field: str | None = None) -> tuple[list[str], list[str]]:
        self._current(name)
        return self._blind_text(name, extract.text_of(self._decode(data), field))

    # -- entries ------------------------------------------------------------------

    def put(self, name: str, entry: str, data: str, field: str | None = None, is_blind: bool = False, actor: str | None = None) -> int:
        """Add or replace one entry; ``data`` is base64. Returns its version."""
        self.guard.allow(name, "put", actor)
        if not entry:
            raise InvalidArgument("entry id is empty")
        with self.guard.audited("PUT", f"{name}/{entry}", actor), self.store.writing(name):
            if is_blind:
                m = self._get(name)
                self._decode(data)
                try:
                    words, trigrams = blind.decode_set(data)
                    blind.check_hex(words, trigrams)
                except ValueError as e:
                    raise InvalidArgument(str(e)) from e
            else:
                m = self._current(name)
                words, trigrams = self._blind_text(name, extract.text_of(self._decode(data), field))
            rows = frame(self.spark, [(entry, words, trigrams)], "entry_id string, words array<string>, trigrams array<string>")
            if self._add(m, rows).first():
                raise InvalidArgument(f"index '{name}' is full: {self.config.max_entries_per_index} entries")
            version = self.store.entries(self._get(name), rows).first()["version"]
        return version

    def _add(self, m: Manifest, rows: DataFrame, gone: DataFrame | None = None, key: bytes | None = None) -> DataFrame:
        """Write entries and the removal of the ids ``gone`` (entry_id, seq) as one segment,
        one row for each id; rejected ids come back.

        Rows have tokens, or with a key plain words, as ``invert.inverted`` takes them. An
        id that is there gets the next version and is always written. New ids are
        admitted in their order as far as there is room.
        """
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(None).cast("bigint"))
        refused, most, held = frame(self.spark, [], "entry_id string"), self.config.max_entries_per_index, None
        try:
            if most:  # only a limit has to know the ids before the entries are written
                held = rows = rows.persist()
                # Asked for apart: Spark 4.1 takes a union of two tables dealt by id for one dealt
                # by id, and a join with it fails if their partitions differ in number at last.
                known = self.store.entries(m, held.select("entry_id")).select("entry_id")
                fresh = held.select("entry_id").join(known, "entry_id", "left_anti")
                leave = self.store.entries(m, gone.select("entry_id")).count() if gone is not None else 0
                room = max(0, most - m.entry_count + leave)
                if fresh.count() > room:
                    refused = self.store.set_aside(m, fresh.join(fresh.orderBy("entry_id").limit(room), "entry_id", "left_anti"))
                    rows = rows.join(refused, "entry_id", "left_anti")
            name = self.store.draw(m)
            made = self.store.stage(m, name, rows, key).withColumn("deleted", F.lit(False))
            if gone is not None:
                size = F.lit(0).cast("bigint")
                made = made.unionByName(gone.select("entry_id", size.alias("words"), size.alias("trigrams"), "seq", F.lit(True).alias("deleted")))
            # Ids with a row in an older segment, a deleted one too, are replaced there.
            old = self.store.latest(m, made.select("entry_id")).select("entry_id", F.when(~F.col("deleted"), F.col("version")).alias("old"), F.lit(True).alias("again"))
            version = F.coalesce(F.col("old"), F.lit(0)) + F.when(F.col("deleted"), 0).otherwise(1)
            self.store.add(m, name, made.join(old, "entry_id", "left").select("entry_id", version.cast("bigint").alias("version"), "deleted", "words", "trigrams", "seq", F.coalesce("again", F.lit(False)).alias("again")))
            return refused
        finally:
            if held is not None:
                held.unpersist()

    def put_frame(self, name: str, rows: DataFrame, entry: str = "entry_id", text: str = "text", order: Column | None = None, actor: str | None = None, field: Column | str | None = None) -> DataFrame:
        """Add or replace many entries at once; returns (entry_id, reason) of refused rows.

        ``text`` is indexed as it is, or through JSON extraction if it is binary or if
        a ``field`` is named (a name, or a column of names, null for all strings). Of
        several rows of an id the last by ``order`` counts, without it the one of the
        largest text. Rows without an id are refused, as are new ids beyond the
        index's capacity.
        """
        self.guard.allow(name, "put", actor)
        with self.guard.audited("PUT", f"{name}/*", actor), self.store.writing(name):
            m = self._current(name)
            # Cutting texts costs far more than moving them: spread the rows, by the key that the
            # steps below need anyway. A stated number is not coalesced by size.
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            got = rows.select(F.col(entry).cast("string").alias("entry_id"), self._plain(rows, text, field).alias("text"), (F.col(text) if order is None else order).alias("order_")).repartition(parts, "entry_id")
            bad = got.where("entry_id is null or entry_id = ''").select("entry_id", F.lit("entry id is empty").alias("reason"))
            words = last_of_each(got.where("entry_id <> ''")).select("entry_id", invert.cut(F.col("text")).alias("words"))
            rejected = self._add(m, words, key=self.store.key(name))
        return bad.unionByName(rejected.select("entry_id", F.lit("index is full").alias("reason")))

    def put_blind_frame(self, name: str, rows: DataFrame, entry: str = "entry_id", data: str = "data", order: Column | None = None, actor: str | None = None) -> DataFrame:
        """Like ``put_frame`` for wire token sets that clients made; malformed ones are refused."""
        self.guard.allow(name, "put", actor)
        with self.guard.audited("PUT", f"{name}/*", actor), self.store.writing(name):
            m = self._get(name)
            got = rows.select(F.col(entry).cast("string").alias("entry_id"), F.col(data).alias("data"), (F.col(data) if order is None else order).alias("order_"))
            # What a row's data is made of may be costly. A map over batches, past which no filter
            # moves, has it worked out and decoded once, not for each use of a list.
            got = got.select("entry_id", blind.checked(F.col("data")).alias("set"), "order_").select("entry_id", "set.words", "set.trigrams", "order_")
            got = got.mapInArrow(lambda batches: batches, got.schema)
            ok = F.coalesce(F.col("entry_id") != "", F.lit(False)) & F.col("words").isNotNull() & F.col("trigrams").isNotNull()
            bad = got.where(~ok).select("entry_id", F.lit("invalid blind tokens").alias("reason"))
            rejected = self._add(m, last_of_each(got.where(ok)).select("entry_id", "words", "trigrams"))
        return bad.unionByName(rejected.select("entry_id", F.lit("index is full").alias("reason")))

    @staticmethod
    def _plain(rows: DataFrame, text: str, field: Column | str | None) -> Column:
        if rows.schema[text].dataType.typeName() == "binary":
            return extract.extracted(F.col(text), field)
        return F.col(text) if field is None else extract.extracted(F.encode(F.col(text), "UTF-8"), field)

    def apply_frame(self, name: str, events: DataFrame, actor: str | None = None) -> DataFrame:
        """Apply (entry_id, op, text, seq) rows, op being put or delete, in one write.

        The event of the largest seq decides about an id, here and over all calls: one
        that is not later than what was applied to its id changes nothing. Returns
        (entry_id, reason) of refused rows.
        """
        self.guard.allow(name, "put", actor)
        self.guard.allow(name, "delete", actor)
        with self.guard.audited("APPLY", f"{name}/*", actor), self.store.writing(name):
            m = self._current(name)
            last = events.where("entry_id <> '' and seq is not null").groupBy("entry_id").agg(F.max_by(F.struct("op", "text"), "seq").alias("e"), F.max("seq").alias("seq"))
            last = last.select("entry_id", "e.op", "e.text", "seq").persist()
            try:
                known = self.store.latest(m, last.select("entry_id")).select("entry_id", F.col("seq").alias("seen"))
                new = last.join(known, "entry_id", "left").where("seen is null or seq > seen")
                words = new.where("op = 'put'").select("entry_id", invert.cut(F.col("text")).alias("words"), "seq")
                rejected = self._add(m, words, new.where("op = 'delete'").select("entry_id", "seq"), self.store.key(name))
            finally:
                last.unpersist()
        return rejected.select("entry_id", F.lit("index is full").alias("reason"))

    def _remove(self, m: Manifest, ids: DataFrame) -> int:
        """Write tombstones for those of ``ids`` that are there; how many they were."""
        return self._bury(m, self.store.entries(m, ids.select("entry_id").distinct()))

    def _bury(self, m: Manifest, gone: DataFrame) -> int:
        """Write tombstones for live entries; how many they were."""
        gone = gone.select("entry_id", "version", "seq").persist()
        try:
            many = gone.count()
            if many:
                none = F.lit(0).cast("bigint")
                rows = gone.select("entry_id", "version", F.lit(True).alias("deleted"), none.alias("words"), none.alias("trigrams"), "seq", F.lit(True).alias("again"))
                self.store.add(m, self.store.draw(m), rows, max(0, m.entry_count - many))
            return many
        finally:
            gone.unpersist()

    def delete(self, name: str, entry: str, actor: str | None = None) -> None:
        self.guard.allow(name, "delete", actor)
        with self.guard.audited("DELETE", f"{name}/{entry}", actor), self.store.writing(name):
            if not self._remove(self._get(name), frame(self.spark, [(entry,)], "entry_id string")):
                raise EntryNotFound(name, entry)

    def delete_frame(self, name: str, ids: DataFrame, actor: str | None = None) -> int:
        """Remove all entries whose entry_id is in ``ids``; absent ones are no error."""
        self.guard.allow(name, "delete", actor)
        with self.guard.audited("DELETE", f"{name}/*", actor), self.store.writing(name):
            return self._remove(self._get(name), ids)

    def reconcile(self, name: str, valid: list[str] | DataFrame, actor: str | None = None, allow_empty: bool = False) -> int:
        """Remove entries that are not in ``valid``; returns how many there were."""
        with self.guard.audited("RECONCILE", f"{name}/*", actor), self.store.writing(name):
            m = self._get(name)
            ids = valid if isinstance(valid, DataFrame) else frame(self.spark, [(v,) for v in valid], "entry_id string")
            if not allow_empty and ids.isEmpty():
                raise InvalidArgument("no valid ids: this would remove all entries")
            return self._bury(m, self.store.entries(m).join(ids.select("entry_id"), "entry_id", "left_anti"))

    # -- search -------------------------------------------------------------------

    def search(self, name: str, query: str, mode: str = "contains", field: str | None = None, limit: int | None = None, is_blind: bool = False, actor: str | None = None) -> SearchResult:
        """Best entries for a query text, or for a client's wire token set.

        ``field`` is accepted and has no effect: entries keep one token set each.
        """
        self.guard.allow(name, "search", actor)
        if not query:
            raise InvalidArgument("query is empty")
        try:
            mode = ops.parse_mode(mode)
        except ValueError as e:
            raise InvalidArgument(str(e)) from e
        with self.guard.audited("SEARCH", name, actor):
            if is_blind:
                try:
                    words, trigrams = blind.decode_set(query)
                except ValueError as e:
                    raise InvalidArgument(str(e)) from e
                if not words and not trigrams:
                    raise InvalidArgument("blind query has no tokens")
                m = self._get(name)
            else:
                m = self._current(name)
                words, trigrams = self._blind_text(name, query)
            rows = self.store.postings(m)
            kind, wanted, _ = ops.plan_of(mode, words, trigrams)
            rows = self.store.live(m, rows.where((F.col("kind") == kind) & F.col("token").isin(wanted))) if 0 < len(wanted) <= ops.PUSHED_TOKENS else self.store.live(m, rows)
            every, hits = ops.scored(rows, mode, words, trigrams, self.config.thresholds)
            k = self.config.default_result_limit if limit is None else limit
            if k < 0:
                raise InvalidArgument("limit is negative")
        return SearchResult(ops.top(hits, k), ops.stats(every, hits))

    def search_frame(self, name: str, queries: DataFrame, limit: int | None = None, actor: str | None = None, is_blind: bool = False) -> DataFrame:
        """(query_id, entry_id, score, rank) for a table with query_id, query, mode.

        With ``is_blind`` queries are wire token sets that clients made. A table with
        an unknown mode, an empty query or a malformed token set is refused as a whole.
        """
        self.guard.allow(name, "search", actor)
        if limit is not None and limit < 0:
            raise InvalidArgument("limit is negative")
        with self.guard.audited("SEARCH", name, actor):
            m = self._get(name) if is_blind else self._current(name)
            q = queries.select("query_id", F.col("query").alias("text"), F.lower("mode").alias("mode"))
            if is_blind:
                q = q.withColumn("tokens", blind.unwire(F.col("text")))
                ok = F.coalesce(F.size("tokens.words") + F.size("tokens.trigrams") > 0, F.lit(False))
            else:
                ok = F.coalesce(F.col("text") != "", F.lit(False))
            mode = F.when(~F.coalesce(F.col("mode").isin(*ops.MODES), F.lit(False)), F.concat(F.lit("unknown match mode: "), F.coalesce("mode", F.lit("none"))))
            wrong = q.select("query_id", mode.when(~ok, "query is empty or malformed").alias("what")).where("what is not null").first()
            if wrong:
                raise InvalidArgument(f"query {wrong['query_id']}: {wrong['what']}")
            if not is_blind:
                q = self._blinded(name, q, F.col("text"))
            return ops.batch(self.store.lists(m), lambda rows: self.store.live(m, rows), lambda rows: self.store.live_lists(m, rows), q.select("query_id", "mode", "tokens.words", "tokens.trigrams"), self.config.thresholds, self.config.default_result_limit if limit is None else limit)
