"""Index storage on any file system that Spark reaches.

    <root>/keys/<index>.json                     key, apart from the data
    <root>/indexes/<index>/manifest.json         record, live segments, entry count
    <root>/indexes/<index>/<segment>/entries    entry_id, version, deleted, words, trigrams, seq
    <root>/indexes/<index>/<segment>/made/part=1    postings: kind, token, entry_ids, block (files sorted by token)
    <root>/indexes/<index>/<segment>/replaced   ids of the segment that older ones hold too

Entries have the sizes of their token lists; the tokens stand in the postings alone, once
for each block of entries (see ``functions/invert.py``).

A write adds one segment, whose name no other writer can draw, and then replaces the
manifest by a rename, so a crash in between leaves the old state. The newest segment
that names an entry decides. Searches read postings and, if any id was written twice,
the replaced ids; never the entries. When segments are many, the newest ones are
merged as far as they are not much smaller than the next older one. A writer whose
manifest is no longer the stored one fails; one process's writers wait in line.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushdex.errors import StoreError
from hushdex.functions.invert import inverted
from hushdex.sources.local import frame, small_batches

ENTRY = "entry_id string, version bigint, deleted boolean, words bigint, trigrams bigint, seq bigint"
POSTING = "kind string, token string, entry_ids array<string>, block bigint"
#: Folders of what is made of entries in one pass: sizes of their lists (kept in ``entries``), and postings.
SIZES, POSTINGS = "made/part=0", "made/part=1"
#: Of the files above; indexes of another layout are refused.
LAYOUT = 2
#: Segments after which a write merges some.
MAX_SEGMENTS = 8
#: A segment is merged with newer ones that together have this share of its rows.
TIER = 0.5
#: Ids up to which a look at entries filters them where they are read.
PUSHED_IDS = 500


@dataclass
class Segment:
    number: int
    name: str
    rows: int
    replaced: int
    #: Whether there are any.
    postings: bool = True


@dataclass
class Manifest:
    name: str
    created_at: int
    tokenizer_version: int = 1
    segments: list[Segment] = field(default_factory=list)
    next_segment: int = 0
    entry_count: int = 0
    layout: int = 1


_locks: dict[tuple[str, str], threading.RLock] = {}
_lock = threading.Lock()


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- small files --------------------------------------------------------------

    def _read(self, path: str) -> dict | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            return json.loads(data)
        except ValueError as e:
            raise StoreError(f"corrupt record {path}") from e

    def _write(self, path: str, value: dict) -> None:
        """Write beside the old file, then put it in place by a rename."""
        new = self._path(f"{path}.{uuid.uuid4().hex}")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        old = self._path(path)
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, old, options)

    def _drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # -- records ------------------------------------------------------------------

    def _home(self, name: str) -> str:
        return f"{self.root}/indexes/{name}"

    def names(self) -> list[str]:
        p = self._path(f"{self.root}/indexes")
        if not self._fs.exists(p):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(p)]
        return sorted(n for n in found if self._fs.exists(self._path(f"{self._home(n)}/manifest.json")))

    def load(self, name: str) -> Manifest | None:
        path = f"{self._home(name)}/manifest.json"
        got = self._read(path)
        for _ in range(20):
            if got is not None or not self._fs.exists(self._path(self._home(name))):
                break
            time.sleep(0.01)  # not every file system replaces a file in one step
            got = self._read(path)
        if got is None:
            return None
        try:
            m = Manifest(**(got | {"segments": [Segment(**s) for s in got["segments"]]}))
        except (TypeError, KeyError) as e:
            raise StoreError(f"corrupt record of index {name}") from e
        if m.layout != LAYOUT:
            raise StoreError(f"index {name} has files of layout {m.layout}, this is layout {LAYOUT}: fill it anew")
        return m

    def writing(self, name: str) -> threading.RLock:
        """The lock of an index's writers in this process."""
        with _lock:
            return _locks.setdefault((self.root, name), threading.RLock())

    def create(self, name: str, key: bytes, version: int, now: int | None = None) -> Manifest:
        self._write(f"{self.root}/keys/{name}.json", {"key": key.hex()})
        m = Manifest(name, int(time.time()) if now is None else now, version, layout=LAYOUT)
        self._save(m)
        return m

    def _save(self, m: Manifest, before: Manifest | None = None) -> None:
        """Store a record; with ``before``, only if that one is still the stored one."""
        if before is not None and self.load(m.name) != before:
            raise StoreError(f"index {m.name} was changed by another writer")
        self._write(f"{self._home(m.name)}/manifest.json", asdict(m))

    def key(self, name: str) -> bytes:
        got = self._read(f"{self.root}/keys/{name}.json")
        if got is None:
            raise StoreError(f"no key for index {name}")
        return bytes.fromhex(got["key"])

    # -- data ---------------------------------------------------------------------

    def _all(self, m: Manifest, part: str, ddl: str, segments: list[Segment] | None = None) -> DataFrame:
        frames = [self.spark.read.schema(ddl).parquet(f"{self._home(m.name)}/{g.name}/{part}").withColumn("segment", F.lit(g.number)) for g in (m.segments if segments is None else segments)]
        if not frames:
            return frame(self.spark, [], ddl + ", segment int")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def latest(self, m: Manifest, ids: DataFrame | None = None, segments: list[Segment] | None = None) -> DataFrame:
        """The newest row of every entry, of deleted ones too; with ``ids``, a table of
        distinct entry_ids, only theirs. A few ids are looked up by pushed filters."""
        every = self._all(m, "entries", ENTRY, segments)
        if ids is not None and m.segments:
            few = [r["entry_id"] for r in ids.select("entry_id").limit(PUSHED_IDS + 1).collect()]
            every = every.where(F.col("entry_id").isin(few)) if len(few) <= PUSHED_IDS else every.join(ids.select("entry_id"), "entry_id", "left_semi")
        if len(m.segments if segments is None else segments) > 1:
            newest = Window.partitionBy("entry_id").orderBy(F.desc("segment"))
            every = every.withColumn("age", F.row_number().over(newest)).where("age = 1").drop("age")
        return every.select("entry_id", "version", "deleted", "words", "trigrams", "seq")

    def entries(self, m: Manifest, ids: DataFrame | None = None) -> DataFrame:
        """Live entries: entry_id, version, words, trigrams, seq; see ``latest``."""
        return self.latest(m, ids).where("not deleted").drop("deleted")

    def lists(self, m: Manifest, segments: list[Segment] | None = None) -> DataFrame:
        """All postings lists, with the segment they come from; see ``live_lists``."""
        return self._all(m, POSTINGS, POSTING, [g for g in (m.segments if segments is None else segments) if g.postings])

    def postings(self, m: Manifest) -> DataFrame:
        """(kind, token, entry_id, segment) of all postings; see ``live``."""
        return self.lists(m).select("kind", "token", F.explode("entry_ids").alias("entry_id"), "segment")

    def live(self, m: Manifest, rows: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        """Drop rows (entry_id, segment, ...) that a later segment replaced.

        Only ids that were written more than once are looked at.
        """
        again = [g for g in (m.segments if segments is None else segments) if g.replaced]
        if not again:
            return rows.drop("segment")
        last = self._all(m, "replaced", "entry_id string", again).groupBy("entry_id").agg(F.max("segment").alias("last"))
        return rows.join(last, "entry_id", "left").where("last is null or segment >= last").drop("segment", "last")

    def live_lists(self, m: Manifest, lists: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        """Lists (POSTING columns and segment) without ids that a later segment replaced."""
        if not any(g.replaced for g in (m.segments if segments is None else segments)):
            return lists.drop("segment")
        rows = self.live(m, lists.select("kind", "token", "block", F.explode("entry_ids").alias("entry_id"), "segment"), segments)
        return rows.groupBy("kind", "token", "block").agg(F.collect_list("entry_id").alias("entry_ids")).select("kind", "token", "entry_ids", "block")

    def draw(self, m: Manifest) -> str:
        """Name of a new segment."""
        return f"segment-{m.next_segment}-{uuid.uuid4().hex}"

    def stage(self, m: Manifest, name: str, rows: DataFrame, key: bytes | None = None) -> DataFrame:
        """Write the postings of a segment and return the sizes of its entries' lists, read
        back; see ``inverted`` for the rows and the key."""
        small_batches(self.spark)
        at = f"{self._home(m.name)}/{name}"
        made = inverted(rows, key).sortWithinPartitions("part", "kind", "token")
        made.write.partitionBy("part").option("compression", "zstd").parquet(f"{at}/made")
        ddl = "entry_id string, words bigint, trigrams bigint, seq bigint"
        return self.spark.read.schema(ddl).parquet(f"{at}/{SIZES}") if self._fs.exists(self._path(f"{at}/{SIZES}")) else frame(self.spark, [], ddl)

    def append(self, m: Manifest, rows: DataFrame, entry_count: int) -> Manifest:
        """Add a segment of rows (ENTRY columns, but lists of tokens, and ``again``: older
        segments hold the id; one row for each id)."""
        name = self.draw(m)
        made = self.stage(m, name, rows.where("not deleted")).select("entry_id", "words", "trigrams")
        return self.add(m, name, rows.drop("words", "trigrams").join(made, "entry_id", "left"), entry_count)

    def add(self, m: Manifest, name: str, rows: DataFrame, entry_count: int | None = None) -> Manifest:
        """Add a segment whose postings, if there are any, are written; rows have ENTRY
        columns and ``again``. Without a count, it follows from the versions."""
        g, change = self._written(m, name, rows)
        if not g.rows:
            self._drop(f"{self._home(m.name)}/{name}")
            return m
        new = replace(m, segments=[*m.segments, g], next_segment=g.number + 1, entry_count=max(0, m.entry_count + change) if entry_count is None else entry_count)
        self._save(new, m)
        return self.merge(new) if len(new.segments) > MAX_SEGMENTS else new

    def set_aside(self, m: Manifest, rows: DataFrame) -> DataFrame:
        """A table beside the index's segments, read back: it outlives what it was made from."""
        at = f"{self._home(m.name)}/aside-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _written(self, m: Manifest, name: str, rows: DataFrame) -> tuple[Segment, int]:
        """The segment, and by how many its rows change the number of live entries."""
        at = f"{self._home(m.name)}/{name}"
        held = rows.select("entry_id", "version", "deleted", "words", "trigrams", "seq", "again").sortWithinPartitions("entry_id")
        held.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#entry_id", "true").parquet(f"{at}/entries")
        self._drop(f"{at}/{SIZES}")
        own = self.spark.read.schema(ENTRY + ", again boolean").parquet(f"{at}/entries")
        one = lambda what: F.count(F.when(F.expr(what), 1))
        counts = own.agg(F.count(F.lit(1)).alias("rows"), one("again").alias("again"), (one("not deleted and version = 1") - one("deleted and version > 0")).alias("change")).first()
        if counts["again"]:
            own.where("again").select("entry_id").write.option("compression", "zstd").parquet(f"{at}/replaced")
        return Segment(m.next_segment, name, counts["rows"], counts["again"], self._fs.exists(self._path(f"{at}/{POSTINGS}"))), counts["change"]

    def merge(self, m: Manifest) -> Manifest:
        """Write the newest segments as one: two at least, and older ones as long as
        those newer than them are not much smaller."""
        k, rows = len(m.segments) - 1, m.segments[-1].rows
        while k > 0 and (k == len(m.segments) - 1 or rows >= TIER * m.segments[k - 1].rows):
            k -= 1
            rows += m.segments[k].rows
        old, some = m.segments[:k], m.segments[k:]
        again = [g for g in some if g.replaced]
        ids = self._all(m, "replaced", "entry_id string", again).select("entry_id").distinct().withColumn("again", F.lit(True)) if again and old else None
        every = self.latest(m, None, some)
        every = every.join(ids, "entry_id", "left").withColumn("again", F.coalesce("again", F.lit(False))) if ids is not None else every.withColumn("again", F.lit(False))
        # A deleted entry is kept while an older segment has it, or a later event may be about it.
        name = self.draw(m)
        lists = self.live_lists(m, self.lists(m, some), some)
        if any(g.postings for g in some):
            lists.repartitionByRange("kind", "token", "block").sortWithinPartitions("kind", "token").write.option("compression", "zstd").parquet(f"{self._home(m.name)}/{name}/{POSTINGS}")
        g, _ = self._written(m, name, every.where("not deleted or again or seq is not null"))
        new = replace(m, segments=[*old, g], next_segment=g.number + 1)
        self._save(new, m)
        for x in some:
            self._drop(f"{self._home(m.name)}/{x.name}")
        return new

    def clear(self, m: Manifest, **change: object) -> Manifest:
        """Forget all entries; ``change`` replaces fields of the record."""
        new = replace(m, segments=[], entry_count=0, **change)
        self._save(new, m)
        for g in m.segments:
            self._drop(f"{self._home(m.name)}/{g.name}")
        return new

    def rotate(self, m: Manifest, key: bytes, now: int) -> Manifest:
        """A new key first: what is left of the old data is unreadable from then on."""
        self._write(f"{self.root}/keys/{m.name}.json", {"key": key.hex()})
        return self.clear(m, created_at=now)

    def destroy(self, m: Manifest) -> None:
        self._drop(f"{self.root}/keys/{m.name}.json")
        self._drop(self._home(m.name))
