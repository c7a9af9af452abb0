"""Shared helpers: scratch tables, document columns, byte-level word hashing."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder used when a session on a single machine names none, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver exits."""
    path = f"{scratch_root(spark)}/hushdex/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, table in _tables:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``saved``, in buckets of ``key``: joins on it don't shuffle this table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "hushdex_" + path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(partitions_for(spark), key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    _tables.append((spark, table))
    return spark.table(table)


#: A key of more rows than this, and than one in HOT_SHARE of all, is joined by broadcast.
HOT_ROWS, HOT_SHARE = 100_000, 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of ``left`` (of about ``rows`` rows) with one row for each key.

    ``right`` tells in its column rows, which is dropped, how many rows its key has on
    the left. Of keys with more than HOT_ROWS and one in HOT_SHARE of all rows there
    are HOT_SHARE at most: their rows are broadcast, and the left side's stay where
    they are. All others meet in a shuffle in which none is large.
    Where all rows together are no more than HOT_ROWS there is no such key.
    """
    if rows <= HOT_ROWS:
        return left.join(right.drop("rows"), key)
    most = max(HOT_ROWS, rows // HOT_SHARE)
    hot = F.broadcast(right.where(F.col("rows") > most).drop("rows"))
    cold = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("rows") <= most).drop("rows"), key)
    return left.join(hot, key).unionByName(cold)


#: Bits of a sieve for each row that it is made of, at most so many, and bits set for a row.
SIEVE_BITS, MOST_BITS, SIEVE_HASHES = 16, 1 << 27, 4


def sieve(wanted: DataFrame) -> Callable[..., Column]:
    """A test of as many columns as ``wanted`` has, of the same types: true for all its
    rows, nulls being equal, and for few others (a Bloom filter).

    So rows that a join would drop need not be shuffled for it. Beyond MOST_BITS more
    of the others pass, up to all of them: what passes has still to be joined.
    """
    spark = wanted.sparkSession
    bits = min(MOST_BITS, max(64, 1 << (wanted.count() * SIEVE_BITS).bit_length()))

    def places(columns: Iterable[Column | str]) -> list[Column]:
        h = F.xxhash64(*columns)
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
        return [(low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(SIEVE_HASHES)]

    at = wanted.select(F.explode(F.array(*places(wanted.columns))).alias("at"))
    held = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[held["word"].to_numpy()] = held["bits"].to_numpy()
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    table = spark.createDataFrame(pa.table({"bits": one}))

    def passes(*columns: Column | str) -> Column:
        found, all_words = F.lit(True), table.scalar()
        for p in places(columns):
            word = F.get(all_words, F.shiftright(p, 6).cast("int"))
            found = found & (F.bit_get(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found

    return passes


#: Rows of an Arrow batch: texts are long, and a batch exists in the JVM and in Python at once.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Also makes Arrow batches shorter, unless the session has a number of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # executors fetch the file from here as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = Path(folder) / f"{root.name}_{app}.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(made))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, fixed: tuple[str, ...] = ("doc_id", "text"), **more: Column) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``fixed`` under neutral names, and name -> neutral name.

    So columns of any name can be carried through an operator that adds its own.
    ``more`` are further columns, under their own names behind ``more_``.
    """
    rest = {c: f"carried_{k}" for k, c in enumerate(c for c in docs.columns if c not in fixed)}
    return docs.select(*fixed, *(F.col(f"`{c}`").alias(n) for c, n in rest.items()), *(c.alias(f"more_{n}") for n, c in more.items())), rest


def restored(got: DataFrame, docs: DataFrame, rest: dict[str, str], text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs`` with ``text`` put in; n_chars follows where ``changed``."""
    out = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(n) for c, n in rest.items()}
    if "n_chars" in rest:
        out["n_chars"] = F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return got.select(*(out[c].alias(c) for c in docs.columns))


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def id_fold(ids: list, n: int) -> np.ndarray:
    """The same fold on plain Python ids."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % n for i in ids], np.int64)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices, so that Python strings of few rows exist at a time."""
    give_back()
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    give_back()


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """Arrow types of a DDL schema string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about 8 MB of long values."""
    some: list[tuple] = []
    weight = 0
    for r in rows:
        some.append(r)
        weight += sum(len(x) for x in r if isinstance(x, (str, bytes)))
        if len(some) >= size or weight >= 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, weight = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# -- words as byte ranges, hashed in numpy ------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, 1 << 16)
        _pow[0], _pow[1] = _powers(_BASE, size), _powers(_INV, size)
    return _pow[0], _pow[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Byte classes of alphanumeric words: 0-9, a-z and every byte from 0x80 up.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Translation that lower-cases A-Z and turns all other ASCII separators to blanks.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if ALNUM[c] else 32 for c in range(256))
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Bytes whose words are hashed at once; numpy takes some twenty times as many.
HASH_BYTES = 1 << 20


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the alphanumeric words of ``data``, in text order."""
    data = data.translate(ALNUM_TABLE)
    out, at = [], 0
    while len(data) - at > HASH_BYTES:
        end = data.rfind(b" ", at + 1, at + HASH_BYTES)
        if end < 0:  # a longer word stays whole
            end = data.find(b" ", at + HASH_BYTES)
        if end < 0:
            break
        out.append(_word_hashes(data[at:end]))
        at = end
    out.append(_word_hashes(data[at:]))
    return np.concatenate(out) if len(out) > 1 else out[0]


def _word_hashes(data: bytes) -> np.ndarray:
    """Polynomial prefix sums give each word's hash, wherever it stands, without cutting strings."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([0], (a != 32).view(np.int8), [0])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MUL)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct sorted hashes of ``n``-word shingles; a shorter text is one shingle."""
    if not len(words):
        return words
    n = min(n, len(words))
    acc = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(acc)]
    return np.unique(mix64(acc))
