"""URL filters: a cascade of Bloom filters with exact answers and no join.

Level 1 holds the listed keys. The keys of the corpus that pass it without being
listed go into level 2, the listed keys that pass level 2 go into level 3, and so
on until none is left. For every key of the universe the first level that
rejects it tells whether it is listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import arrow_schema, saved, slices, to_batches

#: Keys of a level that the driver takes; larger levels are built where the keys lie.
DRIVER_KEYS = 200_000
#: Bytes of a stretch of a filter that is built in the cluster.
STRETCH = 65_536


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: Rules of the production query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Hosts whose pages are blocked where no rule fits, with all their subdomains.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    cut = len(rest) if cut < 0 else cut
    return rest[:cut].translate(_LOWER), rest[cut:]


def digest(key: str) -> tuple[int, int]:
    h = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")


_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    x = (x * 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
    return x ^ x >> 31


class Bloom:
    """Bloom filter with double hashing, salted by its level; eight bits to a byte."""

    def __init__(self, n: int, rate: float, level: int) -> None:
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / max(1, n) * math.log(2)))
        self.level = level
        self.bits = bytearray(-(-self.size // 8))

    def places(self, d: tuple[int, int]) -> list[int]:
        # Both halves are hashed anew for each level: keys that meet on one must not meet on all.
        a, b = _mixed(d[0] + self.level), _mixed(d[1] - self.level) | 1
        return [((a + k * b) & _MASK) % self.size for k in range(self.hashes)]

    def add(self, d: tuple[int, int]) -> None:
        for p in self.places(d):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, d: tuple[int, int]) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(d))


def filled(keys: Iterable[str], n: int, rate: float, level: int) -> Bloom:
    b = Bloom(n, rate, level)
    for k in keys:
        b.add(digest(k))
    return b


def filled_there(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """The same from a table (key), a stretch of bytes at a time; only the filter itself comes back."""
    b = Bloom(n, rate, level)
    ddl = "at bigint, bits binary"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = filled((k for x in batches for k in x.column(0).to_pylist()), n, rate, level).bits
        at = [k for k in range(0, len(part), STRETCH) if any(part[k : k + STRETCH])]
        for k in at:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bytes(part[k : k + STRETCH])], pa.binary())], names=["at", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(0, np.uint8)
        for x in batches:
            for at, raw in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if at == now:
                    bits |= np.frombuffer(raw, np.uint8)
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()], pa.binary())], names=["at", "bits"])
                now, bits = at, np.frombuffer(raw, np.uint8).copy()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bits.tobytes()], pa.binary())], names=["at", "bits"])

    for r in keys.select("key").mapInArrow(own, ddl).repartition("at").sortWithinPartitions("at").mapInArrow(either, ddl).toLocalIterator():
        b.bits[r["at"] : r["at"] + len(r["bits"])] = r["bits"]
    return b


class Cascade:
    """Exact membership of a list within a known universe."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def __contains__(self, d: tuple[int, int]) -> bool:
        for k, level in enumerate(self.levels):
            if d not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def first_rate(listed: int, universe: int) -> float:
    """False positives of the first level, so that about as many pass it as are listed."""
    return min(0.5, max(1, listed) / max(1, universe))


def cascade(levels: list[Bloom], out: Iterable[str], hold: Iterable[str]) -> Cascade:
    """``levels`` and those below them, for the keys ``hold`` that pass on the wrong side."""
    levels, hold, out = list(levels), set(hold), set(out)
    while hold:
        level = filled(hold, len(hold), 0.5, len(levels) + 1)
        levels.append(level)
        hold, out = {k for k in out if digest(k) in level}, hold
    return Cascade(levels)


def passing(keys: DataFrame, level: Bloom) -> DataFrame:
    """Those of the table's keys that the level lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [k for k in b.column(0).to_pylist() if digest(k) in level]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["key"])

    return keys.mapInArrow(run, "key string")


def cascade_there(first: Bloom, out: DataFrame, hold: DataFrame) -> Cascade:
    """``cascade`` for tables (key) of any size: level by level in the cluster, until
    the driver can take what is left. A level halves the keys that go on."""
    levels = [first]
    while (n := hold.count()) > DRIVER_KEYS or n and out.count() > DRIVER_KEYS:
        level = filled_there(hold, n, 0.5, len(levels) + 1)
        levels.append(level)
        hold, out = saved(passing(out, level), "passing"), hold
    return cascade(levels, (r["key"] for r in out.collect()) if n else (), (r["key"] for r in hold.collect()))


def suffixes(host: str, depth: int) -> list[str]:
    """``host`` and its parent domains, of at most ``depth`` labels, longest first."""
    parts = host.split(".")
    return [".".join(parts[k:]) for k in range(max(0, len(parts) - depth), len(parts))] if host else []


def candidate_keys(host: str, path: str, depth: int, lengths: tuple[int, ...]) -> list[str]:
    """Keys under which a list may hold a url, longest first, ties by text."""
    return sorted({h + path[:n] for h in suffixes(host, depth) for n in lengths if len(path) >= n}, key=lambda k: (-len(k), k))


def keys_of(pages: DataFrame, level: Bloom, depth: int, lengths: tuple[int, ...]) -> DataFrame:
    """Distinct keys under which a list may hold a url of ``pages``, those that pass the level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in slices(batches, 4096):
            rows: set[str] = set()
            for url in b.column(0).to_pylist():
                host, path = split_url(url)
                stem = host + " " + path[: max(lengths)]
                if stem in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(stem)
                rows |= {k for k in candidate_keys(host, path, depth, lengths) if digest(k) in level}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(rows), pa.string())], names=["key"])

    return pages.select("url").mapInArrow(run, "key string").distinct()


def build(pages: DataFrame, urls: int, listed: Iterable[str] | DataFrame, depth: int, lengths: tuple[int, ...]) -> Cascade:
    """The cascade of a list over all keys of the ``urls`` urls of ``pages``.

    ``listed`` is a collection or, for lists of any length, a table with a column key.
    """
    universe = urls * depth * len(lengths)
    if isinstance(listed, DataFrame):
        table = saved(listed.select("key").where("key is not null").distinct(), "listed")
        n = table.count()
        first = filled_there(table, n, first_rate(n, universe), 1)
        # Both sides are about as long as the list.
        false = keys_of(pages, first, depth, lengths).join(table, "key", "left_anti")
        return cascade_there(first, table, saved(false, "false"))
    own = frozenset(listed)
    first = filled(own, len(own), first_rate(len(own), universe), 1)
    # About as many rows as the list has keys, of which there are few: the first level's rate is set so.
    return cascade([first], own, {r["key"] for r in keys_of(pages, first, depth, lengths).collect()} - own)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed.

    The longest rule that fits decides. Without one, pages of a blocked host or
    of its subdomains are blocked and all others allowed. ``blocked`` is a
    collection of hosts, or a table of any length with a column host. A null url,
    or one without ``://``, has an empty host and path, fits no rule and is allowed;
    urls of any length are read whole. Repeated and null ids keep their rows; of two
    fitting rules of one length the first by text wins; columns other than page_id
    and url are not read; an empty table gives an empty result.
    """
    depth = max(r.host.count(".") + 1 for r in rules) if rules else 1
    lengths = tuple(sorted({len(r.path) for r in rules})) or (0,)
    if isinstance(blocked, DataFrame):
        host_depth = (blocked.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"]) or 1
        hosts: tuple[str, ...] | DataFrame = blocked.select(F.col("host").alias("key"))
    else:
        host_depth, hosts = max((h.count(".") + 1 for h in blocked), default=1), blocked
    urls = pages.count()
    cascades = {v: build(pages, urls, [r.key for r in rules if r.verdict == v], depth, lengths) for v in ("allow", "block")}
    cascades["hosts"] = build(pages, urls, hosts, host_depth, (0,))
    ddl = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, listed boolean"
    arrow = arrow_schema(pages.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: dict[str, bool] = {}
        found: dict[tuple[str, str], tuple] = {}

        def judge(host: str, path: str) -> tuple:
            stem = (host, path[: lengths[-1]])
            if stem not in found:
                if len(found) > 100_000:
                    found.clear()
                hit: tuple = (None, None)
                for key in candidate_keys(host, path, depth, lengths):
                    d = digest(key)
                    verdict = next((v for v in ("allow", "block") if d in cascades[v]), None)
                    if verdict:
                        hit = (key, verdict)
                        break
                found[stem] = hit
            return found[stem]

        def on_list(host: str) -> bool:
            if host not in listed:
                if len(listed) > 100_000:
                    listed.clear()
                listed[host] = any(digest(k) in cascades["hosts"] for k in candidate_keys(host, "", host_depth, (0,)))
            return listed[host]

        def rows() -> Iterator[tuple]:
            for b in slices(batches, 4096):
                for page, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    host, path = split_url(url)
                    key, verdict = judge(host, path)
                    on = on_list(host)
                    yield page, host, path, key, verdict or ("block" if on else "allow"), on

        yield from to_batches(rows(), arrow)

    return pages.select("page_id", "url").mapInArrow(run, ddl)
