"""Near duplicates: a MinHash LSH forest, then exact Jaccard similarity.

Texts with the same words are one class. Each class gets a path through each of
several prefix tries: a sequence of MinHash values. The tries are one table, sorted
by trie and path, so that classes below a common node are neighbours and the depth
of a class's deepest shared node is its longest common prefix with a neighbour.
The matched prefix starts at full depth. Classes that share a node of that depth
are candidates, and candidate groups are verified exactly: a group's texts meet
once, a large group in blocks of texts against blocks, and only counts and spanning
links leave a task. A verified link of similarity s is found at depth d with the
probability 1 - (1 - s^d)^trees, so the links found tell how many were missed.
While that is more than the target recall allows, the prefix is shortened as far
as they ask for and the groups that have changed are verified again. It stops at
the latest where a pair at the threshold itself is found with the target recall;
too few links to tell make it go there at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import ALNUM_TABLE, arrow_schema, hot_join, saved, shingle_hashes, sieve, slices, to_batches, word_hashes
from hushdex.llm.components import components

#: Tries and their full depth; a step of a path takes two bytes.
TREES, DEPTH, STEP = 20, 8, 2
#: Texts of a block, and shingles that make a group large enough to be cut into blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 2_000, 600_000
#: Shingles in more texts of a block than this are multiplied as a matrix, others by lists.
COMMON = 32


def found(s: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that a pair of similarity ``s`` shares a node of ``depth`` in some trie."""
    return 1 - (1 - s**depth) ** TREES


def shortest_prefix(threshold: float, recall: float) -> int:
    """Longest prefix by which a pair at ``threshold`` is found with ``recall``."""
    return next((d for d in range(DEPTH, 1, -1) if found(threshold, d) >= recall), 1)


_rng = np.random.default_rng(0x5EED)
_A = (_rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def paths(shingles: np.ndarray) -> list[bytes]:
    """The path of a text through each trie: the trie's number, then its MinHash values."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 1024):
        part = h[k : k + 1024]
        np.minimum(low, (part * _A[:, None] + _B[:, None]).min(1), out=low)
    raw = (low & np.uint32(0xFFFF)).astype(">u2").reshape(TREES, DEPTH)
    return [bytes([t]) + raw[t].tobytes() for t in range(TREES)]


def content(text: str | None) -> bytes:
    """The words of a text, one blank apart; empty without words."""
    return b" ".join((text or "").encode().translate(ALNUM_TABLE).split())


def content_key(words: bytes) -> bytes | None:
    return hashlib.blake2b(words, digest_size=16).digest() if words else None


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, mark (a hash of the text as it is), key (null without words), size in
    shingles and paths of every row."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark bigint, key binary, size int, paths array<binary>"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in slices(batches):
                for doc, mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = content(text)
                    if not words:
                        yield doc, mark, None, 0, None
                        continue
                    s = shingle_hashes(word_hashes(words), n)
                    yield doc, mark, content_key(words), len(s), paths(s)

        yield from to_batches(rows(), arrow)

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, ddl)


def shared_depths(rows: np.ndarray) -> np.ndarray:
    """Of paths in order, the depth of the node that each shares with the one before it."""
    same = rows[1:] == rows[:-1]
    step = same[:, 1:].reshape(len(same), DEPTH, STEP).all(2) & same[:, :1]
    return np.logical_and.accumulate(step, 1).sum(1)


def forest(classes: DataFrame, least: int) -> DataFrame:
    """path, key, depth: the part of all tries in which classes share nodes of ``least`` or deeper.

    A partition's first and last path count as shared: their neighbours are elsewhere.
    """
    ddl = "path binary, key binary, depth int"
    arrow = arrow_schema(classes.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, DEPTH  # the last row so far, and what it shares with the one before
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()
            if not t:
                continue
            b = t[0]
            wide = 1 + DEPTH * STEP
            at = b.column(0)
            raw = np.frombuffer(at.buffers()[2], np.uint8)[at.offset * wide : (at.offset + len(at)) * wide].reshape(-1, wide)
            shared = np.concatenate(([before], shared_depths(raw)))
            depth = np.maximum(shared[:-1], shared[1:])
            keep = np.flatnonzero(depth >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(depth[keep], pa.int32())], schema=arrow)
            held, before = b.slice(b.num_rows - 1), int(shared[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held.column(0), held.column(1), pa.array([DEPTH], pa.int32())], schema=arrow)

    every = classes.select(F.explode("paths").alias("path"), "key")
    return every.repartitionByRange("path", "key").sortWithinPartitions("path", "key").mapInArrow(run, ddl)


# -- exact verification ----------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles, left by right."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.float32)
    doc = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    u, s = np.unique(np.concatenate((*left, *right)), return_inverse=True)
    in_left = np.bincount(s[doc < n], minlength=len(u))
    in_right = np.bincount(s[doc >= n], minlength=len(u))
    both = (in_left > 0) & (in_right > 0)
    common = both & (np.maximum(in_left, in_right) > COMMON)
    # Rare shingles: lists of pairs, short ones by the limit on COMMON.
    rare = (both & ~common)[s]
    ds, ss = doc[rare], s[rare]
    order = np.argsort(ss, kind="stable")
    ds, ss = ds[order], ss[order]
    a, b = ds < n, ds >= n
    da, sa, db, sb = ds[a], ss[a], ds[b] - n, ss[b]
    lo, hi = np.searchsorted(sb, sa), np.searchsorted(sb, sa, side="right")
    for k in range(0, len(sa), 50_000):
        size = (hi - lo)[k : k + 50_000]
        i = np.repeat(da[k : k + 50_000], size)
        j = db[np.repeat(lo[k : k + 50_000] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        out += np.bincount(i * m + j, minlength=n * m).reshape(n, m).astype(np.float32)
    # Common shingles: a matrix product, some columns at a time.
    column = np.cumsum(common) - 1
    heavy = common[s]
    dh, ch = doc[heavy], column[s[heavy]]
    for k in range(0, int(common.sum()), 1024):
        here = (ch >= k) & (ch < k + 1024)
        x = np.zeros((n + m, 1024), np.float32)
        x[dh[here], ch[here] - k] = 1
        out += x[:n] @ x[n:].T
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have an exact Jaccard similarity of ``threshold`` or more, and the similarities."""
    common = overlaps(left, right)
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    either = a[:, None] + b[None, :] - common
    # The tolerance is far below the distance of any two ratios of counts.
    return common >= threshold * either - 1e-4, common / either


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for links i-j among n nodes."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify_group(rows: list[tuple[bytes, int, np.ndarray]], threshold: float, left: int, right: int, least: int = DEPTH) -> Iterator[tuple[bytes, int, bytes, list[float]]]:
    """(key, links here, a linked key that spans, missed) of the texts of blocks ``left`` and ``right``.

    ``rows`` are (key, block, shingles); all of one block are compared with each
    other, those of two blocks only across: nothing if one of the two is empty.
    ``missed`` is, for each depth from the full one to ``least``, how many links are
    missed for those found here.
    """
    rows = sorted({k: (k, b, s) for k, b, s in rows}.values(), key=lambda r: (r[1], r[0]))
    first = [r for r in rows if r[1] == left]
    second = rows[len(first) :]
    if left != right and not (first and second):
        return
    one, two = [r[2] for r in first], [r[2] for r in second]
    hit, how = similar(one, two or one, threshold)
    if not second:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    s = np.clip(how[i, j].astype(np.float64), threshold, 1)
    root = roots(len(rows), i, j + (len(first) if second else 0))
    links = np.concatenate((hit.sum(1), hit.sum(0))) if second else hit.sum(1)
    # Each link counts at both of its ends.
    ends = np.concatenate((i, j + len(first))) if second else i
    missed = [np.bincount(ends, weights=np.tile(1 / found(s, d) - 1, 2 if second else 1), minlength=len(rows)) for d in range(DEPTH, least - 1, -1)]
    for k, (key, _, _) in enumerate(rows):
        if links[k]:
            yield key, int(links[k]), rows[root[k]][0], [float(m[k]) for m in missed]


def verified(texts: DataFrame, members: DataFrame, n: int, threshold: float, least: int) -> DataFrame:
    """(comp, key, links, root, missed) rows for candidate groups.

    ``texts`` has doc_id, mark and text, ``members`` has doc_id and mark (of one row with the class's text), key, comp,
    blocks (into how many the group is cut).
    """
    ddl = "comp binary, left int, right int, key binary, block int, shingles binary"
    arrow = arrow_schema(texts.sparkSession, ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last = None
            for b in slices(batches):
                for text, key, comp, blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if key == last:
                        continue  # the same row, repeated
                    last = key
                    words = content(text)
                    if content_key(words) != key:
                        continue  # another text of the same mark
                    raw = shingle_hashes(word_hashes(words), n).tobytes()
                    own = int.from_bytes(key[:8], "little") % blocks
                    for other in range(blocks):
                        yield comp, min(own, other), max(own, other), key, own, raw

        yield from to_batches(rows(), arrow)

    out = "comp binary, key binary, links bigint, root binary, missed array<double>"
    result = arrow_schema(texts.sparkSession, out)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            now, some = None, []
            for b in slices(batches):
                for comp, left, right, key, block, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (comp, left, right) != now:
                        if some:
                            yield some, *now
                        now, some = (comp, left, right), []
                    some.append((key, block, np.frombuffer(raw, np.uint64)))
            if some:
                yield some, *now

        yield from to_batches(((comp, *r) for g, comp, left, right in groups() for r in verify_group(g, threshold, left, right, least)), result)

    # One plan at every size: the members' number grows with the corpus.
    same = F.col("d.mark").eqNullSafe(F.col("m.mark")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))
    met = texts.alias("d").join(members.alias("m").hint("merge"), same).select("text", "key", "comp", "blocks")
    dealt = met.mapInArrow(cut, ddl).repartition("comp", "left", "right").sortWithinPartitions("comp", "left", "right", "key")
    return dealt.mapInArrow(check, out)


def grouped(classes: DataFrame, tries: DataFrame, depth: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, comp) of the candidate groups at ``depth`` of ``tries`` (of so many
    ``rows``), and their groups
    (comp, blocks, many, sign): a sign tells whether a group is the same at two depths."""
    nodes = tries.where(F.col("depth") >= depth).select("key", F.substring("path", 1, 1 + STEP * depth).alias("node"))
    heads = nodes.groupBy("node").agg(F.min("key").alias("v"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    edges = hot_join(nodes, heads, "node", rows).where("key <> v").select(F.col("key").alias("u"), "v")
    groups = components(edges)
    # Every member of a candidate group, its smallest key too.
    member = groups.select(F.col("u").alias("key"), F.col("v").alias("comp")).union(groups.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct())
    member = saved(member.join(classes.select("key", "size"), "key"), "members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    stats = member.groupBy("comp").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("many"), F.bit_xor(F.xxhash64("key")).alias("sign"))
    return member.select("key", "comp"), saved(stats, "groups")


def linked(docs: DataFrame, classes: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """(comp, key, links, root) rows of all links, by matched prefixes as short as ``recall`` asks for."""
    least = shortest_prefix(threshold, recall)
    tries = saved(forest(classes, least), "forest")
    # All rounds together ask for the classes of the forest and their texts, for no others.
    few = saved(classes.join(tries.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "mark", "size"), "candidates")
    wanted = sieve(few.select("doc_id", "mark"))
    texts = saved(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where(wanted("doc_id", "mark")), "texts")
    links, old, depth, rows = None, None, DEPTH, tries.count()
    while True:
        member, stats = grouped(few, tries, depth, rows)
        new = stats if old is None else stats.join(old, ["comp", "many", "sign"], "left_anti")
        todo = hot_join(member, new.select("comp", "blocks", F.col("many").alias("rows")), "comp", rows).join(few.select("key", "doc_id", "mark"), "key")
        got = verified(texts, todo, n, threshold, least)
        if links is not None:
            kept = stats.join(old, ["comp", "many", "sign"], "left_semi").select("comp")
            got = got.unionByName(links.join(kept, "comp", "left_semi"))
        links, old = saved(got, "links"), stats.select("comp", "many", "sign")
        if depth == least:
            return links
        sums = links.agg(F.sum("links").alias("n"), *(F.sum(F.col("missed")[DEPTH - d]).alias(f"missed_{d}") for d in range(depth, least - 1, -1))).first()
        depth = next_depth((sums["n"] or 0) / 2, {d: (sums[f"missed_{d}"] or 0) / 2 for d in range(depth, least - 1, -1)}, depth, least, recall)
        if depth is None:
            return links


def next_depth(have: float, missed: dict[int, float], depth: int, least: int, recall: float) -> int | None:
    """The depth to go on with, or None if the links found at ``depth`` are enough of all."""
    if have * (1 - recall) < 1:  # so few cannot tell so small a share
        return least
    if have >= recall * (have + missed[depth]):
        return None
    return next((d for d in range(depth - 1, least, -1) if have >= recall * (have + missed[d])), least)


def _known(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and (key, top, class_id, n_copies, n_links, doc_id,
    mark) of every class that has copies or links; doc_id and mark are those of the
    first row of all classes of one top, a null id coming last."""
    table = saved(fingerprints(docs, n), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")).alias("rep")
    classes = table.where("key is not null").groupBy("key").agg(least, F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("paths").alias("paths"))
    classes = saved(classes.select("key", "rep.doc_id", "rep.mark", "n_copies", "size", "paths"), "classes")
    links = linked(docs, classes, n, threshold, recall)
    count = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    joined = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    known = classes.select("key", "doc_id", "mark", "n_copies").join(count, "key", "left").where("n_copies > 1 or n_links > 0")
    known = saved(known.join(joined.select(F.col("u").alias("key"), F.col("v").alias("top")), "key", "left").withColumn("top", F.coalesce("top", "key")), "known")
    first = known.groupBy("top").agg(least, F.count(F.lit(1)).alias("rows")).select("top", "rep.doc_id", "rep.mark", "rows")
    many = hot_join(known.select("key", "top", "n_copies", "n_links"), first, "top", known.count())
    return table, many.withColumn("class_id", F.col("doc_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_copies.

    Texts are compared by their sets of ``n``-word shingles (a shorter text is one
    shingle), words being lower-cased runs of letters, digits and non-ASCII.
    class_id is the smallest doc_id of all documents that are linked, directly or
    through others; n_links the number of different texts of similarity
    ``threshold`` or more; n_copies the number of rows with the same words. A null
    text, or one without words, is a class of its own with no copies counted but
    itself. Null ids come last among class ids, and a class without any other id has
    a null one; repeated ids keep their rows, whatever their texts; texts of any
    length are compared whole; columns other than doc_id and text are not read; an
    empty table gives an empty result.
    """
    table, many = _known(docs, threshold, n, recall)
    # One row for each key on the right: copies of a text, however many, only repeat on the left.
    got = table.select("doc_id", "key").join(many.select("key", "class_id", "n_links", "n_copies", F.lit(True).alias("has")), "key", "left")
    alone = F.col("has").isNull()
    return got.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("bigint")).alias("n_copies"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id, a null one last.

    Of rows that agree in id and text one stays. Rows without words stay, as do all
    columns, whatever their names.
    """
    table, many = _known(docs, 0.8, 5, 0.999)
    rows = table.select("doc_id", "mark", "key").alias("t").join(many.select("key", F.col("doc_id").alias("first_id"), F.col("mark").alias("first_mark")), "key")
    first = F.col("t.doc_id").eqNullSafe(F.col("first_id")) & F.col("t.mark").eqNullSafe(F.col("first_mark"))
    rows = rows.groupBy("t.doc_id", "t.mark").agg(F.count(F.lit(1)).alias("times"), F.max(first).alias("stays"))
    # Rows to drop, and rows to keep once: no others are looked up.
    marks = saved(rows.where("not stays or times > 1").select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "stays"), "marks")
    held = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(docs.columns)]
    named = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_mark"), *held)
    same = F.col("own_id").eqNullSafe(F.col("of_id")) & F.col("own_mark").eqNullSafe(F.col("of_mark"))
    back = lambda df: df.select(*(F.col(f"kept_{k}").alias(c) for k, c in enumerate(docs.columns)))
    # Rows that stay as they are, nearly all, are not shuffled for the others.
    listed = sieve(marks.select("of_id", "of_mark"))("own_id", "own_mark")
    some = named.where(listed)
    kept = back(named.where(~listed).unionByName(some.join(marks, same, "left_anti")))
    once = marks.where("stays")
    if once.isEmpty():
        return kept
    return kept.unionByName(back(some.join(once, same, "left_semi").dropDuplicates(["own_id", "own_mark"])))
