"""Postings lists from token lists, made a block of entries at a time.

A block has entries of about ``BLOCK_WORDS`` words. Within it every different word is cut
into trigrams once and every different token is hashed once, however many entries have
it, and all entries that have a token stand in one list. A list is no longer than a
block, so rows stay small however common a token is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushdex.functions import tokens

#: Words (each counts once an entry) and entries of a block.
BLOCK_WORDS, BLOCK_ENTRIES = 400_000, 2_000
#: Rows of an output batch.
ROWS = 1_024
#: ``part`` 0 has a row for each entry with the sizes of its lists, 1 the postings lists.
MADE = "part int, kind string, token string, entry_ids array<string>, block bigint, entry_id string, words bigint, trigrams bigint, seq bigint"


def cut(text: Column) -> Column:
    """Distinct words of a text, what ``inverted`` takes with a key; a null text has none."""
    return F.array_distinct(tokens.words(F.coalesce(text, F.lit(""))))


def inverted(rows: DataFrame, key: bytes | None) -> DataFrame:
    """MADE rows of (entry_id, words, trigrams, seq), one row for each id.

    With a key, words are plain and distinct, and trigrams are not looked at; without
    one, both lists have tokens as clients hashed them.
    """
    return rows.select("entry_id", "words", *([] if key else ["trigrams"]), "seq").mapInArrow(_inverter(key), MADE)


def _inverter(key: bytes | None, most_words: int = BLOCK_WORDS, most_entries: int = BLOCK_ENTRIES, most_rows: int = ROWS) -> Callable[[Iterator], Iterator]:
    # All in one function, which Python workers get by value: they need not have this package.
    def run(batches: Iterator) -> Iterator:
        import hmac
        import secrets

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        text, whole = pa.string(), pa.int64()
        types = {"part": pa.int32(), "kind": text, "token": text, "entry_ids": pa.list_(text), "block": whole, "entry_id": text, "words": whole, "trigrams": whole, "seq": whole}

        def made(n: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

        def sizes(lists: pa.Array) -> np.ndarray:
            return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        def distinct(codes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            """The different pairs, in order."""
            both = np.sort(codes * n + docs)
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            return both // n, both % n

        def lists(kind: str, codes: np.ndarray, docs: np.ndarray, names: list[str], ids: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
            ends = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))
            for a in range(0, len(ends) - 1, most_rows):
                b = min(a + most_rows, len(ends) - 1)
                found = [names[c] for c in codes[ends[a:b]]]
                if key:
                    found = [hmac.digest(key, f"{kind}:{t}".encode(), "sha256").hex() for t in found]
                held = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), ids.take(pa.array(docs[ends[a] : ends[b]])))
                n = b - a
                yield made(n, part=pa.array(np.ones(n, np.int32)), kind=pa.array([kind] * n, text), token=pa.array(found, text), entry_ids=held, block=pa.array(np.full(n, block)))

        def coded(column: pa.Array) -> tuple[np.ndarray, list[str]]:
            d = column.flatten().dictionary_encode()
            return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()

        def index(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.take(pc.sort_indices(t["entry_id"])).combine_chunks()
            column = lambda name: pa.concat_arrays(t[name].chunks) if t[name].num_chunks != 1 else t[name].chunk(0)
            n, ids, block = t.num_rows, column("entry_id"), secrets.randbits(62)
            of_words = sizes(column("words"))
            words, names = coded(column("words"))
            docs = np.repeat(np.arange(n), of_words)
            if key:
                known: dict[str, int] = {}
                flat, first = [], [0]
                for w in names:
                    flat += [known.setdefault(w[k : k + 3], len(known)) for k in range(len(w) - 2)]
                    first.append(len(flat))
                start = np.array(first, np.int64)
                each = np.diff(start)[words]
                at = np.arange(each.sum()) + np.repeat(start[words] - (np.cumsum(each) - each), each)
                grams, gram_docs = distinct(np.array(flat, np.int64)[at], np.repeat(docs, each), n)
                gram_names, of_grams = list(known), np.bincount(gram_docs, minlength=n)
            else:
                of_grams = sizes(column("trigrams"))
                grams, gram_names = coded(column("trigrams"))
                grams, gram_docs = distinct(grams, np.repeat(np.arange(n), of_grams), n)
            yield made(n, part=pa.array(np.zeros(n, np.int32)), entry_id=ids, words=pa.array(of_words), trigrams=pa.array(of_grams.astype(np.int64)), seq=column("seq"))
            yield from lists("w", *distinct(words, docs, n), names, ids, block)
            yield from lists("t", grams, gram_docs, gram_names, ids, block)

        some, count = [], 0
        for batch in batches:
            while batch.num_rows:
                total = np.cumsum(sizes(batch.column("words")))
                room = int(np.searchsorted(total, most_words - count, side="right"))
                room = min(room, most_entries - sum(b.num_rows for b in some))
                if room <= 0 and some:
                    yield from index(pa.Table.from_batches(some))
                    some, count = [], 0
                    continue
                room = min(max(1, room), batch.num_rows)
                some.append(batch.slice(0, room))
                count += int(total[room - 1])
                batch = batch.slice(room)
        if some:
            yield from index(pa.Table.from_batches(some))

    return run
