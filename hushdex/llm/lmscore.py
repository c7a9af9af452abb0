"""Language-model scores of whole documents.

Counts of all training words come from the distinct-word table. The most frequent
words make the recurrent model's vocabulary, which grows with the root of the number
of different words; any other word costs the model's probability of OTHER times the
word's smoothed share among the others. The model is trained where the data lies:
every training document is one lesson of one round; in a round each partition goes
on from the same weights, and what comes out is averaged in a tree.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushdex.llm.common import LOWER_TABLE, arrow_schema, bucketed, crc_mod, id_fold, partitions_for, saved, slices, to_batches
from hushdex.llm.gru import OTHER, Gru, Shape, Trainer, lanes_of, score
from hushdex.llm.vbyte import pack, unpack
from hushdex.llm.wordtable import blobs, by_chunk, chunked, joined, resolved, squeeze, unpack_words, unsqueeze

#: Training tokens of a lesson row, and lanes for scoring.
TOKENS_PER_ROW, LANES = 600_000, 512
#: Training tokens of a partition for each vocabulary entry: weights that travel stay
#: in proportion to what they were learned from.
TOKENS_PER_ENTRY = 400
#: Weight vectors that one task adds up.
FAN_IN = 16
#: Sixteenths of the training documents that each round learns from: short rounds
#: first, so that partitions part from each other only when they agree on the most.
ROUNDS = (1, 1, 2, 4, 8)
#: Vocabulary entries: these, and so many for each root of the number of different words.
LEAST_VOCAB, PER_ROOT = 64, 2.0


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_TABLE).split()


def vocabulary_size(types: int) -> int:
    """Entries of the model's vocabulary, OTHER and the end among them."""
    return LEAST_VOCAB + int(PER_ROOT * types**0.5)


def _train_uses(fold: int, of: int):
    def weigh(heads: list, lens: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(flat[np.repeat(id_fold(heads, of) != fold, lens)], minlength=n)

    return weigh


def _split64(x: np.ndarray) -> bytes:
    """Whole numbers of any size as two packed halves; the upper one is mostly zeros."""
    x = x.astype(np.uint64)
    return joined(pack((x & np.uint64(0xFFFFFFFF)).astype(np.uint32), squeeze), pack((x >> np.uint64(32)).astype(np.uint32), squeeze))


def _whole64(blob: bytes) -> np.ndarray:
    low, high = (unpack(x, unsqueeze).astype(np.int64) for x in blobs(blob))
    return low | high << 32


def _counter(parts: int):
    """Sum each word's training uses over all chunks; rank the most frequent.

    Blocks are held as they came, packed, and opened once more when all are summed.
    """

    def flush(part: int, held: list[tuple]) -> Iterator[tuple]:
        total: dict[bytes, int] = {}
        get = total.get
        for _, a, b, _ in held:
            words, uses = unpack_words(a, b)
            for w, u in zip(words, uses.tolist(), strict=True):
                total[w] = get(w, 0) + u
        seen = [(w, c) for w, c in total.items() if c]
        # Words are dealt by their hash: far more than a partition's part of the vocabulary.
        most = vocabulary_size(2 * parts * len(seen)) / parts
        best = sorted(seen, key=lambda x: (-x[1], x[0]))[: LEAST_VOCAB + int(4 * most)]
        place = {w: k + 1 for k, (w, _) in enumerate(best)}
        size = np.fromiter((len(w) for w, _ in best), np.uint32, len(best))
        yield "", part, 3, squeeze(b"".join(w for w, _ in best)), pack(size, squeeze), _split64(np.array([c for _, c in best], np.uint64))
        yield "", part, 4, struct.pack("<qq", sum(c for _, c in seen), len(seen)), None, None
        for chunk, a, b, c in held:
            words, _ = unpack_words(a, b)
            count = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
            rank = np.fromiter(map(place.get, words, repeat(0)), np.uint32, len(words))
            yield chunk, part, 2, None, joined(_split64(count), pack(rank, squeeze)), c

    def resolve(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, here = [], None
        for chunk, part, a, b, c in rows:
            if part != here:
                if held:
                    yield from flush(here, held)
                held, here = [], part
            held.append((chunk, a, b, c))
        if held:
            yield from flush(here, held)

    return resolve


class Vocabulary:
    """Counts of the corpus and numbers of the model's words."""

    def __init__(self, rows: list, n_words: int, v_words: int, ends: int) -> None:
        self.index = {(r["part"], r["rank"]): k + 2 for k, r in enumerate(rows)}
        self.size = vocabulary_size(v_words)
        self.tokens, self.types, self.ends = n_words + ends, v_words + (ends > 0), ends
        inside = sum(r["n"] for r in rows)
        # Smoothed mass of all words outside, one unseen type with them.
        self.other = (n_words - inside) + (v_words - len(rows)) + 1
        self.counts = np.zeros(self.size)
        self.counts[: 2 + len(rows)] = [self.other, ends, *(r["n"] for r in rows)]

    @property
    def kind(self) -> str:
        """Type of a word's number in lessons."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.types + 1.0))

    def words(self, n: int, got: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Count and vocabulary number of each of a chunk's words."""
        count, number = np.zeros(n, np.int64), np.zeros(n, np.int32)
        for pos, b, part in got:
            c, r = blobs(b)
            r = unpack(r, unsqueeze)
            count[pos] = _whole64(c)
            table = np.array([OTHER, *(self.index.get((part, k), OTHER) for k in range(1, int(r.max(initial=0)) + 1))], np.int32)
            number[pos] = table[r]
        return count, number


def vocabulary(results: DataFrame, docs: DataFrame, fold: int, of: int) -> Vocabulary:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            part, a, size, c = (x[0].as_py() for x in b.columns)
            words, _ = unpack_words(a, joined(size, b""))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(words), pa.int32()), pa.array(range(1, len(words) + 1), pa.int32()), pa.array(words, pa.binary()), pa.array(_whole64(c), pa.int64())], names=["part", "rank", "word", "n"])

    # One row of two numbers for each word partition.
    sums = [struct.unpack("<qq", r["a"]) for r in results.where("kind = 4").select("a").toLocalIterator()]
    types = sum(v for _, v in sums)
    rows = results.where("kind = 3").select("part", "a", "b", "c").mapInArrow(best, "part int, rank int, word binary, n bigint").orderBy(F.desc("n"), "word").limit(vocabulary_size(types) - 2).collect()
    ends = docs.where(crc_mod("doc_id", of) != fold).count()
    return Vocabulary(rows, sum(n for n, _ in sums), types, ends)


def lessons(blocks: DataFrame, results: DataFrame, vocab: Vocabulary, fold: int, of: int) -> DataFrame:
    """Vocabulary streams of all training documents, each in one row: turn (0 to 15), n tokens, words, lens."""
    ddl = "turn int, n bigint, words binary, lens binary"
    arrow = arrow_schema(blocks.sparkSession, ddl)

    def use(groups: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for heads, lens, numbers, got in groups:
                _, number = vocab.words(1 + int(numbers.max(initial=0)), got)
                take = id_fold(heads, of) != fold
                stream = number[numbers[np.repeat(take, lens)]].astype(vocab.kind)
                size = lens[take].astype("<i8")
                after = np.cumsum(size + 1)
                cuts = np.flatnonzero(np.diff((after - 1) // TOKENS_PER_ROW)) + 1
                at = 0
                for some in np.split(size, cuts):
                    n = int(some.sum())
                    words = stream[at : at + n].tobytes()
                    yield zlib.crc32(words) % 16, n + len(some), words, some.tobytes()
                    at += n

        yield from to_batches(rows(), arrow)

    return by_chunk(blocks, results, use, ddl)


def trained(streams: DataFrame, vocab: Vocabulary, shape: Shape, rounds: tuple[int, ...] = ROUNDS) -> Gru:
    """Weights after all rounds: averages over partitions, each trained on its own streams."""
    g, past, kind = Gru.fresh(shape, vocab.counts), None, vocab.kind
    # Sixteen rows at most.
    tokens = {r["turn"]: r["n"] for r in streams.groupBy("turn").agg(F.sum("n").alias("n")).collect()}
    turn = 0
    for size in rounds:
        turns = range(turn, turn + size)
        turn += size
        left = -(-sum(tokens.get(t, 0) for t in turns) // max(TOKENS_PER_ROW, TOKENS_PER_ENTRY * shape.vocab))
        if not left:
            continue

        def teach(batches: Iterator[pa.RecordBatch], flat: np.ndarray = g.flat, past: np.ndarray | None = past) -> Iterator[pa.RecordBatch]:
            t = Trainer(Gru(shape, flat.copy()), None if past is None else past.copy())
            for b in slices(batches, 1):
                t.train(np.frombuffer(b.column(0)[0].as_py(), kind).astype(np.int32), np.frombuffer(b.column(1)[0].as_py(), "<i8"))
            if t.tokens:
                yield _weights(np.concatenate((t.g.flat, t.past)), t.tokens)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for b in slices(batches, 1):
                many = b.column(1)[0].as_py()
                w = np.frombuffer(b.column(0)[0].as_py(), np.float32) * np.float64(many)
                total, n = (w if total is None else total + w), n + many
            if n:
                yield _weights((total / n).astype(np.float32), n)

        # Rows are about as long as one another and are dealt out in turn.
        own = streams.where(F.col("turn").between(turns[0], turns[-1])).select("words", "lens").repartition(left)
        got = own.mapInArrow(teach, "w binary, n bigint")
        while left > 1:
            left = -(-left // FAN_IN)
            got = got.repartition(left).mapInArrow(add, "w binary, n bigint")
        # One vector.
        flat, past = np.split(np.frombuffer(got.first()["w"], np.float32), 2)
        g = Gru(shape, flat.copy())
    return g


def _weights(flat: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["w", "n"])


def lm_scores(docs: DataFrame, fold: int = 2, of: int = 7, shape: dict | None = None, chunk_chars: int = 24_000_000) -> DataFrame:
    """One row per row of ``docs``: counts, a smoothed unigram score and the model's score.

    Returns doc_id, held_out (crc32 of the id modulo ``of`` is ``fold``: not learned
    from), n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score, score (log10 of the text's probability) and n_other
    (tokens outside the model's vocabulary). A null or empty text is its end alone;
    repeated and null ids keep their rows; a text of any length is scored whole;
    columns other than doc_id and text are not read; an empty table gives an empty
    result. ``shape`` may change the sizes of the model.
    """
    blocks = chunked(docs, words_of, weigh=_train_uses(fold, of), chunk_chars=chunk_chars)
    results = bucketed(resolved(blocks, _counter(partitions_for(docs.sparkSession))), "counted", "chunk")
    vocab = vocabulary(results, docs, fold, of)
    g = trained(saved(lessons(blocks, results, vocab, fold, of), "lessons"), vocab, Shape(vocab.size, **(shape or {})))
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_other bigint"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def use(groups: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            end = float(vocab.base(np.array(vocab.ends)))
            for heads, lens, numbers, got in groups:
                count, number = vocab.words(1 + int(numbers.max(initial=0)), got)
                own = np.repeat(np.arange(len(lens)), lens)
                many = len(lens)
                base = np.bincount(own, weights=vocab.base(count)[numbers], minlength=many) + end
                known = np.bincount(own, weights=(count > 0)[numbers], minlength=many).astype(np.int64) + (vocab.ends > 0)
                out = np.where(number == OTHER, np.log10((count + 1.0) / vocab.other), 0.0)
                words = number[numbers]
                other = np.bincount(own[words == OTHER], minlength=many)
                total = np.bincount(own, weights=out[numbers], minlength=many)
                del own
                total += score(g, lanes_of(words, lens, LANES), many) / np.log(10)
                held = id_fold(heads, of) == fold
                yield from zip(heads, held.tolist(), (lens + 1).tolist(), known.tolist(), [vocab.tokens] * many, base.tolist(), total.tolist(), other.tolist(), strict=True)

        yield from to_batches(rows(), arrow)

    return by_chunk(blocks, results, use, ddl)
