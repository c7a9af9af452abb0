"""Baseline JPEG as a media column.

``features`` parses markers, decodes the Huffman-coded scans of many images in
lockstep and rebuilds luminance thumbnails from the DC terms alone. ``store``
keeps any bytes losslessly as the quantised coefficients of a grey image: byte k
of a payload is coefficient k of the scan, so one 8x8 block holds 64 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hushdex.llm.common import arrow_schema, saved, slices, to_batches

# -- Huffman tables ------------------------------------------------------------


def code_lengths(weights: dict[int, float]) -> tuple[list[int], bytes]:
    """DHT form (counts of lengths 1 to 16, symbols) of an optimal prefix code.

    No code is all ones, and lengths beyond 16 are pulled up as T.81 K.2 asks.
    """
    heap = [(w, k, [s]) for k, (s, w) in enumerate(sorted(weights.items()))]
    heap.append((0.0, len(heap), [-1]))  # takes the all-ones code
    heapq.heapify(heap)
    depth = dict.fromkeys([*weights, -1], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], b[1], a[2] + b[2]))
    bits = [0] * (max(17, max(depth.values()) + 1))
    for d in depth.values():
        bits[d] += 1
    for n in range(len(bits) - 1, 16, -1):
        while bits[n]:
            j = n - 2
            while not bits[j]:
                j -= 1
            bits[n] -= 2
            bits[n - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(n for n in range(17) if bits[n])
    bits[last] -= 1
    order = sorted(weights, key=lambda s: (depth[s], s))
    return bits[1:17], bytes(order)


def canonical(bits: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of every symbol value; length 0 where there is none."""
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    c = k = 0
    for n, many in enumerate(bits, 1):
        for _ in range(many):
            code[symbols[k]], size[symbols[k]] = c, n
            c, k = c + 1, k + 1
        c <<= 1
    return code, size


#: What a lookup entry holds: code length in bits 0-4, value size in bits 5-8, run above.
EOB_RUN = 64


def lookup(bits: list[int], symbols: bytes, dc: bool) -> np.ndarray:
    """Entry for each of the 65,536 windows of 16 bits; 0 where no code begins."""
    out = np.zeros(1 << 16, np.int32)
    c = k = 0
    for n, many in enumerate(bits, 1):
        for _ in range(many):
            s = symbols[k]
            size, run = (s, 0) if dc else (s & 15, s >> 4)
            if not dc and not size and run != 15:
                run = EOB_RUN
            out[c << (16 - n) : (c + 1) << (16 - n)] = n | size << 5 | run << 9
            c, k = c + 1, k + 1
        c <<= 1
    return out


# -- bytes as coefficients -----------------------------------------------------

#: Blocks that are coded at once.
STRETCH = 12_000
#: Bytes by falling frequency in running text: they get the coefficients 0, 1, -1, 2, -2, ...
COMMON = " enthaoirsdluchgmfwybpv,.k".encode()


def byte_values(common: bytes = COMMON) -> np.ndarray:
    """Coefficient of every byte: the common ones first, then the rest in order."""
    order = [*common, *(b for b in range(256) if b not in set(common))]
    out = np.zeros(256, np.int64)
    for r, b in enumerate(order):
        out[b] = (r + 1) // 2 if r % 2 else -(r // 2)
    return out


def text_tables() -> tuple[tuple[list[int], bytes], tuple[list[int], bytes]]:
    """DC and AC tables from a simple model: short values and short runs prevail."""
    share = [0.14, 0.2, 0.27, 0.24, 0.1, 0.02, 0.01, 0.01, 0.01]
    dc = {s: share[s] for s in range(9)}
    ac = {run << 4 | s: share[s] * 0.14**run + 1e-9 for run in range(16) for s in range(1, 9)}
    return code_lengths(dc), code_lengths(ac | {0x00: 0.015, 0xF0: 1e-6})


_VALUES = byte_values()
_BYTES = np.zeros(512, np.uint8)
_BYTES[_VALUES + 256] = np.arange(256, dtype=np.uint8)
_DC, _AC = text_tables()
_DC_CODE, _DC_SIZE = canonical(*_DC)
_AC_CODE, _AC_SIZE = canonical(*_AC)
_BITS = np.array([int(abs(v)).bit_length() for v in range(-256, 257)], np.uint64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def encode_payloads(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """A baseline JPEG for each payload; ``sizes`` are noted in comment segments."""
    grids, dims = [], []
    for p in payloads:
        n = len(p) // 64
        w = int(np.ceil(np.sqrt(n)))
        h = -(-n // w)
        dims.append((w, h))
        v = np.zeros((w * h, 64), np.int16)
        v[:n] = _VALUES[np.frombuffer(p, np.uint8)].reshape(n, 64)
        grids.append(v)
    many = np.array([len(g) for g in grids])
    data, image_end = _scans(np.concatenate(grids), many)
    out, at = [], 0
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC4, b"\x00" + bytes(_DC[0]) + _DC[1]) + _segment(0xC4, b"\x10" + bytes(_AC[0]) + _AC[1]) + _segment(0xDD, b"\x00\x01")
    for (w, h), n, end in zip(dims, sizes, image_end.tolist(), strict=True):
        head = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00") + _segment(0xFE, b"bytes=%d" % n) + tables
        head += _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * h, 8 * w, 1, 1, 0x11, 0)) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        out.append(head + data[at:end] + b"\xff\xd9")
        at = end
    return out


def _scans(v: np.ndarray, many: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded segments, a restart interval for each block, and where each image ends.

    Blocks are independent, so long images are coded a stretch of blocks at a time.
    """
    n = len(v)
    last = np.zeros(n, bool)
    last[np.cumsum(many) - 1] = True
    number = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
    parts, ends, size = [], [], 0
    for a in range(0, n, STRETCH):
        b = a + STRETCH
        data, end = _stretch(v[a:b].astype(np.int64), last[a:b], number[a:b])
        parts.append(data)
        ends.append(end + size)
        size += len(data)
    return b"".join(parts), np.concatenate(ends)[last]


def _stretch(v: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Segments of some blocks with the markers behind them, and where each segment ends."""
    n = len(v)
    size = _BITS[v + 256]
    extra = np.where(v < 0, v + (np.int64(1) << size.astype(np.int64)) - 1, v).astype(np.uint64)
    val, length = np.zeros((n, 66), np.uint64), np.zeros((n, 66), np.uint64)
    s0 = size[:, 0].astype(np.int64)
    val[:, 0], length[:, 0] = _DC_CODE[s0] << size[:, 0] | extra[:, 0], _DC_SIZE[s0] + size[:, 0]
    at = np.flatnonzero(v.ravel())
    at = at[at & 63 != 0]
    blk, k = at >> 6, at & 63
    before = np.concatenate(([0], k[:-1])) if len(k) else k
    before[1:][blk[1:] != blk[:-1]] = 0
    run = k - before - 1
    s, e = size.ravel()[at], extra.ravel()[at]
    sym = ((run & 15) << 4) | s.astype(np.int64)
    code, bits = _AC_CODE[sym] << s | e, _AC_SIZE[sym] + s
    for j in range(3):
        far = run >> 4 > j
        if far.any():
            code[far] |= _AC_CODE[0xF0] << bits[far]
            bits[far] += _AC_SIZE[0xF0]
    val[blk, k], length[blk, k] = code, bits
    short = v[:, 63] == 0
    val[short, 64], length[short, 64] = _AC_CODE[0], _AC_SIZE[0]
    pad = (-length.sum(1).astype(np.int64)) % 8
    val[:, 65], length[:, 65] = (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1), pad
    ends = np.cumsum(length.sum(1).astype(np.int64)) // 8
    used = length.ravel() > 0
    raw = _bits(val.ravel()[used], length.ravel()[used].astype(np.int64))[: int(ends[-1])]
    # A zero byte after each 0xFF; a restart marker after each block but an image's last.
    stuffed = np.cumsum(raw == 0xFF)
    marks = np.cumsum(~last) * 2
    first = np.concatenate(([0], ends[:-1]))
    shift = np.repeat(np.concatenate(([0], marks[:-1])), ends - first)
    place = np.arange(len(raw)) + shift
    place[1:] += stuffed[:-1]
    block_end = ends + stuffed[ends - 1] + np.concatenate(([0], marks[:-1]))
    out = np.zeros(int(block_end[-1] + 2 * (not last[-1])), np.uint8)
    out[place] = raw
    m = block_end[~last]
    out[m], out[m + 1] = 0xFF, 0xD0 + number[~last] % 8
    return out.tobytes(), block_end


def _bits(val: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bit strings of up to 57 bits side by side, as bytes."""
    end = np.cumsum(length)
    start = end - length
    words = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
    word, room = start >> 6, 64 - (start & 63)
    over = length - room
    fits = over <= 0
    piece = np.where(fits, val << np.where(fits, -over, 0).astype(np.uint64), val >> np.where(fits, 0, over).astype(np.uint64))
    cut = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[cut]] = np.bitwise_or.reduceat(piece, cut)
    x = np.flatnonzero(~fits)
    words[word[x] + 1] |= val[x] << (64 - over[x]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)


# -- decoding ------------------------------------------------------------------


@dataclass
class Image:
    """What the markers say, and where the scan's restart segments lie."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    dc: dict[int, tuple] = field(default_factory=dict)
    ac: dict[int, tuple] = field(default_factory=dict)
    use: dict[int, tuple[int, int]] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    scan: bytes = b""

    @property
    def layout(self) -> list[int]:
        """Component index of each block of a minimum coded unit."""
        return [0] if len(self.parts) == 1 else [k for k, (_, h, v, _) in enumerate(self.parts) for _ in range(h * v)]

    @property
    def units(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.parts) == 1 else (max(p[1] for p in self.parts), max(p[2] for p in self.parts))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> Image:
    """Read the markers of a baseline JPEG with one interleaved scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    im, at = Image(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                bits = list(body[1:17])
                many = sum(bits)
                (im.ac if body[0] >> 4 else im.dc)[body[0] & 15] = (tuple(bits), bytes(body[17 : 17 + many]))
                body = body[17 + many :]
        elif marker in (0xC0, 0xC1):
            depth, im.height, im.width, many = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples")
            im.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(many)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            im.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            im.comment = body
        elif marker == 0xDA:
            for k in range(body[0]):
                im.use[body[1 + 2 * k]] = (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15)
            if body[0] != len(im.parts):
                raise ValueError("scan without all components")
            im.scan = data[at:]
            break
    if not im.parts or not im.use:
        raise ValueError("no scan")
    return im


def _plain(scan: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers, and where each segment begins."""
    a = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(a[:-1] == 0xFF)
    follow = a[ff + 1]
    stop = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 0xFF)]
    if len(stop):
        a, keep = a[: stop[0]], ff < stop[0]
        ff, follow = ff[keep], follow[keep]
    rst = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    drop = np.concatenate((ff[follow == 0] + 1, rst, rst + 1))
    left = np.ones(len(a), bool)
    left[drop[drop < len(a)]] = False
    where = np.cumsum(left)
    return a[left], np.concatenate(([0], where[rst])).astype(np.int64)


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients in scan order, (blocks, 64) for each image.

    All restart segments of all images are decoded at once, a symbol of each in a
    step. DC terms come out with their predictions added.
    """
    tables: dict[tuple, int] = {}
    luts: list[np.ndarray] = []

    def table(spec: tuple, dc: bool) -> int:
        if (spec, dc) not in tables:
            tables[spec, dc] = len(luts)
            luts.append(lookup(list(spec[0]), spec[1], dc))
        return tables[spec, dc] << 16

    bufs, pos, first, blocks, lay, lays, of = [], [], [], [], [], [], []
    offset = total = 0
    starts = []
    for im in images:
        plain, cuts = _plain(im.scan)
        x, y = im.units
        per, units = len(im.layout), x * y
        each = im.restart or units
        seg = -(-units // each)
        if len(cuts) < seg:
            raise ValueError("restart segments missing")
        bufs += [plain, np.full(8, 0xFF, np.uint8)]
        pos.append((cuts[:seg] + offset) * 8)
        first.append(total + np.arange(seg) * each * per)
        blocks.append(np.minimum(each, units - np.arange(seg) * each) * per)
        lays.append(np.array([[table(im.dc[im.use[im.parts[c][0]][0]], True), table(im.ac[im.use[im.parts[c][0]][1]], False)] for c in im.layout], np.int64))
        of.append(np.full(seg, len(lays) - 1))
        starts.append(total)
        offset += len(plain) + 8
        total += units * per
    buf = np.concatenate([*bufs, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    word = buf[:-4] << np.uint64(32) | buf[1:-3] << np.uint64(24) | buf[2:-2] << np.uint64(16) | buf[3:-1] << np.uint64(8) | buf[4:]
    lut = np.concatenate(luts)
    lay_at = np.cumsum([0, *(len(x) for x in lays)])
    lay, lay_n = np.concatenate(lays), np.array([len(x) for x in lays])
    pos, blk, todo, of = (np.concatenate(x) for x in (pos, first, blocks, of))
    turn, k = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    base, width = lay_at[of], lay_n[of]
    end = 8 * len(buf) - 64
    out = np.zeros(total * 64, np.int16)
    dc, ac = lay[base, 0], lay[base, 1]
    one, sixty_four = np.uint64(1), np.uint64(63)
    while len(pos):
        v = word[pos >> 3] << (np.uint64(24) + (pos & 7).astype(np.uint64))
        e = lut[np.where(k == 0, dc, ac) + (v >> np.uint64(48)).astype(np.int64)]
        n = e & 31
        if not n.all():
            raise ValueError("bad Huffman code")
        size = (e >> 5) & 15
        rest = v << n.astype(np.uint64)
        extra = (rest >> one >> (sixty_four - size.astype(np.uint64))).astype(np.int64)
        value = np.where(rest >> sixty_four, extra, extra - (np.int64(1) << size.astype(np.int64)) + 1)
        k = k + (e >> 9)
        put = (size > 0) & (k < 64)
        out[(blk * 64 + k)[put]] = value[put]
        k += 1
        pos = pos + (n + size)
        if pos.max() > end:
            raise ValueError("scan ends early")
        done = k > 63
        if done.any():
            blk, todo, turn = blk + done, todo - done, turn + done
            k = np.where(done, 0, k)
            go = todo > 0
            if not go.all():
                pos, blk, todo, turn, k, base, width, dc, ac = (x[go] for x in (pos, blk, todo, turn, k, base, width, dc, ac))
            if len(pos) and width.max() > 1:
                j = base + turn % width
                dc, ac = lay[j, 0], lay[j, 1]
    coef = out.reshape(total, 64)
    got = []
    for im, start in zip(images, starts, strict=True):
        x, y = im.units
        per = len(im.layout)
        c = coef[start : start + x * y * per]
        _predict(c, im, per)
        got.append(c)
    return got


def _predict(c: np.ndarray, im: Image, per: int) -> None:
    """Turn DC differences into values, anew after each restart."""
    each = im.restart or len(c) // per
    if each * per == 1:
        return
    layout = np.array(im.layout)
    for s in range(0, len(c), each * per):
        seg = c[s : s + each * per]
        comp = np.tile(layout, len(seg) // per)
        for k in range(len(im.parts)):
            seg[comp == k, 0] = np.cumsum(seg[comp == k, 0])


def thumbnail(im: Image, coef: np.ndarray) -> np.ndarray:
    """Luminance at one eighth of the size, from DC terms: mean of every block."""
    x, y = im.units
    _, h, v, q = im.parts[0] if len(im.parts) > 1 else (*im.parts[0][:1], 1, 1, im.parts[0][3])
    dc = coef[:, 0].astype(np.int64).reshape(y, x, -1)[:, :, : h * v].reshape(y, x, v, h)
    grey = dc.transpose(0, 2, 1, 3).reshape(y * v, x * h) * int(im.quant[q][0])
    grey = grey[: -(-im.height // 8), : -(-im.width // 8)]
    return np.clip(np.round(grey / 8 + 128), 0, 255).astype(np.uint8)


def cells(n: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each of ``many`` stretches that together cover ``n`` pixels;
    where pixels are fewer than stretches, neighbours share them."""
    begin = np.arange(many) * n // many
    return begin, np.maximum(begin + 1, (np.arange(many) + 1) * n // many)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8 by 8 cells are brighter than their right neighbours, by the
    mean over all pixels of a cell."""
    (top, bottom), (left, right) = cells(thumb.shape[0], 8), cells(thumb.shape[1], 9)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    box = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    size = (bottom - top)[:, None] * (right - left)[None, :]
    # Means compared without division.
    return np.packbits(box[:, :-1] * size[:, 1:] > box[:, 1:] * size[:, :-1]).tobytes().hex()


def payload_of(im: Image, coef: np.ndarray) -> tuple[int, bytes]:
    """Stored length and payload bytes of an image that ``encode_payloads`` made."""
    n = int(im.comment.removeprefix(b"bytes="))
    return n, _BYTES[coef.astype(np.int64) + 256].tobytes()[: max(64, -(-n // 64) * 64)]


# -- columns -------------------------------------------------------------------

#: Payload bytes that are coded or decoded at once.
BATCH = 600_000


def _batched(items: Iterator[tuple], weigh: int) -> Iterator[list[tuple]]:
    some: list[tuple] = []
    size = 0
    for x in items:
        some.append(x)
        size += max(64, len(x[weigh]))
        if size >= BATCH:
            yield some
            some, size = [], 0
    if some:
        yield some


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id and media: every text's UTF-8 bytes, zero-padded, as a grey JPEG."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            items = ((d, (t or "").encode()) for b in slices(batches) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for some in _batched(items, 1):
                raw = [t for _, t in some]
                yield from zip([d for d, _ in some], encode_payloads([padded(t) for t in raw], [len(t) for t in raw]), strict=True)

        yield from to_batches(rows(), arrow)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def media_features(media: DataFrame) -> DataFrame:
    """Per image: width, height and thumbnail hash; null where it is no baseline JPEG.

    Works on any (doc_id, media) table. Images are decoded together; when one is
    damaged, those decoded with it are tried one by one.
    """
    ddl = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, width int, height int, thumb_hash string"
    arrow = arrow_schema(media.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, _, got in decoded(batches):
                yield (doc, None, None, None) if got is None else (doc, got[0].width, got[0].height, thumbnail_hash(thumbnail(*got)))

        yield from to_batches(rows(), arrow)

    return media.select("doc_id", "media").mapInArrow(run, ddl)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(doc_id, media, (image, coefficients) or None)`` for every row."""
    items = ((d, m or b"") for b in slices(batches) for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for some in _batched(items, 1):
        for (doc, media), got in zip(some, _try([m for _, m in some]), strict=True):
            yield doc, media, got


def _try(media: list[bytes]) -> list:
    try:
        images = [parse(m) for m in media]
        return list(zip(images, decode_scans(images), strict=True))
    except (ValueError, KeyError, IndexError, struct.error):
        return [None] if len(media) == 1 else [_try([m])[0] for m in media]


def stored_text_features(docs: DataFrame) -> DataFrame:
    """Store every text as a JPEG, read the stored bytes back, return digests and features.

    A null or empty text is 64 zero bytes; rows of equal or null id stay apart;
    equal texts give equal values; an empty table gives an empty result; columns
    other than doc_id and text are not read.
    """
    media = saved(store_text(docs), "media")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    arrow = arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, raw, (im, coef) in decoded(batches):
                n, payload = payload_of(im, coef)
                feature = f"{im.width}x{im.height}:{thumbnail_hash(thumbnail(im, coef))}"
                yield doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature

        yield from to_batches(rows(), arrow)

    return media.mapInArrow(run, ddl)
