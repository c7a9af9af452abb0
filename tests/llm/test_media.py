"""Baseline JPEG: lossless payloads, a general decoder, thumbnails."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushdex.llm import jpeg


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=4))
def test_payload_round_trip(items):
    media = jpeg.encode_payloads([jpeg.padded(x) for x in items], [len(x) for x in items])
    images = [jpeg.parse(m) for m in media]
    for x, im, coef in zip(items, images, jpeg.decode_scans(images), strict=True):
        assert jpeg.payload_of(im, coef) == (len(x), jpeg.padded(x))


def test_long_payloads_are_coded_in_stretches(monkeypatch):
    items = [b"some words \xff\x00" * n for n in (1, 900, 40)]
    make = lambda: jpeg.encode_payloads([jpeg.padded(x) for x in items], [len(x) for x in items])
    whole = make()
    monkeypatch.setattr(jpeg, "STRETCH", 7)
    assert make() == whole


def test_padding():
    assert [len(jpeg.padded(bytes(n))) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def test_code_lengths_are_a_prefix_code():
    for spec in (*jpeg.text_tables(), jpeg.code_lengths({k: 2.0**-k for k in range(40)})):
        bits, symbols = spec
        assert len(symbols) == sum(bits) and sum(n / 2 ** (k + 1) for k, n in enumerate(bits)) < 1  # all ones stays free
        assert len(bits) == 16


class Writer:
    """Scalar reference coder for any component layout, with its own tables."""

    def __init__(self):
        self.bits = ""

    def put(self, value, size):
        self.bits += format(value, f"0{size}b") if size else ""

    def coefficient(self, v, code, sym_of):
        n = abs(v).bit_length()
        c, s = code[sym_of(n)]
        self.put(c, s)
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def block(self, zz, pred, dc, ac):
        self.coefficient(zz[0] - pred, dc, lambda n: n)
        run = 0
        for v in zz[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                self.put(*ac[0xF0])
                run -= 16
            self.coefficient(v, ac, lambda n, run=run: run << 4 | n)
            run = 0
        if run:
            self.put(*ac[0])
        return zz[0]

    def data(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[k : k + 8], 2) for k in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


def scalar_jpeg(width, height, comps, blocks, restart=0):
    """``comps`` are (h, v) factors; ``blocks`` the zigzag blocks in scan order."""
    dc_spec = jpeg.code_lengths({s: 2.0**-s + 0.01 for s in range(12)})
    ac_spec = jpeg.code_lengths({r << 4 | s: 0.5 ** (r + s) + 1e-6 for r in range(16) for s in range(1, 11)} | {0: 0.2, 0xF0: 1e-4})
    tables = []
    for spec in (dc_spec, ac_spec):
        code, size = jpeg.canonical(*spec)
        tables.append({s: (int(code[s]), int(size[s])) for s in range(256) if size[s]})
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    out = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes([16] * 64)) + seg(0xC4, b"\x00" + bytes(dc_spec[0]) + dc_spec[1] + b"\x10" + bytes(ac_spec[0]) + ac_spec[1])
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(comps)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(comps)))
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    out += seg(0xDA, bytes([len(comps)]) + b"".join(bytes([k + 1, 0]) for k in range(len(comps))) + b"\x00\x3f\x00")
    layout = [0] if len(comps) == 1 else [k for k, (h, v) in enumerate(comps) for _ in range(h * v)]
    units = len(blocks) // len(layout)
    w, pred, n = Writer(), [0] * len(comps), 0
    for u in range(units):
        if restart and u and u % restart == 0:
            out += w.data() + bytes([0xFF, 0xD0 + n % 8])
            w, pred, n = Writer(), [0] * len(comps), n + 1
        for k, c in enumerate(layout):
            pred[c] = w.block(blocks[u * len(layout) + k], pred[c], *tables)
    return out + w.data() + b"\xff\xd9"


@pytest.mark.parametrize(("comps", "restart"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_decoder_against_scalar_coder(comps, restart):
    rng = np.random.default_rng(len(comps) + restart)
    per = 1 if len(comps) == 1 else sum(h * v for h, v in comps)
    mh, mv = (8, 8) if len(comps) == 1 else (8 * max(h for h, _ in comps), 8 * max(v for _, v in comps))
    media, want = [], []
    for w, h in ((40, 24), (17, 33), (8, 8)):
        units = -(-w // mh) * -(-h // mv)
        b = np.where(rng.random((units * per, 64)) < 0.15, rng.integers(-900, 900, (units * per, 64)), 0)
        media.append(scalar_jpeg(w, h, comps, b.tolist(), restart))
        want.append(b)
    images = [jpeg.parse(m) for m in media]
    for got, b, im in zip(jpeg.decode_scans(images), want, images, strict=True):
        assert (got == b).all()
        thumb = jpeg.thumbnail(im, got)
        assert thumb.shape == (-(-im.height // 8), -(-im.width // 8))


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (8, 9), (40, 31), (125, 125)])
def test_thumbnail_hash_takes_every_pixel(shape):
    rng = np.random.default_rng(5)
    thumb = rng.integers(0, 256, shape).astype(np.uint8)
    bits = []
    for k in range(8):
        mean = []
        for j in range(9):
            a, b = k * shape[0] // 8, j * shape[1] // 9
            mean.append(thumb[a : max(a + 1, (k + 1) * shape[0] // 8), b : max(b + 1, (j + 1) * shape[1] // 9)].mean())
        bits += [mean[j] > mean[j + 1] for j in range(8)]
    assert jpeg.thumbnail_hash(thumb) == np.packbits(bits).tobytes().hex()


def test_thumbnail_values():
    blocks = np.zeros((6, 64), int)
    blocks[:, 0] = [0, 32, -32, 64, -64, 8]
    im = jpeg.parse(scalar_jpeg(24, 16, [(1, 1)], blocks.tolist()))
    assert jpeg.thumbnail(im, jpeg.decode_scans([im])[0]).tolist() == [[128, 192, 64], [255, 0, 144]]


def test_media_features(spark):
    good = scalar_jpeg(24, 16, [(1, 1)], np.zeros((6, 64), int).tolist())
    rows = [(1, bytearray(good)), (2, bytearray(b"no picture")), (3, None), (4, bytearray(good[:-12])), (5, bytearray(good))]
    got = {r["doc_id"]: r for r in jpeg.media_features(spark.createDataFrame(rows, "doc_id bigint, media binary")).collect()}
    assert (got[1]["width"], got[1]["height"]) == (24, 16) and got[1]["thumb_hash"] == got[5]["thumb_hash"]
    assert got[2]["width"] is None and got[3]["thumb_hash"] is None


def test_stored_text(spark):
    texts = ["Hello there", "", None, "é" * 100, "x" * 64, "long words " * 3000, "\x00\xff", "Hello there"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, feature string")
    got = {r["doc_id"]: r for r in jpeg.stored_text_features(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[0][1:] == got[7][1:] and got[1][1:] == got[2][1:]
    assert jpeg.stored_text_features(df.where("false")).collect() == []
