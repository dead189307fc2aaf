import hashlib
import zlib

import numpy as np
import pytest

from chainframe.llm import media
from chainframe.llm.progressive_jpeg import BASIS, ZIGZAG, Image, _scan, _segment, encode


def test_digests(docs, rows, empty):
    found = sorted((tuple(r)[:5] for r in media.media_digests(docs).collect()), key=str)
    expected = []
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        expected.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert found == sorted(expected, key=str)
    assert media.media_digests(empty).count() == 0


def test_file_columns_by_the_symbol_reader(docs, rows, monkeypatch):
    """media_bytes, media_sha256 and feature of files read symbol by symbol, without the reader of fixed fields."""
    found = {r["payload_sha256"]: r for r in media.media_digests(docs).collect()}
    monkeypatch.setattr(Image, "_read_fields", lambda *a: False)
    texts = sorted({r[1] or "" for r in rows}, key=len)
    for text in [*texts[:4], texts[len(texts) // 2]]:
        b = text.encode()
        payload = np.frombuffer(b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b)), np.uint8)
        file = encode(payload)
        image, r = Image(file), found[hashlib.sha256(payload.tobytes()).hexdigest()]
        assert image.payload() == payload.tobytes() and (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        mean = image.rgb().reshape(-1, 3).mean(0)
        assert r["feature"] == f"{image.width}x{image.height} " + " ".join(f"{m:.3f}" for m in mean)


def test_names_of_a_file_table_may_clash(spark):
    files = spark.createDataFrame([(5, "x", bytearray(encode(np.full(576, 9, np.uint8))))], "height int, payload string, media binary")
    (r,) = media.decode_media(files).collect()
    assert bytes(r["payload"]) == b"\x09" * 576 and r["height"] * r["width"] * 3 == len(r["rgb"])


def test_equal_texts_give_equal_media(docs):
    rows = media.media_digests(docs).collect()
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


@pytest.mark.parametrize("units", [1, 2, 7, 30])
def test_round_trip_and_symbol_reader(units, monkeypatch):
    payload = np.random.default_rng(units).integers(0, 256, 576 * units, dtype=np.uint8)
    data = encode(payload)
    quick = Image(data)
    assert quick.payload() == payload.tobytes()
    monkeypatch.setattr(Image, "_read_fields", lambda *a: False)
    slow = Image(data)
    assert all((quick.parts[c]["coefficients"] == slow.parts[c]["coefficients"]).all() for c in quick.parts)
    assert (quick.rgb() == slow.rgb()).all()


class Writer:
    """Any coefficients as a one-component progressive file with zero runs, end-of-band runs, refinements and new coefficients."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in reversed(range(n))]

    def symbol(self, s):
        self.put(s, 9)  # a table in which symbol s has the nine-bit code s

    def magnitude(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)


def test_general_scans():
    rng = np.random.default_rng(5)
    rows, columns = 3, 4
    c = np.where(rng.random((rows * columns, 64)) < 0.15, rng.integers(-40, 41, (rows * columns, 64)), 0)
    c[2:6, 1:] = 0
    cut = lambda v: np.sign(v) * (np.abs(v) >> 1)
    counts = bytes([0] * 8 + [256 - 1, *[0] * 7])  # 255 codes of nine bits
    table = counts + bytes(range(255))
    out = [b"\xff\xd8", _segment(0xDB, b"\0" + bytes([3] * 64)), _segment(0xC2, bytes([8, 0, 8 * rows, 0, 8 * columns, 1, 1, 0x11, 0])), _segment(0xC4, b"\0" + table + b"\x10" + table)]
    w, before = Writer(), 0
    for v in c[:, 0] >> 1:
        d = int(v) - before
        before = int(v)
        size = abs(d).bit_length()
        w.symbol(size)
        if size:
            w.magnitude(d, size)
    out.append(_scan([(1, 0)], (0, 0), 0, 1, np.array(w.bits, np.uint8)))
    w, run = Writer(), 0

    def flush(more=()):
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0
        w.bits.extend(more)

    for block in cut(c):
        zeros, last = 0, int(max(np.flatnonzero(block[1:]) + 1, default=0))
        if last:
            flush()
        for k in range(1, last + 1):
            if not block[k]:
                zeros += 1
                continue
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            size = int(abs(block[k])).bit_length()
            w.symbol(zeros << 4 | size)
            w.magnitude(int(block[k]), size)
            zeros = 0
        run += last < 63
    flush()
    out.append(_scan([(1, 0)], (1, 63), 0, 1, np.array(w.bits, np.uint8)))
    w, run, held = Writer(), 0, []
    for block in c:
        old = cut(block)
        new = [k for k in range(1, 64) if block[k] and not old[k]]
        if new:
            flush(held)
            held = []
        zeros, fixes = 0, []
        for k in range(1, (new[-1] if new else 0) + 1):
            if old[k]:
                fixes.append(abs(int(block[k])) & 1)
            elif k in new:
                w.symbol(zeros << 4 | 1)
                w.put(int(block[k] > 0), 1)
                w.bits += fixes
                zeros, fixes = 0, []
            else:
                zeros += 1
                if zeros == 16:  # with the corrections among them
                    w.symbol(0xF0)
                    w.bits += fixes
                    zeros, fixes = 0, []
        if not new or new[-1] < 63:
            run += 1
            held += [abs(int(block[k])) & 1 for k in range((new[-1] if new else 0) + 1, 64) if old[k]]
    flush(held)
    out.append(_scan([(1, 0)], (1, 63), 1, 0, np.array(w.bits, np.uint8)))
    out.append(_scan([(1, 0)], (0, 0), 1, 0, np.array([v & 1 for v in c[:, 0]], np.uint8)))
    image = Image(b"".join([*out, b"\xff\xd9"]))
    assert (image.parts[1]["coefficients"].reshape(-1, 64) == c).all()
    grey = image.rgb()
    natural = np.zeros(64)
    natural[ZIGZAG] = c[0] * 3
    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    basis[:, 0] /= np.sqrt(2)
    block = basis @ natural.reshape(8, 8) @ basis.T + 128
    assert np.abs(grey[:8, :8, 0] - block.clip(0, 255)).max() <= 0.51 and BASIS.shape == (64, 64)


def test_decode_keeps_other_columns_and_nulls(spark):
    data = bytearray(encode(np.full(576, 9, np.uint8)))
    files = spark.createDataFrame([(1, data), (2, None)], "name int, media binary")
    found = {r["name"]: r for r in media.decode_media(files).collect()}
    assert found[2]["rgb"] is None and len(found[1]["rgb"]) == found[1]["height"] * found[1]["width"] * 3
    assert bytes(found[1]["payload"]) == b"\x09" * 576


def test_not_a_progressive_file():
    with pytest.raises(ValueError):
        Image(b"GIF89a")
