"""Progressive JPEG: bytes kept losslessly as coefficients, and files read into coefficient arrays and RGB tensors.

A stored byte b is the quantized coefficient b + 2. The file holds it in spectral-selection scans (DC; luma
AC 1-5 and 6-63; chroma AC 1-63) of all but its last bit, and in successive-approximation scans of that bit. The Huffman
tables give size s a code of 9 - s bits, so each coefficient takes nine bits with its magnitude and no
band has zeros; the reader sees this from a scan's fields and then takes them all at once. Scans
of any other make-up (zero runs, end-of-band runs, restarts, new coefficients in refinements) are read symbol by symbol.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The zigzag order of the format: natural index of each coefficient.
ZIGZAG = np.array([8 * y + x for s in range(15) for y, x in ((y, s - y) for y in (range(s + 1) if s % 2 else range(s, -1, -1))) if y < 8 and x < 8])
_PAD = 255  # of payload blocks that only fill the image
_COMPONENTS = ((1, 2), (2, 1), (3, 1))  # id, sampling in both directions


def _basis() -> np.ndarray:
    """Coefficients in zigzag order to samples, both as rows of 64."""
    k = np.arange(8)
    one = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    one[:, 0] /= np.sqrt(2)
    return np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


class Table:
    """A Huffman table from its counts by length and its symbols; `width` is the size of code and magnitude together where that is one number."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
        self.symbols, self.codes, code = list(symbols), [], 0
        for k, n in enumerate(self.lengths):
            code <<= n - (self.lengths[k - 1] if k else 0)
            self.codes.append(code)
            code += 1
        self.by_code = {(n, c): s for n, c, s in zip(self.lengths, self.codes, self.symbols)}
        widths = {n + (s & 15) for n, s in zip(self.lengths, self.symbols)}
        self.width = widths.pop() if len(widths) == 1 and max(self.symbols) < 16 else 0
        if self.width:
            self.size = np.full(1 << self.width, -1, np.int16)  # of the magnitude in each possible field
            for n, c, s in zip(self.lengths, self.codes, self.symbols):
                self.size[c << s : (c + 1) << s] = s

    def field(self, size: int, value: np.ndarray) -> np.ndarray:
        """Code and magnitude of values of one size."""
        k = self.symbols.index(size)
        return self.codes[k] << size | np.where(value < 0, value + (1 << size) - 1, value)


@lru_cache(maxsize=64)
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(counts, symbols)


def _lengths(sizes: range) -> tuple[bytes, bytes]:
    """A table for these sizes of codes of 9 - size bits."""
    order = sorted(sizes, reverse=True)
    return bytes(sum(9 - s == n for s in order) for n in range(1, 17)), bytes(order)


_DC, _AC, _REFINE = _lengths(range(9)), _lengths(range(1, 9)), (bytes([1, *[0] * 15]), b"\0")
_VALUES = np.arange(-127, 129)
_SIZES = np.array([int(abs(v)).bit_length() for v in _VALUES])
_DC_FIELD, _AC_FIELD = np.zeros(256, np.uint16), np.zeros(256, np.uint16)  # by value + 127
for _s in range(9):
    _DC_FIELD[_SIZES == _s] = _table(*_DC).field(_s, _VALUES[_SIZES == _s])
    if _s:
        _at = (_SIZES == _s) & (_VALUES > 0)
        _AC_FIELD[_at] = _table(*_AC).field(_s, _VALUES[_at])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(components: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, bits: np.ndarray) -> bytes:
    """A scan of components (id, table byte); `bits` are filled up with ones, and 0 follows each byte 255."""
    body = bytes([len(components), *(x for c in components for x in c), *band, high << 4 | low])
    fill = np.ones(-len(bits) % 8, np.uint8)
    return _segment(0xDA, body) + np.packbits(np.concatenate([bits, fill])).tobytes().replace(b"\xff", b"\xff\0")


def _bits(fields: np.ndarray) -> np.ndarray:
    """The low nine bits of each."""
    return np.unpackbits(fields.astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 7:].reshape(-1)


def _raster(across: int, down: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Payload block of each luma block in raster order, for images of MCUs of four luma and two chroma blocks; and MCU numbers."""
    mcu = np.arange(across * down)
    grid = (6 * mcu.reshape(down, across)[:, :, None, None] + np.array([[0, 1], [2, 3]])).transpose(0, 2, 1, 3)
    return grid.reshape(-1), mcu


@lru_cache(maxsize=512)
def _layout(blocks: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    mcus = max(1, -(-blocks // 6))
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    return across, down, *_raster(across, down, blocks)


def encode(payload: np.ndarray) -> bytes:
    """A 4:2:0 file that holds the bytes, a positive multiple of 64 of them."""
    blocks = len(payload) // 64
    across, down, luma, mcu = _layout(blocks)
    if 16 * max(across, down) > 65535:
        raise ValueError("more bytes than one image can hold")
    full = np.full((6 * across * down, 64), _PAD + 2, np.int16)
    full[:blocks] = payload.reshape(-1, 64).astype(np.int16) + 2
    top, last = full >> 1, (full & 1).astype(np.uint8)
    dc = top[:, 0].reshape(-1, 6)
    step = np.empty_like(dc)
    y = dc[:, :4].reshape(-1)
    step[:, :4] = np.diff(y, prepend=0).reshape(-1, 4)
    step[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=0)
    out = [b"\xff\xd8", _segment(0xFE, f"bytes {len(payload)}".encode()), _segment(0xDB, b"\0" + b"\1" * 64)]
    out.append(_segment(0xC2, bytes([8]) + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, *(x for c, n in _COMPONENTS for x in (c, n << 4 | n, 0))])))
    out.append(_segment(0xC4, b"".join(bytes([k]) + counts + symbols for k, (counts, symbols) in ((0x00, _DC), (0x10, _AC), (0x11, _REFINE)))))
    every = [(c, 0) for c, _ in _COMPONENTS]
    out.append(_scan(every, (0, 0), 0, 1, _bits(_DC_FIELD[step.reshape(-1) + 127])))
    parts = [(1, luma), (2, 6 * mcu + 4), (3, 6 * mcu + 5)]
    fields = _AC_FIELD[top + 127]
    for c, at in parts:
        own = fields[at]
        for a, z in ((1, 5), (6, 63)) if c == 1 else ((1, 63),):
            out.append(_scan([(c, 0)], (a, z), 0, 1, _bits(own[:, a : z + 1].reshape(-1))))
    for c, at in parts:
        bits = last[at]
        bits[:, 0] = 0  # an end-of-band code, and a correction bit for each coefficient
        out.append(_scan([(c, 1)], (1, 63), 1, 0, bits.reshape(-1)))
    out.append(_scan(every, (0, 0), 1, 0, last[:, 0]))
    return b"".join([*out, b"\xff\xd9"])


class Image:
    """A progressive file's components: coefficient arrays (rows of blocks, blocks, 64 in zigzag order), sampling and quantizers."""

    def __init__(self, data: bytes):
        self.height = self.width = 0
        self.parts: dict[int, dict] = {}
        self.comment = b""
        tables: dict[int, Table] = {}
        quantizers: dict[int, np.ndarray] = {}
        at, restart = 2, 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    quantizers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                found = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
                self.h, self.v = max(x[1] for x in found), max(x[2] for x in found)
                self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
                for c, h, v, q in found:
                    self.parts[c] = {"h": h, "v": v, "q": q, "coefficients": np.zeros((self.down * v, self.across * h, 64), np.int32)}
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
                raise ValueError("not a progressive Huffman file")
            elif marker == 0xDA:
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0:
                        raise ValueError("the file ends in a scan")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self._read(body, data[at:end], tables, restart)
                at = end
        for part in self.parts.values():
            part["q"] = quantizers[part["q"]]

    def _read(self, head: bytes, entropy: bytes, tables: dict[int, Table], restart: int) -> None:
        n = head[0]
        chosen = [(head[1 + 2 * k], head[2 + 2 * k]) for k in range(n)]
        first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        parts = [(self.parts[c], tables.get(t >> 4), tables.get(0x10 | t & 15)) for c, t in chosen]
        if not restart and self._read_fields(parts, entropy.replace(b"\xff\0", b"\xff"), first, last, high, low):
            return
        read_symbols(self, parts, entropy, first, last, high, low, restart)

    def _grid(self, part: dict) -> tuple[int, int]:
        """Rows and columns of blocks in a scan of this component alone."""
        wide, tall = -(-self.width * part["h"] // self.h), -(-self.height * part["v"] // self.v)
        return -(-tall // 8), -(-wide // 8)

    def _read_fields(self, parts, data: bytes, first: int, last: int, high: int, low: int) -> bool:
        """Reads a scan whose fields all have one width; False, and nothing read, for any other."""
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        if first == 0:
            slots = [(p, y, x) for p, _, _ in parts for y in range(p["v"]) for x in range(p["h"])] if len(parts) > 1 else None
            if slots is None:
                return False
            n = self.across * self.down * len(slots)
            if high:
                if -(-n // 8) != len(data):
                    return False
                values = bits[:n].reshape(-1, len(slots)).astype(np.int32) << low
            else:
                table = parts[0][1]
                if any(t is not table for _, t, _ in parts) or not table.width or -(-n * table.width // 8) != len(data):
                    return False
                values = self._values(bits, n, table)
                if values is None:
                    return False
                values = values.reshape(-1, len(slots))
            k = 0
            for p, _, _ in parts:
                own = values[:, k : k + p["v"] * p["h"]]
                k += p["v"] * p["h"]
                if not high:
                    own = np.cumsum(own.reshape(-1)).reshape(own.shape) << low
                grid = own.reshape(self.down, self.across, p["v"], p["h"]).transpose(0, 2, 1, 3).reshape(self.down * p["v"], -1)
                p["coefficients"][:, :, 0] |= grid
            return True
        part, _, table = parts[0]
        rows, columns = self._grid(part)
        band = part["coefficients"][:rows, :columns, first : last + 1]
        n = rows * columns
        if high:
            if table.symbols != [0] or (1 + last - first + 1) * n > 8 * len(data) or not band.all():
                return False
            each = bits[: n * (last - first + 2)].reshape(n, -1)
            if each[:, 0].any():
                return False
            more = each[:, 1:].reshape(band.shape).astype(np.int32) << low
            band += np.where(band > 0, more, -more)
            return True
        n *= last - first + 1
        if not table.width or -(-n * table.width // 8) != len(data) or 0 in table.symbols:
            return False
        values = self._values(bits, n, table)
        if values is None:
            return False
        band[:] = values.reshape(band.shape) << low
        return True

    @staticmethod
    def _values(bits: np.ndarray, n: int, table: Table) -> np.ndarray | None:
        wide = np.zeros((n, 16), np.uint8)
        wide[:, 16 - table.width :] = bits[: n * table.width].reshape(n, table.width)
        fields = np.packbits(wide.reshape(-1)).view(">u2").astype(np.int32)
        size = table.size[fields].astype(np.int32)
        if len(size) and size.min() < 0:
            return None
        value = fields & (1 << size) - 1
        return np.where((value << 1) >> size > 0, value, value - (1 << size) + 1)

    def rgb(self) -> np.ndarray:
        """The image as height x width x 3 bytes: inverse transform, chroma repeated to full resolution, and the format's colour matrix."""
        planes = []
        for part in self.parts.values():
            c = part["coefficients"]
            rows, columns = c.shape[:2]
            samples = (c.reshape(-1, 64).astype(np.float32) * part["q"]) @ BASIS + 128
            plane = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
            plane = plane.clip(0, 255)
            if part["v"] < self.v:
                plane = plane.repeat(self.v // part["v"], 0)
            if part["h"] < self.h:
                plane = plane.repeat(self.h // part["h"], 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            planes = [planes[0], np.float32(128), np.float32(128)]
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((self.height, self.width, 3), np.float32)
        out[..., 0] = y + 1.402 * cr
        out[..., 1] = y - 0.344136 * cb - 0.714136 * cr
        out[..., 2] = y + 1.772 * cb
        return np.rint(out.clip(0, 255)).astype(np.uint8)

    def payload(self) -> bytes:
        """The bytes of a file made by `encode`."""
        n = int(self.comment.split()[1])
        across, down, luma, mcu = _layout(n // 64)
        full = np.empty((6 * across * down, 64), np.uint8)
        for at, part in zip((luma, 6 * mcu + 4, 6 * mcu + 5), self.parts.values()):
            full[at] = part["coefficients"].reshape(-1, 64) - 2
        return full.reshape(-1)[:n].tobytes()


def read_symbols(image: Image, parts, entropy: bytes, first: int, last: int, high: int, low: int, restart: int) -> None:
    """Reads any scan, symbol by symbol: zero runs, end-of-band runs, refinements and restarts."""
    pieces, begin = [], 0
    for k in range(len(entropy) - 1):
        if entropy[k] == 0xFF and 0xD0 <= entropy[k + 1] <= 0xD7:
            pieces.append(entropy[begin:k])
            begin = k + 2
    pieces.append(entropy[begin:])
    if len(parts) > 1:
        units = [[(p, dc, ac, my * p["v"] + y, mx * p["h"] + x) for p, dc, ac in parts for y in range(p["v"]) for x in range(p["h"])] for my in range(image.down) for mx in range(image.across)]
    else:
        p, dc, ac = parts[0]
        rows, columns = image._grid(p)
        units = [[(p, dc, ac, y, x)] for y in range(rows) for x in range(columns)]
    size = restart or len(units)
    for number, data in enumerate(pieces):
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        at, run, before = 0, 0, {}

        def take(n: int) -> int:
            nonlocal at
            value = 0
            for _ in range(n):
                value = value << 1 | (bits[at] if at < len(bits) else 1)
                at += 1
            return value

        def symbol(table: Table) -> int:
            code = 0
            for n in range(1, 17):
                code = code << 1 | take(1)
                if (n, code) in table.by_code:
                    return table.by_code[n, code]
            raise ValueError("a code is in no table")

        def signed(n: int) -> int:
            value = take(n)
            return value if n == 0 or value >> n - 1 else value - (1 << n) + 1

        for unit in units[number * size : (number + 1) * size]:
            for p, dc, ac, y, x in unit:
                block = p["coefficients"][y, x]
                if first == 0:
                    if high:
                        block[0] |= take(1) << low
                    else:
                        before[id(p)] = before.get(id(p), 0) + signed(symbol(dc))
                        block[0] = before[id(p)] << low
                    continue
                k = first
                if not high:
                    if run:
                        run -= 1
                        continue
                    while k <= last:
                        r, s = divmod(symbol(ac), 16)
                        if s:
                            k += r
                            block[k] = signed(s) << low
                            k += 1
                        elif r == 15:
                            k += 16
                        else:
                            run = (1 << r) + take(r) - 1
                            break
                    continue

                def correct(k: int) -> None:
                    if take(1):
                        block[k] += (1 << low) * (1 if block[k] > 0 else -1)

                while k <= last and not run:
                    r, s = divmod(symbol(ac), 16)
                    new = 0
                    if s:
                        new = (1 << low) * (1 if take(1) else -1)
                    elif r < 15:
                        run = (1 << r) + take(r)
                        break
                    while k <= last:
                        if block[k]:
                            correct(k)
                        elif r == 0:
                            if new:
                                block[k] = new
                            k += 1
                            break
                        else:
                            r -= 1
                        k += 1
                if run:
                    for j in range(k, last + 1):
                        if block[j]:
                            correct(j)
                    run -= 1
