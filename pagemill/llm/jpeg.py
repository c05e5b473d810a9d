"""Progressive JPEG: scans accumulate into coefficient arrays, numpy turns them into RGB.

``decode`` reads baseline-coded and progressive frames with Huffman coding, 8-bit samples, one to four components, any
sampling factors, restart intervals, spectral selection and successive approximation. Entropy-coded data is decoded
symbol by symbol, except where whole stretches can be taken at once: end-of-band runs (only correction bits of known
coefficients follow), refinements of DC, and stretches in which every symbol is the table's one-bit code, which is
checked bit by bit before it is used.

``store`` writes bytes without loss as coefficients, the format's unit: each byte is the sign and the low seven bits of
a coefficient of magnitude 128 to 255, so every AC coefficient is known from its first scan on. DC is zero.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: The zigzag order, natural position of each coefficient.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])

_STEP = np.arange(8)
#: The inverse transform's basis: row u holds frequency u at the eight places.
BASIS = (np.cos((2 * _STEP[None, :] + 1) * _STEP[:, None] * np.pi / 16) * np.where(_STEP == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)

NOTE = b"payload "


class Huffman:
    """A decoding table: 16 bits of look-ahead give length and symbol."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for bits, n in enumerate(counts, 1):
            for value in symbols[at : at + n]:
                low = code << (16 - bits)
                self.length[low : low + (1 << (16 - bits))] = bits
                self.symbol[low : low + (1 << (16 - bits))] = value
                code += 1
            at += n
            code <<= 1
        self.short = symbols[0] if counts[0] else None  # the symbol of code 0, one bit


huffman = lru_cache(64)(Huffman)


class Bits:
    """Bits of one restart interval; ones follow its end."""

    def __init__(self, raw: bytes):
        self.raw = raw.replace(b"\xff\x00", b"\xff")
        self.at, self.end = 0, 8 * len(self.raw)

    def many(self, n: int) -> np.ndarray:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        out = np.unpackbits(np.frombuffer(self.raw, np.uint8, max(0, min(b, len(self.raw)) - a), a))[self.at - 8 * a :][:n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.ones(n - len(out), np.uint8)])

    def peek(self) -> int:
        word = self.raw[self.at >> 3 : (self.at >> 3) + 3]
        return int.from_bytes(word + b"\xff" * (3 - len(word)), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek() >> (16 - n)
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        word = self.peek()
        bits = int(table.length[word])
        if not bits:
            raise ValueError("no such code")
        self.at += bits
        return int(table.symbol[word])

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, number: int, h: int, v: int, table: int):
        self.number, self.h, self.v, self.table = number, h, v, table
        self.blocks = np.zeros((0, 0, 64), np.int32)  # rows, columns, zigzag
        self.rows = self.columns = 0  # without the padding of interleaved scans


#: Pixels of the largest image that is read: what a header asks for is checked before anything is laid out.
MOST_PIXELS = 1 << 26


class Image:
    """A parsed file: coefficients and quantisation."""

    def __init__(self, raw: bytes):
        self.notes: list[bytes] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.components: list[Component] = []
        self.tables: dict[tuple[int, int], Huffman] = {}
        self.interval = 0
        self.transform: int | None = None  # how colours are coded, where the file says so
        self._read(raw)

    def _read(self, raw: bytes) -> None:
        if raw[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while at < len(raw):
            while raw[at : at + 1] == b"\xff" and raw[at + 1 : at + 2] == b"\xff":
                at += 1
            marker = raw[at + 1]
            at += 2
            if marker == 0xD9:
                return
            size = struct.unpack_from(">H", raw, at)[0]
            part = raw[at + 2 : at + size]
            at += size
            if marker == 0xDA:
                at = self._scan(part, raw, at)
            elif marker == 0xDB:
                self._quantiser(part)
            elif marker == 0xC4:
                self._huffman(part)
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", part)[0]
            elif marker == 0xFE:
                self.notes.append(part)
            elif marker == 0xEE and part[:5] == b"Adobe" and len(part) >= 12:
                self.transform = part[11]
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(part)
            elif 0xC3 <= marker <= 0xCF:
                raise ValueError("lossless, hierarchical or arithmetic frames are not read")
        raise ValueError("the file ends early")

    def _quantiser(self, part: bytes) -> None:
        while part:
            wide, number = divmod(part[0], 16)
            n = 64 * (1 + wide)
            self.quantisers[number] = np.frombuffer(part[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
            part = part[1 + n :]

    def _huffman(self, part: bytes) -> None:
        while part:
            counts = part[1:17]
            n = sum(counts)
            self.tables[divmod(part[0], 16)] = huffman(counts, part[17 : 17 + n])
            part = part[17 + n :]

    def _frame(self, part: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", part)
        if precision != 8 or not self.height or not self.width:
            raise ValueError("8-bit samples and a size are expected")
        if self.components or not 1 <= n <= 4:
            raise ValueError("one frame of one to four components is expected")
        if self.height * self.width > MOST_PIXELS:
            raise ValueError(f"more than {MOST_PIXELS} pixels")
        for i in range(n):
            number, factors, table = part[6 + 3 * i : 9 + 3 * i]
            if not (1 <= factors >> 4 <= 4 and 1 <= factors & 15 <= 4):
                raise ValueError("sampling factors are 1 to 4")
            self.components.append(Component(number, factors >> 4, factors & 15, table))
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.rows, c.columns = -(-(-(-self.height * c.v // self.v)) // 8), -(-(-(-self.width * c.h // self.h)) // 8)
            c.blocks = np.zeros((self.down * c.v, self.across * c.h, 64), np.int32)

    def _scan(self, part: bytes, raw: bytes, at: int) -> int:
        chosen = []
        for i in range(part[0]):
            number, tables = part[1 + 2 * i], part[2 + 2 * i]
            component = next(c for c in self.components if c.number == number)
            chosen.append((component, self.tables.get((0, tables >> 4)), self.tables.get((1, tables & 15))))
        first, last, planes = part[1 + 2 * part[0] :][:3]
        end, pieces = at, [at]
        while True:  # up to a marker that is neither a stuffed byte nor a restart
            end = raw.index(b"\xff", end)
            kind = raw[end + 1]
            if 0xD0 <= kind <= 0xD7:
                pieces.append(end + 2)
            elif kind != 0:
                break
            end += 2
        units = self._units(chosen)
        each = self.interval or len(units[0])
        for i, begin in enumerate(pieces):
            stop = pieces[i + 1] - 2 if i + 1 < len(pieces) else end
            self._interval(Bits(raw[begin:stop]), chosen, [u[i * each : (i + 1) * each] for u in units], first, last, planes >> 4, planes & 15)
        return end

    def _units(self, chosen: list) -> list[np.ndarray]:
        """For each component of a scan: (units, blocks of a unit), as numbers into its flattened blocks."""
        if len(chosen) == 1:
            c = chosen[0][0]
            return [(np.arange(c.rows)[:, None] * c.blocks.shape[1] + np.arange(c.columns)).reshape(-1, 1)]
        out = []
        for c, _, _ in chosen:
            y = np.arange(self.down)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None]
            x = np.arange(self.across)[None, :, None, None] * c.h + np.arange(c.h)[None, None, None, :]
            out.append((y * c.blocks.shape[1] + x).reshape(self.down * self.across, c.v * c.h))
        return out

    def _interval(self, bits: Bits, chosen: list, units: list[np.ndarray], first: int, last: int, high: int, low: int) -> None:
        flat = [c.blocks.reshape(-1, 64) for c, _, _ in chosen]
        if first == 0 and last == 63 and high == 0 and low == 0:
            self._sequential(bits, chosen, units, flat)
        elif first == 0 and high:
            order = np.concatenate(units, axis=1)
            found = bits.many(order.size).reshape(order.shape).astype(np.int32) << low
            at = 0
            for own, u in zip(flat, units):
                own[u, 0] |= found[:, at : at + u.shape[1]]
                at += u.shape[1]
        elif first == 0:
            self._dc(bits, chosen, units, flat, low)
        elif high:
            _ac_refined(bits, flat[0], units[0].ravel(), chosen[0][2], first, last, low)
        else:
            _ac_first(bits, flat[0], units[0].ravel(), chosen[0][2], first, last, low)

    def _dc(self, bits: Bits, chosen: list, units: list[np.ndarray], flat: list[np.ndarray], low: int) -> None:
        n = sum(u.size for u in units)
        if all(table.short == 0 for _, table, _ in chosen) and bits.end - bits.at >= n:
            begin = bits.at
            if not bits.many(n).any():  # all differences are zero
                for own, u in zip(flat, units):
                    own[u, 0] = 0
                return
            bits.at = begin
        before = [0] * len(units)
        for i in range(len(units[0])):
            for j, (own, u) in enumerate(zip(flat, units)):
                for block in u[i]:
                    before[j] += bits.signed(bits.symbol(chosen[j][1]))
                    own[block, 0] = before[j] << low

    def _sequential(self, bits: Bits, chosen: list, units: list[np.ndarray], flat: list[np.ndarray]) -> None:
        before = [0] * len(units)
        for i in range(len(units[0])):
            for j, (own, u) in enumerate(zip(flat, units)):
                for block in u[i]:
                    before[j] += bits.signed(bits.symbol(chosen[j][1]))
                    own[block, 0] = before[j]
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.symbol(chosen[j][2]), 16)
                        if not size:
                            if run < 15:
                                break
                            k += 16
                            continue
                        k += run
                        own[block, k] = bits.signed(size)
                        k += 1

    def planes(self) -> list[np.ndarray]:
        """Samples of each component, at its own resolution."""
        out = []
        for c in self.components:
            natural = np.zeros((*c.blocks.shape[:2], 64), np.float32)
            natural[..., ZIGZAG] = c.blocks * self.quantisers[c.table]
            samples = np.matmul(np.matmul(BASIS.T, natural.reshape(-1, 8, 8)), BASIS)
            samples = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)
            rows, columns = c.blocks.shape[:2]
            out.append(samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8))
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) bytes, chroma brought to full resolution; one component gives grey."""
        full = []
        for c, plane in zip(self.components, self.planes()):
            wide = np.repeat(np.repeat(plane, self.v // c.v, axis=0), self.h // c.h, axis=1) if not (self.v % c.v or self.h % c.h) else \
                plane[(np.arange(self.height) * c.v // self.v)[:, None], np.arange(self.width) * c.h // self.h]
            full.append(wide[: self.height, : self.width])
        if len(full) < 3:
            return np.repeat(full[0][:, :, None], 3, axis=2)
        coded = self.transform != 0 if len(full) == 3 else self.transform == 2  # luma and chroma, or colours as they are
        colours = _from_luma(*full[:3]) if coded else np.stack(full[:3], axis=2)
        if len(full) == 4:  # cyan, magenta, yellow and black, as ink left out where Adobe wrote the file
            ink = [colours.astype(np.int64), full[3].astype(np.int64)[:, :, None]]
            light = ink if self.transform is not None else [255 - x for x in ink]
            colours = ((light[0] * light[1] + 127) // 255).astype(np.uint8)
        return colours


def _from_luma(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    y, cb, cr = y.astype(np.float32), cb.astype(np.float32) - 128, cr.astype(np.float32) - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _ac_first(bits: Bits, own: np.ndarray, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    band = last - first + 1
    if table.short is not None and 0 < table.short < 16:  # no zeros before it
        width, n = 1 + table.short, len(blocks) * band
        if bits.end - bits.at >= n * width:
            begin = bits.at
            if width == 8 and not begin & 7:  # a byte each
                value = np.frombuffer(bits.raw, np.uint8, n, begin >> 3).astype(np.int32)
                if value.max() < 128:
                    bits.at += 8 * n
                    value -= np.where(value < 64, 127, 0)
                    own[blocks, first : last + 1] = (value << low).reshape(len(blocks), band)
                    return
            found = bits.many(n * width).reshape(n, width)
            if not found[:, 0].any():
                value = np.packbits(found[:, 1:], axis=1)
                value = (value[:, 0].astype(np.int32) if width <= 9 else value[:, 0].astype(np.int32) << 8 | value[:, 1]) >> (-(width - 1) % 8)
                value -= np.where(found[:, 1] == 0, (1 << (width - 1)) - 1, 0)
                own[blocks, first : last + 1] = (value << low).reshape(len(blocks), band)
                return
            bits.at = begin
    i = 0
    while i < len(blocks):
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                own[blocks[i], k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                i += (1 << run) + bits.take(run) - 1  # this block and those that follow end here
                break
        i += 1


def _correct(bits: Bits, own: np.ndarray, at: tuple, low: int) -> None:
    """Correction bits for the known coefficients among ``own[at]``, in order."""
    part = own[at]
    known = part != 0
    more = bits.many(int(known.sum())).astype(np.int32) << low
    values = part[known]
    part[known] = np.where(values > 0, values + more, values - more)
    own[at] = part


def _ac_refined(bits: Bits, own: np.ndarray, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
    i = 0
    while i < len(blocks):
        block, k, run_of_blocks = blocks[i], first, 0
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            fresh = 0
            if size:
                fresh = 1 << low if bits.take(1) else -(1 << low)
            elif run < 15:
                run_of_blocks = (1 << run) + bits.take(run)
                break
            while k <= last:
                if own[block, k]:
                    if bits.take(1):
                        own[block, k] += (1 << low) if own[block, k] > 0 else -(1 << low)
                elif run == 0:
                    if fresh:
                        own[block, k] = fresh
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if run_of_blocks:
            if k <= last:
                _correct(bits, own, (block, slice(k, last + 1)), low)
            if run_of_blocks > 1:
                _correct(bits, own, (blocks[i + 1 : i + run_of_blocks], slice(first, last + 1)), low)
            i += run_of_blocks
        else:
            i += 1


# --- storing bytes ----------------------------------------------------------------------------------

#: First scans code every coefficient as one bit and seven bits of magnitude; later ones are end-of-band runs.
_FIRST, _RUNS = bytes([7]), bytes(r << 4 for r in range(15))
_BANDS = ((1, 5), (6, 63))
_LONGEST_RUN = 32767


def _segment(marker: int, part: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(part) + 2) + part


def _table(kind: int, number: int, length: int, symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number]) + bytes(len(symbols) if n == length else 0 for n in range(1, 17)) + symbols)


def _start(numbers: list[int], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(numbers)]) + b"".join(bytes([n, tables]) for n in numbers) + bytes([first, last, high << 4 | low]))


def _number_bits(value: int, n: int) -> np.ndarray:
    return (value >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8)


def _stuffed(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00")


def store(payload: bytes) -> bytes:
    """A progressive JPEG (4:2:0) that holds the payload in its AC coefficients, and its length in a comment."""
    units = max(1, -(-len(payload) // (6 * 63)))
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    data = np.zeros(across * down * 6 * 63, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    size, negative = 128 + (data & 127), data > 127
    out = [b"\xff\xd8", _segment(0xFE, NOTE + str(len(payload)).encode()), _segment(0xDB, bytes([0]) + b"\x01" * 64),
           _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
           _table(0, 0, 1, b"\x00"), _table(1, 0, 1, _FIRST), _table(1, 1, 4, _RUNS)]
    zeros = np.zeros(-(-across * down * 6 // 8) * 8, np.uint8)
    zeros[across * down * 6 :] = 1
    out += [_start([1, 2, 3], 0, 0, 0, 0, 0), _stuffed(np.packbits(zeros).tobytes())]
    half = (size >> 1).reshape(-1, 63)
    coded = np.where(negative.reshape(-1, 63), 127 - half, half).astype(np.uint8)
    edges = np.cumsum([0, 4 * across * down, across * down, across * down])
    for number, (a, b) in enumerate(zip(edges, edges[1:]), 1):
        for first, last in _BANDS:
            out += [_start([number], 0, first, last, 0, 1), coded[a:b, first - 1 : last].tobytes()]  # all below 0x80
    low_bits = (size & 1).reshape(-1, 63)
    for number, (a, b) in enumerate(zip(edges, edges[1:]), 1):
        parts = []
        for begin in range(a, b, _LONGEST_RUN):
            n = min(_LONGEST_RUN, b - begin)
            exponent = int(n).bit_length() - 1
            parts += [_number_bits(exponent, 4), _number_bits(n - (1 << exponent), exponent), low_bits[begin : begin + n].ravel()]
        run = np.concatenate(parts)
        run = np.concatenate([run, np.ones(-len(run) % 8, np.uint8)])
        out += [_start([number], 1, 1, 63, 1, 0), _stuffed(np.packbits(run).tobytes())]
    return b"".join([*out, b"\xff\xd9"])


def stored(image: Image) -> bytes:
    """The payload of an image that ``store`` wrote."""
    note = next((n for n in image.notes if n.startswith(NOTE)), None)
    if note is None:
        raise ValueError("the image holds no payload")
    values = np.concatenate([c.blocks.reshape(-1, 64)[:, 1:].ravel() for c in image.components])
    data = (np.abs(values) - 128).astype(np.uint8) | np.where(values < 0, 128, 0).astype(np.uint8)
    return data[: int(note[len(NOTE) :])].tobytes()
