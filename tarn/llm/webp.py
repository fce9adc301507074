"""Lossless WebP (VP8L) after its published bitstream specification.

``decode`` reads any VP8L image: normal and simple prefix codes, meta prefix
images, back-references, colour cache, and the predictor, cross-colour,
subtract-green and palette transforms.  Images whose literals all have 8-bit
codes (what ``encode`` writes) are unpacked by array operations; everything
else goes through the general symbol loop.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the VP8L format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 16384

class BitReader:
    def __init__(self, data: bytes, bit: int = 0):
        self.data, self.bit = data, bit

    def read(self, n: int) -> int:
        if not n:
            return 0
        at, shift = self.bit >> 3, self.bit & 7
        self.bit += n
        return int.from_bytes(self.data[at : at + ((shift + n + 7) >> 3)], "little") >> shift & ((1 << n) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.value = self.bits = 0

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.bits
        self.bits += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.bits + 7) >> 3, "little")


class PrefixCode:
    """Canonical code."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else None
        self.table: dict[tuple[int, int], int] = {}
        if self.single is not None or not used:
            self.single = self.single or 0
            return
        top = max(lengths)
        code = 0
        for n in range(1, top + 1):
            for s in used:
                if lengths[s] == n:
                    self.table[n, code] = s
                    code += 1
            code <<= 1
        if code != 1 << (top + 1):
            raise ValueError("incomplete or oversubscribed prefix code")

    def read(self, r: BitReader) -> int:
        if self.single is not None:
            return self.single
        code = n = 0
        while True:
            code = code << 1 | r.read(1)
            n += 1
            s = self.table.get((n, code))
            if s is not None:
                return s
            if n > 15:
                raise ValueError("bad prefix code")


def _read_code(r: BitReader, symbols: int) -> PrefixCode:
    lengths = [0] * symbols
    if r.read(1):
        two, wide = r.read(1), r.read(1)
        lengths[r.read(8 if wide else 1)] = 1
        if two:
            lengths[r.read(8)] = 1
        return PrefixCode(lengths)
    firsts = [0] * 19
    for k in range(4 + r.read(4)):
        firsts[CODE_LENGTH_ORDER[k]] = r.read(3)
    left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else symbols
    code, at, before = PrefixCode(firsts), 0, 8
    while at < symbols and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
        else:
            if s == 16:
                n = 3 + r.read(2)
            elif s == 17:
                n = 3 + r.read(3)
            else:
                n = 11 + r.read(7)
            lengths[at : at + n] = [before if s == 16 else 0] * n
            at += n
    return PrefixCode(lengths[:symbols])


def _read_group(r: BitReader, cache_bits: int) -> list[PrefixCode]:
    return [_read_code(r, n) for n in (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def _extra(r: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + r.read(n) + 1


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _read_image(r: BitReader, w: int, h: int, main: bool) -> np.ndarray:
    """Pixels as uint8 (h, w, 4) in the order red, green, blue, alpha."""
    cache_bits = r.read(4) if r.read(1) else 0
    groups_at, meta_bits = None, 0
    if main and r.read(1):
        meta_bits = r.read(3) + 2
        meta = _read_image(r, _up(w, meta_bits), _up(h, meta_bits), False)
        groups_at = meta[..., 0].astype(np.int32) << 8 | meta[..., 1]
    groups = [_read_group(r, cache_bits) for _ in range(1 if groups_at is None else int(groups_at.max()) + 1)]
    first = groups[0]
    if len(groups) == 1 and not cache_bits:
        if all(c.single is not None for c in first[:4]) and first[0].single < 256:
            g, red, b, a = (c.single for c in first[:4])
            return np.broadcast_to(np.array([red, g, b, a], dtype=np.uint8), (h, w, 4)).copy()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    out, n, cached = [], w * h, 0
    group = first
    while len(out) < n:
        at = len(out)
        if groups_at is not None:
            group = groups[groups_at[(at // w) >> meta_bits, (at % w) >> meta_bits]]
        s = group[0].read(r)
        if s < 256:
            red = group[1].read(r)
            blue = group[2].read(r)
            out.append(group[3].read(r) << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _extra(r, s - 256)
            code = _extra(r, group[4].read(r))
            if code > 120:
                back = code - 120
            else:
                dx, dy = DISTANCE_MAP[code - 1]
                back = max(1, dx + dy * w)
            if back > at:
                raise ValueError("back-reference before the image")
            for _ in range(min(length, n - at)):
                out.append(out[-back])
        else:
            while cached < at:
                cache[(out[cached] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out.append(cache[s - 280])
    argb = np.array(out, dtype=np.uint32)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], axis=-1).astype(np.uint8).reshape(h, w, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left, top, top_left, top_right) -> np.ndarray:
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (None, left, top, top_right, top_left)[mode]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum()
        to_top = np.abs(left - top_left).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    middle = _average(left, top)
    # division by two rounds towards zero
    half = (middle - top_left) / 2
    return np.clip(middle + np.trunc(half).astype(np.int64), 0, 255)


def invert_predictor(residue: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = residue.shape
    out = residue.copy()
    out[0, 0] += np.array([0, 0, 0, 255], dtype=np.uint8)
    kinds = np.unique(modes)
    if w == 1 or h == 1 or (len(kinds) == 1 and kinds[0] == 2):
        # first row from the left, first column and, where all modes say so, the rest from above
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        return np.cumsum(out, axis=0, dtype=np.uint8)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, h):
        above, row, fixed = out[y - 1].astype(np.int64), out[y].astype(np.int64), modes[y >> bits]
        row[0] = (row[0] + above[0]) & 255
        for x in range(1, w):
            # right of the last column lies the row's own first pixel
            right = above[x + 1] if x + 1 < w else row[0]
            row[x] = (row[x] + _predict(int(fixed[x >> bits]), row[x - 1], above[x], above[x - 1], right)) & 255
        out[y] = row
    return out


def invert_cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    h, w, _ = pixels.shape
    spread = factors.view(np.int8).astype(np.int32).repeat(1 << bits, 0)[:h].repeat(1 << bits, 1)[:, :w]
    red_to_blue, green_to_blue, green_to_red = spread[..., 0], spread[..., 1], spread[..., 2]
    signed = pixels.view(np.int8).astype(np.int32)
    red = (signed[..., 0] + (green_to_red * signed[..., 1] >> 5)) & 255
    again = red.astype(np.uint8).view(np.int8).astype(np.int32)
    blue = (signed[..., 2] + (green_to_blue * signed[..., 1] >> 5) + (red_to_blue * again >> 5)) & 255
    out = pixels.copy()
    out[..., 0], out[..., 2] = red, blue
    return out


def invert_palette(pixels: np.ndarray, table: np.ndarray, w: int, bits: int) -> np.ndarray:
    index = pixels[..., 1]
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = np.stack([index >> (k * each) & ((1 << each) - 1) for k in range(per)], axis=-1).reshape(len(index), -1)[:, :w]
    whole = np.zeros((256, 4), dtype=np.uint8)  # an index beyond the table is transparent black
    whole[: len(table)] = table
    return whole[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """The pixel array (height, width, 4) of a VP8L chunk's content."""
    r = BitReader(data)
    if r.read(8) != 0x2F:
        raise ValueError("not a VP8L image")
    w, h, alpha, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise ValueError("unknown VP8L version")
    undo, width = [], w
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.read(3) + 2
            side = _read_image(r, _up(width, bits), _up(h, bits), False)
            if kind == PREDICTOR:
                undo.append(lambda p, m=side[..., 1] & 15, b=bits: invert_predictor(p, m, b))
            else:
                undo.append(lambda p, m=np.ascontiguousarray(side[..., :3]), b=bits: invert_cross_colour(p, m, b))
        elif kind == SUBTRACT_GREEN:

            def add_green(p):
                p = p.copy()
                p[..., 0] += p[..., 1]
                p[..., 2] += p[..., 1]
                return p

            undo.append(add_green)
        else:
            size = r.read(8) + 1
            table = np.cumsum(_read_image(r, size, 1, False)[0], axis=0, dtype=np.uint8)
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append(lambda p, t=table, n=width, b=bits: invert_palette(p, t, n, b))
            width = _up(width, bits)
    pixels = _read_image(r, width, h, True)
    for f in reversed(undo):
        pixels = f(pixels)
    if not alpha:
        pixels = pixels.copy()
        pixels[..., 3] = 255
    return pixels


def riff(chunk: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode_file(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The first VP8L image of the RIFF file at ``at`` and the offset after the file."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    k = at + 12
    while k + 8 <= end:
        n = struct.unpack_from("<I", data, k + 4)[0]
        if data[k : k + 4] == b"VP8L":
            return decode_vp8l(data[k + 8 : k + 8 + n]), end + (end - at & 1)
        k += 8 + n + (n & 1)
    raise ValueError("no VP8L chunk")
