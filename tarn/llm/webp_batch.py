"""Many small lossless WebP images at once, by array operations over images.

``encode`` writes real VP8L streams: prefix codes fitted to each image,
back-references, a colour cache, and for each image the one of several lists
of transforms (none, predictor, cross-colour, subtract-green, combinations)
that its pixels' entropy says is the smallest, or a palette where the image has
few colours.

``decode`` reads any VP8L stream.  Images advance in lock step: one step
decodes one symbol (or one code length) of every image, so that the work of a
step is a few operations on arrays with an entry per image.  Streams with
several groups of codes go to the one-image decoder in ``webp``.
"""

from __future__ import annotations

import struct

import numpy as np

from tarn.llm.webp import CACHE_FACTOR, CODE_LENGTH_ORDER, CROSS_COLOUR, DISTANCE_MAP, PALETTE, PREDICTOR, SUBTRACT_GREEN, decode_vp8l

WIDTH = 16
CACHE_BITS = 6
BLOCK_BITS = 3
FEW_COLOURS = 16
#: Back-reference distances that the writer looks for, in pixels: repeated pixels, rows, and short periods.
DISTANCES = (1, 16, 2, 3, 4, 32)
LEAST_RUN = 3
MULTIPLIERS = (0, 8, 16, 24, 32)
#: Predictors that the writer chooses from, block by block.
MODES = (2, 7, 11, 12, 13)
#: Lists of transforms an image can get.
PLANS = ((), (PREDICTOR,), (CROSS_COLOUR,), (SUBTRACT_GREEN,), (PREDICTOR, CROSS_COLOUR), (SUBTRACT_GREEN, PREDICTOR))
#: A list of transforms has to save this share of the estimated bits: what is transformed has fewer repeats to refer back to.
LEAST_GAIN = 0.1
#: Up to this share about the plain estimate both forms are written and the shorter is taken.
DOUBT = 0.1
ALPHABETS = (256 + 24 + (1 << CACHE_BITS), 256, 256, 256, 40)
#: Longer codes than this go to the one-image decoder, whose tables are not per image.
LONGEST = 11

_REV15 = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], dtype=np.uint32)
_SYMBOL_16, _SYMBOL_17, _SYMBOL_18 = 16, 17, 18


def _profile(n: int, width: int) -> np.ndarray:
    """Code lengths by rank of a complete code for n symbols: two short tiers, then a balanced rest."""
    out = np.zeros(width, dtype=np.uint8)
    at, depth = 0, 0
    if n > 8:
        out[:4] = 3
        at, depth = 4, 1
        if n >= 20:
            out[4:12] = 5
            at, depth = 12, 2
    rest = n - at
    top = (rest - 1).bit_length() if rest > 1 else 0
    short = (1 << top) - rest
    out[at : at + short] = depth + top - 1
    out[at + short : n] = depth + top
    return out


_PROFILES = {a: np.stack([np.zeros(a, np.uint8), np.zeros(a, np.uint8), *[_profile(n, a) for n in range(2, a + 1)]]) for a in set(ALPHABETS)}


class _Writer:
    """Fields of bits for many images, each added behind what its image already has."""

    def __init__(self, images: int):
        self.length = np.zeros(images, dtype=np.int64)
        self.own: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def add(self, who: np.ndarray, value: object, bits: object) -> None:
        """One field, or with two dimensions a run of fields, for each of the images ``who``; no bits: nothing."""
        v, b = np.asarray(value), np.asarray(bits)
        wide = max([x.shape[-1] for x in (v, b) if x.ndim == 2], default=1)
        v = np.broadcast_to(v[:, None] if v.ndim == 1 else v, (len(who), wide))
        b = np.broadcast_to(b[:, None] if b.ndim == 1 else b, (len(who), wide)).astype(np.int64)
        ends = np.cumsum(b, axis=1)
        some = (b > 0).ravel()
        self.own.append(np.repeat(who, wide)[some])
        self.at.append((self.length[who][:, None] + ends - b).ravel()[some])
        self.values.append(v.ravel()[some].astype(np.uint64))
        self.length[who] += ends[:, -1]

    def constant(self, who: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
        """The same run of fields for all of ``who``."""
        self.add(who, values[None, :], bits[None, :])

    def ragged(self, own: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
        """Fields in the order of their images, any number for each; rows of several fields are written one after the other."""
        if not len(own):
            return
        inside = np.cumsum(bits, axis=1) - bits
        each = bits.sum(axis=1)
        ahead = np.cumsum(each) - each
        first = np.searchsorted(own, np.arange(len(self.length)))
        ahead -= np.append(ahead, 0)[first][own]
        some = (bits > 0).ravel()
        self.own.append(np.repeat(own, bits.shape[1])[some])
        self.at.append((inside + (ahead + self.length[own])[:, None]).ravel()[some])
        self.values.append(values.ravel()[some])
        self.length += np.bincount(own, weights=each, minlength=len(self.length)).astype(np.int64)

    def done(self) -> list[bytes]:
        words = (self.length + 31) >> 5
        start = (np.cumsum(words) - words) << 5
        own = np.concatenate(self.own)
        at = np.concatenate(self.at) + start[own]
        shifted = np.concatenate(self.values) << (at & 31).astype(np.uint64)
        many = int(words.sum()) + 1
        # fields do not overlap, so the sums of their bits in a word are exact
        low = np.bincount(at >> 5, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=many)
        high = np.bincount((at >> 5) + 1, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=many)
        raw = (low[:many] + high[:many]).astype(np.uint32).astype("<u4").tobytes()
        return [raw[a : a + n] for a, n in zip((start >> 3).tolist(), ((self.length + 7) >> 3).tolist(), strict=True)]


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes with their bits reversed, as they are written, for rows of code lengths (0: unused)."""
    order = np.argsort(np.where(lengths, lengths, 99), axis=1, kind="stable")
    ordered = np.take_along_axis(lengths, order, axis=1).astype(np.int64)
    share = np.where(ordered > 0, 1 << (15 - np.minimum(ordered, 15)), 0)
    start = np.cumsum(share, axis=1) - share
    codes = np.zeros(lengths.shape, dtype=np.uint32)
    np.put_along_axis(codes, order, np.where(ordered > 0, _REV15[start & 0x7FFF], 0).astype(np.uint32), axis=1)
    return codes


#: The fixed code for code lengths: zero, its two run lengths and the usual lengths have three bits, the others five.
_FIRST = np.zeros((1, 19), dtype=np.uint8)
_FIRST[0, [0, 17, 18, 5, 6, 7]] = 3
_FIRST[0, [1, 2, 3, 4, 8, 9, 10, 11]] = 5
_FIRST_CODES = _canonical(_FIRST)[0].astype(np.int64)
_LEAD = np.array([0, 15, *(int(_FIRST[0, k]) for k in CODE_LENGTH_ORDER), 0]), np.array([1, 4, *[3] * 19, 1])


def _described(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) of the code lengths of each row, runs of zeros by their number."""
    rows, width = lengths.shape
    flat = lengths.ravel().astype(np.int64)
    own = np.repeat(np.arange(rows), width)
    edge = np.flatnonzero(np.concatenate(([True], (flat[1:] > 0) | (flat[:-1] > 0) | (own[1:] != own[:-1]))))
    size = np.diff(np.append(edge, len(flat)))
    # a run of zeros becomes pieces of 138 at most; of a piece of one or two every zero stands for itself
    pieces = -(-size // 138)
    which = np.repeat(np.arange(len(edge)), pieces)
    number = np.arange(len(which)) - (np.cumsum(pieces) - pieces)[which]
    n = np.minimum(138, size[which] - 138 * number)
    value = flat[edge][which]
    times = np.where((value == 0) & (n == 2), 2, 1)
    which, n, value = np.repeat(which, times), np.repeat(np.where(n == 2, 1, n), times), np.repeat(value, times)
    symbol = np.where(value > 0, value, np.where(n >= 11, 18, np.where(n >= 3, 17, 0)))
    extra = np.where(symbol == 18, n - 11, np.where(symbol == 17, n - 3, 0))
    base = _FIRST[0][symbol].astype(np.int64)
    return own[edge][which], _FIRST_CODES[symbol] | extra << base, base + np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))


def _write_code(w: _Writer, who: np.ndarray, lengths: np.ndarray) -> None:
    """A normal prefix code for each of ``who``: a row of code lengths each, or one row for all."""
    w.constant(who, *_LEAD)
    row, value, bits = _described(lengths)
    if len(lengths) == 1:
        w.constant(who, value, bits)
    else:
        w.ragged(who[row], value[:, None].astype(np.uint64), bits[:, None])


def _flat(symbols: np.ndarray, size: int) -> np.ndarray:
    """Lengths of the code that gives 2^k symbols k bits each."""
    out = np.zeros((1, size), dtype=np.uint8)
    out[0, symbols] = len(symbols).bit_length() - 1
    return out


def _single(w: _Writer, who: np.ndarray, symbol: int) -> None:
    """A simple code of one symbol below 256."""
    w.constant(who, np.array([0b101, symbol]), np.array([3, 8]))


def combine(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The format's predictors over arrays of pixels (int16, last axis the channels)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode == 6:
        return (left + corner) >> 1
    if mode == 7:
        return (left + top) >> 1
    if mode == 8:
        return (corner + top) >> 1
    if mode == 9:
        return (top + right) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:
        to_left = np.abs(top - corner).sum(axis=-1)
        to_top = np.abs(left - corner).sum(axis=-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = (left + top) >> 1
        half = middle - corner
        # division by two rounds towards zero
        return np.clip(middle + ((half + (half < 0)) >> 1), 0, 255)
    black = np.zeros_like(left)
    black[..., 3] = 255
    return black


class _Layout:
    """Pixels of several images of one width, one after the other."""

    def __init__(self, heights: np.ndarray):
        self.heights = heights
        self.counts = heights * WIDTH
        self.starts = np.cumsum(self.counts) - self.counts
        self.own = np.repeat(np.arange(len(heights)), self.counts)
        self.within = np.arange(int(self.counts.sum())) - self.starts[self.own]
        self.x, self.y = self.within % WIDTH, self.within // WIDTH
        self.across = (WIDTH + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
        self.rows = (heights + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
        self.per = self.across * self.rows
        self.first = np.cumsum(self.per) - self.per
        self.block = self.first[self.own] + (self.y >> BLOCK_BITS) * self.across + (self.x >> BLOCK_BITS)


def _forward_predictor(p: np.ndarray, at: _Layout) -> tuple[np.ndarray, np.ndarray]:
    """(residues, mode of each block): the mode of the least sum of residues."""
    wide = p.astype(np.int16)
    i = np.arange(len(p))
    near = [wide[np.maximum(i - d, 0)] for d in (1, WIDTH, WIDTH + 1, WIDTH - 1)]
    top, side = at.y == 0, at.x == 0
    edge = np.flatnonzero(top | side)
    # the first row goes by its left, the first column by what is above, whatever the mode
    border = np.where(top[edge, None], near[0][edge], near[1][edge])
    border[(top & side)[edge]] = (0, 0, 0, 255)
    blocks = int(at.per.sum())
    best = np.full(blocks, np.inf)
    modes = np.zeros(blocks, dtype=np.int64)
    chosen = np.zeros_like(wide)
    for mode in MODES:
        guess = combine(mode, *near).copy()
        guess[edge] = border
        left = np.abs(((wide - guess + 128) & 255) - 128).sum(axis=1)
        cost = np.bincount(at.block, weights=left, minlength=blocks)
        better = cost < best
        best[better], modes[better] = cost[better], mode
        mine = better[at.block]
        chosen[mine] = guess[mine]
    return ((wide - chosen) & 255).astype(np.uint8), modes


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).view(np.int8).astype(np.int32)


def _forward_cross(p: np.ndarray, at: _Layout) -> tuple[np.ndarray, np.ndarray]:
    """(residues, factors of each block as red-to-blue, green-to-blue, green-to-red)."""
    blocks = int(at.per.sum())
    red, green, blue = (_signed(p[:, c]) for c in range(3))

    def least(target: np.ndarray, by: np.ndarray) -> np.ndarray:
        costs = [np.bincount(at.block, weights=np.abs(_signed((target - (m * by >> 5)) & 255)), minlength=blocks) for m in MULTIPLIERS]
        return np.array(MULTIPLIERS)[np.argmin(costs, axis=0)]

    to_red, to_blue = least(red, green), least(blue, green)
    rest = _signed((blue - (to_blue[at.block] * green >> 5)) & 255)
    red_to_blue = least(rest, red)
    out = p.copy()
    out[:, 0] = (red - (to_red[at.block] * green >> 5)) & 255
    out[:, 2] = (rest - (red_to_blue[at.block] * red >> 5)) & 255
    return out, np.stack([red_to_blue, to_blue, to_red], axis=1)


def _table(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, there): runs of ``flat`` as rows."""
    there = np.arange(int(counts.max(initial=0))) < counts[:, None]
    table = np.zeros(there.shape, dtype=np.int64)
    table[there] = flat
    return table, there


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, extra value, extra bits) of lengths or distances of 1 or more."""
    u = np.maximum(v - 1, 1)
    top = np.floor(np.log2(u)).astype(np.int64)
    half = (u >> np.maximum(top - 1, 0)) & 1
    small = v <= 4
    extra = np.where(small, 0, top - 1)
    return np.where(small, v - 1, 2 * top + half), np.where(small, 0, u - ((2 + half) << np.maximum(extra, 0))), extra


def _operations(argb: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, symbol slots, bits or -1 by channel, kinds) of the pixels: literals, cache hits, back-references."""
    n = len(argb)
    own = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(n) - starts[own]
    back = np.zeros(n, dtype=np.int64)
    for d in DISTANCES[::-1]:
        same = np.zeros(n, dtype=bool)
        same[d:] = (argb[d:] == argb[:-d]) & (within[d:] >= d)
        back[same] = d
    edge = np.flatnonzero(np.concatenate(([True], (back[1:] != back[:-1]) | (own[1:] != own[:-1]))))
    length = np.diff(np.append(edge, n))
    runs = (back[edge] > 0) & (length >= LEAST_RUN)
    inside = np.repeat(runs, length)
    starts_run = np.zeros(n, dtype=bool)
    starts_run[edge[runs]] = True
    size = np.zeros(n, dtype=np.int64)
    size[edge] = length
    slot = ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
    # the pixel before in the same slot: by slot and place in one sort
    placed = np.sort((own << CACHE_BITS | slot) << 32 | np.arange(n))
    key, order = placed >> 32, placed & 0xFFFFFFFF
    hit = np.zeros(n, dtype=bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (argb[order[1:]] == argb[order[:-1]])
    keep = ~inside | starts_run
    return own[keep], argb[keep], starts_run[keep], (hit & ~inside)[keep], slot[keep], size[keep], back[keep]


def _entropy(own: np.ndarray, values: np.ndarray, total: int) -> np.ndarray:
    """Bits that each image's bytes take by the frequencies in each of its channels."""
    bits = np.zeros(total)
    logs = np.log2(np.maximum(np.arange(int(np.bincount(own, minlength=total).max()) + 1), 1))
    for c in range(values.shape[1]):
        counts = np.bincount(own << 8 | values[:, c], minlength=total << 8).reshape(total, 256)
        each = counts.sum(axis=1)
        bits += each * logs[each] - (counts * logs[counts]).sum(axis=1)
    return bits


def estimated(p: np.ndarray, layout: _Layout) -> np.ndarray:
    """Bits by image and list of ``PLANS``: the entropy of what the transforms leave, and the room their tables take.

    A predictor counts as the average of the pixels to the left and above, and
    the transform across colours as green taken from red and blue.
    """
    total = len(layout.counts)
    left, top = np.zeros_like(p), np.zeros_like(p)
    left[1:], top[WIDTH:] = p[:-1], p[:-WIDTH]
    place = np.arange(len(p)) - layout.starts[layout.own]
    left[place == 0] = 0
    top[place < WIDTH] = 0

    def less_green(x: np.ndarray) -> np.ndarray:
        out = x.copy()
        out[:, 0] -= x[:, 1]
        out[:, 2] -= x[:, 1]
        return out

    predicted = p - ((left.astype(np.int16) + top) >> 1).astype(np.uint8)
    plain, guess, green, both = (_entropy(layout.own, x, total) for x in (p, predicted, less_green(p), less_green(predicted)))
    table = 4.0 * layout.per
    return np.stack([plain, guess + table, green + 9.0 * layout.per, green, both + 13.0 * layout.per, both + table], axis=1)


def chosen(p: np.ndarray, layout: _Layout) -> np.ndarray:
    """The number in ``PLANS`` of each image: the least estimate, if it saves enough; in doubt the shorter of both when written."""
    bits = estimated(p, layout)
    best = bits[:, 1:].argmin(axis=1) + 1
    least, plain = bits[np.arange(len(bits)), best], bits[:, 0]
    plan = np.where(least <= (1 - LEAST_GAIN) * plain, best, 0)
    tried = np.flatnonzero((plan == 0) & (least <= (1 + DOUBT) * plain))
    if len(tried):
        images = [p[k : k + n].reshape(-1, WIDTH, 4) for k, n in zip(layout.starts[tried], layout.counts[tried], strict=True)]
        as_is, turned = ([len(c) for c in encode(images, plans)] for plans in (np.zeros(len(tried), dtype=np.int64), best[tried]))
        plan[tried] = np.where(np.array(turned) < np.array(as_is), best[tried], 0)
    return plan


def encode(images: list[np.ndarray], plans: np.ndarray | None = None) -> list[bytes]:
    """A VP8L chunk for each image of shape (height, 16, 4), red, green, blue, alpha.

    ``plans`` gives each image's number in ``PLANS``, in place of the estimate.
    """
    total = len(images)
    if not total:
        return []
    heights = np.array([len(p) for p in images], dtype=np.int64)
    p = np.concatenate([p.reshape(-1, 4) for p in images])
    layout = _Layout(heights)
    argb = np.ascontiguousarray(p[:, [2, 1, 0, 3]]).view("<u4").ravel()
    # images of few colours get a palette
    keys = np.sort(layout.own.astype(np.uint64) << np.uint64(32) | argb)
    colours = np.bincount((keys[np.concatenate(([True], keys[1:] != keys[:-1]))] >> np.uint64(32)).astype(np.int64), minlength=total)
    few = (colours <= FEW_COLOURS) & (layout.counts >= 2 * colours)
    plan = np.where(few, -1, chosen(p, layout) if plans is None else plans)

    w = _Writer(total)
    every = np.arange(total)
    w.add(every, np.stack([np.full(total, 0x2F), np.full(total, WIDTH - 1), heights - 1, np.ones(total, dtype=np.int64)], axis=1), np.array([[8, 14, 14, 4]]))
    work = p.copy()
    for turn in range(2):
        for kind in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN):
            with_it = [k for k, made in enumerate(PLANS) if len(made) > turn and made[turn] == kind]
            which = np.flatnonzero(np.isin(plan, with_it))
            if not len(which):
                continue
            w.constant(which, np.array([1 | kind << 1]), np.array([3]))
            mine = np.isin(plan, with_it)[layout.own]
            at = _Layout(heights[which])
            if kind == SUBTRACT_GREEN:
                part = work[mine]
                part[:, 0] -= part[:, 1]
                part[:, 2] -= part[:, 1]
                work[mine] = part
                continue
            w.constant(which, np.array([BLOCK_BITS - 2]), np.array([4]))
            if kind == PREDICTOR:
                work[mine], modes = _forward_predictor(work[mine], at)
                _write_code(w, which, _flat(np.arange(16), 280))
                for _ in range(4):
                    _single(w, which, 0)
                table, there = _table(modes, at.per)
                w.add(which, _canonical(_flat(np.arange(16), 16))[0][table], 4 * there)
            else:
                work[mine], factors = _forward_cross(work[mine], at)
                symbols = np.arange(8) * 8
                codes = _canonical(_flat(symbols, 64))[0]
                for size in (280, 256, 256):
                    _write_code(w, which, _flat(symbols, size))
                _single(w, which, 255)
                _single(w, which, 0)
                tables = [_table(factors[:, c], at.per) for c in (1, 0, 2)]  # green, red, blue
                values = np.stack([codes[t] for t, _ in tables], axis=2).reshape(len(which), -1)
                w.add(which, values, 3 * np.repeat(tables[0][1], 3, axis=1))
    counts = layout.counts.copy()
    main = np.ascontiguousarray(work[:, [2, 1, 0, 3]]).view("<u4").ravel()
    if few.any():
        which = np.flatnonzero(few)
        w.add(which, np.stack([np.full(len(which), 1 | PALETTE << 1), colours[which] - 1, np.zeros(len(which), dtype=np.int64)], axis=1), np.array([[3, 8, 1]]))
        for size in (280, 256, 256, 256):
            _write_code(w, which, _flat(np.arange(256), size))
        _single(w, which, 0)
        palette = np.unique(keys[few[(keys >> np.uint64(32)).astype(np.int64)]])
        table, there = _table((palette & np.uint64(0xFFFFFFFF)).astype(np.int64), colours[which])
        grba = np.stack([table >> s & 255 for s in (8, 16, 0, 24)], axis=2)
        steps = np.diff(grba, axis=1, prepend=np.zeros((len(which), 1, 4), dtype=np.int64)) & 255
        codes = _canonical(_flat(np.arange(256), 256))[0]
        w.add(which, codes[steps].reshape(len(which), -1), 8 * np.repeat(there, 4, axis=1))
        # the place of every pixel's colour in its image's palette, several to a byte
        ends = np.cumsum(colours * few)
        mine = few[layout.own]
        index = np.zeros(len(argb), dtype=np.int64)
        index[mine] = np.searchsorted(palette, layout.own[mine].astype(np.uint64) << np.uint64(32) | argb[mine]) - (ends - colours * few)[layout.own[mine]]
        bits = np.where(colours <= 2, 3, np.where(colours <= 4, 2, 1))
        pieces, sizes, done = [], counts.copy(), 0
        for k in which:
            a, b = layout.starts[k], layout.starts[k] + layout.counts[k]
            pieces.append(main[done:a])
            done = b
            per = 1 << bits[k]
            part = index[a:b].reshape(-1, WIDTH // per, per)
            packed = (part << np.arange(per) * (8 >> bits[k])).sum(axis=2).astype(np.uint32).ravel()
            pieces.append(packed << 8 | np.uint32(0xFF000000))
            sizes[k] = len(packed)
        main, counts = np.concatenate([*pieces, main[done:]]), sizes
    # no more transforms; a colour cache; one group of codes
    w.constant(every, np.array([0 | 1 << 1 | CACHE_BITS << 2]), np.array([7]))

    own, pixel, ref, hit, slot, size, back = _operations(main, np.cumsum(counts) - counts, counts)
    literal = ~ref & ~hit
    g, r, b, a = ((pixel >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0, 24))
    # a row's width and one pixel have codes of their own; the former only where rows have the full width
    run, far = _prefix(size[ref]), _prefix(np.where(back[ref] == 1, 2, np.where((back[ref] == WIDTH) & ~few[own[ref]], 1, back[ref] + 120)))
    green = np.where(literal, g, 280 + slot)
    green[ref] = 256 + run[0]
    lit, refs = np.flatnonzero(literal), np.flatnonzero(ref)
    values = np.zeros((len(own), 4), dtype=np.uint64)
    bits = np.zeros((len(own), 4), dtype=np.int64)
    # of a literal green, red, blue, alpha; of a reference the length, its extra bits, the distance, its extra bits
    for c, (width, at, symbol) in enumerate(zip(ALPHABETS, (slice(None), lit, lit, lit, refs), (green, r[lit], b[lit], a[lit], far[0]), strict=True)):
        place = own[at] * width + symbol
        times = np.bincount(place, minlength=total * width).reshape(total, width)
        for filler in (0, 1):
            lone = (times > 0).sum(axis=1) < 2
            times[lone & (times[:, filler] == 0), filler] = 1
        ranks = np.argsort(-times, axis=1, kind="stable")
        lengths = np.zeros((total, width), dtype=np.uint8)
        np.put_along_axis(lengths, ranks, _PROFILES[width][(times > 0).sum(axis=1)], axis=1)
        _write_code(w, every, lengths)
        column = 2 if c == 4 else c
        values[at, column], bits[at, column] = _canonical(lengths).ravel()[place], lengths.ravel()[place]
    values[refs, 1], bits[refs, 1] = run[1], run[2]
    values[refs, 3], bits[refs, 3] = far[1], far[2]
    w.ragged(own, values, bits)
    return w.done()


# ---- reading ----------------------------------------------------------------------------------------


class _Odd(Exception):
    """A stream that the lock-step reader leaves to the one-image decoder."""


class _Reader:
    """Bit positions of many streams in one buffer."""

    def __init__(self, chunks: list[bytes]):
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        whole = np.frombuffer(b"".join(chunks) + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
        self.window = whole[:-3] | whole[1:-2] << 8 | whole[2:-1] << 16 | whole[3:] << 24
        ends = np.cumsum(sizes)
        self.pos = (ends - sizes) << 3
        self.end = ends << 3

    def peek(self, who: np.ndarray) -> np.ndarray:
        """At least 25 bits from each stream's position."""
        pos = self.pos[who]
        return self.window[np.minimum(pos >> 3, len(self.window) - 1)] >> (pos & 7).astype(np.uint32)

    def read(self, who: np.ndarray, bits: object) -> np.ndarray:
        b = np.broadcast_to(np.asarray(bits, dtype=np.int64), who.shape)
        out = (self.peek(who) & ((np.uint32(1) << b.astype(np.uint32)) - np.uint32(1))).astype(np.int64)
        self.pos[who] += b
        return out


def _tables(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): for every stream and every next ``bits`` bits the symbol times 16 plus its code's length."""
    used = lengths > 0
    number = used.sum(axis=1)
    top = int(lengths.max(initial=0))
    if top > LONGEST:
        raise _Odd
    bits = max(top, 1)
    lone = number <= 1
    if ((1 << (bits - lengths[~lone].astype(np.int64))) * used[~lone]).sum(axis=1).min(initial=1 << bits) != 1 << bits or ((1 << (bits - lengths[~lone].astype(np.int64))) * used[~lone]).sum(axis=1).max(initial=1 << bits) != 1 << bits:
        raise ValueError("incomplete or oversubscribed prefix code")
    order = np.argsort(np.where(used, lengths, 99), axis=1, kind="stable")
    ordered = np.take_along_axis(lengths, order, axis=1).astype(np.int64)
    reps = np.where(ordered > 0, 1 << (bits - ordered), 0)
    entry = order << 4 | ordered
    # a code of one symbol (or of none) takes no bits
    reps[lone], reps[lone, 0] = 0, 1 << bits
    entry[lone, 0] = np.where(number[lone] == 1, order[lone, 0] << 4, 0)
    flat = np.repeat(entry.ravel(), reps.ravel()).reshape(len(lengths), 1 << bits)
    back = _REV15[np.arange(1 << bits)] >> (15 - bits)
    return flat[:, back], bits


def _read_code(r: _Reader, who: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code lengths (streams x largest alphabet) of one prefix code of each stream."""
    lengths = np.zeros((len(who), int(sizes.max(initial=1))), dtype=np.uint8)
    simple = r.read(who, 1) == 1
    k = np.flatnonzero(simple)
    if len(k):
        two, wide = r.read(who[k], 1), r.read(who[k], 1)
        lengths[k, r.read(who[k], np.where(wide == 1, 8, 1))] = 1
        both = k[two == 1]
        if len(both):
            lengths[both, r.read(who[both], 8)] = 1
    k = np.flatnonzero(~simple)
    if not len(k):
        return lengths
    mine = who[k]
    firsts = np.zeros((len(k), 19), dtype=np.uint8)
    many = 4 + r.read(mine, 4)
    for j in range(int(many.max())):
        on = many > j
        firsts[on, CODE_LENGTH_ORDER[j]] = r.read(mine[on], 3)
    left = sizes[k].copy()
    limited = r.read(mine, 1) == 1
    if limited.any():
        m = mine[limited]
        left[limited] = 2 + r.read(m, 2 + 2 * r.read(m, 3))
    table, bits = _tables(firsts)
    mask = np.uint32((1 << bits) - 1)
    at = np.zeros(len(k), dtype=np.int64)
    before = np.full(len(k), 8, dtype=np.uint8)
    size = sizes[k]
    live = np.arange(len(k))
    while True:
        live = live[(at[live] < size[live]) & (left[live] > 0)]
        if not len(live):
            return lengths
        left[live] -= 1
        got = table[live, r.peek(mine[live]) & mask]
        r.pos[mine[live]] += got & 15
        s = got >> 4
        plain = s < _SYMBOL_16
        who_plain, v = live[plain], s[plain].astype(np.uint8)
        lengths[k[who_plain], at[who_plain]] = v
        before[who_plain[v > 0]] = v[v > 0]
        at[who_plain] += 1
        if plain.all():
            continue
        runs, kind = live[~plain], s[~plain]
        n = np.where(kind == _SYMBOL_18, 11, 3) + r.read(mine[runs], np.where(kind == _SYMBOL_16, 2, np.where(kind == _SYMBOL_17, 3, 7)))
        for i in np.flatnonzero(kind == _SYMBOL_16):
            lengths[k[runs[i]], at[runs[i]] : min(at[runs[i]] + n[i], size[runs[i]])] = before[runs[i]]
        at[runs] += n


def _read_images(r: _Reader, who: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> np.ndarray:
    """Pixels as ARGB (streams x most pixels) of one entropy-coded image of each stream."""
    n = width * height
    cached = r.read(who, 1)
    cache_bits = np.zeros(len(who), dtype=np.int64)
    if cached.any():
        cache_bits[cached == 1] = r.read(who[cached == 1], 4)
    if main and r.read(who, 1).any():
        raise _Odd
    sizes = 280 + np.where(cache_bits > 0, 1 << cache_bits, 0)
    codes = [_tables(_read_code(r, who, z)) for z in (sizes, *[np.full(len(who), 256)] * 3, np.full(len(who), 40))]
    most = int(n.max(initial=0))
    out = np.zeros((len(who), most), dtype=np.uint32)
    cache = np.zeros((len(who), 1 << int(cache_bits.max(initial=0))), dtype=np.uint32)
    caching = bool(cache_bits.any())
    shift = (32 - cache_bits).astype(np.uint64)
    copies, back = np.zeros(len(who), dtype=np.int64), np.zeros(len(who), dtype=np.int64)
    # longest first, so that those still running are a prefix
    order = np.argsort(-n, kind="stable")
    ends = n[order]
    near = np.array(DISTANCE_MAP, dtype=np.int64)

    def symbol(c: int, k: np.ndarray) -> np.ndarray:
        table, bits = codes[c]
        got = table[k, r.peek(who[k]) & np.uint32((1 << bits) - 1)]
        r.pos[who[k]] += got & 15
        return got >> 4

    def number(prefix: np.ndarray, k: np.ndarray) -> np.ndarray:
        extra = np.maximum(prefix - 2, 0) >> 1
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + r.read(who[k], np.where(prefix < 4, 0, extra)) + 1)

    for at in range(most):
        live = order[: np.searchsorted(-ends, -at, side="left")]
        copying = copies[live] > 0
        k = live[~copying] if copying.any() else live
        if len(k):
            s = symbol(0, k)
            lit = s < 256
            kl = k if lit.all() else k[lit]
            if len(kl):
                red, blue, alpha = symbol(1, kl), symbol(2, kl), symbol(3, kl)
                out[kl, at] = (alpha << 24 | red << 16 | (s if kl is k else s[lit]) << 8 | blue).astype(np.uint32)
            if kl is not k:
                ref = ~lit & (s < 280)
                kr = k[ref]
                if len(kr):
                    copies[kr] = number(s[ref] - 256, kr)
                    code = number(symbol(4, kr), kr)
                    close = near[np.minimum(code, 120) - 1]
                    back[kr] = np.where(code > 120, code - 120, np.maximum(1, close[:, 0] + close[:, 1] * width[kr]))
                    if (back[kr] > at).any():
                        raise ValueError("back-reference before the image")
                hit = s >= 280
                if hit.any():
                    out[k[hit], at] = cache[k[hit], s[hit] - 280]
        moving = live[copies[live] > 0]
        if len(moving):
            out[moving, at] = out[moving, at - back[moving]]
            copies[moving] -= 1
        if caching:
            px = out[live, at].astype(np.uint64)
            cache[live, ((px * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> shift[live]) * (cache_bits[live] > 0)] = out[live, at]
    if (r.pos[who] > r.end[who]).any():
        raise ValueError("image data ends early")
    return out


def _rgba(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (16, 8, 0, 24)], axis=-1).astype(np.uint8)


def _up(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (n + (1 << bits) - 1) >> bits


def _undo_predictor(px: np.ndarray, who: np.ndarray, w: int, heights: np.ndarray, modes: np.ndarray, bits: int) -> None:
    """In place for the images ``who`` of width w; px is (images, rows * w, 4)."""
    part = px[who].astype(np.int16)
    across = (w + (1 << bits) - 1) >> bits
    part[:, 0] = (part[:, 0] + np.array([0, 0, 0, 255], dtype=np.int16)) & 255
    for x in range(1, w):
        part[:, x] = (part[:, x] + part[:, x - 1]) & 255
    for y in range(1, int(heights.max())):
        live = np.flatnonzero(heights > y)
        i = y * w
        part[live, i] = (part[live, i] + part[live, i - w]) & 255
        for left_edge in range(0, w, 1 << bits):
            kinds = modes[live, (y >> bits) * across + (left_edge >> bits)]
            groups = [(m, live[kinds == m]) for m in np.unique(kinds)]
            for x in range(max(left_edge, 1), min(left_edge + (1 << bits), w)):
                j = i + x
                for m, k in groups:
                    guess = combine(int(m) if m < 14 else 0, part[k, j - 1], part[k, j - w], part[k, j - w - 1], part[k, j - w + 1])
                    part[k, j] = (part[k, j] + guess) & 255
    px[who] = part.astype(np.uint8)


def _undo_cross(px: np.ndarray, who: np.ndarray, w: int, factors: np.ndarray, bits: int) -> None:
    part = px[who]
    across = (w + (1 << bits) - 1) >> bits
    j = np.arange(part.shape[1])
    block = np.minimum((j // w >> bits) * across + (j % w >> bits), factors.shape[1] - 1)
    by = _signed(factors)[:, block]
    green = _signed(part[..., 1])
    red = (_signed(part[..., 0]) + (by[..., 2] * green >> 5)) & 255
    part[..., 2] = (_signed(part[..., 2]) + (by[..., 1] * green >> 5) + (by[..., 0] * _signed(red) >> 5)) & 255
    part[..., 0] = red
    px[who] = part


def _decode_alike(chunks: list[bytes]) -> list[np.ndarray]:
    r = _Reader(chunks)
    total = len(chunks)
    every = np.arange(total)
    if (r.read(every, 8) != 0x2F).any():
        raise ValueError("not a VP8L image")
    w, h = r.read(every, 14) + 1, r.read(every, 14) + 1
    opaque = r.read(every, 1) == 0
    if r.read(every, 3).any():
        raise ValueError("unknown VP8L version")
    width = w.copy()
    undo: list[tuple] = []
    live = every
    while len(live):
        live = live[r.read(live, 1) == 1]
        kind = r.read(live, 2)
        for what in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE):
            k = live[kind == what]
            if not len(k):
                continue
            if what == SUBTRACT_GREEN:
                undo.append((what, k, None, None))
            elif what == PALETTE:
                size = r.read(k, 8) + 1
                table = np.cumsum(_rgba(_read_images(r, k, size, np.ones_like(size), False)), axis=1, dtype=np.uint8)
                table[np.arange(table.shape[1]) >= size[:, None]] = 0
                bits = np.where(size <= 2, 3, np.where(size <= 4, 2, np.where(size <= 16, 1, 0)))
                undo.append((what, k, table, (bits, width[k].copy())))
                width[k] = _up(width[k], bits)
            else:
                bits = r.read(k, 3) + 2
                side = _rgba(_read_images(r, k, _up(width[k], bits), _up(h[k], bits), False))
                undo.append((what, k, side, bits))
    pixels = _rgba(_read_images(r, every, width, h, True))
    wide = int((w * h).max())
    if pixels.shape[1] < wide:
        pixels = np.concatenate([pixels, np.zeros((total, wide - pixels.shape[1], 4), np.uint8)], axis=1)
    for what, k, side, more in reversed(undo):
        if what == SUBTRACT_GREEN:
            part = pixels[k]
            part[..., 0] += part[..., 1]
            part[..., 2] += part[..., 1]
            pixels[k] = part
        elif what == PALETTE:
            bits, full = more
            for b, f in {*zip(bits.tolist(), full.tolist(), strict=True)}:
                mine = np.flatnonzero((bits == b) & (full == f))
                narrow, per, each = (f + (1 << b) - 1) >> b, 1 << b, 8 >> b
                rows = int(h[k[mine]].max())
                index = pixels[k[mine], : rows * narrow, 1].reshape(len(mine), rows, narrow)
                if b:
                    index = np.stack([index >> (j * each) & ((1 << each) - 1) for j in range(per)], axis=-1).reshape(len(mine), rows, -1)[..., :f]
                tables = np.zeros((len(mine), 256, 4), dtype=np.uint8)
                tables[:, : side.shape[1]] = side[mine]
                pixels[k[mine], : rows * f] = tables[np.arange(len(mine))[:, None], index.reshape(len(mine), -1)]
                width[k[mine]] = f
        else:
            for b, f in {*zip(more.tolist(), width[k].tolist(), strict=True)}:
                mine = np.flatnonzero((more == b) & (width[k] == f))
                if what == PREDICTOR:
                    _undo_predictor(pixels, k[mine], f, h[k[mine]], side[mine, :, 1] & 15, b)
                else:
                    _undo_cross(pixels, k[mine], f, side[mine, :, :3], b)
    pixels[opaque, :, 3] = 255
    return [pixels[i, : w[i] * h[i]].reshape(h[i], w[i], 4) for i in range(total)]


def decode(chunks: list[bytes]) -> list[np.ndarray]:
    """The pixel array (height, width, 4) of every VP8L chunk."""
    if not chunks:
        return []
    try:
        return _decode_alike(chunks)
    except _Odd:
        if len(chunks) == 1:
            return [decode_vp8l(chunks[0])]
        half = len(chunks) // 2
        return decode(chunks[:half]) + decode(chunks[half:])


def chunks_of(media: bytes) -> list[bytes]:
    """The VP8L chunks of all RIFF files in ``media``."""
    found, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        k, chunk = at + 12, None
        while k + 8 <= end:
            n = struct.unpack_from("<I", media, k + 4)[0]
            if media[k : k + 4] == b"VP8L":
                chunk = media[k + 8 : k + 8 + n]
                break
            k += 8 + n + (n & 1)
        if chunk is None:
            raise ValueError("no VP8L chunk")
        found.append(chunk)
        at = end + (end - at & 1)
    return found
