"""A small VP8L writer for tests: every feature that the production encoder leaves out."""

from __future__ import annotations

from tarn.llm.webp import CACHE_FACTOR, BitWriter


def canonical(lengths):
    code, out = 0, {}
    for n in range(1, max(lengths) + 1):
        for s, k in enumerate(lengths):
            if k == n:
                out[s] = int(f"{code:0{n}b}"[::-1], 2), n
                code += 1
        code <<= 1
    return out


def balanced(symbols, size):
    """Lengths of a complete code over the symbols, of two neighbouring lengths."""
    symbols = sorted(symbols)
    lengths = [0] * size
    if len(symbols) == 1:
        symbols = sorted({symbols[0], 0 if symbols[0] else 1})
    top = max(1, (len(symbols) - 1).bit_length())
    short = (1 << top) - len(symbols)
    for i, s in enumerate(symbols):
        lengths[s] = top - 1 if i < short else top
    return lengths


def put_code(w: BitWriter, lengths):
    """A normal code whose lengths are written by a flat code-length code, with runs of zeros."""
    w.write(0, 1)
    order = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
    first = balanced([*range(16), 17, 18], 19)
    w.write(15, 4)
    for s in order:
        w.write(first[s], 3)
    codes = canonical(first)
    w.write(0, 1)
    i = 0
    while i < len(lengths):
        run = 0
        while i + run < len(lengths) and not lengths[i + run] and run < 138:
            run += 1
        if run >= 11:
            w.write(*codes[18])
            w.write(run - 11, 7)
            i += run
        elif run >= 3:
            w.write(*codes[17])
            w.write(run - 3, 3)
            i += run
        else:
            w.write(*codes[lengths[i]])
            i += 1
    return canonical(lengths)


def prefix(v):
    """(prefix code, extra value, extra bits) of a length or distance of 1 or more."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def put_image(w: BitWriter, argb, width, main, cache_bits=0, refs=False):
    """Entropy-coded pixels (a list of ARGB integers), with an optional cache and back-references."""
    w.write(int(cache_bits > 0), 1)
    if cache_bits:
        w.write(cache_bits, 4)
    if main:
        w.write(0, 1)
    ops, i, cache = [], 0, {}

    def slot(p):
        return (p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)

    while i < len(argb):
        best = (0, 0)
        if refs:
            for back in range(1, min(i, 300) + 1):
                n = 0
                while i + n < len(argb) and n < 500 and argb[i + n] == argb[i + n - back]:
                    n += 1
                best = max(best, (n, -back))
        if best[0] >= 3:
            ops.append(("ref", best[0], -best[1]))
            n = best[0]
        elif cache_bits and cache.get(slot(argb[i])) == argb[i]:
            ops.append(("cache", slot(argb[i]), 0))
            n = 1
        else:
            ops.append(("lit", argb[i], 0))
            n = 1
        for p in argb[i : i + n]:
            if cache_bits:
                cache[slot(p)] = p
        i += n
    greens, dists = set(), set()
    others = [set(), set(), set()]
    for kind, a, b in ops:
        if kind == "lit":
            greens.add(a >> 8 & 255)
            for k, v in enumerate((a >> 16 & 255, a & 255, a >> 24)):
                others[k].add(v)
        elif kind == "ref":
            greens.add(256 + prefix(a)[0])
            dists.add(prefix(b + 120)[0])
        else:
            greens.add(280 + a)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [put_code(w, balanced(s or {0}, n)) for s, n in zip((greens, *others, dists), sizes, strict=True)]
    for kind, a, b in ops:
        if kind == "lit":
            for k, v in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                w.write(*codes[k][v])
        elif kind == "ref":
            p, extra, n = prefix(a)
            w.write(*codes[0][256 + p])
            w.write(extra, n)
            p, extra, n = prefix(b + 120)
            w.write(*codes[4][p])
            w.write(extra, n)
        else:
            w.write(*codes[0][280 + a])


def start(width, height):
    w = BitWriter()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 1)
    w.write(0, 3)
    return w


def to_argb(pixels):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in pixels.reshape(-1, 4)]
