import hashlib
import zlib

import numpy as np
import pytest
from tarn.llm import webp_batch
from tarn.llm.media import decode_media, encode_media, from_media, media_digests, to_media
from tarn.llm.webp import BitWriter, decode_vp8l as decode_one, invert_predictor

from .webp_writer import put_image, start, to_argb

rng = np.random.default_rng(5)


def decode_vp8l(chunk):
    """Both decoders must agree, the one in lock step with others beside it."""
    alone, (first, _, again) = decode_one(chunk), webp_batch.decode([chunk, OTHER, chunk])
    assert (alone == first).all() and (alone == again).all()
    return alone


OTHER = webp_batch.encode([rng.integers(0, 9, (5, 16, 4), dtype=np.uint8)])[0]


@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 64, bytes(range(256)) * 3, rng.bytes(5000)])
def test_round_trip(raw):
    back = from_media(to_media([raw]))[0].tobytes()
    assert back == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def test_more_than_one_file():
    raw = rng.bytes(64 * 300 + 100)
    (media,) = to_media([raw])
    assert media.count(b"RIFF") >= 2
    assert from_media([media])[0].tobytes() == raw.ljust(64 * 302, b"\0")


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("refs", [False, True])
def test_prefix_codes_references_cache(cache_bits, refs):
    pixels = rng.integers(0, 3, (9, 13, 4), dtype=np.uint8) * 70
    w = start(13, 9)
    w.write(0, 1)
    put_image(w, to_argb(pixels), 13, True, cache_bits, refs)
    assert (decode_vp8l(w.bytes()) == pixels).all()


def test_palette():
    for colours in (2, 3, 11, 40):
        table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
        index = rng.integers(0, colours, (5, 17))
        w = start(17, 5)
        w.write(1, 1)
        w.write(3, 2)
        w.write(colours - 1, 8)
        put_image(w, to_argb(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), colours, False)
        w.write(0, 1)
        bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
        per, each = 1 << bits, 8 >> bits
        packed = np.zeros((5, -(-17 // per)), dtype=np.int64)
        for x in range(17):
            packed[:, x // per] |= index[:, x] << (x % per * each)
        put_image(w, [int(v) << 8 | 0xFF000000 for v in packed.ravel()], packed.shape[1], True)
        assert (decode_vp8l(w.bytes()) == table[index]).all()


def test_subtract_green_and_cross_colour():
    pixels = rng.integers(0, 256, (6, 7, 4), dtype=np.uint8)
    factors = rng.integers(-128, 128, (2, 2, 3))  # red-to-blue, green-to-blue, green-to-red
    signed = lambda v: (int(v) + 128) % 256 - 128
    moved = pixels.copy()
    for y in range(6):
        for x in range(7):
            rb, gb, gr = factors[y >> 2, x >> 2]
            r, g, b = (signed(v) for v in pixels[y, x, :3])
            moved[y, x, 0] = (r - ((int(gr) * g) >> 5)) % 256
            moved[y, x, 2] = (b - ((int(gb) * g) >> 5) - ((int(rb) * r) >> 5)) % 256
    moved[..., 0] -= moved[..., 1]
    moved[..., 2] -= moved[..., 1]
    w = start(7, 6)
    w.write(1, 1)
    w.write(1, 2)
    w.write(0, 3)
    put_image(w, [0xFF000000 | (int(a) & 255) << 16 | (int(b) & 255) << 8 | (int(c) & 255) for a, b, c in factors.reshape(-1, 3)], 2, False)
    w.write(1, 1)
    w.write(2, 2)
    w.write(0, 1)
    put_image(w, to_argb(moved), 7, True)
    assert (decode_vp8l(w.bytes()) == pixels).all()


def plain_predict(mode, out, x, y, w):
    L, T, TL = (out[y][x - 1], out[y - 1][x], out[y - 1][x - 1])
    TR = out[y - 1][x + 1] if x + 1 < w else out[y][0]
    avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    if mode == 0:
        return [0, 0, 0, 255]
    if mode < 5:
        return [L, T, TR, TL][mode - 1]
    if mode < 11:
        return [avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR))][mode - 5]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(L, T, TL)]
        return L if sum(abs(i - j) for i, j in zip(p, L)) < sum(abs(i - j) for i, j in zip(p, T)) else T
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(L, T, TL)]
    return [clip(a + int((a - b) / 2)) for a, b in zip(avg(L, T), TL)]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    pixels = rng.integers(0, 256, (7, 6, 4), dtype=np.uint8)
    out = pixels.astype(int).tolist()
    residue = pixels.copy()
    for y in range(7):
        for x in range(6):
            if y == 0:
                p = out[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                p = out[y - 1][0]
            else:
                p = plain_predict(mode, out, x, y, 6)
            residue[y, x] = [(a - b) % 256 for a, b in zip(out[y][x], p)]
    assert (invert_predictor(residue, np.full((2, 2), mode), 2) == pixels).all()
    w = start(6, 7)
    w.write(1, 1)
    w.write(0, 2)
    w.write(0, 3)
    put_image(w, [0xFF000000 | mode << 8] * 4, 2, False)
    w.write(0, 1)
    put_image(w, to_argb(residue), 6, True, 4, True)
    assert (decode_vp8l(w.bytes()) == pixels).all()


def test_damaged():
    (media,) = to_media([b"abc" * 100])
    with pytest.raises(ValueError):
        from_media([media[:60]])
    with pytest.raises(ValueError):
        from_media([b"nonsense"])
    assert BitWriter().bytes() == b""


def test_query(spark):
    texts = ["", None, "é" * 70, "same", "same", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_bytes", df_lit())
    rows = media_digests(encode_media(df)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[3][1:] == rows[4][1:] and rows[0][1:] == rows[1][1:]
    pixels = decode_media(encode_media(df)).orderBy("doc_id").collect()
    assert (pixels[2].width, pixels[2].height) == (16, 3)
    assert bytes(pixels[3].pixels).rstrip(b"\0") == b"same"
    assert media_digests(encode_media(df.limit(0))).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit(-1)


def pictures():
    """Images of every plan of transforms, of few colours, with runs, noise and single rows."""
    out = [np.zeros((1, 16, 4), np.uint8), np.full((64, 16, 4), 7, np.uint8), rng.integers(0, 256, (64, 16, 4), dtype=np.uint8)]
    for k in (1, 2, 3, 5, 16, 17):
        table = rng.integers(0, 256, (k, 4), dtype=np.uint8)
        out += [table[rng.integers(0, k, (h, 16))] for h in (1, 2, 9, 33)]
    ramp = np.arange(64)[:, None, None] + np.arange(16)[None, :, None] + np.array([0, 3, 9, 2])
    out += [((ramp * k) % 256).astype(np.uint8) for k in range(1, 30)]
    text = b"The quick brown fox jumps over the lazy dog, and then it does so again. "
    out += [np.frombuffer((text * 60)[k : k + 64 * h], np.uint8).reshape(h, 16, 4) for k in range(40) for h in (1, 5, 64)]
    return out


def test_batches_of_images():
    images = pictures()
    chunks = webp_batch.encode(images)
    forced = webp_batch.encode(images, np.arange(len(images)) % len(webp_batch.PLANS))
    for made in (chunks, forced):
        assert all((a == b).all() for a, b in zip(images, webp_batch.decode(made), strict=True))
        # the one-image decoder, which shares no code with the writer, reads the same
        assert all((a == decode_one(c)).all() for a, c in zip(images, made, strict=True))
    # what is beside an image does not change it
    assert webp_batch.encode(images[5:6]) == chunks[5:6] and webp_batch.encode(images[::-1])[::-1] == chunks


def test_transforms_are_chosen_by_size(spark):
    """Smooth pictures get transforms and texts none; nothing is larger than without them."""
    smooth = [x for x in pictures()[15:44] if len(x) == 64]
    least = sum(map(len, webp_batch.encode(smooth, np.zeros(len(smooth), dtype=np.int64))))
    assert sum(map(len, webp_batch.encode(smooth))) < 0.7 * least
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    images = [np.frombuffer(t[: len(t) // 64 * 64], np.uint8).reshape(-1, 16, 4) for t in ((r.text or "").encode()[:16384] for r in rows) if len(t) >= 64]
    best = sum(map(len, webp_batch.encode(images)))
    assert all(best <= sum(map(len, webp_batch.encode(images, np.full(len(images), k)))) for k in range(len(webp_batch.PLANS)))


def test_every_part_of_the_decoder_runs(monkeypatch):
    """With lists of transforms in turn, the writer's streams hold transforms of each kind, back-references, cache hits and fitted prefix codes; without any part texts change."""
    texts = [(b"A text %d with some words, and a table:      |    |      |\n" % k) * 40 for k in range(30)] + [b"", b"a", b"-" * 900, b"ab" * 2000]
    monkeypatch.setattr(webp_batch, "chosen", lambda p, layout: np.arange(len(layout.counts)) % len(webp_batch.PLANS))
    media = to_media(texts)
    seen = set()
    monkeypatch.setattr(webp_batch, "_undo_predictor", lambda *a, f=webp_batch._undo_predictor: seen.add("predictor") or f(*a))
    monkeypatch.setattr(webp_batch, "_undo_cross", lambda *a, f=webp_batch._undo_cross: seen.add("cross") or f(*a))
    back = from_media(media)
    assert seen == {"predictor", "cross"} and all(p.tobytes().rstrip(b"\0") == t for p, t in zip(back, texts, strict=True))
    for name, broken in (("_undo_predictor", lambda *a: None), ("_undo_cross", lambda *a: None), ("CACHE_FACTOR", 1), ("DISTANCE_MAP", ((1, 1),) * 120)):
        with monkeypatch.context() as m:
            m.setattr(webp_batch, name, broken)
            try:
                same = all(p.tobytes().rstrip(b"\0") == t for p, t in zip(from_media(media), texts, strict=True))
            except ValueError:
                same = False
            assert not same, name
    codes = [c for m in media for c in webp_batch.chunks_of(m)]
    assert sum(map(len, codes)) < 0.8 * sum(map(len, texts))  # prefix codes are fitted and runs are references
