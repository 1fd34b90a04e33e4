import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from vitalframe.llm import webp as W

from .data import clashing, documents, empty, rows

RNG = np.random.default_rng(5)


def put_image(out, pixels, main, meta=None, cache_bits=0):
    """Literal-only entropy coding; ``meta``: (bits, groups per tile)."""
    h, w = pixels.shape
    out.put(0, 1)
    if main:
        out.put(int(meta is not None), 1)
    groups = np.zeros((h, w), int)
    if meta is not None:
        bits, tiles = meta
        out.put(bits - 2, 3)
        put_image(out, (tiles.astype(np.uint32) << 8) | np.uint32(0xFF000000), False)
        groups = np.repeat(np.repeat(tiles, 1 << bits, 0), 1 << bits, 1)[:h, :w]
    flat, g = pixels.reshape(-1), groups.reshape(-1)
    codes = []
    for k in range(int(g.max()) + 1):
        own = flat[g == k]
        lengths = [W.code_lengths(np.bincount((own >> s & 0xFF).astype(int), minlength=n)) for s, n in ((8, 280), (16, 256), (0, 256), (24, 256))] + [np.zeros(40, int)]
        codes.append((lengths, [W.canonical(x) for x in lengths[:4]]))
        for x in lengths:
            W._write_code(out, x)
    for p, k in zip(flat.tolist(), g.tolist(), strict=True):
        lengths, code = codes[k]
        for i, s in enumerate((8, 16, 0, 24)):
            v = p >> s & 0xFF
            if np.count_nonzero(lengths[i]) > 1:
                out.put(int(code[i][v]), int(lengths[i][v]))


def webp_file(width, height, body):
    out = W._Out()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    body(out)
    data = out.value.to_bytes((out.size + 7) // 8, "little")
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def rgba(p):
    return np.stack([(p >> s & 0xFF).astype(np.uint8) for s in (16, 8, 0, 24)], -1)


def picture(h, w):
    base = RNG.integers(0, 40, (h, w, 4)) + np.arange(w)[None, :, None] * 2
    c = (base & 255).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict_pixel(img, y, x, mode):
    """The format's prediction, written pixel by pixel from its description."""
    ch = lambda p: [int(p) >> s & 255 for s in (24, 16, 8, 0)]
    h, w = img.shape
    if y == 0:
        return [255, 0, 0, 0] if x == 0 else ch(img[0, x - 1])
    if x == 0:
        return ch(img[y - 1, 0])
    L, T, TL = ch(img[y, x - 1]), ch(img[y - 1, x]), ch(img[y - 1, x - 1])  # noqa: N806
    TR = ch(img[y - 1, x + 1]) if x + 1 < w else ch(img[y, 0])  # noqa: N806
    avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 0:
        return [255, 0, 0, 0]
    table = {1: L, 2: T, 3: TR, 4: TL, 5: avg(avg(L, TR), T), 6: avg(L, TL), 7: avg(L, T), 8: avg(TL, T), 9: avg(T, TR), 10: avg(avg(L, TL), avg(T, TR))}
    if mode in table:
        return table[mode]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(L, T, TL, strict=True)]
        pl, pt = sum(abs(a - b) for a, b in zip(p, L, strict=True)), sum(abs(a - b) for a, b in zip(p, T, strict=True))
        return L if pl < pt else T
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(L, T, TL, strict=True)]
    a = avg(L, T)
    return [clamp(i + int((i - j) / 2)) for i, j in zip(a, TL, strict=True)]


def test_predictor_modes():
    img = picture(13, 22)
    h, w = img.shape
    modes = RNG.permutation(np.arange(24) % 14).reshape(4, 6)
    res = np.zeros_like(img)
    for y in range(h):
        for x in range(w):
            p = predict_pixel(img, y, x, int(modes[y >> 2, x >> 2]))
            c = [(int(img[y, x]) >> s & 255) - v & 255 for s, v in zip((24, 16, 8, 0), p, strict=True)]
            res[y, x] = c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]

    def body(out):
        for v, n in ((1, 1), (0, 2), (0, 3)):
            out.put(v, n)
        put_image(out, (modes.astype(np.uint32) << 8) | np.uint32(0xFF000000), False)
        out.put(0, 1)
        put_image(out, res, True)

    data = webp_file(w, h, body)
    assert (W.decode(data) == rgba(img)).all()
    assert (W.decode_many([data])[0] == rgba(img)).all()


def test_cross_colour_subtract_green_and_meta_codes():
    img = picture(9, 12)
    h, w = img.shape
    tiles = RNG.integers(0, 1 << 24, (3, 3)).astype(np.uint32) | np.uint32(0xFF000000)
    s8 = lambda v: (v & 255) - 256 if (v & 255) > 127 else v & 255
    res = np.zeros_like(img)
    for y in range(h):
        for x in range(w):
            p, t = int(img[y, x]), int(tiles[y >> 2, x >> 2])
            a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
            nb = b - ((s8(t >> 8) * s8(g)) >> 5) - ((s8(t >> 16) * s8(r)) >> 5)
            nr = r - ((s8(t) * s8(g)) >> 5)
            res[y, x] = a << 24 | (nr & 255) << 16 | g << 8 | nb & 255
    plain = np.zeros_like(res)
    for i, p in enumerate(res.reshape(-1).tolist()):
        a, r, g, b = p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255
        plain.reshape(-1)[i] = a << 24 | ((r - g) & 255) << 16 | g << 8 | (b - g) & 255

    def body(out):
        for v, n in ((1, 1), (1, 2), (0, 3)):
            out.put(v, n)
        put_image(out, tiles, False)
        for v, n in ((1, 1), (2, 2), (0, 1)):
            out.put(v, n)
        put_image(out, plain, True, meta=(2, RNG.integers(0, 3, (3, 3))))

    data = webp_file(w, h, body)
    assert (W.decode(data) == rgba(img)).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 11, 16, 200])
def test_palette_with_bundling(colours):
    palette = RNG.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    index = RNG.integers(0, colours, (7, 21))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, depth = 1 << pack, 8 >> pack
    narrow = -(-21 // per)
    bundled = np.zeros((7, narrow), np.uint32)
    for y in range(7):
        for x in range(21):
            bundled[y, x // per] |= np.uint32(int(index[y, x]) << (x % per) * depth << 8)
    bundled |= np.uint32(0xFF000000)
    steps = palette.copy()
    for i in range(1, colours):
        c = [((int(palette[i]) >> s & 255) - (int(palette[i - 1]) >> s & 255)) & 255 for s in (24, 16, 8, 0)]
        steps[i] = c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]

    def body(out):
        for v, n in ((1, 1), (3, 2), (colours - 1, 8)):
            out.put(v, n)
        put_image(out, steps[None, :], False)
        out.put(0, 1)
        put_image(out, bundled, True)

    data = webp_file(21, 7, body)
    assert (W.decode(data) == rgba(palette[index])).all()


@pytest.mark.parametrize("cache_bits", [0, 1, 4, 7, 11])
def test_encoder_round_trip(cache_bits):
    images = [np.full((3, 5), 7, np.uint32), picture(1, 1), picture(40, 33), RNG.integers(0, 3, (30, 31)).astype(np.uint32), np.repeat(RNG.integers(0, 1 << 32, (9, 9), dtype=np.uint64).astype(np.uint32), 700, axis=1)]
    files = [W.encode(i, cache_bits=cache_bits) for i in images]
    for one, many, want in zip(map(W.decode, files), W.decode_many(files * 8), images, strict=False):
        assert (one == rgba(want)).all() and (many == rgba(want)).all()


def test_lockstep_equals_scalar():
    rnd = random.Random(2)
    loads = [W.padded("".join(rnd.choice("abc é\n") for _ in range(rnd.randint(0, 4000)))) for _ in range(80)]
    files = [W.encode(W.text_image(x)) for x in loads]
    for x, a in zip(loads, W.decode_many(files), strict=True):
        assert a[..., :3].tobytes() == x
    assert all((a == W.decode(f)).all() for a, f in zip(W.decode_many(files), files, strict=True))


def test_lockstep_tables_are_small():
    """Lanes with and without a cache, of all ends in a word; tables of 16 bits an entry."""
    rng = np.random.default_rng(4)
    texts = ["".join(chr(33 + min(93, int(x))) for x in rng.exponential(9, 2400 + 7 * i)) for i in range(40)]
    images = [W.text_image(W.padded(t)) for t in texts]
    files = [W.encode(x, cache_bits=(0, 1, 7, 11)[i % 4]) for i, x in enumerate(images)]
    entries = 0
    for f in files:
        bits = W._header(f)[0]
        bits.take(1)
        size = 1 << bits.take(4) if bits.take(1) else 0
        bits.take(1)
        entries += sum(len(W.read_code(bits, n).table) for n in (W.ALPHABETS[0] + size, *W.ALPHABETS[1:]))
    tracemalloc.start()
    found = W.decode_many(files)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for f, y in zip(files, found, strict=True):
        assert np.array_equal(y, W.decode(f))
    assert most < 12 * entries


def test_damaged_files():
    good = W.encode(picture(20, 20))
    assert isinstance(W.decode_many([b"", b"RIFF", good[:40], good])[0], W.WebPError)
    found = W.decode_many([good[: len(good) // 2] + bytes(8), good])
    assert isinstance(found[0], W.WebPError) and not isinstance(found[1], W.WebPError)
    with pytest.raises(W.WebPError):
        W.decode(b"not an image")


def test_long_text_image():
    load = W.padded("y" * 4_000_000)
    img = W.text_image(load)
    assert img.shape[0] <= W.MAX_SIDE and W.decode(W.encode(img))[..., :3].reshape(-1)[: len(load)].tobytes() == load


def test_query_rows(spark):
    from collections import Counter

    def want(i, t):
        raw = (t or "").encode()
        load = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        return i, len(raw), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:])

    for df in (documents(spark), clashing(spark)):
        got = W.store_texts(df).collect()
        assert Counter(map(tuple, ([r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]] for r in got))) == Counter(want(r[0], r[1]) for r in rows())
    assert W.store_texts(empty(spark)).count() == 0


def test_decode_column(spark):
    good = W.encode(picture(4, 4))
    df = spark.createDataFrame([(1, good), (2, b"x"), (3, None)], "k int, media binary")
    got = {r["k"]: r["pixels"] for r in W.decode_column(df, "media").collect()}
    assert bytes(got[1]["rgba"]) == W.decode(good).tobytes() and got[2]["error"] and got[2]["rgba"] is None and got[3] is None


def test_distance_map_is_a_half_disc_of_120():
    near = W.distance_map()
    assert len(set(near)) == 120 and near[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    assert all((y == 0 and 1 <= x <= 8) or (1 <= y <= 7 and -7 <= x <= 8) for x, y in near)


def test_small_code_tables_equal_the_general_ones():
    for _ in range(200):
        lengths = W.code_lengths(RNG.integers(0, 2 ** RNG.integers(1, 12), 19) * (RNG.random(19) < 0.7), 7)
        if np.count_nonzero(lengths) < 2:
            continue
        table, bits = W._small_table(lengths.tolist())
        code = W.Code(lengths)
        assert bits == code.bits and table == code.table.tolist()
    assert W._small_table([0, 0, 3]) == ([2 << 4], 0)
    for broken in ([1, 2], [1, 1, 1], [0, 0], [2, 2, 2, 2, 2]):
        with pytest.raises(W.WebPError):
            W._small_table(broken)


def test_long_codes_of_all_four_samples_share_words():
    weight = np.repeat(np.arange(24), np.minimum(2 ** np.arange(24), 4000))  # skewed: codes up to 15 bits
    p = np.zeros((100, 300), np.uint32)
    for s in (24, 16, 8, 0):
        p |= RNG.choice(weight, p.shape).astype(np.uint32) << np.uint32(s)
    media = W.encode(p)
    assert np.array_equal(W.decode(media), rgba(p))
    assert all(np.array_equal(x, rgba(p)) for x in W.decode_many([media] * 30))


def steps_of(media):
    return [t[0] for t in W._transforms(*W._header(media))[0]]


def test_encoder_writes_every_transform():
    rng = np.random.default_rng(8)
    g = rng.integers(0, 256, (64, 80))
    noise = lambda: rng.integers(0, 3, g.shape)
    image = lambda r, g, b: np.uint32(0xFF000000) | ((r & 255) << 16 | (g & 255) << 8 | b & 255).astype(np.uint32)
    signed = (g ^ 128) - 128
    x = np.arange(80)[None, :] * 3 + np.arange(64)[:, None] * 2
    cases = {
        (W.PREDICTOR,): image(x + noise(), 2 * x + noise(), 255 - x + noise()),
        (W.PREDICTOR, W.SUBTRACT_GREEN): image(x + g // 16, x + g // 16, x + g // 16 + noise()),
        (W.SUBTRACT_GREEN,): image(g + noise(), g, g + noise()),
        (W.CROSS_COLOUR,): image((signed * -20 >> 5) + noise(), g, (signed * 45 >> 5) + noise()),
        (W.PALETTE,): rng.integers(0, 1 << 32, 5, dtype=np.uint64).astype(np.uint32)[g % 5],
    }
    files = W.encode_many(list(cases.values()))
    assert [tuple(steps_of(f)) for f in files] == list(cases)
    for f, p in zip(files, cases.values(), strict=True):
        assert f == W.encode(p) and np.array_equal(W.decode(f), rgba(p))
    assert all(np.array_equal(y, rgba(p)) for y, p in zip(W.decode_many(files * 30), list(cases.values()) * 30, strict=True))
    clear = [p & np.uint32(0xFFFFFF) | (g % 200 + 20).astype(np.uint32) << np.uint32(24) for p in cases.values()]
    assert all(np.array_equal(W.decode(f), rgba(p)) for f, p in zip(W.encode_many(clear), clear, strict=True))


def test_encoder_copies_from_far_back():
    rng = random.Random(3)
    once = "".join(chr(rng.randint(33, 126)) for _ in range(2997))
    one, many = (W.encode(W.text_image(W.padded(once * k))) for k in (1, 9))
    assert len(many) < 1.1 * len(one) and W.decode(many)[..., :3].tobytes() == W.padded(once * 9)
    flat = np.array([5, 6, 7, 1, 5, 6, 7, 8, 2, 5, 6, 7, 8, 9, 9, 9, 9, 9], np.uint32)
    at, length, far = W._copies([flat, flat])[1]
    assert list(zip(at.tolist(), length.tolist(), far.tolist(), strict=True)) == [(4, 3, 4), (9, 4, 5), (14, 4, 1)]
    long = np.tile(RNG.integers(0, 1 << 24, 7000).astype(np.uint32), 3)  # copies of 4,096 pixels at most
    at, length, far = W._copies([long])[0]
    assert length.sum() == 14000 and length.max() == 4096 and set(far.tolist()) == {7000}


def test_stored_texts_use_what_helps(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(("ab ", "xyz", "...", "q7-")) for _ in range(900)), "".join(chr(rng.randint(33, 126)) for _ in range(999)) * 6]
    got = {r["doc_id"]: r for r in W.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert steps_of(W.encode(W.text_image(W.padded(texts[0])))) == [W.PALETTE]
    for i, t in enumerate(texts):
        assert got[i]["payload_sha256"] == hashlib.sha256(W.padded(t)).hexdigest()
    assert got[0]["media_bytes"] < 400 and got[1]["media_bytes"] < 1300
