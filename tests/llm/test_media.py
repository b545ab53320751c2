"""GIF media: op1."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from odd_rows import docs, odd  # noqa: F401

from tamis.llm import gif_media as g
from tamis.llm.queries import QUERIES


def slow_lzw(codes, code_size):
    """The textbook decoder over a list of codes."""
    clear, out, table, before = 1 << code_size, [], {}, None
    for c in codes:
        if c == clear:
            table, before = {i: [i] for i in range(clear)}, None
            free = clear + 2
        elif c == clear + 1:
            break
        else:
            now = table[c] if c in table else before + before[:1]
            out += now
            if before is not None and free < 4096:
                table[free] = before + now[:1]
                free += 1
            before = now
    return out


def read_codes(raw, code_size):
    """Codes from the bits, one by one."""
    bits = int.from_bytes(raw, "little")
    clear, width, free, first, at, out = 1 << code_size, code_size + 1, (1 << code_size) + 2, True, 0, []
    while at + width <= 8 * len(raw):
        c = bits >> at & ((1 << width) - 1)
        at += width
        out.append(c)
        if c == clear:
            width, free, first = code_size + 1, clear + 2, True
            continue
        if c == clear + 1:
            break
        if not first and free < 4096:
            free += 1
        first = False
        if free == 1 << width and width < 12:
            width += 1
    return out


@pytest.mark.parametrize("code_size", [2, 4, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 576, 5000, 40_000])
def test_streams(code_size, n):
    rng = random.Random(n)
    top = (1 << code_size) - 1
    for data in (bytes(rng.randint(0, top) for _ in range(n)), bytes(rng.choice([0, 1]) for _ in range(n)), bytes(n)):
        codes = g.lzw_codes(data, code_size)
        raw = g.pack([codes, codes], code_size)
        assert raw[0] == raw[1] and read_codes(raw[0], code_size) == codes
        assert bytes(slow_lzw(codes, code_size)) == data
        assert g.lzw_decode([raw[0], b"", raw[1]], code_size)[2].tobytes() == data


def test_streams_of_many_lengths_together():
    rng = random.Random(1)
    data = [bytes(rng.randint(97, 105) for _ in range(rng.randint(0, 9000))) for _ in range(40)]
    raw = [g.pack([g.lzw_codes(d)])[0] for d in data]
    assert [x.tobytes() for x in g.lzw_decode(raw, 8)] == data


def test_a_full_table_without_clear():
    """An encoder may go on with a full table; codes stay 12 bits wide."""
    rng = random.Random(2)
    data = [rng.randint(0, 255) for _ in range(30_000)]
    codes, table, free, now = [256], {}, 258, data[0]
    for x in data[1:]:
        if (now, x) in table:
            now = table[now, x]
            continue
        codes.append(now)
        if free < 4096:
            table[now, x] = free
            free += 1
        now = x
    raw = g.pack([[*codes, now, 257]])[0]
    assert g.lzw_decode([raw], 8)[0].tobytes() == bytes(data)


def test_broken_streams_end_early():
    raw = g.pack([g.lzw_codes(b"hello hello hello")])[0]
    for cut in range(len(raw)):
        assert b"hello hello hello".startswith(g.lzw_decode([raw[:cut]], 8)[0].tobytes())
    assert g.lzw_decode([g.pack([[256, 65, 300, 66, 257]])[0]], 8)[0].tobytes() == b"A"


def gif(size, palette, images, screen_palette=True):
    """A file from images (left, top, w, h, samples, disposal, delay, transparent, interlaced, local palette)."""
    bits = max(1, (len(palette) - 1).bit_length())
    full = palette + [(0, 0, 0)] * ((1 << bits) - len(palette))
    flat = bytes(v for c in full for v in c)
    out = b"GIF89a" + struct.pack("<HHBBB", *size, (0x80 if screen_palette else 0) | (bits - 1), 0, 0) + (flat if screen_palette else b"")
    for left, top, w, h, samples, disposal, delay, transparent, interlaced, local in images:
        out += b"\x21\xfe\x03abc\x00"
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent >= 0), delay, max(0, transparent)) + b"\x00"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x80 | (bits - 1) if local else 0) | (0x40 if interlaced else 0))
        if local:
            out += bytes(v for c in local + [(0, 0, 0)] * ((1 << bits) - len(local)) for v in c)
        raw = g.pack([g.lzw_codes(bytes(samples), max(2, bits))], max(2, bits))[0]
        out += bytes([max(2, bits)]) + b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\x00"
    return out + b";"


R, G, B, K = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)


def shown(raw):
    return [(f.start_ms, f.rgb.reshape(-1, 3).tolist()) for f in g.frames(g.decode([raw])[0])]


def test_disposal_and_transparency():
    whole = (0, 0, 2, 1, [0, 0], 1, 5, -1, False, None)
    frames = shown(gif((2, 1), [R, G, B], [whole, (1, 0, 1, 1, [1], 3, 7, -1, False, None), (0, 0, 2, 1, [2, 1], 2, 1, 1, False, None), (0, 0, 1, 1, [1], 0, 1, -1, False, None)]))
    assert [t for t, _ in frames] == [0, 50, 120, 130]
    assert [f for _, f in frames] == [[list(R), list(R)], [list(R), list(G)], [list(B), list(R)], [list(G), list(K)]]


def test_local_palettes_interlacing_and_clipping():
    samples = [r % 3 for r in range(11)]
    order = g._rows(11)
    raw = gif((1, 11), [R, G, B], [(0, 0, 1, 11, [samples[i] for i in order], 1, 0, -1, True, None), (0, 9, 3, 4, [1] * 12, 0, 0, -1, False, [B, B])])
    first, second = shown(raw)
    assert first[1] == [list((R, G, B)[s]) for s in samples]
    assert second[1][9:] == [list(B), list(B)] and second[1][:9] == first[1][:9]


def test_broken_files():
    good = gif((2, 2), [R, G], [(0, 0, 2, 2, [0, 1, 1, 0], 1, 1, -1, False, None)])
    assert g.decode([good])[0].error == ""
    for n in range(len(good)):
        found = g.decode([good[:n]])[0]
        list(g.frames(found))
        assert found.error or n == len(good)
    assert g.decode([None, b"", b"PNG"])[0].error == "null"
    short = gif((2, 2), [R, G], [(0, 0, 2, 2, [1], 1, 1, -1, False, None)])
    bad = g.decode([short])[0]
    assert list(g.frames(bad))[0].rgb.shape == (2, 2, 3) and bad.error == "short image"
    assert g.decode([gif((1, 1), [R, G], [(0, 0, 1, 1, [0], 0, 0, -1, False, None)], screen_palette=False)])[0].error == "no palette"


def test_histogram():
    rgb = np.array([[[255, 0, 31], [32, 0, 64]]], np.uint8)
    h = g.histogram(rgb)
    assert h.sum() == 6 and h[7] == h[1] == 1 and h[8] == 2 and h[16] == h[18] == 1


def test_columns(spark):
    raw = gif((2, 1), [R, G, B], [(0, 0, 2, 1, [0, 1], 1, 5, -1, False, None), (0, 0, 2, 1, [2, 2], 1, 6, -1, False, None)])
    df = spark.createDataFrame([(1, bytearray(raw), "own"), (2, None, "own"), (3, bytearray(raw[:-9]), "own")], "id int, media binary, frames string")
    rows = {r.id: r for r in g.read_gif(df, "id").collect()}
    assert [(f.start_ms, f.delay_ms, f.hist_red[7], bytes(f.rgb)) for f in rows[1].frames] == [(0, 50, 1, bytes(R + G)), (50, 60, 0, bytes(B + B))]
    assert rows[2].error == "null" and rows[2].frames == [] and rows[3].error
    assert g.read_gif(df.where("id < 0"), "id").count() == 0


def check(rows, texts):
    assert len(rows) == len(texts)
    for r, (doc_id, text) in zip(rows, texts, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media = g.encode([raw])[0]
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (doc_id, len(raw), len(payload), zlib.crc32(payload[-32:]), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()


def test_op1(spark, sf, odd, docs):
    for df, out in ((odd, g.text_media(odd)), (docs, QUERIES["op1_gif_media"](spark, sf))):
        key = lambda x: (str(x[0]), hashlib.sha256((x[1] or "").encode()).hexdigest())
        texts = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (str(x[0]), len((x[1] or "").encode())))
        rows = sorted(out.collect(), key=lambda r: (str(r.doc_id), r.n_bytes))
        check(rows, texts)
        assert key
    assert g.text_media(odd.where("doc_id < 0")).count() == 0
    by = {r.doc_id: r for r in g.text_media(odd.where("doc_id in (4, 5)")).collect()}
    assert by[4].feature == by[5].feature
