"""GIF media columns: LZW code streams, palettes, interlacing, disposal and transparency; timed frames with histograms.

The decoder takes many code streams at once. Between two clear codes a code's width depends on its place only, so all codes
up to the next clear are cut out of the bits together; a code's string is what an earlier code put out and one byte more, so
lengths and bytes are found by following pointers, doubling their reach each time. The encoder stores bytes as grey samples
in square frames, a real LZW stream for each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_chunks

#: Samples of a frame's row and column in the encoder; a payload is padded with PAD to whole frames.
SIDE = 24
PAD = 255
DELAY_CS = 10
#: Histogram bins for each of red, green and blue.
BINS = 8


# --- writing ---------------------------------------------------------------------------------------------------------


def lzw_codes(data: bytes, code_size: int = 8) -> list[int]:
    """Codes of one stream, a clear first, a clear whenever the table is full, the end code last."""
    clear = 1 << code_size
    codes, table, free = [clear], {}, clear + 2
    at = iter(data)
    now = next(at, None)
    if now is None:
        return [clear, clear + 1]
    put, get = codes.append, table.get
    for x in at:
        key = now << 8 | x
        known = get(key)
        if known is None:
            put(now)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = clear + 2
            now = x
        else:
            now = known
    put(now)
    put(clear + 1)
    return codes


def _widths(code_size: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code."""
    free = (1 << code_size) + 1 + np.arange(n, dtype=np.int64)
    bits = np.full(n, code_size + 1)
    for w in range(code_size + 1, 12):
        bits[free >= 1 << w] = w + 1
    return bits


def pack(streams: list[list[int]], code_size: int = 8) -> list[bytes]:
    """The bytes of each stream of codes."""
    clear = 1 << code_size
    sizes = np.array([len(s) for s in streams])
    codes = np.fromiter(chain.from_iterable(streams), np.int32, int(sizes.sum()))
    first = np.concatenate(([0], np.cumsum(sizes)))
    # A code's place after the last clear before it; the first code of a stream is a clear itself.
    marks = np.flatnonzero(codes == clear)
    runs = np.diff(np.append(marks, len(codes)))
    place = np.arange(len(codes)) - np.repeat(marks, runs) - 1
    # A clear code has the width of the code that would stand there.
    place[marks[1:]] = runs[:-1] - 1
    place[first[:-1]] = 0
    bits = _widths(code_size, int(place.max()) + 1)[place]
    ends = np.cumsum(bits)
    stream = np.repeat(np.arange(len(sizes)), sizes)
    base = np.concatenate(([0], ends))[first]
    n_bytes = (np.diff(base) + 7) // 8
    byte0 = np.concatenate(([0], np.cumsum(n_bytes)))
    at = ends - bits - base[stream] + 8 * byte0[stream]
    word = codes << (at & 7)
    out = np.zeros(int(byte0[-1]) + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(word >> (8 * k)) & 255, minlength=len(out))
    raw = out.astype(np.uint8).tobytes()
    return [raw[a:b] for a, b in zip(byte0[:-1].tolist(), byte0[1:].tolist(), strict=True)]


_GREY = bytes(v for i in range(256) for v in (i, i, i))
_HEAD = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _GREY + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
_FRAME = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\x00\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"


def padded(payload: bytes) -> bytes:
    size = SIDE * SIDE
    return payload + bytes([PAD]) * (max(1, -(-len(payload) // size)) * size - len(payload))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A GIF of grey 24 x 24 frames for each payload, padded to whole frames."""
    size = SIDE * SIDE
    frames, counts = [], []
    for p in payloads:
        p = padded(p)
        counts.append(len(p) // size)
        frames += [lzw_codes(p[i : i + size]) for i in range(0, len(p), size)]
    data = iter(pack(frames))
    out = []
    for n in counts:
        parts = [_HEAD]
        for _ in range(n):
            raw = next(data)
            parts.append(_FRAME)
            for i in range(0, len(raw), 255):
                block = raw[i : i + 255]
                parts += [bytes([len(block)]), block]
            parts.append(b"\x00")
        out.append(b"".join([*parts, b";"]))
    return out


# --- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Image:
    """An image block as it is stored."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    interlaced: bool
    disposal: int
    delay_ms: int
    transparent: int
    code_size: int
    data: bytes
    indices: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    images: list[Image] = field(default_factory=list)
    error: str = ""


def parse(raw: bytes) -> Gif:
    """Blocks of a file. What is missing or wrong at some point ends it there and is told in error."""
    gif = Gif(0, 0)
    try:
        if raw[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        gif.width, gif.height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n

        def blocks(at: int) -> tuple[bytes, int]:
            parts = []
            while n := raw[at]:
                parts.append(raw[at + 1 : at + 1 + n])
                at += n + 1
            return b"".join(parts), at + 1

        control = (0, 0, -1)
        while (kind := raw[at]) != 0x3B:
            if kind == 0x21:
                label = raw[at + 1]
                data, at = blocks(at + 2)
                if label == 0xF9 and len(data) >= 4:
                    bits, delay, index = struct.unpack_from("<BHB", data)
                    control = (bits >> 2 & 7, 10 * delay, index if bits & 1 else -1)
            elif kind == 0x2C:
                left, top, width, height, flags = struct.unpack_from("<HHHHB", raw, at + 1)
                at += 10
                palette = shared
                if flags & 0x80:
                    n = 2 << (flags & 7)
                    palette = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
                    at += 3 * n
                if palette is None:
                    raise ValueError("no palette")
                code_size = raw[at]
                if not 2 <= code_size <= 11:
                    raise ValueError("bad code size")
                data, at = blocks(at + 1)
                gif.images.append(Image(left, top, width, height, palette, bool(flags & 0x40), *control, code_size, data))
                control = (0, 0, -1)
            else:
                raise ValueError("bad block")
    except (IndexError, struct.error):
        gif.error = "cut off"
    except ValueError as e:
        gif.error = "cut off" if "buffer" in str(e) else str(e)
    return gif


def lzw_decode(streams: list[bytes], code_size: int) -> list[np.ndarray]:
    """Samples of each stream. A stream ends at its end code, its last bit, or a code that isn't in the table yet."""
    done: list[list[np.ndarray]] = [[] for _ in streams]
    clear, base = 1 << code_size, (1 << code_size) + 2
    flat = np.frombuffer(b"\0\0\0".join(streams) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    sizes = np.array([len(s) for s in streams], np.int64)
    begins = 8 * (np.concatenate(([0], np.cumsum(sizes + 3)))[:-1])
    ends, at = begins + 8 * sizes, begins.copy()
    live, reach = np.flatnonzero(sizes), 4200
    while len(live):
        most = int(min(reach, (ends[live] - at[live]).max() // (code_size + 1) + 1))
        width = _widths(code_size, most)
        start = at[live, None] + (np.cumsum(width) - width)
        inside = start + width <= ends[live, None]
        byte = np.where(inside, start, 0) >> 3
        code = ((flat[byte] | flat[byte + 1] << 8 | flat[byte + 2] << 16) >> (start & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        code = code.astype(np.int32)
        k = np.arange(most, dtype=np.int32)
        known = np.minimum(k - 1, 4095 - base)
        stop = ~inside | (code == clear) | (code == clear + 1) | (code - base > known)
        cut = np.where(stop.any(axis=1), stop.argmax(axis=1), most)
        if (cut == most).any() and most == reach and (start[cut == most, -1] < ends[live][cut == most] - 12).any():
            reach *= 2
            continue
        n = int(cut.max())
        if n:
            for i, x in zip(live, _strings(code[:, :n], cut, base), strict=True):
                if len(x):
                    done[i].append(x)
        row = np.arange(len(live))
        stopped = np.minimum(cut, most - 1)
        on = (cut < most) & inside[row, stopped] & (code[row, stopped] == clear)
        at[live] = start[row, stopped] + width[stopped]
        live = live[on]
    return [np.concatenate(x) if x else np.zeros(0, np.uint8) for x in done]


def _strings(code: np.ndarray, count: np.ndarray, base: int) -> list[np.ndarray]:
    """What each row of codes (count of them, all valid, no clear) stands for."""
    s, n = code.shape
    used = np.arange(n) < count[:, None]
    parent = np.where(used & (code >= base), code - base, -1)
    # Lengths: hops to a literal, by doubling.
    length = np.where(used, 1, 0)
    flat_parent = np.where(parent >= 0, parent + np.arange(s)[:, None] * n, -1).ravel()
    hops, jump = (flat_parent >= 0).astype(np.int64), flat_parent.copy()
    while True:
        go = np.flatnonzero(jump >= 0)
        if not len(go):
            break
        hops[go] += hops[jump[go]]
        jump[go] = jump[jump[go]]
    length = (length.ravel() + hops) * used.ravel()
    first = np.cumsum(length) - length
    total = int(length.sum())
    which = np.repeat(np.arange(s * n), length)
    source = np.arange(total)
    copied = np.flatnonzero(flat_parent[which] >= 0)
    of = which[copied]
    source[copied] = first[flat_parent[of]] + (copied - first[of])
    while True:
        then = source[source]
        if np.array_equal(then, source):
            break
        source = then
    out = code.ravel()[which].astype(np.uint8)[source]
    per_row = length.reshape(s, n).sum(axis=1)
    return np.split(out, np.cumsum(per_row)[:-1])


def decode(raws: list[bytes | None]) -> list[Gif]:
    """Files with the samples of each image; streams of one code size are decoded together."""
    gifs = [parse(r) if r is not None else Gif(0, 0, error="null") for r in raws]
    by_size: dict[int, list[Image]] = {}
    for g in gifs:
        for image in g.images:
            by_size.setdefault(image.code_size, []).append(image)
    for code_size, images in by_size.items():
        start = 0
        while start < len(images):
            stop, pixels = start, 0
            while stop < len(images) and (stop == start or pixels < 150_000):
                pixels += images[stop].width * images[stop].height
                stop += 1
            for image, x in zip(images[start:stop], lzw_decode([i.data for i in images[start:stop]], code_size), strict=True):
                image.indices = x
            start = stop
    return gifs


def _rows(height: int) -> np.ndarray:
    """Row numbers in the order in which an interlaced image stores them."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    disposal: int
    rgb: np.ndarray


def frames(gif: Gif) -> Iterator[Frame]:
    """The screen as shown with each image: transparent samples leave it, then the image's disposal applies.

    Disposal 2 clears the image's area to black, 3 brings back what was there before; others leave the image. Missing
    samples count as index 0, indices beyond the palette as its last colour, and parts beyond the screen are cut off.
    """
    screen, clock = None, 0
    for image in gif.images:
        n = image.width * image.height
        index = image.indices
        if len(index) < n:
            gif.error = gif.error or "short image"
            index = np.concatenate((index, np.zeros(n - len(index), np.uint8)))
        index = index[:n].reshape(image.height, image.width)
        if image.interlaced:
            ordered = np.empty_like(index)
            ordered[_rows(image.height)] = index
            index = ordered
        colours = image.palette[np.minimum(index, len(image.palette) - 1)]
        whole = (image.left, image.top, image.width, image.height) == (0, 0, gif.width, gif.height) and image.transparent < 0
        if whole and image.disposal in (0, 1):
            screen = colours
        else:
            screen = np.zeros((gif.height, gif.width, 3), np.uint8) if screen is None else screen.copy()
            before = screen.copy() if image.disposal == 3 else None
            area = screen[image.top : image.top + image.height, image.left : image.left + image.width]
            h, w = area.shape[:2]
            seen = index[:h, :w] != image.transparent
            area[seen] = colours[:h, :w][seen]
        yield Frame(clock, image.delay_ms, image.disposal, screen)
        clock += image.delay_ms
        if image.disposal == 3 and before is not None:
            screen = before
        elif image.disposal == 2:
            screen = screen.copy()
            screen[image.top : image.top + image.height, image.left : image.left + image.width] = 0


_BIN0 = np.arange(0, 3 * BINS, BINS, dtype=np.uint8)


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of BINS equal ranges of red, then green, then blue."""
    return np.bincount(((rgb.reshape(-1, 3) >> (9 - BINS.bit_length())) + _BIN0).ravel(), minlength=3 * BINS)


# --- columns ---------------------------------------------------------------------------------------------------------


def text_to_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8, null: none), media: the text's bytes, padded, as a GIF. Other columns are not carried."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(encode(raw), pa.binary())], [id_col, "n_bytes", "media"])

    return arrow_map(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", kernel, f"`{id_col}` {id_type}, n_bytes bigint, media binary")


_FRAME_TYPE = "struct<start_ms:bigint,delay_ms:int,disposal:int,width:int,height:int,hist_red:array<int>,hist_green:array<int>,hist_blue:array<int>,rgb:binary>"


def read_gif(media: DataFrame, id_col: str, media_col: str = "media", rgb: bool = True, samples: bool = False) -> DataFrame:
    """media with frames (timed, with colour histograms and, with rgb, pixels), error, and with samples the red bytes of all frames.

    A null media has no frames and the error "null"; a broken one has the frames before the break and an error. Columns of
    media other than its id stay; those named like the new ones are replaced.
    """
    new = ["frames", "error", "samples"]
    base = [c for c in media.columns if c not in new]
    fields = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in base)
    frame_type = _arrow_frame()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_chunks(batch, media_col, 512 << 10):
                all_frames, errors, bytes_ = [], [], []
                for gif in decode(piece.column(media_col).to_pylist()):
                    own, red = [], []
                    for f in frames(gif):
                        h = histogram(f.rgb).tolist()
                        own.append((f.start_ms, f.delay_ms, f.disposal, gif.width, gif.height, h[:BINS], h[BINS : 2 * BINS], h[2 * BINS :], f.rgb.tobytes() if rgb else None))
                        if samples:
                            red.append(f.rgb[:, :, 0].tobytes())
                    all_frames.append([dict(zip(_FRAME_NAMES, x, strict=True)) for x in own])
                    errors.append(gif.error or None)
                    bytes_.append(b"".join(red) if samples else None)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in base), pa.array(all_frames, pa.list_(frame_type)), pa.array(errors, pa.string()), pa.array(bytes_, pa.binary())], [*base, *new]
                )

    return media.select(*(F.col(f"`{c}`") for c in base)).mapInArrow(run, f"{fields}, frames array<{_FRAME_TYPE}>, error string, samples binary")


_FRAME_NAMES = ["start_ms", "delay_ms", "disposal", "width", "height", "hist_red", "hist_green", "hist_blue", "rgb"]


def _arrow_frame() -> pa.DataType:
    hist = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), hist, hist, hist, pa.binary()]
    return pa.struct(list(zip(_FRAME_NAMES, kinds, strict=True)))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the stored GIF's digests and what is read back from it.

    Null and empty texts are one frame of padding. feature is the number of frames, their time in ms and the summed histogram.
    """
    read = read_gif(text_to_gif(docs, id_col, text_col), id_col, rgb=False, samples=True)

    def summed(name: str) -> str:
        zero = f"array_repeat(0L, {BINS})"
        return f"array_join(aggregate(frames.{name}, {zero}, (s, h) -> zip_with(s, h, (a, b) -> a + b)), ',')"

    return read.select(
        id_col, "n_bytes", F.octet_length("samples").cast("bigint").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.expr(f"concat_ws('|', size(frames), aggregate(frames.delay_ms, 0L, (s, d) -> s + d), {summed('hist_red')}, {summed('hist_green')}, {summed('hist_blue')})").alias("feature"),
        F.size("frames").alias("n_frames"),
    )
