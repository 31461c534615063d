"""GIF media columns: code streams, palettes, disposal and transparency, timed frames, colour histograms.

A stored image is a whole GIF file. Reading parses its blocks, decodes the
LZW code streams of many frames in step, applies each frame's palette and
composes it on the canvas by the transparency and disposal rules. LZW copies
always repeat earlier output, so a code becomes a pointer into the frame and
pointers are resolved by jumping, for all frames at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents
from tidelog.llm.textarrays import chunks, encoded

SIDE, BINS = 24, 8
PIXELS = SIDE * SIDE
DELAY = 4  # hundredths of a second
#: Frames that are coded, and pixels that are decoded, at once.
FRAMES_AT_ONCE, PIXELS_AT_ONCE = 4096, 1 << 21
#: A file may show this many pixels in all its frames, and so many more for each of its bytes; one that states more is reported as failed, unread.
MOST_PIXELS, MOST_PER_BYTE = 1 << 24, 64
_GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int
    min_bits: int
    data: bytes
    indices: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    background: np.ndarray
    frames: list[Frame] = field(default_factory=list)


def lzw_codes(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each row of 8-bit pixels, after the clear code and before the end code: (codes, how many of a row).

    Rows advance together, one pixel a step; each has its part of one hash
    table of (prefix, byte). Rows of 3,838 pixels at most never fill the code space.
    """
    rows, width = pixels.shape
    size = 1 << max(8, int(np.ceil(np.log2(width * 3))))
    shift = np.uint32(32 - int(np.log2(size)))
    key_at, value_at = np.zeros(rows * size, np.int32), np.zeros(rows * size, np.int16)
    codes, used = np.zeros((rows, width), np.int16), np.zeros(rows, np.int64)
    base = np.arange(rows, dtype=np.int64) * size
    columns = np.ascontiguousarray(pixels.T).astype(np.int32)
    prefix = columns[0].copy()
    for c in columns[1:]:
        key = (prefix << 8) + c + 1
        slot = ((key.astype(np.uint32) * np.uint32(2654435769)) >> shift).astype(np.int64) + base
        there = key_at[slot]
        todo = np.flatnonzero((there != key) & (there != 0))
        while len(todo):
            slot[todo] = base[todo] + ((slot[todo] - base[todo] + 1) & (size - 1))
            there[todo] = key_at[slot[todo]]
            todo = todo[(there[todo] != key[todo]) & (there[todo] != 0)]
        new = np.flatnonzero(there == 0)
        codes[new, used[new]] = prefix[new]
        key_at[slot[new]] = key[new]
        prefix = value_at[slot].astype(np.int32)
        value_at[slot[new]] = 258 + used[new]
        used[new] += 1
        prefix[new] = c[new]
    codes[np.arange(rows), used] = prefix
    return codes, used + 1


def lzw_bytes(codes: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed code streams with clear and end codes: (bytes of all rows, offsets)."""
    rows, width = codes.shape
    stream = np.full((rows, width + 2), 257, np.int64)
    stream[:, 0] = 256
    inside = np.arange(width)[None, :] < used[:, None]
    stream[:, 1:-1][inside] = codes[inside]
    known = 258 + np.maximum(np.arange(width + 2) - 2, 0)  # codes that a reader knows before each one
    bits = np.maximum(9, np.minimum(12, np.floor(np.log2(known)).astype(np.int64) + 1))
    at = np.concatenate(([0], np.cumsum(bits)))
    total = (at[used + 2] + 7) // 8
    offsets = np.concatenate(([0], np.cumsum(total)))
    keep = np.arange(width + 2)[None, :] < (used + 2)[:, None]
    place = (offsets[:-1, None] * 8 + at[None, :-1])[keep]
    value = stream[keep] << (place & 7)
    out = np.zeros(offsets[-1] + 3, np.int64)
    for k in range(3):
        out += np.bincount((place >> 3) + k, (value >> (8 * k)) & 255, len(out)).astype(np.int64)
    return out.astype(np.uint8), offsets


def write_gifs(payloads: list[bytes]) -> list[bytes]:
    """A GIF of grey 24 x 24 frames for each payload, whose length is a positive multiple of 576."""
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, PIXELS)
    coded = [lzw_bytes(*lzw_codes(pixels[i : i + FRAMES_AT_ONCE])) for i in range(0, len(pixels), FRAMES_AT_ONCE)]
    raw = b"".join(data.tobytes() for data, _ in coded)
    offsets = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for _, o in coded])))) if coded else np.zeros(1, int)
    head = b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _GREY + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"
    begin = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY, 0) + b"\x00\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    out, f = [], 0
    for p in payloads:
        parts = [head]
        for _ in range(len(p) // PIXELS):
            s, e = int(offsets[f]), int(offsets[f + 1])
            parts.append(begin)
            for i in range(s, e, 255):
                block = raw[i : min(i + 255, e)]
                parts += [bytes((len(block),)), block]
            parts.append(b"\x00")
            f += 1
        out.append(b"".join([*parts, b"\x3b"]))
    return out


def _blocks(b: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := b[at]:
        parts.append(b[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def parse(b: bytes) -> Image:
    """The blocks of a GIF file; ValueError if it is none or breaks off."""
    try:
        if b[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        width, height, flags, back, _ = struct.unpack_from("<HHBBB", b, 6)
        at, table = 13, np.zeros((0, 3), np.uint8)
        if flags & 0x80:
            n = 2 << (flags & 7)
            table = np.frombuffer(b, np.uint8, 3 * n, at).reshape(-1, 3)
            at += 3 * n
        image = Image(width, height, table[back] if back < len(table) else np.zeros(3, np.uint8))
        control, shown = (0, 0, -1), 0
        while b[at] != 0x3B:
            if b[at] == 0x21:
                if b[at + 1] == 0xF9:
                    packed, delay, clear = struct.unpack_from("<BHB", b, at + 3)
                    control = (packed >> 2 & 7, delay * 10, clear if packed & 1 else -1)
                _, at = _blocks(b, at + 2)
            elif b[at] == 0x2C:
                left, top, w, h, packed = struct.unpack_from("<HHHHB", b, at + 1)
                at, palette = at + 10, table
                if packed & 0x80:
                    n = 2 << (packed & 7)
                    palette = np.frombuffer(b, np.uint8, 3 * n, at).reshape(-1, 3)
                    at += 3 * n
                bits = b[at]
                data, at = _blocks(b, at + 1)
                if not 1 <= bits <= 8:
                    raise ValueError(f"codes of {bits} bits")
                codes = 8 * len(data) // (bits + 1)  # each at most one pixel longer than the one before, and than what the code space holds
                if w * h > codes * min(codes, 4096):
                    raise ValueError(f"{w} x {h} pixels from {len(data)} bytes")
                shown += width * height
                if max(shown, w * h) > MOST_PIXELS + MOST_PER_BYTE * len(b):
                    raise ValueError(f"states over {shown} pixels in {len(b)} bytes")
                image.frames.append(Frame(left, top, w, h, bool(packed & 0x40), palette, control[1], control[0], control[2], bits, data))
                control = (0, 0, -1)
            else:
                raise ValueError("unknown block")
        return image
    except (IndexError, struct.error) as e:
        raise ValueError("GIF breaks off") from e


def lzw_decode(frames: list[Frame]) -> None:
    """Fill in the indices of frames. Streams advance together, one code a step."""
    n = len(frames)
    if not n:
        return
    sizes = np.array([len(f.data) for f in frames])
    begin = np.concatenate(([0], np.cumsum(sizes + 4)))[:-1]
    raw = np.frombuffer(b"".join(f.data + b"\0\0\0\0" for f in frames), np.uint8).astype(np.int32)
    word = raw.copy()
    word[:-1] |= raw[1:] << 8
    word[:-2] |= raw[2:] << 16
    clear = np.array([1 << f.min_bits for f in frames])
    want = np.array([f.width * f.height for f in frames])
    place = np.concatenate(([0], np.cumsum(want)))
    codes = min(4096, int(clear.max()) + 3 + int((sizes * 8 // np.array([f.min_bits + 1 for f in frames])).max()))
    source, length = np.zeros((n, codes), np.int32), np.zeros((n, codes), np.int32)
    bit, limit = begin * 8, (begin + sizes) * 8
    bits = np.array([f.min_bits + 1 for f in frames])
    known, out, last_at, last_n = clear + 2, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pointer, value = np.arange(place[-1]), np.zeros(place[-1], np.uint8)
    live, copies = np.arange(n), []
    while len(live):
        b = bit[live]
        code = (word[np.minimum(b >> 3, len(word) - 1)] >> (b & 7)) & ((1 << bits[live]) - 1)
        bit[live] = b + bits[live]
        reset = code == clear[live]
        if reset.any():
            r = live[reset]
            bits[r], known[r], last_n[r] = np.log2(clear[r]).astype(np.int64) + 1, clear[r] + 2, 0
        data = ~reset & (code != clear[live] + 1) & (bit[live] <= limit[live]) & (out[live] < want[live])
        a, k = live[data], code[data]
        first = last_n[a] == 0
        if (bad := (k > known[a]) | (first & (k >= clear[a]))).any() or (k == clear[a] + 1).any():
            raise ValueError(f"broken code stream: {int(bad.sum())}")
        literal, again = k < clear[a], k == known[a]
        src = np.where(again, last_at[a], source[a, np.minimum(k, codes - 1)])
        size = np.where(literal, 1, np.where(again, last_n[a] + 1, length[a, np.minimum(k, codes - 1)]))
        grow = ~first & (known[a] < codes)
        g = a[grow]
        source[g, known[g]], length[g, known[g]] = last_at[g], last_n[g] + 1
        known[g] += 1
        bits[g] = np.minimum(12, bits[g] + (known[g] == 1 << bits[g]))
        to = place[a] + out[a]
        value[to[literal]] = k[literal]
        copy = ~literal
        copies.append((to[copy], (place[a] + src)[copy], np.minimum(size, want[a] - out[a])[copy]))
        last_at[a], last_n[a] = out[a], size
        out[a] += size
        live = live[reset | data]
    if (out < want).any():
        raise ValueError("code stream ends too early")
    to, src, size = (np.concatenate(c) for c in zip(*copies))
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    pointer[np.repeat(to, size) + step] = np.repeat(src, size) + step
    while len(moved := np.flatnonzero((hop := pointer[pointer]) != pointer)):
        pointer[moved] = hop[moved]
    flat = value[pointer]
    for f, s, e in zip(frames, place, place[1:]):
        f.indices = flat[s:e]
        if e > s and int(f.indices.max()) >= len(f.palette):
            raise ValueError("a colour beyond the palette")


def decode_all(frames: list[Frame]) -> None:
    """lzw_decode for any number of frames, so many pixels and frames at a time."""
    start = held = 0
    for i, f in enumerate(frames):
        if i > start and (held + f.width * f.height > PIXELS_AT_ONCE or i - start == FRAMES_AT_ONCE):
            lzw_decode(frames[start:i])
            start, held = i, 0
        held += f.width * f.height
    lzw_decode(frames[start:])


def compose(image: Image) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGB) at each frame, under transparency and the previous frame's disposal."""
    canvas = None
    for f in image.frames:
        whole = (f.left, f.top, f.width, f.height) == (0, 0, image.width, image.height)
        pixels = f.palette[f.indices].reshape(f.height, f.width, 3)
        shown = f.indices.reshape(f.height, f.width) != f.transparent
        if f.interlaced:
            rows = np.concatenate([np.arange(s, f.height, k) for s, k in ((0, 8), (4, 8), (2, 4), (1, 2))])
            back = np.argsort(rows)
            pixels, shown = pixels[back], shown[back]
        if whole and f.transparent < 0 and f.disposal < 2:
            canvas = pixels
            yield canvas
            continue
        if canvas is None:
            canvas = np.broadcast_to(image.background, (image.height, image.width, 3))
        before, canvas = canvas, canvas.copy()
        box = (slice(f.top, f.top + f.height), slice(f.left, f.left + f.width))
        part = canvas[box]
        part[...] = np.where(shown[: part.shape[0], : part.shape[1], None], pixels[: part.shape[0], : part.shape[1]], part)
        yield canvas
        if f.disposal == 3:
            canvas = before
        elif f.disposal == 2:
            canvas = canvas.copy()
            canvas[box] = image.background


def padded(text: bytes) -> bytes:
    """A text's bytes with 255s up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % PIXELS if text else PIXELS)


def stored(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, n_bytes, media): kept columns, and each whole text (null: empty) stored as a GIF's samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts = encoded(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(t) for t in texts], pa.int64()), pa.array(write_gifs([padded(t) for t in texts]), pa.binary())], ["row", "n_bytes", "media"])

    x = df.select(F.struct(*[F.col(f"`{k}`") for k in (df.columns if keep is None else keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, n_bytes long, media binary")


FRAMES = "array<struct<at_ms: long, delay_ms: int, reds: array<int>, greens: array<int>, blues: array<int>>>"


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """df's columns with samples, frames and failed for each GIF in media.

    samples: red samples of the composed frames, one after the other; frames:
    their times and colour histograms of 8 bins a channel; failed: why a file
    could not be read, with no samples and frames: it breaks off, breaks the
    rules of its codes or palette, or states more pixels than MOST_PIXELS and
    MOST_PER_BYTE for each of its bytes. A null file has nulls.
    Rows are read one by one, so repeated rows and an empty table are fine.
    df must not have the new columns.
    """
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in chunks(iter([b]), media, PIXELS_AT_ONCE):
                yield from _read(part, media)

    return df.mapInArrow(run, f"{schema}, samples binary, frames {FRAMES}, failed string")


def _read(part: pa.RecordBatch, media: str) -> Iterator[pa.RecordBatch]:
    """The files of a batch, so many stated pixels at a time."""
    images: list[Image | None] = []
    failed: list[str | None] = []
    start = held = 0
    for i, s in enumerate(part.column(media)):
        try:
            images.append(parse(s.as_py()) if s.is_valid else None)
            failed.append(None)
        except ValueError as e:
            images.append(None)
            failed.append(str(e))
        m = images[-1]
        n = sum(f.width * f.height + m.width * m.height for f in m.frames) if m else 0
        if held and held + n > 4 * PIXELS_AT_ONCE:
            yield _decoded(part.slice(start, i - start), images[start:i], failed[start:i])
            images[start:i] = [None] * (i - start)
            start, held = i, 0
        held += n
    yield _decoded(part.slice(start), images[start:], failed[start:])


def _decoded(part: pa.RecordBatch, images: list[Image | None], failed: list[str | None]) -> pa.RecordBatch:
    try:
        decode_all([f for m in images if m for f in m.frames])
    except ValueError:  # find the files that are at fault
        for k, m in enumerate(images):
            try:
                decode_all(m.frames if m else [])
            except ValueError as e:
                images[k], failed[k] = None, str(e)
    counts, delays, at, bars, samples = [], [], [], [[], [], []], [[] for _ in images]
    held: list[tuple[int, np.ndarray]] = []

    def count() -> None:
        """Histograms and samples of the canvases held."""
        flat = np.concatenate([c.reshape(-1, 3) for _, c in held]) if held else np.zeros((0, 3), np.uint8)
        sizes = [c.shape[0] * c.shape[1] for _, c in held]
        of = np.repeat(np.arange(len(held)), sizes) * BINS
        for c in range(3):
            bars[c].append(np.bincount(of + (flat[:, c] >> 5), minlength=len(held) * BINS).astype(np.int32))
        red, ends = np.ascontiguousarray(flat[:, 0]), np.concatenate(([0], np.cumsum(sizes))).astype(int)
        for (k, _), s, e in zip(held, ends, ends[1:]):
            samples[k].append(red[s:e].tobytes())
        held.clear()

    for k, m in enumerate(images):
        n = pixels = 0
        for n, canvas in enumerate(compose(m) if m else [], 1):
            held.append((k, canvas))
            pixels += canvas.shape[0] * canvas.shape[1]
            if pixels > PIXELS_AT_ONCE:
                count()
                pixels = 0
        counts.append(n)
        delays += [f.delay_ms for f in m.frames] if m else []
        at += np.concatenate(([0], np.cumsum([f.delay_ms for f in m.frames])[:-1])).astype(int).tolist() if n else []
    count()
    total = sum(counts)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * BINS, pa.int32()), pa.array(np.concatenate(x))) for x in bars]
    each = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(delays, pa.int32()), *lists], ["at_ms", "delay_ms", "reds", "greens", "blues"])
    column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), each, mask=pa.array([m is None for m in images]))
    told = pa.array([b"".join(p) if m else None for m, p in zip(images, samples)], pa.binary())
    return pa.RecordBatch.from_arrays([*part.columns, told, column, pa.array(failed, pa.string())], [*part.schema.names, "samples", "frames", "failed"])


def frame_table(df: DataFrame) -> DataFrame:
    """One row a frame from read(): df's columns but media, samples and frames, with frame and the frame's fields."""
    rest = [c for c in df.columns if c not in ("media", "samples", "frames", "failed")]
    return df.select(*rest, F.posexplode("frames").alias("frame", "f")).select(*rest, "frame", "f.*")


def op6_gif_media(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document stored as a GIF and read back."""
    x = read(stored(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]))
    red = ", ".join(f"aggregate(frames, 0L, (n, f) -> n + f.reds[{i}])" for i in range(BINS))
    return x.selectExpr(
        "row.doc_id AS doc_id", "n_bytes", "CAST(octet_length(samples) AS BIGINT) AS payload_bytes", "sha2(samples, 256) AS payload_sha256",
        "crc32(substring(samples, -32, 32)) AS tail_crc32", "CAST(octet_length(media) AS BIGINT) AS media_bytes", "sha2(media, 256) AS media_sha256",
        f"concat_ws(' ', concat('frames=', size(frames)), concat('ms=', aggregate(frames, 0L, (n, f) -> n + f.delay_ms)), concat('grey=', concat_ws(',', {red}))) AS feature",
    )
