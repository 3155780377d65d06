"""Animated GIF as a media column: LZW code streams, palettes, disposal, transparency, timed frames.

``store_texts`` keeps each text's UTF-8 bytes as 8-bit palette indices of a GIF; ``read_media`` decodes any GIF
column into timed frames, each with the indices of its own rectangle and a colour histogram of the canvas as
shown, and joins the indices of all frames to the payload.

Defined cases: a null text is stored like an empty one (64 zero bytes); a null or broken file gives the frames
before the fault and the fault in ``error``; a canvas of any size takes the memory of what its frames cover, and a frame or
frames that cover more than ``MAX_PIXELS`` are such a fault; repeated rows are handled alike, null ids carried along; columns other than those named are ignored; empty tables give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm import textnum
from wayfind.llm.common import column

WIDTH, ROWS = 64, 512
DELAY_CS = 10
BINS = 64
#: 3 bits of red, 3 of green, 2 of blue.
PALETTE = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3) for i in range(256)], np.uint8)
OUT_BYTES = 4 << 20
#: Pixels that the frames of a file cover at most, so that a small file cannot claim gigabytes.
MAX_PIXELS = 1 << 24

_HEAD = struct.Struct("<6sHHBBB")
_IMAGE = struct.Struct("<BHHHHB")


# ---- LZW ----


def _widths(least: int, n: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, for a least code size."""
    known = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(np.frexp(known.astype(float))[1], 12)


_MOST = 4096


def lzw_codes(samples: bytes, least: int = 8) -> list[int]:
    clear, end = 1 << least, (1 << least) + 1
    if not samples:
        return [clear, end]
    # codes are kept eight bits to the left, so that a code and the next sample make a key without a shift
    codes, table, free, full = [clear << 8], {}, (end + 1) << 8, _MOST << 8
    add, get = codes.append, table.get
    stream = iter(samples)
    held = next(stream) << 8
    for c in stream:
        key = held | c
        known = get(key)
        if known:
            held = known
            continue
        add(held)
        table[key] = free
        free += 256
        held = c << 8
        if free == full:
            add(clear << 8)
            table.clear()
            free = (end + 1) << 8
    add(held)
    add(end << 8)
    return [c >> 8 for c in codes]


def lzw_pack(codes: list[int], least: int = 8) -> bytes:
    """Codes as a bit stream, least significant bit first; widths follow from the place after the last clear code."""
    c = np.array(codes, np.int64)
    place = np.arange(len(c))
    at = np.flatnonzero(c == 1 << least)
    since = place - np.concatenate(([0], at))[np.searchsorted(at, place, side="left")] - 1
    since[0] = 0
    width = _widths(least, int(since.max()) + 2)[since]
    bit = np.cumsum(width) - width
    spread, byte = c << (bit & 7), bit >> 3
    n = int(bit[-1] + width[-1] + 7 >> 3)
    out = np.zeros(n + 3)
    for k in range(3):
        out += np.bincount(byte + k, weights=spread >> 8 * k & 255, minlength=n + 3)[: n + 3]
    return out[:n].astype(np.uint8).tobytes()


def lzw_unpack(stream: bytes, least: int, wanted: int) -> bytes:
    """Samples of a code stream, at most ``wanted``; a stream that breaks off gives what came before."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits, bit, out = 8 * len(stream), 0, []
    done = 0
    span = _MOST
    while bit < bits and done < wanted:
        width = _widths(least, span)
        at = bit + np.cumsum(width) - width
        n = int(np.searchsorted(at + width, bits, side="right"))
        if not n:
            break
        at, width = at[:n], width[:n]
        byte = at >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & (1 << width) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and n == span:
            span *= 4  # a full table stays in use until the next clear code
            continue
        n = int(stop[0]) if len(stop) else n
        part, whole = _expand(codes[:n].tolist(), clear)
        out.append(part)
        done += len(part)
        if not whole or not len(stop) or codes[n] == end:
            break
        bit, span = int(at[n] + width[n]), _MOST
    return b"".join(out)[:wanted]


_SINGLE = [bytes((i,)) for i in range(256)]


def _expand(codes: list[int], clear: int) -> tuple[bytes, bool]:
    """Samples of the codes between two clear codes, and whether all of them have a meaning. Every code but the
    first adds an entry: what the code before stands for and the first sample of this one."""
    if not codes:
        return b"", True
    if codes[0] >= clear:
        return b"", False
    table = [*_SINGLE[:clear], b"", b""]
    before = table[codes[0]]
    out = [before]
    put, learn = out.append, table.append
    room = _MOST - len(table)
    for code in codes[1 : room + 1]:
        try:
            entry = table[code]
        except IndexError:
            if code > len(table):
                return b"".join(out), False
            entry = before + before[:1]
        put(entry)
        learn(before + entry[:1])
        before = entry
    out += [table[code] for code in codes[room + 1 :]]  # the table is full
    return b"".join(out), True


# ---- files ----


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(x),)) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Samples as frames of at most width x rows; the payload's length is a multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill whole rows")
    height = min(rows, len(payload) // width)
    out = [_HEAD.pack(b"GIF89a", width, height, 0xF7, 0, 0), PALETTE.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for i in range(0, len(payload), width * rows):
        part = payload[i : i + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(_IMAGE.pack(0x2C, 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_blocks(lzw_pack(lzw_codes(part))))
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        if at + 1 + n > len(data):
            raise ValueError("the file ends in a block")
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def _deinterlaced(pixels: np.ndarray) -> np.ndarray:
    h = len(pixels)
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
    out = np.empty_like(pixels)
    out[order] = pixels
    return out


def _grown(x0: int, y0: int, canvas: np.ndarray, left: int, top: int, width: int, height: int) -> tuple[int, int, np.ndarray]:
    """The covered part of a canvas with this box in it: its corner and pixels."""
    if not canvas.size:
        x0, y0 = left, top
    h, w = canvas.shape
    a, b, c, d = min(x0, left), min(y0, top), max(x0 + w, left + width), max(y0 + h, top + height)
    if (c - a, d - b) == (w, h):
        return x0, y0, canvas
    if (c - a) * (d - b) > MAX_PIXELS:
        raise ValueError(f"frames that cover {c - a} x {d - b} are too large")
    out = np.full((d - b, c - a), -1, np.int32)
    out[y0 - b : y0 - b + h, x0 - a : x0 - a + w] = canvas
    return a, b, out


def decode(data: bytes | None) -> tuple[list[dict], str | None]:
    """Timed frames in file order, and the fault that ended the reading, if any."""
    frames: list[dict] = []
    try:
        if not data or data[:6] not in (b"GIF87a", b"GIF89a"):
            return frames, "no GIF header"
        _, w, h, flags, _, _ = _HEAD.unpack_from(data)
        at = _HEAD.size
        shared = None
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            shared, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
        # packed colours of the part of the canvas that frames have covered so far; -1 shows through
        x0 = y0 = 0
        canvas = np.full((0, 0), -1, np.int32)
        control = (0, 0, -1)
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                block, at = _sub_blocks(data, at + 2)
                if label == 0xF9 and len(block) >= 4:
                    flags, delay, clear = struct.unpack_from("<BHB", block)
                    control = (flags >> 2 & 7, delay, clear if flags & 1 else -1)
                continue
            if data[at] != 0x2C:
                raise ValueError(f"unknown block {data[at]}")
            _, left, top, fw, fh, flags = _IMAGE.unpack_from(data, at)
            at += _IMAGE.size
            palette = shared
            if flags & 0x80:
                n = 3 << (flags & 7) + 1
                palette, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
            least = data[at]
            if not 2 <= least <= 8 or palette is None or left + fw > w or top + fh > h:
                raise ValueError("a frame cannot be drawn")
            if fw * fh > MAX_PIXELS:
                raise ValueError(f"a frame of {fw} x {fh} is too large")
            stream, at = _sub_blocks(data, at + 1)
            samples = lzw_unpack(stream, least, fw * fh)
            if len(samples) < fw * fh:
                raise ValueError("a frame breaks off")
            pixels = np.frombuffer(samples, np.uint8).reshape(fh, fw)
            if flags & 0x40:
                pixels = _deinterlaced(pixels)
            disposal, delay, clear = control
            control = (0, 0, -1)
            x0, y0, canvas = _grown(x0, y0, canvas, left, top, fw, fh)
            before = canvas.copy() if disposal == 3 else None
            colours = np.zeros(256, np.int32)
            p = palette.astype(np.int32)
            colours[: len(p)] = p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]
            box = canvas[top - y0 : top - y0 + fh, left - x0 : left - x0 + fw]
            if clear >= 0:
                np.copyto(box, colours[pixels], where=pixels != clear)
            else:
                np.copyto(box, colours[pixels])
            shown = canvas[canvas >= 0]
            bins = (shown >> 18 & 48) | (shown >> 12 & 12) | (shown >> 6 & 3)
            frames.append({"frame": len(frames), "x": left, "y": top, "width": fw, "height": fh, "delay_ms": 10 * delay, "disposal": disposal, "transparent": clear, "interlaced": bool(flags & 0x40), "pixels": pixels.tobytes(), "histogram": np.bincount(bins, minlength=BINS)})
            if disposal == 2:
                box[:] = -1
            elif disposal == 3:
                canvas = before
        return frames, None
    except (IndexError, ValueError, struct.error) as fault:
        return frames, str(fault) or type(fault).__name__


# ---- operators ----


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, filled with zeros to a positive multiple of ``width``, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = textnum.view(batch.column(1))
            raw = data.tobytes()
            for i, j in textnum.parts(off, OUT_BYTES):
                media = []
                for k in range(i, j):
                    n = int(off[k + 1] - off[k])
                    media.append(encode(raw[off[k] : off[k + 1]] + bytes(max(width, -(-n // width) * width) - n), width))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = dict(df.dtypes)[id_col]
    return df.select(column(id_col).alias("id"), column(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


FRAME = "struct<frame: int, x: int, y: int, width: int, height: int, delay_ms: int, disposal: int, transparent: int, interlaced: boolean, histogram: array<long>>"
_FRAME = pa.struct([(n, pa.int32()) for n in ("frame", "x", "y", "width", "height", "delay_ms", "disposal", "transparent")] + [("interlaced", pa.bool_()), ("histogram", pa.list_(pa.int64()))])


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows with payload (the indices of all frames in one piece), frames and error; columns of these names are replaced."""
    df = df.select(*(column(c) for c in df.columns if c not in ("payload", "frames", "error")))
    names = [*df.columns, "payload", "frames", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textnum.slices(batches, names.index(media_col), OUT_BYTES):
            found = [decode(x) for x in part.column(names.index(media_col)).to_pylist()]
            frames = [[{k: v for k, v in f.items() if k != "pixels"} for f in x] for x, _ in found]
            payload = [b"".join(f["pixels"] for f in x) for x, _ in found]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(frames, pa.list_(_FRAME)), pa.array([x for _, x in found], pa.string())], names=names)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, payload binary, frames array<{FRAME}>, error string")


def frames_table(read: DataFrame) -> DataFrame:
    """One row per timed frame, with the moment it appears and a column for each colour bin's count."""
    shown = read.select("id", F.expr("posexplode(frames)").alias("pos", "f"), F.col("frames.delay_ms").alias("delays"))
    start = F.aggregate(F.slice("delays", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda a, x: a + x)
    return shown.select("id", "f.*", start.alias("starts_ms")).select("*", *(F.col("histogram")[k].alias(f"colour_{k:02d}") for k in range(BINS))).drop("histogram")


def digests(docs: DataFrame) -> DataFrame:
    """The stored and re-read texts' digests: one row per document."""
    read = read_media(store_texts(docs))
    colours = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), BINS), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    shown = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), F.size("frames")),
        F.concat(F.lit("ms="), F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"])),
        F.concat(F.lit("colours="), F.array_join(F.transform(colours, lambda x: x.cast("string")), ",")),
    )
    return read.select(F.col("id").alias("doc_id"), "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), shown.alias("feature"), "error")
