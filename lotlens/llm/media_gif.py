"""GIF media columns: store bytes as 8-bit samples in timed frames, decode frames, colour histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WIDTH = 64
FRAME_ROWS = 256
DELAY_CS = 10
_MOST_CODES = 4096


def _widths(code_bits: int, count: int) -> np.ndarray:
    """Bits of the j-th code after a clear code: the table has grown by one entry per code since."""
    end = (1 << code_bits) + 1
    sizes = np.maximum(np.floor(np.log2(end + np.arange(count))).astype(np.int64) + 1, code_bits + 1)
    return np.minimum(sizes, 12)


_W8 = _widths(8, _MOST_CODES)


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples; the table is cleared when it is full."""
    codes, runs, table, free = [256], [1], {}, 258
    current, rest = samples[0], memoryview(samples)[1:]
    get, put = table.get, codes.append
    for sample in rest:
        key = current << 8 | sample
        code = get(key)
        if code is not None:
            current = code
            continue
        put(current)
        if free < _MOST_CODES:
            table[key] = free
            free += 1
        else:
            put(256)
            runs.append(len(codes))
            table.clear()
            free = 258
        current = sample
    put(current)
    put(257)
    values = np.array(codes, np.int64)
    widths = np.empty(len(codes), np.int64)
    widths[0] = 9
    for start, stop in zip(runs, [*runs[1:], len(codes)]):
        widths[start:stop] = _W8[: stop - start]
    places = np.arange(12)
    bits = (values[:, None] >> places & 1)[places < widths[:, None]]
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, code_bits: int, most: int) -> bytes:
    """Samples of a code stream, at most ``most``.  Raises ValueError if it is broken."""
    clear, end = 1 << code_bits, (1 << code_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    limit, at = len(stream) * 8, 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made = 0
    steps = _W8 if code_bits == 8 else _widths(code_bits, _MOST_CODES)
    ends = np.cumsum(steps)
    fixed = False  # the table is full and no clear code has come: codes stay at 12 bits
    table, previous = list(roots), b""
    while made < most:
        if fixed:
            widths = np.full(_MOST_CODES, 12, np.int64)
            stops = np.cumsum(widths)
        else:
            widths, stops = steps, ends
        fit = int(np.searchsorted(stops, limit - at, side="right"))
        if fit == 0:
            break
        widths, starts = widths[:fit], at + stops[:fit] - widths[:fit]
        byte = starts >> 3
        values = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7) & ((1 << widths) - 1)
        marks = np.nonzero((values == clear) | (values == end))[0]
        stop = int(marks[0]) if len(marks) else fit
        for code in values[:stop].tolist():
            size = len(table)
            if code < size:
                entry = table[code]
                if previous and size < _MOST_CODES:
                    table.append(previous + entry[:1])
            elif code == size and previous and size < _MOST_CODES:
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError("a code beyond the table")
            out.append(entry)
            previous = entry
            made += len(entry)
        if len(marks):
            at = int(starts[stop] + widths[stop])
            if values[stop] == end:
                break
            table, previous, fixed = list(roots), b"", False
        else:
            at, fixed = int(starts[-1] + widths[-1]), True
    found = b"".join(out)[:most]
    if len(found) < most:
        raise ValueError("the code stream ends early")
    return found


def _blocks(data: bytes) -> bytes:
    parts = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes([len(p)]) + p for p in parts) + b"\0"


_GREY = bytes(v for i in range(256) for v in (i, i, i))


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """``payload``, a positive multiple of ``width`` bytes, as grey samples in timed frames.

    Every frame is cleared to the background before the next one.
    """
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, frame_rows):
        part = payload[top * width : (top + frame_rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay_cs, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """One image of a GIF: its own palette indices and the composed canvas (RGBA) as shown."""

    left: int
    top: int
    indices: np.ndarray
    canvas: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> list[Frame]:
    """The frames of a GIF file, composed by the disposal and transparency rules."""
    try:
        return list(_frames(data))
    except (IndexError, struct.error) as broken:
        raise ValueError("the file ends early") from broken


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        common = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)
        at += size
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            _, at = _sub_blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            size = 3 << (flags & 7) + 1
            palette = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)
            at += size
        if palette is None:
            raise ValueError("no palette")
        code_bits = data[at]
        if not 2 <= code_bits <= 8:
            raise ValueError("a code size out of range")
        stream, at = _sub_blocks(data, at + 1)
        indices = np.frombuffer(lzw_decode(stream, code_bits, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:  # interlaced: four passes
            order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, h, step)]
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        if indices.size and indices.max() >= len(palette):
            raise ValueError("an index beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        shown = canvas[top : top + h, left : left + w]
        seen = indices[: shown.shape[0], : shown.shape[1]]
        if transparent is None:
            shown[..., :3], shown[..., 3] = palette[seen], 255
        else:
            drawn = seen != transparent
            shown[drawn] = np.concatenate([palette[seen[drawn]], np.full((drawn.sum(), 1), 255, np.uint8)], 1)
        yield Frame(left, top, indices, canvas.copy(), delay * 10, disposal, transparent)
        if disposal == 2:
            shown[:] = 0
        elif before is not None:
            canvas = before
        disposal, delay, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the canvas' opaque pixels over 64 bins: two bits each of red, green and blue."""
    pixels = canvas.view(np.uint32).ravel()  # little-endian: red is the low byte
    pixels = pixels[pixels >> 24 != 0]
    bins = (pixels >> 2 & 0x30) | (pixels >> 12 & 0x0C) | (pixels >> 22 & 0x03)
    return np.bincount(bins, minlength=64)


def store_text(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a ``gif`` column.

    A null text is empty: one row of zeros.  Texts of any length take as many frames as they need;
    equal texts give equal files; an empty table gives no rows; other columns are ignored.
    Returns doc_id, n_bytes (unpadded), gif.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("_text").to_pylist()]
            padded = [r.ljust(max(WIDTH, -(-len(r) // WIDTH) * WIDTH), b"\0") for r in raw]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array([len(r) for r in raw], pa.int64()),
                    "gif": pa.array([encode_gif(p) for p in padded], pa.binary()),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, gif binary")


_READ = pa.schema(
    [
        ("payload", pa.binary()),
        ("frames", pa.int32()),
        ("duration_ms", pa.int64()),
        ("histogram", pa.list_(pa.int64())),
        ("error", pa.string()),
    ]
)


def read_media(rows: DataFrame) -> DataFrame:
    """``rows`` with the samples and features of their ``gif`` column.

    payload: palette indices of all frames in order; histogram: colour_histogram summed over the
    composed frames; a null or broken file has nulls and an ``error``.
    """
    small_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name not in _READ.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column("gif").to_pylist():
                try:
                    frames = decode_gif(data or b"")
                    bins = sum((colour_histogram(f.canvas) for f in frames), np.zeros(64, np.int64))
                    found.append(
                        {
                            "payload": b"".join(f.indices.tobytes() for f in frames),
                            "frames": len(frames),
                            "duration_ms": sum(f.delay_ms for f in frames),
                            "histogram": bins,
                            "error": None,
                        }
                    )
                except ValueError as broken:
                    found.append(dict.fromkeys(_READ.names) | {"error": str(broken)})
            made = pa.RecordBatch.from_pylist(found, _READ)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *made.columns], names=[*names, *_READ.names]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*names).mapInArrow(
        run, schema + ", payload binary, frames int, duration_ms long, histogram array<long>, error string"
    )


def frame_rows(rows: DataFrame) -> DataFrame:
    """One row per frame of each ``gif``: doc_id, frame, place, timing, disposal and its histogram.

    A broken file gives one row with its ``error`` and no frame.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "frame int, left int, top int, width int, height int, delay_ms int, disposal int, transparent int, histogram array<long>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 8 + [pa.list_(pa.int64()), pa.string()]
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            ids, out = [], []
            for i, data in enumerate(batch.column("gif").to_pylist()):
                try:
                    for n, f in enumerate(decode_gif(data or b"")):
                        h, w = f.indices.shape
                        place = (n, f.left, f.top, w, h, f.delay_ms, f.disposal, f.transparent)
                        out.append((*place, colour_histogram(f.canvas).tolist(), None))
                        ids.append(i)
                except ValueError as broken:
                    out.append((*[None] * 9, str(broken)))
                    ids.append(i)
            columns = list(zip(*out)) or [()] * 10
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids, pa.int64())), *arrays], names=["doc_id", *names]
            )

    return rows.select("doc_id", "gif").mapInArrow(run, f"doc_id {kind}, {fields}")
