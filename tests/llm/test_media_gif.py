import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotlens.llm import media_gif as m
from lotlens.llm import queries


@settings(deadline=None, max_examples=40)
@given(st.binary(min_size=1, max_size=3000))
def test_lzw_round_trip(data):
    assert m.lzw_decode(m.lzw_encode(data), 8, len(data)) == data


def test_long_and_flat_streams():
    for data in (os.urandom(40000), b"\0" * 50000, bytes(range(256)) * 100):
        assert m.lzw_decode(m.lzw_encode(data), 8, len(data)) == data


def test_known_small_file():
    # the 10 x 10 sample image of the format's public description: red, blue and white blocks
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c0491 4c01".replace(" ", ""))
    rows = m.lzw_decode(stream, 2, 100)
    assert rows[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and rows[-10:] == bytes([2, 2, 2, 2, 2, 1, 1, 1, 1, 1])


def _gif(frames, size=(2, 1)):
    """frames: (disposal, transparent or None, left, samples); palette black, red, green, blue."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF7, 0, 0)]
    out.append(bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]) + bytes(252 * 3))
    for disposal, clear, left, samples in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", left, 0, len(samples), 1, 0) + b"\x08")
        out.append(m._blocks(m.lzw_encode(bytes(samples))))
    return b"".join(out) + b"\x3b"


def _shown(frame):
    return [tuple(p) for p in frame.canvas[0].tolist()]


def test_disposal_and_transparency():
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    kept = m.decode_gif(_gif([(1, None, 0, [1, 1]), (0, 0, 0, [0, 2])]))
    assert _shown(kept[1]) == [red, green]
    cleared = m.decode_gif(_gif([(2, None, 0, [1, 1]), (0, 0, 0, [0, 2])]))
    assert _shown(cleared[1]) == [none, green]
    restored = m.decode_gif(_gif([(1, None, 0, [1, 1]), (3, None, 1, [3]), (0, 0, 0, [2, 0])]))
    assert _shown(restored[1]) == [red, blue] and _shown(restored[2]) == [green, red]
    assert m.colour_histogram(kept[1].canvas).sum() == 2 and kept[0].delay_ms == 50


def test_broken_files():
    good = m.encode_gif(bytes(64))
    for data in (b"", b"GIF89a", good[:-20], b"PNG" + good):
        with pytest.raises(ValueError):
            m.decode_gif(data)


def test_operator_edges(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (2, None, None), (None, "", "y"), (4, "é" * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gif string")
    stored = m.store_text(docs)
    got = {(r.doc_id, r.payload, r.n_bytes, r.frames) for r in m.read_media(stored).collect()}
    long = ("é" * 30000).encode().ljust(60032, b"\0")
    assert got == {
        (1, b"abc".ljust(64, b"\0"), 3, 1),
        (2, bytes(64), 0, 1),
        (None, bytes(64), 0, 1),
        (4, long, 60000, 4),
    }
    assert m.frame_rows(stored).filter("doc_id = 4").count() == 4
    assert m.read_media(m.store_text(docs.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, gif binary")
    assert all(r.error and r.payload is None for r in m.read_media(bad).collect())
    assert m.frame_rows(bad).filter("error is not null").count() == 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op9_media_gif(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        raw = texts[r.doc_id].encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        assert np.isfinite(r.media_bytes)
