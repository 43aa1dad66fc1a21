import hashlib
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import queries, tiff
from strandline.llm.tiff import lzw_decode, lzw_encode, packbits_decode, packbits_encode, payload_of, read, read_pages, round_trip, write


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_codecs(data):
    assert lzw_decode(lzw_encode(data)) == data
    assert packbits_decode(packbits_encode(data)) == data


def test_long_codes():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes() + b"a" * 40_000
    assert lzw_decode(lzw_encode(data)) == data


def test_known_streams():
    assert packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80])) == b"\xaa\xaa\xaa\x80\x00\x2a\xaa\xaa\xaa\xaa"
    assert lzw_decode(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_all_sizes_round_trip():
    for size in (0, 1, 192, 193, 385, 1536, 1537, 12_287, 12_500, 98_304, 98_305, 250_000):
        payload = payload_of("é" * (size // 2) + "x" * (size % 2))
        assert len(payload) % 192 == 0 and len(payload) >= max(size, 192)
        pages = read(write(payload))
        assert b"".join(p["samples"] for p in pages) == payload and len(pages) == -(-len(payload) // (192 * tiff.PAGE_ROWS))


def test_big_endian_colour_strips():
    pixels = bytes(range(24))
    tags = [(256, 3, 4), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 2), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, 24)]
    out = b"MM\0*" + struct.pack(">I", 8 + 24) + pixels + struct.pack(">H", len(tags))
    for tag, kind, v in tags:
        out += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", v, 0) if kind == 3 else struct.pack(">I", v))
    (page,) = read(out + b"\0\0\0\0")
    assert (page["width"], page["height"], page["samples"]) == (4, 2, pixels)


def test_codecs_of_words():
    text = ("the other of the others " * 4000 + "aab" * 900).encode()
    assert lzw_decode(lzw_encode(text)) == text and len(lzw_encode(text)) < len(text) // 4
    assert packbits_decode(packbits_encode(text)) == text


def test_damaged_and_unknown_files(spark):
    good = write(payload_of("page " * 30_000))
    bad = [good[:3], b"PK" + good[2:], good[:200], b"", good[:8] + b"\xff" * (len(good) - 8)]
    odd = bytearray(write(payload_of("y" * 100)))
    at = odd.index(struct.pack("<HHI", 317, 4, 1))
    odd[at + 8 : at + 12] = struct.pack("<I", 3)
    rows = [(k, 0, bytearray(m)) for k, m in enumerate([*bad, odd])] + [(90, 0, bytearray(good)), (90, 0, bytearray(good)), (91, 0, None)]
    out = read_pages(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()
    assert sorted(r.doc_id for r in out if r.error) == list(range(6)) and all(r.page is None for r in out if r.error)
    assert sorted(r.page for r in out if r.doc_id == 90) == [0, 0, 1, 1] and not [r for r in out if r.doc_id == 91]


def test_query_over_the_whole_table(spark, small):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op6_tiff(spark, small).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)
    for r in out:
        payload = payload_of(rows[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(rows[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        media = write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_query_over_edges(spark):
    texts = [None, "", "a", "é" * 96, "text " * 20_000, "b" * 400, "b" * 400, "line\n" * 700]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", "x")] + [(4, texts[4], "x")] * 2, "doc_id long, text string, media string")
    out = round_trip(df).collect()
    assert len(out) == len(texts) + 3
    by = {r.doc_id: r for r in out}
    for k, t in enumerate(texts):
        assert bytes(by[k].payload) == payload_of(t) and by[k].n_bytes == len((t or "").encode())
        assert by[k].media_sha256 == hashlib.sha256(write(payload_of(t))).hexdigest()
    assert by[5].feature == by[6].feature and by[0].media_sha256 == by[1].media_sha256
    assert {r.feature.split(":")[1] for r in out} == {"packbits", "lzw", "deflate"}
    assert round_trip(df.filter("false")).count() == 0
