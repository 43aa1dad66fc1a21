"""TIFF as a media column: payloads are stored as 8-bit samples, and any TIFF is read back as one row per page.

The reader walks the chain of image directories of either byte order, decodes PackBits, LZW or deflate strips and tiles,
undoes horizontal differencing, and gives a page's samples. The writer stores a payload as rows of ``WIDTH`` samples in
pages of at most ``PAGE_ROWS`` rows. A checksum of the payload deals payloads of all sizes evenly over PackBits, LZW and
deflate, so equal payloads get equal files and every decoder gets its share of the bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, PAGE_ROWS, STRIP_ROWS, TILE = 192, 512, 64, 64
#: Images of so many bytes and more are stored in tiles.
TILED = 12_288

# TIFF tags, compressions, sizes of field types.
WIDTH_TAG, HEIGHT_TAG, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CODECS = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257


RUNS = re.compile(rb"(.)\1+", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(upto: int) -> None:
        for k in range(at, upto, 128):
            part = data[k : min(k + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUNS.finditer(data):
        literal(m.start())
        at = m.end()
        left = at - m.start()
        while left:
            run = min(left, 128)
            out.extend((257 - run & 255, data[m.start()]) if run > 1 else (0, data[m.start()]))
            left -= run
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += head + 2
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def _widths(since_clear: np.ndarray) -> np.ndarray:
    """The bits of a code by how many came since the table was cleared: one more as soon as an entry needs it."""
    entry = since_clear + 258
    return 9 + (entry >= 512).astype(np.int64) + (entry >= 1024) + (entry >= 2048)


def lzw_encode(data: bytes) -> bytes:
    codes, since, table, following = [CLEAR], [0], {}, 258
    held, count = -1, 0
    for byte in data:
        if held < 0:
            held = byte
            continue
        key = held << 8 | byte
        longer = table.get(key)
        if longer is not None:
            held = longer
            continue
        codes.append(held)
        since.append(count)
        table[key] = following
        following += 1
        count += 1
        held = byte
        if following == 4094:
            codes.append(CLEAR)
            since.append(count)
            table, following, count = {}, 258, 0
    if held >= 0:
        codes.append(held)
        since.append(count)
        count += 1
    codes.append(END)
    since.append(count)
    width = _widths(np.array(since))
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


def lzw_decode(data: bytes) -> bytes:
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
    start = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, last, out, since, at = list(start), b"", [], 0, 0
    while True:
        width = _widths(np.arange(since, since + 4096))
        places = at + np.cumsum(width) - width
        inside = places + width <= 8 * len(data)
        width, places = width[inside], places[inside]
        if not len(places):
            return b"".join(out)
        k = places >> 3
        found = (raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) >> 24 - (places & 7) - width & (1 << width) - 1
        stops = np.flatnonzero((found == CLEAR) | (found == END))
        upto = int(stops[0]) if len(stops) else len(found)
        for code in found[:upto].tolist():
            if code < len(table):
                text = table[code]
            elif last and code == len(table):
                text = last + last[:1]
            else:
                raise ValueError("an LZW code before its entry")
            if last and len(table) < 4096:
                table.append(last + text[:1])
            out.append(text)
            last = text
        since += upto
        at = int(places[upto - 1] + width[upto - 1]) if upto else at
        if len(stops):
            if found[upto] == END:
                return b"".join(out)
            at = int(places[upto] + width[upto])
            table, last, since = list(start), b"", 0


def _coded(raw: bytes, codec: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: packbits_encode}[codec](raw)


def _decoded(raw: bytes, codec: int) -> bytes:
    if codec in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw)
    if codec not in CODECS:
        raise ValueError(f"compression {codec} is not known")
    return {NONE: bytes, LZW: lzw_decode, PACKBITS: packbits_decode}[codec](raw)


def write(payload: bytes) -> bytes:
    """A TIFF with the payload, whose length is a positive multiple of WIDTH."""
    codec = (PACKBITS, LZW, DEFLATE)[zlib.crc32(payload) % 3]
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(rows), PAGE_ROWS):
        image = rows[top : top + PAGE_ROWS]
        tiled = image.size >= TILED
        if tiled:
            tall = -(-len(image) // TILE) * TILE
            image = np.concatenate([image, np.zeros((tall - len(image), WIDTH), np.uint8)])
            parts = [image[y : y + TILE, x : x + TILE] for y in range(0, tall, TILE) for x in range(0, WIDTH, TILE)]
        else:
            parts = [image[y : y + STRIP_ROWS] for y in range(0, len(image), STRIP_ROWS)]
        predictor = 1 if codec == PACKBITS else 2
        if predictor == 2:
            parts = [np.diff(p, axis=1, prepend=np.uint8(0)) for p in parts]
        coded = [_coded(p.tobytes(), codec) for p in parts]
        at = []
        for c in coded:
            at.append(len(out))
            out += c + b"\0" * (len(c) % 2)
        where = [(TILE_WIDTH, [TILE]), (TILE_HEIGHT, [TILE]), (TILE_OFFSETS, at), (TILE_BYTES, list(map(len, coded)))] if tiled else [(STRIP_OFFSETS, at), (ROWS_PER_STRIP, [STRIP_ROWS]), (STRIP_BYTES, list(map(len, coded)))]
        fields = sorted([(WIDTH_TAG, [WIDTH]), (HEIGHT_TAG, [min(PAGE_ROWS, len(rows) - top)]), (BITS, [8]), (COMPRESSION, [codec]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor]), *where])
        entries = b""
        for tag, values in fields:
            if len(values) > 1:
                entries += struct.pack("<HHII", tag, 4, len(values), len(out))
                out += struct.pack(f"<{len(values)}I", *values)
            else:
                entries += struct.pack("<HHII", tag, 4, 1, values[0])
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read(media: bytes) -> list[dict]:
    """A TIFF's pages: width, height, codec, predictor, layout, samples (rows of 8-bit samples, pixels' together)."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), out, seen = struct.unpack_from(order + "I", media, 4), [], set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", media, at)
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
            place = at + 10 + 12 * k
            if n * TYPE_BYTES.get(kind, 1) > 4:
                (place,) = struct.unpack_from(order + "I", media, place)
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{n}{'.B.HI'[kind]}", media, place)
        out.append(_page(media, tags))
        (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * count)
    return out


def _page(media: bytes, tags: dict) -> dict:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, depth, codec, predictor = one(WIDTH_TAG, 0), one(HEIGHT_TAG, 0), one(SAMPLES, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))) or one(PLANAR, 1) != 1:
        raise ValueError("only 8-bit samples, pixel by pixel")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not known")
    image = np.zeros((height, width, depth), np.uint8)
    tiled = TILE_OFFSETS in tags
    wide, tall = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    across = -(-width // wide) if wide else 0
    for k, (start, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        raw = _decoded(bytes(media[start : start + size]), codec)
        part = np.frombuffer(raw, np.uint8, rows * wide * depth).reshape(rows, wide, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        image[y : y + rows, x : x + wide] = part[: height - y, : width - x]
    return {"width": width, "height": height, "codec": CODECS[codec], "predictor": predictor, "layout": "tiles" if tiled else "strips", "samples": image.tobytes()}


def payload_of(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of WIDTH bytes; null is empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


#: What a damaged or foreign file raises.
DAMAGE = (ValueError, KeyError, IndexError, struct.error, zlib.error, ZeroDivisionError)


def _about(page: dict) -> tuple[float, float]:
    """The mean of a page's samples and the mean difference of neighbours in a row."""
    x = np.frombuffer(page["samples"], np.uint8).reshape(page["height"], -1)
    return float(x.mean()) if x.size else 0.0, float(np.abs(np.diff(x.astype(np.int16), axis=1)).mean()) if x.shape[1] > 1 and len(x) else 0.0


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text), media (its TIFF) for each row; null text is empty, which is a row of spaces."""

    def stored(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = part.column(1).to_pylist()
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([write(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return rows.mapInArrow(stored, "doc_id long, n_bytes long, media binary")


PAGE = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, pages int, page int, width int, height int, codec string, predictor int, layout string, mean double, contrast double, samples binary, error string"


def read_pages(stored: DataFrame) -> DataFrame:
    """A row for each page of each ``media``: where it stands, its sizes, how it was stored, two features of its samples
    (their mean and the mean difference of neighbours in a row) and the samples.

    Null media has no page. A file that is damaged, or of a kind that isn't known, is one row with what is wrong as its ``error``
    and no page. Repeated rows come out as often.
    """
    names = [f.split()[0] for f in PAGE.split(", ")]

    def pages(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for doc_id, size, media in zip(*(batch.slice(i, 200).column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    if media is None:
                        continue
                    same = doc_id, size, len(media), sha256(media).hexdigest()
                    try:
                        found = [(p, *_about(p)) for p in read(media)]
                    except DAMAGE as wrong:
                        rows.append((*same, *[None] * 10, str(wrong) or type(wrong).__name__))
                        continue
                    for k, (p, mean, contrast) in enumerate(found):
                        rows.append((*same, len(found), k, p["width"], p["height"], p["codec"], p["predictor"], p["layout"], mean, contrast, p["samples"], None))
                kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(pages, PAGE)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, payload (all pages read back), feature for each row of ``docs``, repeated rows
    as often. A file's pages are read by one task, so nothing is shuffled."""

    def whole(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for doc_id, size, media in zip(*(batch.slice(i, 200).column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    pages = read(media)
                    about = ("{width}x{height}:{codec}:{predictor}:{layout}:".format(**p) + "%.3f:%.3f" % _about(p) for p in pages)
                    rows.append((doc_id, size, len(media), sha256(media).hexdigest(), b"".join(p["samples"] for p in pages), "|".join(about)))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload", "feature"])

    return store(docs, id_col, text_col).mapInArrow(whole, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, feature string")
