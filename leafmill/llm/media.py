"""Media columns: TIFF images in a binary column, one row per page.

Reading walks the image directories of a file, undoes the compression (none, PackBits, LZW, deflate)
of each strip or tile and then its horizontal predictor, and gives the samples of each page, row by
row and pixel by pixel: samples of 1, 2 and 4 bits as one byte each, those of 16 and 32 bits in
little-endian order. Samples of other sizes and the floating-point predictor are not read.

Null media give no rows. What is not a TIFF, or a page that can't be read, gives one row with
``error`` set and null samples; other rows of the table are not touched by it. So does a page whose
header asks for more than ``MAX_PAGE`` bytes, or for none; strips and tiles are never inflated beyond
the bytes that their header asks for. A directory chain that returns to itself ends there. Pages are
decoded one by one and handed on as soon as ``HELD`` bytes of them are together, so a task holds that
and one page more, however many directories share a strip; pages behind the first ``MAX_FILE`` bytes
of a file's samples are not decoded and give a row with ``error``. Empty tables give empty results;
columns that share a name with a result column are replaced.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: tags, and the numbers of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, CHANNELS, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 3: "H", 4: "I"}

#: Bytes of the largest page, and of the largest strip or tile, that is read.
MAX_PAGE = 1 << 28
#: Bytes of samples that a file may have, its pages together.
MAX_FILE = 1 << 36
#: Bytes of samples, and rows, that are together in a batch before it is handed on.
HELD, HELD_ROWS = 1 << 25, 1024

#: Where a page's row has its samples.
SAMPLES = 6

PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("pages", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("samples", T.BinaryType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
ARROW_PAGE = [("page", pa.int32()), ("pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("samples", pa.binary()), ("feature", pa.string()), ("error", pa.string())]


def unpack_bits(data: bytes, most: int = MAX_PAGE) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n != 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as a repeat, the rest as literals."""
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in re.finditer(rb"(?s)(.)\1{2,127}", data):
        literal(run.start())
        out += bytes((257 - (run.end() - run.start()), data[run.start()]))
        at = run.end()
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = MAX_PAGE) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; widths grow one code early.

    Decoding ends at ``most`` bytes.
    """
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, last, width = list(single), [], b"", 9
    have, bits, size = 0, 0, 0
    for byte in data:
        have, bits = (have << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, have = have >> bits, have & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = list(single), b"", 9
            continue
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} of {len(table)}")
        out.append(word)
        size += len(word)
        if size >= most:
            break
        if last:
            table.append(last + word[:1])
        last = word
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    acc, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits)
            acc &= (1 << bits) - 1

    table = {bytes((i,)): i for i in range(256)}
    size, word = 258, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], max(9, min(12, size.bit_length())))
        table[longer], size, word = size, size + 1, data[i : i + 1]
        if size == 4094:
            put(table[word], 12)
            put(256, 12)
            table, size, word = {bytes((j,)): j for j in range(256)}, 258, b""
    if word:
        put(table[word], max(9, min(12, size.bit_length())))
        size += 1
    put(257, max(9, min(12, size.bit_length())))
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int = MAX_PAGE) -> bytes:
    return zlib.decompressobj().decompress(data, most)


UNDO = {NONE: lambda data, most: data, PACKBITS: unpack_bits, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}
DO = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1)}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """Tags of the directory at an offset, and the offset of the next."""
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            form = f"{order}{count}{TYPES[kind]}"
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(form, data, where)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _samples(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> tuple[np.ndarray, int]:
    """Height x width x channels of a page, and the bits of its samples."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, channels, bits = tags[WIDTH][0], tags[HEIGHT][0], one(CHANNELS, 1), one(BITS, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"samples of {tags.get(BITS)} bits")
    if one(COMPRESSION, NONE) not in UNDO:
        raise ValueError(f"compression {one(COMPRESSION, NONE)}")
    if one(PREDICTOR, 1) not in (1, 2) or (one(PREDICTOR, 1) == 2 and bits < 8):
        raise ValueError(f"predictor {one(PREDICTOR, 1)} of {bits} bits")
    undo, kind = UNDO[one(COMPRESSION, NONE)], np.dtype(f"{order}u{max(bits, 8) // 8}")
    planes, deep = (channels, 1) if one(PLANAR, 1) == 2 else (1, channels)
    tiled = TILE_OFFSETS in tags
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if min(width, height, channels, wide, high) < 1:
        raise ValueError(f"a page of {width} x {height} x {channels} in parts of {wide} x {high}")
    if max(width * height * channels, wide * high * deep) * kind.itemsize > MAX_PAGE:
        raise ValueError(f"a page of {width} x {height} x {channels} in parts of {wide} x {high} is above {MAX_PAGE} bytes")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) != planes * across * down or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} parts for {planes} x {across} x {down}")
    out = np.empty((height, width, channels), kind.newbyteorder("="))
    line = -(-wide * deep * bits // 8)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        plane, y, x = k // (across * down), k // across % down * high, k % across * wide
        rows = high if tiled else min(high, height - y)
        part = undo(data[at : at + size], rows * line)
        if bits < 8:  # samples are packed, lines begin with a byte
            part = np.unpackbits(np.frombuffer(part, np.uint8, rows * line).reshape(rows, line), axis=1)
            part = part[:, : wide * deep * bits].reshape(rows, wide, deep, bits) @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
        else:
            part = np.frombuffer(part, kind, rows * wide * deep).reshape(rows, wide, deep).astype(out.dtype)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        part = part[: height - y, : width - x]
        out[y : y + rows, x : x + wide, plane : plane + deep if planes > 1 else channels] = part
    return out, bits


def read_pages(data: bytes) -> Iterator[np.ndarray | Exception]:
    """The pages of a TIFF, or what keeps one from being read."""
    for page, _ in _pages_bits(data):
        yield page


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]] | Exception]]:
    """Byte order and tags of each directory, or what ends the chain."""
    try:
        order = {b"II*\0": "<", b"MM\0*": ">"}[data[:4]]
        (at,) = struct.unpack_from(order + "I", data, 4)
    except (KeyError, struct.error):
        yield "", ValueError("not a TIFF")
        return
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
        except struct.error as e:
            yield order, e
            return
        yield order, tags


def _pages_bits(data: bytes) -> Iterator[tuple[np.ndarray | Exception, int]]:
    size = 0
    for order, tags in _directories(data):
        if isinstance(tags, Exception):
            yield tags, 0
            continue
        try:
            if size >= MAX_FILE:
                raise ValueError(f"the pages before have {MAX_FILE} bytes")
            page, bits = _samples(data, tags, order)
            size += page.nbytes
        except (KeyError, ValueError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            page, bits = e, 0
        yield page, bits


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: int = 0, order: str = "<") -> bytes:
    """Pages of height x width (x channels) samples of 8 or 16 bits, in strips or in square tiles."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, channels = page.shape
        bits = page.dtype.itemsize * 8
        if tile:
            padded = np.pad(page, ((0, -height % tile), (0, -width % tile), (0, 0)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
            stored = DO[compression](part.astype(page.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored + bytes(len(stored) % 2)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [bits] * channels, COMPRESSION: [compression], PHOTOMETRIC: [1], CHANNELS: [channels], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_BYTES: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_BYTES: counts}
        fields = bytearray()
        for tag, values in sorted(tags.items()):
            stored = struct.pack(f"{order}{len(values)}I", *values)
            if len(stored) > 4:
                where, stored = len(out), stored
                out += stored
                stored = struct.pack(order + "I", where)
            fields += struct.pack(order + "HHI", tag, 4, len(values)) + stored
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + fields + bytes(4)
        link = len(out) - 4
    return bytes(out)


def feature(page: np.ndarray) -> str:
    """Size, sum, distinct values and greatest value of the samples."""
    values = page.reshape(-1)
    return f"{page.shape[1]}x{page.shape[0]}x{page.shape[2]} sum={int(values.sum(dtype=np.uint64))} distinct={len(np.unique(values))} max={int(values.max(initial=0))}"


def _rows(data: bytes) -> Iterator[tuple]:
    """A row for each page, decoded when it is asked for."""
    pages = sum(1 for _ in _directories(data))
    for i, (page, bits) in enumerate(_pages_bits(data)):
        if isinstance(page, Exception):
            yield i, pages, None, None, None, None, None, None, f"{type(page).__name__}: {page}"
        else:
            stored = page.astype(page.dtype.newbyteorder("<")).tobytes()
            yield i, pages, page.shape[1], page.shape[0], page.shape[2], bits, stored, feature(page), None


def _page_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows of pages beside those of their files, whose media are column ``at``; an empty batch for none."""

    def together(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows = batch.take(pa.array([x[0] for x in found], pa.int32()))
        made = [pa.array([x[k + 1] for x in found], kind) for k, (_, kind) in enumerate(ARROW_PAGE)]
        return pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, *[n for n, _ in ARROW_PAGE]])

    for batch in batches:
        found, held = [], 0
        for i, media in enumerate(batch.column(at)):
            data = media.as_py()
            for row in _rows(data) if media.is_valid else ():
                found.append((i, *row))
                # the file itself is repeated beside each of its pages
                held += len(row[SAMPLES] or b"") + len(data)
                if held >= HELD or len(found) >= HELD_ROWS:
                    yield together(batch, found)
                    found, held = [], 0
        yield together(batch, found)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the columns of PAGE, one row per page; ``pages`` is how many the file has."""
    df = df.drop(*PAGE.names)
    at = df.columns.index(media)
    return df.mapInArrow(lambda batches: _page_batches(batches, at), T.StructType([*df.schema.fields, *PAGE.fields]))


def _stored(data: bytes, width: int, varied: bool) -> bytes:
    page = np.frombuffer(data, np.uint8).reshape(-1, width)
    if not varied:
        return write_tiff([page])
    form = zlib.crc32(data)
    pages = [page, page[-1:]] if form >> 5 & 1 else [page]
    compression = (NONE, PACKBITS, LZW, DEFLATE)[form & 3]
    return write_tiff(pages, compression, 1 + (form >> 2 & 1), tile=48 * (form >> 3 & 1), order="<>"[form >> 4 & 1])


def store_text(text: Column, width: int = 64, varied: bool = False) -> Column:
    """A text's UTF-8 bytes (null: none), zeros up to a positive multiple of ``width``, as one 8-bit grey page.

    The page is deflated, in strips. If ``varied``, the checksum of the bytes chooses compression,
    predictor, strips or tiles, byte order, and whether the last line follows as a page of its own; so
    equal texts have one form, and a table of texts has all.
    """

    @F.pandas_udf("binary")
    def store(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            stored = []
            for x in part:
                data = (x or "").encode()
                data += bytes(-len(data) % width or (0 if data else width))
                stored.append(_stored(data, width, varied))
            yield pd.Series(stored)

    return store(text)
