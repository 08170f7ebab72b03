"""Media columns: TIFF.

``pages`` walks the image directories of each file, reads its strips or tiles
(uncompressed, PackBits, LZW or deflate), undoes the horizontal and the
floating-point predictor and emits one row for each page: its size, samples and raw bytes, rows from the
top, samples interleaved or plane by plane as stored.  ``encode`` writes the
same formats.  Either byte order is read; samples have 8, 16, 24, 32 or
64 bits (other depths are given packed by row, as stored).

Edge cases: a null file has no pages and gives one row with page -1 and the
error ``no bytes``; so does a file that is no TIFF.  A page that can't be read
has its error and null pixels, whose feature is null, and the pages after it
are still read.  A page that claims more than its strips or tiles can hold is
refused before anything is allocated, as is one over what a binary value of
Spark holds (2 GiB).  A directory that overlaps one visited before ends the
walk.  Of the columns kept, those named like one of a page are called
``file_...``; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tags of TIFF 6.0.
SUBFILE = 254
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 322, 323, 324, 325
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I"}
#: A binary value holds at most so many bytes.
MOST_BYTES = (1 << 31) - 1
#: Bytes that one stored byte can stand for at most.
_MOST_EACH = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}


class TiffError(ValueError):
    """What is wrong with a file or page."""


@dataclass
class Page:
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 0
    pixels: bytes | None = None
    error: str | None = None
    tags: dict[int, tuple] = field(default_factory=dict)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of 3 to 128 equal bytes, literals between them."""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, int)
    long = np.diff(edges) >= 3
    out, at = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(k + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for a, b in zip(edges[:-1][long].tolist(), edges[1:][long].tolist()):
        literal(at, a)
        at = b
        while a < b:
            n = min(128, b - a)
            out += bytes((257 - n if n > 1 else 0, data[a]))
            a += n
    literal(at, len(data))
    return bytes(out)


_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first; codes widen one entry early."""
    out, table, last = bytearray(), [], b""
    value = bits = 0
    width = 9
    start = [bytes((k,)) for k in range(256)] + [b"", b""]
    for byte in data:
        value, bits = (value << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = value >> bits
        value &= (1 << bits) - 1
        if code == _CLEAR:
            table, last, width = start[:], b"", 9
            continue
        if code == _END:
            break
        if not table:
            raise TiffError("LZW data starts without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """A phrase is known by its code, a longer one by that code and the next byte."""
    out, value, bits = bytearray(), _CLEAR, 9
    known: dict[int, int] = {}
    next_code, width, phrase = 258, 9, -1
    for byte in data:
        if phrase < 0:
            phrase = byte
            continue
        longer = phrase << 8 | byte
        if (code := known.get(longer)) is not None:
            phrase = code
            continue
        value, bits = (value << width) | phrase, bits + width
        known[longer], next_code, phrase = next_code, next_code + 1, byte
        if next_code + 1 > 1 << width:
            width += 1
        if next_code >= 4094:
            value, bits = (value << width) | _CLEAR, bits + width
            known, next_code, width = {}, 258, 9
        if bits >= 256:
            out += (value >> bits % 8).to_bytes(bits // 8, "big")
            value, bits = value & ((1 << bits % 8) - 1), bits % 8
    if phrase >= 0:
        value, bits = (value << width) | phrase, bits + width
        if next_code + 1 >= 1 << width and width < 12:
            width += 1
    value, bits = (value << width) | _END, bits + width
    value, bits = value << (-bits % 8), bits + -bits % 8
    return bytes(out + value.to_bytes(bits // 8, "big"))


def _inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


_DECODERS = {NONE: lambda d, n: d[:n], PACKBITS: unpack_bits, LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate}
_ENCODERS = {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1)}


def difference(data: bytes, width: int, samples: int) -> bytes:
    """The horizontal predictor over rows of 8-bit samples."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width, samples)
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out.tobytes()


def _undo(data: bytes, width: int, samples: int, bits: int, order: str) -> bytes:
    """Undoes the horizontal predictor; samples of any depth up to 64 bits keep the file's byte order."""
    if bits > 64:
        raise TiffError(f"predictor with {bits} bits")
    if bits in (8, 16, 32, 64):
        kind = np.dtype(f"{order}u{bits // 8}")
        rows = np.frombuffer(data, kind).reshape(-1, width, samples)
        return np.cumsum(rows, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
    swap = order == "<" and bits % 8 == 0
    row = (width * samples * bits + 7) // 8
    out = []
    # by blocks of rows, as each bit takes a word
    block = max(1, (1 << 22) // (width * samples * bits)) * row
    for at in range(0, len(data), block):
        part = np.frombuffer(data[at : at + block], np.uint8).reshape(-1, row)
        if swap:
            part = part.reshape(len(part), -1, bits // 8)[:, :, ::-1].reshape(len(part), row)
        cells = np.unpackbits(part, axis=1, count=width * samples * bits).reshape(-1, width, samples, bits)
        places = np.arange(bits - 1, -1, -1, dtype=np.uint64)
        values = np.cumsum((cells.astype(np.uint64) << places).sum(axis=3, dtype=np.uint64), axis=1, dtype=np.uint64)
        cells = ((values[..., None] >> places) & np.uint64(1)).astype(np.uint8)
        part = np.packbits(cells.reshape(len(part), -1), axis=1)
        if swap:
            part = part.reshape(len(part), -1, bits // 8)[:, :, ::-1]
        out.append(part.tobytes())
    return b"".join(out)


def _undo_float(data: bytes, width: int, samples: int, bits: int, order: str) -> bytes:
    """Undoes the floating-point predictor: sums of bytes, then planes of bytes, the highest first, back to samples."""
    if bits not in (16, 24, 32, 64):
        raise TiffError(f"floating-point predictor with {bits} bits")
    rows = np.frombuffer(data, np.uint8).reshape(-1, width * bits // 8, samples)
    planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(len(rows), bits // 8, width * samples)
    return (planes[:, ::-1] if order == "<" else planes).transpose(0, 2, 1).tobytes()


class Reader:
    """Walks the directories of one file."""

    def __init__(self, data: bytes):
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8 or self.unpack("H", 2)[0] != 42:
            raise TiffError("not a TIFF file")

    def unpack(self, code: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + code, self.data, at)
        except struct.error as e:
            raise TiffError("the file ends early") from e

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, ranges = self.unpack("I", 4)[0], []
        while at:
            (count,) = self.unpack("H", at)
            end = at + 2 + 12 * count
            k = bisect_right(ranges, (at, end))
            if (k and ranges[k - 1][1] > at) or (k < len(ranges) and ranges[k][0] < end):
                return
            ranges.insert(k, (at, end))
            tags = {}
            for place in range(at + 2, end, 12):
                tag, kind, n = self.unpack("HHI", place)
                code, size = _CODES.get(kind), _SIZES.get(kind, 0) * n
                if code and 0 < size <= len(self.data):
                    tags[tag] = self.unpack(f"{n}{code}", place + 8 if size <= 4 else self.unpack("I", place + 8)[0])
            yield tags
            (at,) = self.unpack("I", end)

    def page(self, tags: dict[int, tuple]) -> Page:
        one = lambda tag, default: tags.get(tag, (default,))[0]
        numbers = [one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)]
        page = Page(*(min(x, 0x7FFFFFFF) for x in numbers), tags=tags)
        try:
            page.pixels = self._pixels(page, one(PLANAR, 1), tags)
        except TiffError as e:
            page.error = str(e)
        return page

    def _pixels(self, page: Page, planar: int, tags: dict[int, tuple]) -> bytes:
        if len(set(tags.get(BITS, (1,)))) > 1 or not page.width or not page.height or not page.samples or not 0 < page.bits <= 64:
            raise TiffError("no size, no samples, or samples of different or odd depths")
        if page.compression not in _DECODERS:
            raise TiffError(f"compression {page.compression}")
        inside = page.samples if planar == 1 else 1
        planes = 1 if planar == 1 else page.samples
        tiled = TILE_AT in tags
        one = lambda tag, default: tags.get(tag, (default,))[0]
        across = one(TILE_WIDTH, 0) if tiled else page.width
        down = one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, page.height), page.height)
        starts, sizes = (tags.get(k) for k in ((TILE_AT, TILE_SIZE) if tiled else (STRIP_AT, STRIP_SIZE)))
        if not starts or not sizes or not across or not down:
            raise TiffError("no strips or tiles")
        row_bytes = lambda width: (width * inside * page.bits + 7) // 8
        columns, rows = -(-page.width // across), -(-page.height // down)
        if min(len(starts), len(sizes)) < columns * rows * planes or (tiled and page.bits % 8):
            raise TiffError("too few strips or tiles")
        needed = row_bytes(page.width) * page.height * planes
        stored = sum(max(0, min(n, len(self.data) - a)) for a, n in zip(starts, sizes))
        if needed > min(MOST_BYTES, stored * _MOST_EACH[page.compression]) or row_bytes(across) * down > MOST_BYTES:
            raise TiffError("a page larger than its strips or tiles can hold")
        out = np.zeros((planes, page.height, row_bytes(page.width)), np.uint8)
        for k in range(columns * rows * planes):
            plane, r, c = k // (columns * rows), k // columns % rows, k % columns
            height = down if tiled else min(down, page.height - r * down)
            size = row_bytes(across) * height
            block = _DECODERS[page.compression](self.data[starts[k] : starts[k] + sizes[k]], size)[:size]
            if len(block) < size:
                raise TiffError("a strip or tile ends early")
            if page.predictor == 2:
                block = _undo(block, across, inside, page.bits, self.order)
            elif page.predictor == 3:
                block = _undo_float(block, across, inside, page.bits, self.order)
            elif page.predictor != 1:
                raise TiffError(f"predictor {page.predictor}")
            grid = np.frombuffer(block, np.uint8).reshape(height, -1)
            top, left = r * down, c * row_bytes(across)
            grid = grid[: page.height - top, : out.shape[2] - left]
            out[plane, top : top + grid.shape[0], left : left + grid.shape[1]] = grid
        return out.tobytes()


def read(data: bytes | None) -> list[Page]:
    """The pages of a file; one page with an error if there is none."""
    if not data:
        return [Page(error="no bytes")]
    found: list[Page] = []
    try:
        reader = Reader(data)
        for tags in reader.directories():
            found.append(reader.page(tags))
    except TiffError as e:
        found.append(Page(error=str(e)))
    return found or [Page(error="no image directory")]


def _blocks(pixels: bytes, width: int, strip_bytes: int, tile: int) -> tuple[list[tuple[bytes, int]], int]:
    """(bytes, width) of each tile of ``tile`` squared, filled up with 0, or of each strip; and the rows of one."""
    if not tile:
        rows = max(1, strip_bytes // width)
        return [(pixels[at : at + rows * width], width) for at in range(0, len(pixels), rows * width)], rows
    grid = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    grid = np.pad(grid, ((0, -len(grid) % tile), (0, -width % tile)))
    return [(grid[r : r + tile, c : c + tile].tobytes(), tile) for r in range(0, grid.shape[0], tile) for c in range(0, grid.shape[1], tile)], tile


def encode(images: list[tuple[bytes, int]], compression: int = DEFLATE, predictor: int = 2, strip_bytes: int = 1 << 15, tile: int = 0) -> bytes:
    """A little-endian file with a page for each (pixels, width): 8-bit grey
    rows, in tiles of ``tile`` squared (a multiple of 16), or in strips of about
    ``strip_bytes``.  Pages after the first are marked as reduced versions of it."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for n, (pixels, width) in enumerate(images):
        blocks, rows = _blocks(pixels, width, strip_bytes, tile)
        starts, sizes = [], []
        for part, across in blocks:
            part = _ENCODERS[compression](difference(part, across, 1) if predictor == 2 else part)
            starts.append(len(out))
            sizes.append(len(part))
            out += part + b"\0" * (len(part) % 2)
        shape = [(TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (TILE_AT, starts), (TILE_SIZE, sizes)] if tile else [(STRIP_AT, starts), (STRIP_ROWS, [rows]), (STRIP_SIZE, sizes)]
        plain = [(SUBFILE, [int(n > 0)]), (WIDTH, [width]), (HEIGHT, [len(pixels) // width]), (BITS, [8]), (COMPRESSION, [compression]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
        entries = sorted(plain + shape)
        places = {}
        for tag, values in entries:
            if len(values) > 1:
                places[tag] = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag, values in entries:
            out += struct.pack("<HHII", tag, 4, len(values), places.get(tag, values[0]))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def pages(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each page of each file, with the columns ``keep`` of the file."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for k, data in enumerate(batch[content].to_pylist()):
                for n, p in enumerate(read(data)):
                    page = -1 if p.error and not p.tags else n
                    for column, value in zip(out, (k, page, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, p.error)):
                        column.append(value)
            rows = pa.array(out[0], pa.int64())
            kept = [batch[c].take(rows) for c in keep]
            made = [*(pa.array(x, pa.int32()) for x in out[1:8]), pa.array(out[8], pa.binary()), pa.array(out[9], pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names)

    small_batches(files.sparkSession, 1000)
    own = [f.split()[0] for f in _SCHEMA.split(", ")]
    names = [*(f"file_{c}" if c in own else c for c in keep), *own]
    types = dict(files.dtypes)
    kept = "".join(f"`{n}` {types[c]}, " for n, c in zip(names, keep))
    return files.select(*dict.fromkeys((*keep, content))).mapInArrow(run, kept + _SCHEMA)


def _stored(data: bytes) -> bytes:
    """The padded bytes as a page, 64 wide.  Codec, strips or tiles, and whether
    a page of every fourth sample of every fourth row follows, go by a checksum
    of the text, so that texts of all lengths meet them all."""
    data += b"\0" * (-len(data) % 64 or 64 * (not data))
    choice = zlib.crc32(data)
    images = [(data, 64)]
    if choice // 6 % 2:
        images.append((np.frombuffer(data, np.uint8).reshape(-1, 64)[::4, ::4].tobytes(), 16))
    return encode(images, (PACKBITS, LZW, DEFLATE)[choice % 3], tile=32 * (choice // 3 % 2))


def from_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content: each text stored as a TIFF file."""

    @F.pandas_udf("binary")
    def file_of(text):
        return text.map(lambda t: _stored((t or "").encode()))

    small_batches(docs.sparkSession, 1000)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), file_of(text).alias("content"))


def features(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tail_crc32`` of the last 64 bytes and ``feature``: size,
    mean, deviation and an 8 by 8 average hash of the pixels."""

    @F.pandas_udf("string")
    def feature_of(pixels, width):
        return pixels.combine(width, lambda p, w: None if p is None else _feature(p, w))

    return rows.withColumn("feature", feature_of("pixels", "width"))


def _feature(pixels: bytes, width: int) -> str:
    grid = np.frombuffer(pixels, np.uint8)
    width = width if len(grid) % width == 0 else len(grid)  # rows of packed bits or of several samples
    grid = grid.reshape(-1, width)
    rows = np.linspace(0, len(grid), 9).astype(int)[:8]
    columns = np.linspace(0, width, 9).astype(int)[:8]
    sums = np.add.reduceat(np.add.reduceat(grid, rows, axis=0, dtype=np.int64), columns, axis=1)
    mean = grid.mean()
    bits = np.packbits((sums > sums.mean()).ravel()).tobytes().hex()
    return f"{width}x{len(grid)}:{mean:.3f}:{grid.std():.3f}:{bits}"
