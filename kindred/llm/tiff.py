"""TIFF as a media column: write byte payloads as images, walk directories and emit one row per page.

Decodes baseline TIFF of either byte order with strips or tiles, 8 or 16 bits a sample, chunky layout,
compression none, LZW, deflate or PackBits, and predictors none or horizontal differencing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8, widened

#: Fixed values of the TIFF 6.0 format: compression schemes and field sizes.
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that one stored byte can stand for at most.
MOST = {LZW: 2731, DEFLATE: 1032, DEFLATE_OLD: 1032, PACKBITS: 64}
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, SAMPLES = 64, 3
ROW_BYTES = WIDTH * SAMPLES


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as repeats, everything else as literals of at most 128 bytes."""
    out, n, i = bytearray(), len(data), 0
    literal = 0
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            while literal < i:
                step = min(128, i - literal)
                out.append(step - 1)
                out += data[literal : literal + step]
                literal += step
            out += bytes((257 - run, data[i]))
            literal = i + run
        i += run
    while literal < n:
        step = min(128, n - literal)
        out.append(step - 1)
        out += data[literal : literal + step]
        literal += step
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits with the format's early change of width."""
    acc = held = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc = acc << width | code
        held += width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    fresh, width, word = 258, 9, b""
    put(256, 9)
    for value in data:
        longer = word + bytes((value,))
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = fresh
        fresh += 1
        if fresh == 4094:
            put(256, width)
            table = {bytes((i,)): i for i in range(256)}
            fresh, width = 258, 9
        elif fresh + 1 > (1 << width):
            width += 1
        word = bytes((value,))
    if word:
        put(table[word], width)
        fresh += 1
        if fresh + 1 > (1 << width) and width < 12:
            width += 1
    put(257, width)
    if held:
        put(0, 8 - held)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, None
    out = bytearray()
    acc = held = 0
    for byte in data:
        acc = acc << 8 | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code outside the table")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, DEFLATE_OLD):
        return zlib.decompressobj().decompress(data, size)
    if compression == NONE:
        return data[:size]
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {compression} is not supported")


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] = block[:, 1:] - block[:, :-1]
    return out


def write_tiff(
    pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 64, tile: int = 0, order: str = "<"
) -> bytes:
    """A TIFF of pages, each an array (height, width, samples) of uint8 or uint16; tile > 0 writes square tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for number, page in enumerate(pages):
        height, width, samples = page.shape
        bits = page.dtype.itemsize * 8
        blocks = []
        if tile:
            for top in range(0, height, tile):
                for left in range(0, width, tile):
                    block = np.zeros((tile, tile, samples), page.dtype)
                    part = page[top : top + tile, left : left + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[top : top + strip_rows] for top in range(0, height, strip_rows)]
        packed = [
            _pack((_difference(b) if predictor == 2 else b).astype(b.dtype.newbyteorder(order)).tobytes(), compression) for b in blocks
        ]
        n = len(packed)
        fields = [
            (256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [compression]),
            (262, 3, [2 if samples >= 3 else 1]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor]),
        ]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, None), (325, 4, [len(x) for x in packed])] if tile else []
        fields += [] if tile else [(273, 4, None), (278, 4, [strip_rows]), (279, 4, [len(x) for x in packed])]
        fields.sort()
        start = len(out)
        extra = start + 2 + 12 * len(fields) + 4
        body, entries = bytearray(), []
        sizes = [0 if v is None else len(v) * FIELD_BYTES[t] for _, t, v in fields]
        room = sum(s for s in sizes if s > 4) + (4 * n if n > 1 else 0)
        places = np.cumsum([extra + room] + [len(x) for x in packed])
        for tag, kind, values in fields:
            values = [int(x) for x in places[:-1]] if values is None else values
            raw = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(raw) > 4:
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), extra + len(body)))
                body += raw
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += struct.pack(order + "H", len(fields)) + b"".join(entries)
        end = int(places[-1])
        end += end % 2
        out += struct.pack(order + "I", end if number + 1 < len(pages) else 0) + body + b"".join(packed)
        if number + 1 < len(pages):
            out += b"\0" * (end - len(out))
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[Page]:
    """Every page in directory order. A directory that was seen before ends the walk (cyclic files)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    (at,) = struct.unpack(order + "I", data[4:8])
    seen: set[int] = set()
    index = 0
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = FIELD_BYTES.get(kind, 1) * n
            where = at + 10 + 12 * i
            if size > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            if where + size > len(data):
                raise ValueError("a field lies outside the file")
            code = {1: "B", 3: "H", 4: "I"}.get(kind)
            if code:
                tags[tag] = struct.unpack_from(order + code * n, data, where)
        yield _page(data, tags, order, index)
        index += 1
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def _page(data: bytes, tags: dict, order: str, index: int) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    bits, compression, predictor = one(258, 1), one(259, NONE), one(317, 1)
    if bits not in (8, 16) or one(284, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only chunky 8 or 16 bit samples with no or horizontal prediction are supported")
    kind = np.dtype(np.uint8 if bits == 8 else np.uint16)
    tiled = 324 in tags
    wide, high = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height) or 1)
    across = -(-width // wide) if tiled else 1
    if not wide or not high:
        raise ValueError("strips or tiles without rows")
    places, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
    if height * width * samples * kind.itemsize > sum(MOST.get(compression, 1) * (min(n, len(data)) + 16) for n in sizes):
        raise ValueError("more samples than the stored bytes can hold")
    image = np.zeros((height, width, samples), kind)
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = k // across * high, k % across * wide
        if top >= height:
            break
        rows = high if tiled else min(high, height - top)
        raw = _unpack(data[place : place + size], compression, rows * wide * samples * kind.itemsize)
        block = np.frombuffer(raw, kind.newbyteorder(order)).astype(kind).reshape(rows, wide, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind)
        image[top : top + rows, left : left + wide] = block[: height - top, : width - left]
    return Page(index, width, height, samples, bits, compression, predictor, tiled, image.tobytes())


def text_payload(text: bytes) -> bytes:
    """The text padded with spaces to a positive multiple of one image row."""
    return text + b" " * (max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES - len(text))


def feature(page: Page) -> str:
    """Size, mean, deviation and extremes of each channel, in a fixed number format."""
    pixels = np.frombuffer(page.pixels, np.uint8 if page.bits == 8 else np.uint16).reshape(-1, page.samples)
    if not len(pixels):
        return f"{page.width}x{page.height}x{page.samples}"
    total, square = pixels.sum(axis=0, dtype=np.int64), (pixels.astype(np.int64) ** 2).sum(axis=0)
    n = len(pixels)
    parts = [
        f"{total[c] / n:.4f}/{max(0.0, square[c] / n - (total[c] / n) ** 2) ** 0.5:.4f}/{pixels[:, c].min()}-{pixels[:, c].max()}"
        for c in range(page.samples)
    ]
    return f"{page.width}x{page.height}x{page.samples};" + ";".join(parts)


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """(key, n_bytes, media): each whole text as one RGB page, 64 pixels wide. A null or empty text is one row of spaces."""

    def run(batches):
        for part in chunks(batches):
            raw = utf8(part.column(1))
            media = [
                write_tiff([np.frombuffer(p := text_payload(x), np.uint8).reshape(-1, WIDTH, SAMPLES)], compression, predictor)
                for x in raw
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"]
            )

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def decode_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of ``df`` and, for each page, page_index, width, height, samples, bits, pixels, page_feature and page_error.

    A null or undecodable media value gives one row with a null page and the reason in page_error, so no row is lost.
    Columns of ``df`` with one of these names are replaced. A file that declares more samples than its bytes can hold, or
    fields outside itself, is undecodable; nothing is allocated for it.
    """
    own = ["page_index", "width", "height", "samples", "bits", "pixels", "page_feature", "page_error"]
    source = df.drop(*own)
    names = source.columns
    at = names.index(media)

    def pages(data):
        try:
            if data is None:
                raise ValueError("null media")
            return [(p.index, p.width, p.height, p.samples, p.bits, p.pixels, feature(p), None) for p in read_tiff(data)]
        except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as error:
            return [(None,) * 7 + (str(error) or type(error).__name__,)]

    kinds = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]

    def run(batches):
        for part in chunks(batches):
            take, rows = [], []
            for i, data in enumerate(part.column(at).to_pylist()):
                found = pages(data)
                take += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * len(own)
            yield pa.RecordBatch.from_arrays(
                [*part.take(pa.array(take, pa.int32())).columns, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                [*names, *own],
            )

    found = "page_index int, width int, height int, samples int, bits int, pixels binary, page_feature string, page_error string"
    return source.mapInArrow(run, widened(source.schema, found))


def media_digest(documents: DataFrame) -> DataFrame:
    """The registered query: every text stored as a TIFF, read back, and digested."""
    pages = decode_pages(encode_texts(documents))
    return pages.select(
        "doc_id", "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("page_feature").alias("feature"),
        "width", "height", "page_error",
    )
