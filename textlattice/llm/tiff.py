"""Media columns: TIFF files in a binary column.

``tiff_pages`` walks the image directories of each file, decodes the strips or
tiles (plain, PackBits, LZW or deflate), undoes the predictor and emits one row
per page with the page's samples. ``encode`` writes single-page grey files.

Defined results: a page that can't be decoded gives a row with its number, null
samples and an error, and the walk goes on; a file that can't be read on, or has no
directory, a last one with the number that its next page would have (0 for a null,
empty or otherwise unreadable file). Directory loops end the walk. Rows that repeat
are decoded one by one; an empty table gives none; other columns pass through when
they are named, and one with the name of a new one comes back with _in at its end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textlattice.llm.common import kept_columns

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q"}
WIDTH, LENGTH, SAMPLE_BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_SIZE = 322, 323, 324, 325
PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, feature string, error string"


class Bad(ValueError):
    """The file can't be read."""


def unpackbits(b: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(b) and len(out) < size:
        n = b[i]
        i += 1
        if n < 128:
            out += b[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += b[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits(b: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(b):
        n = 1
        while n < 128 and i + n < len(b) and b[i + n] == b[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, b[i]])
        else:
            while n < 128 and i + n < len(b) and (i + n + 1 >= len(b) or b[i + n] != b[i + n + 1]):
                n += 1
            out += bytes([n - 1]) + b[i : i + n]
        i += n
    return bytes(out)


def unlzw(b: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early."""
    out, acc, have, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in b:
        acc = (acc << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = acc >> have
        acc &= (1 << have) - 1
        if code == 256:
            table = [bytes([k]) for k in range(256)] + [b"", b""]
            last, width = b"", 9
            continue
        if code == 257 or len(out) >= size:
            break
        if not table:
            raise Bad("LZW data don't start with a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise Bad("LZW code out of range")
        out += word
        if last and len(table) < 4096:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw(b: bytes) -> bytes:
    out, acc, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal acc, have
        acc = (acc << width) | code
        have += width
        while have >= 8:
            have -= 8
            out.append(acc >> have)
            acc &= (1 << have) - 1

    table = {bytes([k]): k for k in range(256)}
    n, width, word = 258, 9, b""
    put(256, 9)
    for k in range(len(b)):
        ch = b[k : k + 1]
        if word + ch in table:
            word += ch
            continue
        put(table[word], width)
        table[word + ch] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        word = ch
        if n == 4094:
            put(table[word], width)
            put(256, width)
            table = {bytes([k]): k for k in range(256)}
            n, width, word = 258, 9, b""
    if word:
        put(table[word], width)
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257, width)
    if have:
        out.append((acc << (8 - have)) & 0xFF)
    return bytes(out)


def inflate(kind: int, b: bytes, size: int) -> bytes:
    if kind == NONE:
        out = b[:size]
    elif kind == PACKBITS:
        out = unpackbits(b, size)[:size]
    elif kind == LZW:
        out = unlzw(b, size)[:size]
    elif kind in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(b, size) if size else b""
        except zlib.error as e:
            raise Bad(f"deflate: {e}") from None
    else:
        raise Bad(f"compression {kind}")
    if len(out) < size:
        raise Bad("a strip or tile is cut")
    return out


def deflate(kind: int, b: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[kind](b)


def directories(b: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in chain order."""
    if len(b) < 8:
        raise Bad("no header")
    o = {b"II": "<", b"MM": ">"}.get(b[:2])
    if o is None or struct.unpack_from(o + "H", b, 2)[0] != 42:
        raise Bad("not a TIFF header")
    at, seen = struct.unpack_from(o + "I", b, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            (n,) = struct.unpack_from(o + "H", b, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(o + "HHI", b, at + 2 + 12 * i)
                if kind not in TYPES:
                    continue
                fmt = f"{o}{count}{TYPES[kind]}"
                size = struct.calcsize(fmt)
                where = at + 10 + 12 * i
                if size > 4:
                    (where,) = struct.unpack_from(o + "I", b, where)
                if where + size > len(b):
                    raise Bad(f"tag {tag} lies outside the file")
                tags[tag] = struct.unpack_from(fmt, b, where)
            (at,) = struct.unpack_from(o + "I", b, at + 2 + 12 * n)
        except struct.error:
            raise Bad("a directory lies outside the file") from None
        yield tags | {"order": o}


def unpacked(raw: bytes, rows: int, n: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, each row of n from a whole byte on."""
    x = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1).reshape(rows, -1, bits)[:, :n]
    return (x << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def page(b: bytes, tags: dict) -> dict:
    """The samples of one directory: rows of interleaved samples, little-endian where they have more than 8 bits, a byte each where they have fewer."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h = one(WIDTH, 0), one(LENGTH, 0)
    spp, planar = one(SAMPLES, 1), one(PLANAR, 1)
    bits = set(tags.get(SAMPLE_BITS, (1,)))
    if bits - {1, 2, 4, 8, 16, 32} or len(bits) != 1 or not w or not h:
        raise Bad(f"{w} x {h} with {sorted(bits)} bits")
    bits, kind, predictor = bits.pop(), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if predictor not in (1, 2, 3) or predictor == 3 and bits not in (16, 32):
        raise Bad(f"predictor {predictor} with {bits} bits")
    if w * h * spp * max(bits, 8) // 8 >= 1 << 31:
        raise Bad("a page of 2 GB or more doesn't fit a binary column")
    dtype = np.dtype(f"{tags['order']}u{max(bits, 8) // 8}")
    tiled = TILE_AT in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (w, min(one(STRIP_ROWS, h), h))
    at, sizes = (tags.get(TILE_AT), tags.get(TILE_SIZE)) if tiled else (tags.get(STRIP_AT), tags.get(STRIP_SIZE))
    if not at or not sizes or len(at) != len(sizes) or not bw or not bh:
        raise Bad("no strips or tiles")
    across, down = -(-w // bw), -(-h // bh)
    planes, inner = (spp, 1) if planar == 2 else (1, spp)
    if len(at) < planes * across * down:
        raise Bad("strips or tiles are missing")
    out = np.zeros((h, w, spp), dtype=dtype.newbyteorder("<"))
    for k in range(planes * across * down):
        p, rest = divmod(k, across * down)
        y, x = divmod(rest, across)
        rows = bh if tiled else min(bh, h - y * bh)
        if at[k] + sizes[k] > len(b):
            raise Bad("a strip or tile lies outside the file")
        raw = inflate(kind, b[at[k] : at[k] + sizes[k]], rows * -(-bw * inner * bits // 8))
        if bits < 8:
            block = unpacked(raw, rows, bw * inner, bits).reshape(rows, bw, inner)
        elif predictor == 3:  # differences of bytes; a row holds all first bytes, then all second ones
            block = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, inner), axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, bw * inner)
            block = np.ascontiguousarray(block.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, bw, inner).astype(out.dtype)
        else:
            block = np.frombuffer(raw, dtype=dtype).reshape(rows, bw, inner).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype) & out.dtype.type((1 << bits) - 1)
        part = out[y * bh : y * bh + rows, x * bw : x * bw + bw, p : p + inner]
        part[...] = block[: part.shape[0], : part.shape[1]]
    return {"width": w, "height": h, "samples": spp, "bits": bits, "compression": kind, "predictor": predictor, "pixels": out.tobytes(), "feature": feature(out)}


def feature(px: np.ndarray) -> str:
    """64 bits of a page's brightness in an 8 x 8 grid: above the grid's mean or not. Equal pages, equal bits."""
    h, w, _ = px.shape
    rows, cols = np.arange(h) * 8 // h, np.arange(w) * 8 // w
    grey = px.sum(axis=2, dtype=np.uint64)
    total = np.zeros((8, 8), dtype=np.uint64)
    by_row = np.zeros((8, w), dtype=np.uint64)
    np.add.at(by_row, rows, grey)
    np.add.at(total.T, cols, by_row.T)
    n = np.outer(np.bincount(rows, minlength=8), np.bincount(cols, minlength=8))
    mean = total / np.maximum(n, 1)
    return f"{int.from_bytes(np.packbits((mean > total.sum() / max(1, n.sum())).ravel()).tobytes(), 'big'):016x}"


def encode(samples: bytes, width: int, kind: int = DEFLATE, predictor: int = 2, strip_rows: int = 256) -> bytes:
    """One page of 8-bit grey samples in rows of width; its strips follow the directory."""
    px = np.frombuffer(samples, np.uint8).reshape(-1, width)
    h = len(px)
    if predictor == 2:
        px = np.diff(px, axis=1, prepend=np.uint8(0))
    strips = [deflate(kind, px[y : y + strip_rows].tobytes()) for y in range(0, h, strip_rows)]
    n = len(strips)
    tags = {WIDTH: width, LENGTH: h, SAMPLE_BITS: 8, COMPRESSION: kind, PHOTOMETRIC: 1, STRIP_AT: 0, SAMPLES: 1, STRIP_ROWS: strip_rows, STRIP_SIZE: 0, PREDICTOR: predictor}
    lists = 8 + 2 + 12 * len(tags) + 4
    body = lists + (8 * n if n > 1 else 0)
    starts = np.cumsum([body, *map(len, strips)])[:-1].tolist()
    sizes = [len(s) for s in strips]
    out = [b"II*\0", struct.pack("<IH", 8, len(tags))]
    for tag, value in sorted(tags.items()):
        if tag in (STRIP_AT, STRIP_SIZE):
            values = starts if tag == STRIP_AT else sizes
            value = values[0] if n == 1 else lists + (0 if tag == STRIP_AT else 4 * n)
            out.append(struct.pack("<HHII", tag, 4, n, value))
        else:
            out.append(struct.pack("<HHII", tag, 4, 1, value))
    out.append(struct.pack("<I", 0))
    if n > 1:
        out.append(struct.pack(f"<{2 * n}I", *starts, *sizes))
    return b"".join([*out, *strips])


def pages(b: bytes | None) -> Iterator[dict]:
    """A row for each page, with an error where it can't be decoded, and where the file can't be read on one with the number that the next page would have."""
    k = 0
    try:
        for tags in directories(b or b""):
            try:
                found = page(b, tags)
            except (Bad, ValueError, MemoryError) as e:
                found = {"error": str(e)[:200]}
            yield {"page": k} | found
            k += 1
        if not k:
            raise Bad("no image directory")
    except (Bad, ValueError, MemoryError) as e:
        yield {"page": k, "error": str(e)[:200]}


#: Bytes of samples in one output batch.
BATCH = 4 << 20


def _decode(names: list[str], schema: pa.Schema):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size, at = [], 0, []
            for i, cell in enumerate(b.column(len(names))):
                for p in pages(cell.as_py()):
                    rows.append(p)
                    at.append(i)
                    size += len(p.get("pixels") or b"")
                    if size >= BATCH:
                        yield _batch(b, names, at, rows, schema)
                        rows, size, at = [], 0, []
            if rows:
                yield _batch(b, names, at, rows, schema)

    return f


def _batch(b: pa.RecordBatch, names: list[str], at: list[int], rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([c.take(pa.array(at)) for c in b.columns[:-1]] + [pa.array([r.get(x.name) for r in rows], x.type) for x in schema], names=[*names, *schema.names])


PAGE_FIELDS = pa.schema([(n, {"int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in PAGE.split(", "))])


def tiff_pages(files: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """One row per page: the columns named in keep, then those of PAGE."""
    own, names, kinds = kept_columns(files, keep, PAGE_FIELDS.names)
    d = files.select(*own, files[media_col].cast("binary").alias("_media"))
    return d.mapInArrow(_decode(names, PAGE_FIELDS), ", ".join([*kinds, PAGE]))


def _encode(names: list[str], width: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = 0
            while i < b.num_rows:
                out, size = [], 0
                while i + len(out) < b.num_rows and size < BATCH:
                    raw = b.column(len(names))[i + len(out)].as_py()
                    out.append(encode(raw, width))
                    size += len(raw)
                yield pa.record_batch([c.slice(i, len(out)) for c in b.columns[:-1]] + [pa.array(out, pa.binary())], names=[*names, "media"])
                i += len(out)

    return f


def as_tiff(rows: DataFrame, payload_col: str, keep: list[str], width: int = 64) -> DataFrame:
    """The columns named in keep and media: each payload (a positive multiple of width bytes) as a grey TIFF file."""
    own, names, kinds = kept_columns(rows, keep, ["media"])
    d = rows.select(*own, rows[payload_col].cast("binary").alias("_payload"))
    return d.mapInArrow(_encode(names, width), ", ".join([*kinds, "media binary"]))
