"""TIFF: exact round trips through every codec, predictor and layout; broken files."""

import random
import struct

import numpy as np
import pytest

from textlattice.llm import tiff as T


def build(px, order="<", kind=T.NONE, predictor=1, tile=None, strip_rows=2, planar=1, next_at=0, base=0):
    """One directory with its data from offset base on, written independently of encode()."""
    h, w, spp = px.shape
    bits = px.dtype.itemsize * 8
    blocks = []
    planes = [px[:, :, k : k + 1] for k in range(spp)] if planar == 2 else [px]
    for p in planes:
        bh, bw = tile or (strip_rows, w)
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = p[y : y + bh, x : x + bw]
                if tile:
                    full = np.zeros((bh, bw, p.shape[2]), px.dtype)
                    full[: part.shape[0], : part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1, part.shape[2]), px.dtype))
                blocks.append(T.deflate(kind, part.astype(px.dtype.newbyteorder(order)).tobytes()))
    tags = [(T.WIDTH, 3, [w]), (T.LENGTH, 4, [h]), (T.SAMPLE_BITS, 3, [bits] * spp), (T.COMPRESSION, 3, [kind]), (T.SAMPLES, 3, [spp]), (T.PLANAR, 3, [planar]), (T.PREDICTOR, 3, [predictor])]
    at_tag, size_tag = (T.TILE_AT, T.TILE_SIZE) if tile else (T.STRIP_AT, T.STRIP_SIZE)
    tags += [(T.TILE_WIDTH, 3, [tile[1]]), (T.TILE_LENGTH, 3, [tile[0]])] if tile else [(T.STRIP_ROWS, 3, [strip_rows])]
    data_at, starts = base, []
    for b in blocks:
        starts.append(data_at)
        data_at += len(b)
    tags = sorted(tags + [(at_tag, 4, starts), (size_tag, 4, [len(b) for b in blocks])])
    body, extra, extra_at = b"", b"", data_at + 2 + 12 * len(tags) + 4
    for tag, t, values in tags:
        raw = struct.pack(f"{order}{len(values)}{T.TYPES[t]}", *values)
        if len(raw) > 4:
            body += struct.pack(f"{order}HHII", tag, t, len(values), extra_at + len(extra))
            extra += raw
        else:
            body += struct.pack(f"{order}HHI", tag, t, len(values)) + raw.ljust(4, b"\0")
    ifd = struct.pack(order + "H", len(tags)) + body + struct.pack(order + "I", next_at)
    return b"".join(blocks) + ifd + extra, data_at


def file(px, order="<", **k):
    data, at = build(px, order, base=8, **k)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + data


@pytest.mark.parametrize("kind", [T.NONE, T.PACKBITS, T.LZW, T.DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (4, 6)])
def test_round_trip(kind, order, tile):
    rng = np.random.default_rng(3)
    for dtype in (np.uint8, np.uint16):
        for spp, planar in ((1, 1), (3, 1), (3, 2)):
            for predictor in (1, 2):
                px = rng.integers(0, 7, (9, 13, spp)).astype(dtype) * (1 if dtype == np.uint8 else 300)
                (p,) = T.pages(file(px, order, kind=kind, predictor=predictor, tile=tile, planar=planar))
                assert p.get("error") is None and p["pixels"] == px.astype(px.dtype.newbyteorder("<")).tobytes()


@pytest.mark.parametrize("code", [(T.packbits, T.unpackbits), (T.lzw, T.unlzw)])
def test_codecs(code):
    rnd = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 300, 5000, 60_000):
        for alphabet in (1, 2, 5, 256):
            b = bytes(rnd.randrange(alphabet) for _ in range(n))
            assert code[1](code[0](b), n) == b


def test_pages_and_broken_files():
    a, b = np.full((3, 4, 1), 5, np.uint8), np.full((2, 2, 1), 9, np.uint8)
    first, at = build(a, base=8)
    second, at2 = build(b, base=8 + len(first))
    first, at = build(a, base=8, next_at=at2)
    both = b"II" + struct.pack("<HI", 42, at) + first + second
    assert [(p["page"], p["pixels"]) for p in T.pages(both)] == [(0, b"\5" * 12), (1, b"\x09" * 4)]
    loop, at = build(a, base=8)
    loop, _ = build(a, base=8, next_at=at)
    assert len(list(T.pages(b"II" + struct.pack("<HI", 42, at) + loop))) == 1
    for bad in (None, b"", b"II*", b"JUNKJUNK", both[:20], both[: at + 9], file(a, kind=T.DEFLATE)[:12] + b"\0\0\0" + file(a, kind=T.DEFLATE)[15:]):
        rows = list(T.pages(bad))
        assert rows[-1].get("error") and rows[-1].get("pixels") is None


def test_encode_and_operator(spark):
    rnd = random.Random(4)
    rows = [(k, bytes(rnd.randrange(256) for _ in range(64 * n))) for k, n in enumerate([1, 2, 255, 256, 257, 3000])] + [(9, bytes(64)), (9, bytes(64))]
    d = spark.createDataFrame(rows, "id long, raw binary")
    out = T.tiff_pages(T.as_tiff(d, "raw", ["id"]), "media", ["id"]).collect()
    assert sorted((r.id, bytes(r.pixels)) for r in out) == sorted(rows)
    assert all(r.page == 0 and r.error is None and r.width == 64 and len(r.feature) == 16 for r in out)
    broken = T.tiff_pages(spark.createDataFrame([(1, None), (2, b"x")], "id long, media binary"), "media", ["id"]).collect()
    assert all(r.page == 0 and r.error for r in broken) and len(broken) == 2
    clash = T.tiff_pages(T.as_tiff(d.selectExpr("id", "raw", "'x' AS media", "id AS page", "'k' AS error"), "raw", ["id", "media", "page", "error"]).withColumnRenamed("media_in", "kept"), "media", ["id", "kept", "page", "error"])
    assert clash.columns[:4] == ["id", "kept", "page_in", "error_in"] and sorted(r.page_in for r in clash.collect()) == sorted(r[0] for r in rows)
    none = spark.createDataFrame([], "id long, raw binary")
    assert T.tiff_pages(T.as_tiff(none, "raw", ["id"]), "media", ["id"]).collect() == []


def test_numbers_of_pages_that_cannot_be_read():
    first, at = build(np.full((3, 4, 1), 5, np.uint8), base=8)
    first, at = build(np.full((3, 4, 1), 5, np.uint8), base=8, next_at=10**6)  # the second directory lies outside the file
    out = list(T.pages(b"II" + struct.pack("<HI", 42, at) + first))
    assert [(p["page"], "error" in p) for p in out] == [(0, False), (1, True)]
    assert [(p["page"], p["error"]) for p in T.pages(b"II" + struct.pack("<HI", 42, 0))] == [(0, "no image directory")]


def test_registered_query_equals_brute_force(spark, tmp_path):
    import zlib
    from hashlib import sha256

    from textlattice.llm.queries import op2_media_columns

    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 40_000, "x" * 64]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' AS media", "1 AS page").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op2_media_columns(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = T.encode(payload, 64)
        (page,) = T.pages(media)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), sha256(media).hexdigest(), page["feature"]) and page["pixels"] == payload


def paged(*pages_):
    """Little-endian file of one-strip pages: (width, rows, bits, samples, compression, predictor, bytes)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for w, h, bits, spp, kind, predictor, raw in pages_:
        body = T.deflate(kind, raw)
        at = len(out)
        out += body + b"\0" * (len(body) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = {T.WIDTH: w, T.LENGTH: h, T.SAMPLE_BITS: bits, T.COMPRESSION: kind, T.STRIP_AT: at, T.SAMPLES: spp, T.STRIP_ROWS: h, T.STRIP_SIZE: len(body), T.PREDICTOR: predictor}
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def test_small_samples_floats_and_pages_after_a_bad_one():
    floats = np.array([[1.5, -2.25, 3e9], [0.0, 7.0, 1e-20]], "<f4")
    planes = floats.astype(">f4").view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    coded = np.diff(planes, axis=1, prepend=np.zeros((2, 1), np.uint8)).astype(np.uint8)
    b = paged(
        (10, 2, 1, 1, T.PACKBITS, 1, bytes([0b10110000, 0b01000000, 0b00000001, 0b11000000])),
        (3, 1, 4, 1, T.NONE, 1, bytes([0x1F, 0x70])),
        (4, 4, 8, 1, T.NONE, 9, bytes(16)),
        (3, 2, 32, 1, T.DEFLATE, 3, coded.tobytes()),
        (5, 1, 2, 1, T.LZW, 1, bytes([0b00011011, 0b11000000])),
    )
    out = list(T.pages(b))
    assert [p["page"] for p in out] == [0, 1, 2, 3, 4] and [k for k, p in enumerate(out) if p.get("error")] == [2]
    assert list(out[0]["pixels"]) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1]
    assert list(out[1]["pixels"]) == [1, 15, 7] and list(out[4]["pixels"]) == [0, 1, 2, 3, 3]
    assert out[3]["pixels"] == floats.tobytes()
