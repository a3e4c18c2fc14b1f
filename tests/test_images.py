"""Literal goldens, round trips and faults of the image operators; every query against its SQL."""

import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import __main__ as cli
from tesserae.operators import alpha, demux, mux, vp8, vp8_frame, vp8_header, vp8_tables, vp8l
from tesserae.operators.errors import CATEGORIES, ImageError
from tesserae.plans import registry
from tesserae.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = sql.sql(registry.SQL[name])
    assert sorted(want.columns) == names
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    got = order(tuple(r) for r in df.select(*names).collect())
    assert got == order(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


def test_frame_tag_of_long_partitions(spark, tmp_path):
    """i05 against its SQL for lengths that one tag holds just, no more, and for the longest of all."""
    path = str(tmp_path / "part.parquet")
    keys = [0, 1, 74898, 74899, 74900, 119999, 1199999, 2**36, 2**63 // 7]
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").write.parquet(path)
    got = registry.QUERIES["i05_frame_tag"](spark, str(tmp_path)).select("img_id", "key_frame", "version", "shown", "first_partition").collect()
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{path}/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.SQL["i05_frame_tag"]).fetchall()) and len(got) == len(keys)


def chunk(tag: bytes, payload: bytes) -> bytes:
    return tag + len(payload).to_bytes(4, "little") + payload + b"\0" * (len(payload) & 1)


def riff(*chunks: bytes) -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def head(w, h, a=0):
    return b"\x2f" + ((w - 1) | (h - 1) << 14 | a << 28).to_bytes(4, "little")


def vp8x(flags, w, h):
    return chunk(b"VP8X", bytes([flags, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))


def anmf(x, y, w, h, *inner):
    return chunk(b"ANMF", b"".join(v.to_bytes(3, "little") for v in (x, y, w - 1, h - 1, 40)) + b"\x03" + b"".join(inner))


IMAGE, ANIM = chunk(b"VP8L", head(4, 4)), chunk(b"ANIM", bytes(6))


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (riff(IMAGE), None),
        (riff(chunk(b"abcd", b"x"), IMAGE), None),
        (riff(IMAGE, chunk(b"EXIF", b"x")), "InvalidSimpleChunk"),
        (riff(chunk(b"EXIF", b"x")), "MissingExtendedHeader"),
        (riff(), "MissingImageData"),
        (riff(vp8x(0, 4, 4), IMAGE, IMAGE), "DuplicateImageData"),
        (riff(vp8x(0, 4, 4), vp8x(0, 4, 4), IMAGE), "DuplicateChunk"),
        (riff(vp8x(0, 5, 4), IMAGE), "InvalidFeatureFlags"),
        (riff(vp8x(0x20, 4, 4), IMAGE, chunk(b"ICCP", b"x")), "InvalidChunkOrder"),
        (riff(vp8x(0x08, 4, 4), IMAGE, chunk(b"EXIF", b"x"), chunk(b"EXIF", b"x")), "DuplicateMetadata"),
        (riff(vp8x(0x08, 4, 4), IMAGE), "MissingRequiredChunk"),
        (riff(vp8x(0, 4, 4), IMAGE, chunk(b"XMP ", b"x")), "InvalidFeatureFlags"),
        (riff(vp8x(0, 4, 4), chunk(b"ANIM", b"xx"), IMAGE), None),
        (riff(vp8x(2, 9, 9), anmf(0, 0, 4, 4, IMAGE)), "MissingAnimationControl"),
        (riff(vp8x(2, 9, 9), ANIM), "MissingImageData"),
        (riff(vp8x(2, 9, 9), ANIM, anmf(0, 0, 4, 4, IMAGE), anmf(2, 2, 4, 4, IMAGE)), None),
        (riff(vp8x(2, 9, 9), ANIM, anmf(3, 0, 4, 4, IMAGE)), "InvalidFrameChunk"),
        (riff(vp8x(2, 9, 9), ANIM, anmf(0, 0, 4, 4)), "MissingImageData"),
        (riff(vp8x(2, 9, 9), ANIM, anmf(0, 0, 4, 4, chunk(b"abcd", b""), IMAGE)), "InvalidFrameChunk"),
        (riff(chunk(b"VP8X", b"123"), IMAGE), "InvalidExtendedHeaderSize"),
        (b"", "InputTooSmall"),
    ],
)
def test_demux_faults(data, error):
    assert demux.describe(data, demux.Limits()).get("error") == error


def test_limits():
    two = riff(vp8x(2, 9, 9), ANIM, anmf(0, 0, 4, 4, IMAGE), anmf(0, 0, 4, 4, IMAGE))
    assert demux.describe(two, demux.Limits(frames=1))["error"] == "FrameCountTooLarge"
    assert demux.describe(two, demux.Limits(chunks=5))["error"] == "TooManyChunks"
    assert demux.describe(riff(IMAGE), demux.Limits(pixels=15))["error"] == "CanvasTooLarge"
    assert demux.describe(two, demux.Limits(animation_pixels=80))["error"] == "CanvasTooLarge" and "error" not in demux.describe(two, demux.Limits(pixels=1))
    assert sum(map(len, CATEGORIES.values())) == 50


def test_any_bytes_give_a_row():
    rng = np.random.default_rng(3)
    good = riff(chunk(b"VP8L", vp8l.write_image(rng.integers(0, 1 << 32, (5, 5)))))
    for _ in range(300):
        bad = bytearray(good)
        for _ in range(rng.integers(1, 5)):
            bad[rng.integers(len(bad))] = rng.integers(256)
        out = vp8l.decode_static(bytes(bad[: rng.integers(1, len(bad) + 1)]))
        assert "error" in out or out["width"] > 0


def test_checkerboard_hash():
    y, x = np.mgrid[:16, :16]
    board = np.where((x + y) % 2 == 0, 0xFF0000FF, 0x80FF0000)
    for green in (False, True):
        rgba = vp8l.swizzle(vp8l.decode(vp8l.write_image(board, green)), "rgba")
        assert hashlib.sha256(rgba).hexdigest() == "c6b88b3e6e3d60d8260a5f3d66d39b93fd650750ce8a1abe05130c09e5859b32"


def test_lossless_vectors():
    """Inputs and results of the format's rules, pixel by pixel."""
    one = lambda *p: np.array([[p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]]])
    assert vp8l.planes(vp8l.undo_color(one(7, 10, 5, 20), one(255, 32, 64, 32), 2))[0, 0].tolist() == [7, 15, 5, 45]
    assert vp8l.planes(vp8l.undo_color(one(7, 1, 64, 20), one(255, 0, 0, 255), 2))[0, 0].tolist() == [7, 255, 64, 20]
    tens = np.full((2, 3), 0x0A0000)
    tens[0, 0] = 0x0A0000
    modes = np.array([[7 << 8]])
    red = vp8l.planes(vp8l.undo_predictor(tens, modes, 2).astype(np.int64))[..., 1].tolist()
    assert red == [[10, 20, 30], [20, 30, 40]]
    packed = vp8l.undo_palette(np.array([[0x3900]]), np.array([5, 6, 7, 8]), 2, 3)
    assert packed.tolist() == [[6, 7, 8]]
    assert vp8l.undo_palette(np.array([[0xFF00]]), np.array([5, 6, 7]), 2, 1).tolist() == [[0]]
    with pytest.raises(ImageError, match="InvalidVP8LTransform"):
        vp8l.undo_predictor(tens, np.array([[14 << 8]]), 2)
    with pytest.raises(ImageError, match="InvalidHuffmanTree"):
        vp8l.Code([1, 2])
    assert vp8l.distance_of(1, 10) == 10 and vp8l.distance_of(4, 1) == 1 and vp8l.distance_of(121, 9) == 1


def test_back_reference():
    """A literal and a copy that overlaps itself: lone symbols can't hold two kinds, so green has two of one bit."""
    out = vp8l.BitWriter().put(0x2F, 8).put(4, 14).put(0, 14).put(1, 1).put(0, 3).put(0, 1).put(0, 1).put(0, 1)
    lengths = [0] * 280
    lengths[9] = lengths[259] = 1
    out.put(0, 1).put(12 - 4, 4)
    for s in vp8l.LENGTH_ORDER[:12]:  # two code lengths, 0 and 1, of one bit each
        out.put(1 if s in (0, 1) else 0, 3)
    out.put(0, 1)
    for n in lengths:
        out.put(n, 1)
    for symbol in (3, 4, 255, 1):  # red, blue, alpha and distance are lone symbols
        out.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)
    out.put(0, 1).put(1, 1)  # literal; copy of four, distance code 2: one to the left
    counts = {}
    assert vp8l.decode(out.done(), counts=counts).tolist() == [[0xFF030904] * 5]
    assert counts == {"pixels": 5, "literals": 1, "copies": 1, "cache_hits": 0}


def test_alpha_vectors():
    """Fixed values, and round trips."""
    p = lambda v, w: np.array(v, np.uint8).reshape(-1, w)
    assert alpha.unfilter(p([1, 2, 3, 4], 2), 1).ravel().tolist() == [1, 3, 4, 8]
    assert alpha.unfilter(p([200, 100], 2), 1).ravel().tolist() == [200, 44]
    rng = np.random.default_rng(1)
    for kind in range(4):
        plane = rng.integers(0, 256, (5, 7)).astype(np.uint8)
        assert (alpha.unfilter(alpha.filtered(plane, kind), kind) == plane).all()
    assert alpha.header(0b00010101) == (1, 1, 1)
    for bad in (0b01000000, 0b10, 0b100000):
        with pytest.raises(ImageError):
            alpha.header(bad)


def test_lossy_vectors(spark):
    """Coefficients and samples with their results."""
    lit = [F.lit(v).cast("long") for v in (8, *[0] * 15)]
    neg = [F.lit(v).cast("long") for v in (-13, *[0] * 15)]
    c1 = [F.lit(v).cast("long") for v in (0, 100, *[0] * 14)]
    w = [F.lit(v).cast("long") for v in (64, *[0] * 15)]
    w9 = [F.lit(v).cast("long") for v in (-9, *[0] * 15)]
    row = spark.range(1).select(*[F.array(*f(v)) for f, v in ((vp8.inverse_dct, lit), (vp8.inverse_dct, neg), (vp8.inverse_dct, c1), (vp8.inverse_wht, w), (vp8.inverse_wht, w9))]).first()
    assert row[0] == [1] * 16 and row[1] == [-2] * 16 and row[2] == [16, 7, -7, -16] * 4 and row[3] == [8] * 16 and row[4] == [-1] * 16
    corner, above, left = F.lit(10), [F.lit(v) for v in (20, 30, 40, 50, 60, 70, 80, 90)], [F.lit(v) for v in (100, 110, 120, 130)]
    got = spark.range(1).select(F.array(*vp8.subblock("dc", corner, above, left)), F.array(*vp8.subblock("horizontal_up", corner, above, left))).first()
    assert got[0] == [75] * 16 and got[1][-1] == 130


def test_bool_coder():
    rng = np.random.default_rng(5)
    bits = [(int(rng.random() < 0.3), int(rng.integers(1, 256))) for _ in range(2000)]
    writer = vp8.BoolWriter()
    for b, p in bits:
        writer.put(b, p)
    reader = vp8.BoolReader(writer.done())
    assert [reader.get(p) for _, p in bits] == [b for b, _ in bits]
    with pytest.raises(ImageError, match="TruncatedBitstream"):
        for _ in range(100):
            reader.get()
    carry = vp8.BoolWriter()  # a carry through bytes that are already out
    for _ in range(6000):
        carry.put(1, 1)
    for bit in (0, 1) * 3000:
        carry.put(bit, 200)
    reader = vp8.BoolReader(carry.done())
    assert all(reader.get(1) for _ in range(6000)) and [reader.get(200) for _ in range(6000)] == [0, 1] * 3000


ALL_TRANSFORMS = ((), ("green",), ("palette",), ("predictor",), ("color",), ("predictor", "color", "green"), ("palette", "predictor"), ("green", "color", "predictor"))


@pytest.mark.parametrize("transforms", ALL_TRANSFORMS, ids="-".join)
def test_streams(transforms):
    """What is written comes back, with every part of the format in use."""
    seen = {"pixels": 0, "literals": 0, "copies": 0, "cache_hits": 0}
    for (h, w, colors), (cache, groups) in itertools.product(((1, 1, 1), (8, 8, 2), (17, 33, 3), (20, 50, 12), (40, 21, 200), (31, 64, 4096)), ((0, 0), (7, 0), (0, 2), (11, 3), (1, 0))):
        if "palette" in transforms and colors > 256:
            continue
        y, x = np.mgrid[:h, :w]
        img = 2654435761 * (4928 + (x // 3 + 5 * (y // 2)) % colors) & 0xFFFFFFFF
        for copies in (True, False):
            payload, counts = vp8l.write_stream(img, transforms, cache, groups, 2 + cache % 3, copies), {}
            assert (vp8l.decode(payload, counts=counts) == img).all() and vp8l.summary(payload) == counts
            for k, v in counts.items():
                seen[k] += v
            assert copies or not counts["copies"]
            if h > 8 and copies:
                with pytest.raises(ImageError):
                    vp8l.decode(payload[: len(payload) // 2])
    assert min(seen.values()) > 100


def test_large_image_and_budget():
    y, x = np.mgrid[:512, :512]
    img = 2654435761 * (1 + (x // 5 + 7 * (y // 3)) % 1000) & 0xFFFFFFFF
    payload = vp8l.write_stream(img, ("predictor", "color", "green"), 10, 4, 5)
    assert (vp8l.decode(payload) == img).all()
    data = riff(chunk(b"VP8L", payload))
    n = 512 * 512
    assert vp8l.decode_static(data)["width"] == 512
    assert vp8l.decode_static(data, demux.Limits(allocation=16 * n + 1028))["error"] == "AllocationLimitExceeded"  # nothing left for prefix tables
    assert vp8l.decode_static(data, demux.Limits(pixels=n - 1))["error"] == "CanvasTooLarge"
    with pytest.raises(ImageError, match="OutputTooLarge"):
        vp8l.BitWriter(most=4).put(1, 30).put(1, 3)
    assert vp8l.BitWriter(most=4).put(5, 32).done() == b"\5\0\0\0"


LOSSY = vp8_tables.formula_tables()


def macroblocks(r, n, segments):
    out = []
    for _ in range(n):
        luma = r.choice((*vp8.FULL_MODES, "subblocks", "subblocks"))
        own = tuple(r.choice(vp8.SUBBLOCK_MODES) for _ in range(16)) if luma == "subblocks" else ()
        m = vp8_frame.Macroblock(luma, r.choice(vp8.FULL_MODES), own, r.randrange(4) if segments else 0, r.random() < 0.2)
        for b in range(25) if not m.skip else ():
            values = [r.choice((1, -1, 2, -3, 4, 6, -10, 30, -66, 67, r.randint(-2048, 2048))) if r.random() < 0.3 else 0 for _ in range(16)]
            if 0 < b < 17 and luma != "subblocks":
                values[0] = 0
            if any(values) and (b or luma != "subblocks") and r.random() < 0.6:
                m.coefficients[b] = values
        out.append(m)
    return out


def plain_frame(w, h, records, factors):
    """Sample by sample, from a dict of finished samples."""
    columns = (w + 15) // 16
    planes = []
    for plane, n in ((0, 16), (1, 8), (2, 8)):
        done = {}

        def at(x, y, done=done):
            return 127 if y < 0 else 129 if x < 0 else done[x, y]

        for i, m in enumerate(records):
            x0, y0 = i % columns * n, i // columns * n
            c = vp8_frame.dequantised(m, factors[m.segment])
            step = lambda b, c=c: vp8.inverse_dct(c[b].tolist(), vp8.NUMBERS)
            mode = m.chroma if plane else m.luma
            if mode == "subblocks":
                for k, sub in enumerate(m.subblocks):
                    x, y = x0 + k % 4 * 4, y0 + k // 4 * 4
                    beyond = [at(x + 4 + j, y - 1) for j in range(4)] if k % 4 < 3 else [at(x0 + 16 + j, y0 - 1) if y0 == 0 or x0 + 16 < 16 * columns else at(x0 + 15, y0 - 1) for j in range(4)]
                    above = [at(x + j, y - 1) for j in range(4)] + beyond
                    p, res = vp8.subblock(sub, at(x - 1, y - 1), above, [at(x - 1, y + j) for j in range(4)], vp8.NUMBERS), step(1 + k)
                    for j in range(16):
                        done[x + j % 4, y + j // 4] = max(0, min(255, p[j] + res[j]))
                continue
            above, left, corner = [at(x0 + j, y0 - 1) for j in range(n)], [at(x0 - 1, y0 + j) for j in range(n)], at(x0 - 1, y0 - 1)
            edges = (above if y0 else []) + (left if x0 else [])
            flat = (sum(edges) + len(edges) // 2) // len(edges) if edges else 128
            new = {}
            for y in range(n):
                for x in range(n):
                    p = {"dc": flat, "vertical": above[x], "horizontal": left[y], "true_motion": max(0, min(255, left[y] + above[x] - corner))}[mode]
                    b = 1 + y // 4 * 4 + x // 4 if not plane else (17, 21)[plane - 1] + y // 4 * 2 + x // 4
                    new[x0 + x, y0 + y] = max(0, min(255, p + step(b)[y % 4 * 4 + x % 4])) if c[b].any() else p
            done |= new
        planes.append(done)
    return planes


def test_frames():
    """A lone skipped macroblock is 128 all over, one predicted from above the frame 127."""
    mb = vp8_frame.Macroblock
    one = vp8_frame.decode_frame(vp8_frame.write_frame(16, 16, [mb(skip=True)], LOSSY), LOSSY)
    assert all((p == 128).all() for p in one.planes) and len(one.yuv()) == 384
    two = vp8_frame.decode_frame(vp8_frame.write_frame(32, 16, [mb(skip=True), mb("vertical", skip=True)], LOSSY), LOSSY)
    assert (two.planes[0][:, 16:] == 127).all() and (two.planes[0][:, :16] == 128).all()
    r = random.Random(3)
    for trial in range(12):
        w, h = r.randint(1, 60), r.randint(1, 50)
        records = macroblocks(r, ((w + 15) // 16) * ((h + 15) // 16), trial % 2)
        q, deltas = r.randrange(128), tuple(r.randint(-15, 15) for _ in range(5))
        more = {"segments": [r.randint(-20, 100) for _ in range(4)], "absolute": trial % 4 == 1, "map_probs": [r.choice((255, 100, 30)) for _ in range(3)]} if trial % 2 else {}
        payload = vp8_frame.write_frame(w, h, records, LOSSY, q, deltas, log2_parts=trial % 4, updates={r.randrange(1056): r.randint(1, 255) for _ in range(5)}, **more)
        got = vp8_frame.decode_frame(payload, LOSSY)
        assert got.records == records
        index = [(v if more["absolute"] else q + v) for v in more["segments"]] if more else [q] * 4
        for p, want in zip(got.planes, plain_frame(w, h, records, [vp8.factor_values(i, list(deltas)) for i in index]), strict=True):
            assert all(p[y, x] == v for (x, y), v in want.items()) and len(want) == p.size
        for cut in (4, 12, len(payload) // 3, len(payload) - 40):
            try:
                vp8_frame.decode_frame(payload[:cut], LOSSY)
            except ImageError as e:
                assert e.name in ("InvalidVP8Header", "TruncatedBitstream")


def test_frames_as_rows(spark, tmp_path):
    good = vp8_frame.write_frame(17, 3, [vp8_frame.Macroblock(skip=True)] * 2, LOSSY)
    rows = spark.createDataFrame([(1, good), (2, good[:9]), (3, None), (4, good[:6] + bytes(4) + good[10:])], "k long, payload binary")
    out = {r.k: r for r in vp8_frame.decode_frames(rows, "k", LOSSY).collect()}
    assert (out[1].luma_stride, out[1].chroma_stride, len(out[1].y), len(out[1].yuv), len(out[1].records)) == (32, 16, 512, 17 * 3 + 2 * 9 * 2, 2)
    assert [out[k].error for k in (2, 3, 4)] == ["InvalidVP8Header", "InvalidVP8Header", "InvalidCanvasSize"] and out[2].category == "bitstream"
    lines = [(n, i, v) for n in ("coefficients", "updates", "subblocks") for i, v in enumerate(getattr(LOSSY, n))]
    spark.createDataFrame(lines, "name string, position int, value int").write.csv(str(tmp_path / "tables"))
    assert vp8_tables.read_tables(spark, str(tmp_path / "tables")) == LOSSY
    with pytest.raises(ValueError, match="updates"):
        vp8_tables.Tables(LOSSY.coefficients, (), LOSSY.subblocks)


def test_header_fields():
    payload = vp8_header.write_header(5, 6, [3, -4, 5, -6], 7, 1, 2, 9, [1, 0, -2, 0, 3], absolute=False, strengths=[0, 5, -6, 63], map_probs=[255, 9, 0], deltas=[1, -2, 0, 4, 0, 0, -63, 8])
    got = vp8_header.read_header(payload)
    assert (got["quant"], got["absolute"], got["strength"], got["map_probs"], got["deltas"], got["q_deltas"]) == ([3, -4, 5, -6], False, [0, 5, -6, 63], [255, 9, 0], [1, -2, 0, 4, 0, 0, -63, 8], [1, 0, -2, 0, 3])
    assert (got["width"], got["height"], got["level"], got["sharpness"], got["partitions"], got["base_q"], got["new_map"]) == (5, 6, 7, 1, 4, 9, True)


def test_mux():
    bits, lossy = head(4, 4), b"\x10\0\0\x9d\x01\x2a\4\0\4\0"
    still = lambda **more: mux.Still(**({"width": 4, "height": 4, "lossless": True, "bitstream": bits} | more))
    assert mux.encode_static(still()) == riff(IMAGE)
    assert mux.encode_static(still(force_extended=True)) == riff(vp8x(0, 4, 4), IMAGE) and mux.remux(riff(IMAGE), force_extended=True) == riff(vp8x(0, 4, 4), IMAGE)
    full = still(icc=b"i", exif=b"e", xmp=b"", unknown=[(b"abcd", b"u")])
    assert mux.encode_static(full) == riff(vp8x(0x2C, 4, 4), chunk(b"ICCP", b"i"), IMAGE, chunk(b"EXIF", b"e"), chunk(b"XMP ", b""), chunk(b"abcd", b"u")) and full.chunk_count() == 6
    plane = chunk(b"ALPH", bytes(17))
    with_alpha = {"lossless": False, "bitstream": lossy, "alpha": bytes(17)}
    assert mux.encode_static(still(**with_alpha)) == riff(vp8x(0x10, 4, 4), plane, chunk(b"VP8 ", lossy))
    assert mux.remux(riff(vp8x(0x10, 4, 4), chunk(b"ALPH", b"\xc0" + bytes(16)), chunk(b"VP8 ", lossy), chunk(b"wxyz", b""))) == riff(vp8x(0x10, 4, 4), plane, chunk(b"VP8 ", lossy), chunk(b"wxyz", b""))
    for fault, more in (
        ("InvalidCanvasSize", {"width": 0}), ("CanvasTooLarge", {"width": 1 << 24, "height": 2}), ("InvalidMuxChunk", {"width": 5}), ("InvalidMuxChunk", {"unknown": [(b"EXIF", b"")]}), ("InvalidMuxChunk", {"alpha": bytes(17)}),
        ("InvalidMuxChunk", {"has_alpha": True}), ("InvalidVP8LHeader", {"bitstream": b"no"}), ("MissingRequiredChunk", {"lossless": False, "bitstream": lossy, "has_alpha": True}), ("InvalidAlphaChunk", with_alpha | {"alpha": b"\x40" + bytes(16)}), ("InvalidAlphaChunk", with_alpha | {"alpha": bytes(16)}),
    ):
        with pytest.raises(ImageError) as e:
            mux.encode_static(still(**more))
        assert e.value.name == fault, more
    for fault, limits in (("TooManyChunks", demux.Limits(chunks=1)), ("AllocationLimitExceeded", demux.Limits(allocation=40))):
        with pytest.raises(ImageError, match=fault):
            mux.encode_static(still(force_extended=True), limits)
    with pytest.raises(ImageError, match="UnsupportedAnimationMux"):
        mux.remux(riff(vp8x(2, 9, 9), ANIM, anmf(0, 0, 4, 4, IMAGE)))


def test_files(spark, tmp_path):
    (tmp_path / "a.webp").write_bytes(riff(IMAGE))
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "long.webp").write_bytes(bytes(100))
    assert [r.length for r in files.image_files(spark, str(tmp_path), most=50).select("length").collect()] == [26]
    rows = spark.createDataFrame([("b", "rgba", "2" * 64), ("a", "alpha", "1" * 64)], "file string, kind string, sha256 string")
    files.write_manifest(rows, str(tmp_path / "m"))
    again = files.manifest(spark, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in again.collect()) == [("a", "alpha", "1" * 64), ("b", "rgba", "2" * 64)]
    assert {r.status for r in files.verify_manifest(again, rows).collect()} == {"ok"}
    lines = spark.createDataFrame([("# note",), ("",), ("a\tb",), ("a\tvideo\t" + "0" * 64,), ("../a\trgba\t" + "0" * 64,), ("a\trgba\tx",), ("a\trgba\t" + "0" * 64,)], "value string")
    assert sorted(str(r.error) for r in files.manifest_lines(lines).collect()) == ["None", "fields", "hash", "kind", "path"]
    lines.write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="bad manifest line"):
        files.manifest(spark, str(tmp_path / "bad")).collect()


def test_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.yuv", b"123"), ("../y", b"1"), ("z", None)], "file string, content binary")
    out = {r.file: (r.bytes, r.error) for r in files.sink(rows, f"file://{tmp_path}/out").collect()}
    assert out == {"a/x.yuv": (3, None), "../y": (None, "InvalidCorpusPath"), "z": (None, "MissingImageData")}
    assert (tmp_path / "out/a/x.yuv").read_bytes() == b"123" and not (tmp_path / "y").exists()


def test_modes(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    board = np.arange(12).reshape(3, 4) * 0x01020304
    (src / "a.webp").write_bytes(riff(chunk(b"VP8L", vp8l.write_stream(board))))
    frame = vp8_frame.write_frame(4, 3, [vp8_frame.Macroblock(skip=True)], LOSSY)
    (src / "b.webp").write_bytes(riff(vp8x(0x10, 4, 3), chunk(b"ALPH", b"\0" + bytes(range(12))), chunk(b"VP8 ", frame)))
    (src / "c.webp").write_bytes(b"RIFF")
    lines = [(n, i, v) for n in ("coefficients", "updates", "subblocks") for i, v in enumerate(getattr(LOSSY, n))]
    spark.createDataFrame(lines, "name string, position int, value int").write.csv(str(tmp_path / "tables"))
    mode = lambda *a: cli.run(spark, *(str(x) for x in a))
    assert {r.file: (r.format, r.error) for r in mode("probe", src)[0].collect()} == {"a.webp": ("lossless", None), "b.webp": ("lossy", None), "c.webp": (None, "InputTooSmall")}
    for name in ("decode", "alpha", "remux"):
        assert mode(name, src, f"file://{out}/{name}")[0].where("error is null").count() == {"decode": 1, "alpha": 1, "remux": 2}[name]
    mode("yuv", src, f"file://{out}/yuv", tmp_path / "tables")[0].collect()
    assert (out / "decode/a.pam").read_bytes().endswith(vp8l.swizzle(board, "rgba")) and (out / "alpha/b.alpha").read_bytes() == bytes(range(12)) and (out / "yuv/b.yuv").read_bytes() == bytes([128]) * 20
    mode("hash", src, out / "m")
    assert mode("verify", src, out / "m")[1] and mode("compare", out / "remux", src)[0].first() == (2, 0, 1, False)
    (src / "c.webp").unlink()
    assert mode("compare", out / "remux", src)[1]
    (src / "a.webp").write_bytes(riff(chunk(b"VP8L", vp8l.write_stream(board + 1))))
    assert not mode("verify", src, out / "m")[1] and not mode("compare", out / "remux", src)[1]


def test_kernels_need_no_package_on_executors(tmp_path):
    """What is pickled for the workers loads and runs in a process that can't import the package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tesserae import decode_frame, remux
    from tesserae.operators import vp8l
    from tesserae.operators.errors import ImageError
    from tesserae.operators.vp8_tables import formula_tables

    def kernel():
        out = []
        for call in (lambda: decode_frame(b"", formula_tables()), lambda: remux(b""), lambda: vp8l.decode_static(b"")):
            try:
                call()
            except ImageError as e:
                out.append(e.name)
        return out

    (tmp_path / "kernel").write_bytes(cloudpickle.dumps(kernel))
    program = "import importlib.util, pickle; assert importlib.util.find_spec('tesserae') is None; print(pickle.load(open('kernel', 'rb'))())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == str(kernel()) and len(kernel()) >= 2
