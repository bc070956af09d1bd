"""Headers of MP4 files and images, of files made here."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions.temporal import fitted
from scorelake.sources import files, media


def box(kind, *inside, wide=False):
    body = b"".join(inside)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def clock(kind, units, length, wide=False):
    return box(kind, b"\1\0\0\0" + bytes(16) + struct.pack(">IQ", units, length) + bytes(4)) if wide else box(kind, bytes(12) + struct.pack(">II", units, length) + bytes(4))


def track(handler, runs, units=30000, size=(640, 360), sizes=True, wide=False):
    frames, length = sum(n for n, _ in runs), sum(n * d for n, d in runs)
    times = box(b"stts", bytes(4), struct.pack(">I", len(runs)), *[struct.pack(">II", *r) for r in runs])
    stbl = box(b"stbl", times, *([box(b"stsz", bytes(8), struct.pack(">I", frames), bytes(4 * frames))] if sizes else []))
    tkhd = box(b"tkhd", bytes(76), struct.pack(">II", size[0] << 16, size[1] << 16))
    return box(b"trak", tkhd, box(b"mdia", clock(b"mdhd", units, length, wide), box(b"hdlr", bytes(8), handler, bytes(12)), box(b"minf", stbl)))


def video(first=True, wide=False, **of):
    sound = track(b"soun", [(9, 1024)], 48000, (0, 0))
    moov = box(b"moov", clock(b"mvhd", 1000, 10010, wide), sound, track(b"vide", [(200, 1001), (100, 1001)], wide=wide, **of))
    mdat = box(b"mdat", bytes(5000), wide=wide)
    return box(b"ftyp", b"isom", bytes(4)) + (moov + mdat if first else mdat + moov)


def test_facts():
    want = (30000 / 1001, 300, 10.01, 640, 360)
    for first in (True, False):
        for wide in (True, False):
            for sizes in (True, False):
                assert media.video_facts(io.BytesIO(video(first, wide, sizes=sizes))) == pytest.approx(want)
    whole = video(False)
    assert media.video_facts(io.BytesIO(whole[:-4])) is None and media.video_facts(io.BytesIO(b"")) is None
    for end in range(0, len(whole), 97):  # a file that breaks off anywhere
        assert media.video_facts(io.BytesIO(whole[:end])) is None
    rng = np.random.default_rng(1)
    start = whole.index(b"moov") - 4
    for _ in range(300):  # broken bytes end nothing
        data = bytearray(whole)
        for at in rng.integers(start, start + 700, 4):
            data[at] = rng.integers(256)
        media.video_facts(io.BytesIO(bytes(data)))
    open_ended = bytearray(whole)
    open_ended[start : start + 4] = bytes(4)  # the last box may reach to the end
    assert media.video_facts(io.BytesIO(bytes(open_ended))) == pytest.approx(want)
    assert media.video_facts(io.BytesIO(box(b"moov", clock(b"mvhd", 1, 1), track(b"soun", [(1, 1)])))) is None
    assert media.video_facts(io.BytesIO(box(b"moov", clock(b"mvhd", 1, 1), track(b"vide", [])))) is None


def test_metadata(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x y.mp4").write_bytes(video())
    (tmp_path / "b.mp4").write_bytes(video(False, True))
    (tmp_path / "broken.mp4").write_bytes(video()[:300])
    (tmp_path / "empty.mp4").write_bytes(b"")
    listed = files.listing(spark, str(tmp_path), "*.mp4")
    paths = [(str(tmp_path / p),) for p in ("gone.mp4", "empty.mp4", "b.mp4", "b.mp4")] + [(None,)]  # listings are without empty files
    rows = listed.select("path").union(spark.createDataFrame(paths, "path string"))
    got = {r.path and r.path[len(str(tmp_path)) + 1 :]: r for r in media.video_metadata(rows).collect()}
    assert set(got) == {"a/x y.mp4", "b.mp4", "broken.mp4", "empty.mp4", "gone.mp4"}
    for name, r in got.items():
        good = name in ("a/x y.mp4", "b.mp4")
        assert [r.fps, r.frames, r.duration, r.width, r.height] == (pytest.approx([30000 / 1001, 300, 10.01, 640, 360]) if good else [None] * 5)
    samples = spark.createDataFrame([(1, str(tmp_path / "b.mp4")), (2, str(tmp_path / "broken.mp4")), (3, None)], "id long, path string")
    framed = {r.id: r.frame_indices for r in media.with_frames(samples, media.video_metadata(rows), 4).collect()}
    assert framed == {1: [0, 99, 199, 299], 2: None, 3: None}
    assert media.video_metadata(rows.limit(0)).count() == 0


def test_images(spark, tmp_path):
    rng = np.random.default_rng(2)
    made = {"wide": rng.integers(0, 256, (30, 90, 3)), "tall": rng.integers(0, 256, (64, 8, 4)), "small": rng.integers(0, 256, (5, 7, 3)), "line": rng.integers(0, 256, (1, 200, 3))}
    for name, pixels in made.items():
        (tmp_path / f"{name}.png").write_bytes(media.png(pixels.astype(np.uint8)))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nno image")
    read = media.images(spark, str(tmp_path))
    for r in read.collect():
        name = r.path.rsplit("/", 1)[1][:-4]
        if name == "broken":
            assert (r.error, r.width, r.pixels) == ("no image", None, None)
        else:
            assert r.error is None and (np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels) == made[name]).all()
    size = {r.path: r.f for r in read.filter("error is null").select("path", fitted(F.col("width"), F.col("height"), 32).alias("f")).collect()}
    small = media.resized(read, 32)
    for r in small.collect():
        if r.error is None:
            assert (r.width, r.height) == (max(1, size[r.path].width), max(1, size[r.path].height)) and r.content[:4] == b"\x89PNG"
        else:
            assert r.content is None
    samples = spark.createDataFrame([(1, str(tmp_path / "wide.png")), (2, str(tmp_path / "broken.png")), (3, str(tmp_path / "gone.png")), (4, None)], "id long, image_path string")
    got = {r.id: (r.error, r.content is not None) for r in media.with_images(samples, small).collect()}
    assert got == {1: (None, True), 2: ("no image", False), 3: ("missing", False), 4: ("missing", False)}


def test_means_of_areas():
    pixels = np.arange(6 * 4 * 1).reshape(6, 4, 1).astype(np.uint8)
    assert (media.shrunk(pixels, 3)[:, :, 0] == np.rint(pixels[:, :, 0].reshape(3, 2, 2, 2).mean((1, 3)))[:, : media.shrunk(pixels, 3).shape[1]]).all()
    assert media.shrunk(pixels, 6) is pixels
    flat = np.full((50, 31, 3), 77, np.uint8)
    assert (media.shrunk(flat, 13) == 77).all() and media.shrunk(flat, 13).shape == (13, 8, 3)
    assert media._weights(7, 3).sum(1) == pytest.approx([1, 1, 1])
