"""Media as tables: what the headers of MP4 files say, and images by Spark's image source, scaled down.

A video's frames aren't decoded. An MP4 file is a row of boxes (size, type, contents), some of which hold boxes in turn; the box `moov`, before or after the pictures, tells the number, times and sizes of all frames.
A task seeks from box to box, so of a file of any length it reads a few hundred bytes, and up to one table of times.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.temporal import linspace_frames
from scorelake.sources.files import plain_path

FACTS = "fps double, frames long, duration double, width int, height int"
#: Bytes of a box of times that are read at once.
PIECE = 1 << 20


# ---- boxes ----


def _boxes(file: io.IOBase, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of contents, end) of the boxes between two places; ValueError where a box doesn't fit."""
    while start < end:
        file.seek(start)
        head = file.read(16)
        if len(head) < 8 or end - start < 8:
            raise ValueError("cut off")
        size, kind, inside = int.from_bytes(head[:4], "big"), head[4:8], start + 8
        if size == 1:
            if len(head) < 16:
                raise ValueError("cut off")
            size, inside = int.from_bytes(head[8:], "big"), start + 16
        stop = end if size == 0 else start + size
        if stop < inside or stop > end:
            raise ValueError("a box reaches over its parent")
        yield kind, inside, stop
        start = stop


def _path(file: io.IOBase, start: int, end: int, *kinds: bytes) -> tuple[int, int]:
    """The contents of the first box of the first kind, of the first of the second kind in it, and so on; KeyError if there is none."""
    for kind in kinds:
        start, end = next(((a, b) for k, a, b in _boxes(file, start, end) if k == kind), (-1, -1))
        if start < 0:
            raise KeyError(kind)
    return start, end


def _numbers(file: io.IOBase, at: int, form: str) -> tuple[int, ...]:
    file.seek(at)
    return struct.unpack(form, file.read(struct.calcsize(form)))


def _clock(file: io.IOBase, start: int) -> tuple[int, int]:
    """(units a second, length in units) of a box mvhd or mdhd, in either version."""
    wide = _numbers(file, start, ">B")[0] == 1
    return _numbers(file, start + (20 if wide else 12), ">IQ" if wide else ">II")


def _times(file: io.IOBase, start: int, end: int) -> tuple[int, int]:
    """(frames, units) that a box of times adds up to."""
    entries = _numbers(file, start + 4, ">I")[0]
    if start + 8 + 8 * entries > end:
        raise ValueError("cut off")
    file.seek(start + 8)
    frames = units = 0
    left = 8 * entries
    while left:
        piece = file.read(min(left, PIECE))
        if not piece or len(piece) % 8:
            raise ValueError("cut off")
        counts, lasting = np.frombuffer(piece, ">u4").reshape(-1, 2).astype("u8").T
        frames += int(counts.sum())
        units += int((counts * lasting).sum())
        left -= len(piece)
    return frames, units


def video_facts(file: io.IOBase) -> tuple[float, int, float, int, int] | None:
    """(frames a second, frames, seconds, width, height) of a file's first video track; None for a file that isn't whole, isn't MP4 or has no such track, or whose frames are told piece by piece."""
    try:
        end = file.seek(0, io.SEEK_END)
        moov = _path(file, 0, end, b"moov")
        per_second, length = _clock(file, _path(file, *moov, b"mvhd")[0])
        for kind, *track in _boxes(file, *moov):
            if kind != b"trak":
                continue
            mdia = _path(file, *track, b"mdia")
            file.seek(_path(file, *mdia, b"hdlr")[0] + 8)
            if file.read(4) != b"vide":
                continue
            units, _ = _clock(file, _path(file, *mdia, b"mdhd")[0])
            frames, lasting = _times(file, *_path(file, *mdia, b"minf", b"stbl", b"stts"))
            sizes = next(((a, b) for k, a, b in _boxes(file, *_path(file, *mdia, b"minf", b"stbl")) if k == b"stsz"), None)
            told = _numbers(file, sizes[0] + 8, ">I")[0] if sizes else frames
            if not (frames and told and units and lasting):
                return None
            at = _path(file, *track, b"tkhd")[1] - 8
            width, height = _numbers(file, at, ">II")
            seconds = length / per_second if per_second and length else lasting / units
            return frames * units / lasting, told, seconds, width >> 16, height >> 16
    except (ValueError, KeyError, struct.error):
        return None
    return None


# ---- tables ----


def _opened(path: str) -> io.IOBase:
    """A file of any file system that pyarrow knows by its address, with seeks that fetch no more than is read."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path.replace("file:/", "/", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(inside)


def video_metadata(files: DataFrame, column: str = "path") -> DataFrame:
    """(column, fps, frames, duration, width, height) for each different path of a column; nulls for files that are broken, missing or no MP4. A null path has no row.

    Paths alone are shuffled, so that the files of a folder are read by all tasks; a lost task reads its headers again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for path in part[column]:
                try:
                    with _opened(path) as file:
                        found.append(video_facts(file) or (None,) * 5)
                except (OSError, ValueError):  # pyarrow's errors are of these two
                    found.append((None,) * 5)
            facts = pd.DataFrame(found, columns=["fps", "frames", "duration", "width", "height"], index=part.index)
            yield pd.concat([part, facts.astype({"fps": "float64", "frames": "Int64", "duration": "float64", "width": "Int32", "height": "Int32"})], axis=1)

    paths = files.select(column).filter(F.col(column).isNotNull()).distinct()
    return paths.mapInPandas(run, f"`{column}` string, {FACTS}").withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("fps", "duration")})


def with_frames(samples: DataFrame, metadata: DataFrame, n: int, column: str = "path", out: str = "frame_indices") -> DataFrame:
    """samples with their video's facts and n evenly spaced frame numbers, null for samples whose video can't be read."""
    met = samples.join(metadata, column, "left")
    return met.withColumn(out, F.when(F.col("frames").isNotNull(), linspace_frames(F.col("frames").cast("int"), n)))


def images(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, width, height, channels, pixels, error) of the files under a folder, by Spark's image source; pixels are rows from the top, each pixel blue, green, red (and alpha).
    A file that is no image has an error and nulls."""
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    good = F.col("image.width") > 0
    value = lambda c: F.when(good, F.col(f"image.{c}"))
    return read.select(
        plain_path(F.col("image.origin")).alias("path"), value("width").alias("width"), value("height").alias("height"), value("nChannels").alias("channels"), value("data").alias("pixels"), F.when(good, None).otherwise("no image").alias("error"),
    )


def _weights(n: int, m: int) -> np.ndarray:
    """(m, n): which share of each of n cells a row of m equal cells takes, as means."""
    edges = np.arange(m + 1) * (n / m)
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(n)[None, :]
    return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) * (m / n)


def shrunk(pixels: np.ndarray, largest: int) -> np.ndarray:
    """An image (height, width, channels) scaled down by means of areas, so that its longer side is at most largest; sides are those of temporal.fitted, one at least."""
    height, width = pixels.shape[:2]
    if max(height, width) <= largest:
        return pixels
    scale = largest / max(height, width)
    rows, columns = _weights(height, max(1, int(height * scale))), _weights(width, max(1, int(width * scale)))
    return np.rint(np.einsum("hy,yxc->hxc", rows, np.einsum("wx,yxc->ywc", columns, pixels.astype(float)))).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """An image in grey, blue-green-red or blue-green-red-alpha as a PNG file."""
    height, width, channels = pixels.shape
    ordered = pixels if channels == 1 else pixels[:, :, [2, 1, 0, 3][:channels]]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(ordered).reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def resized(pictures: DataFrame, largest: int = 512) -> DataFrame:
    """pictures, as images gives them, with the size after scaling in width and height, and content, a PNG file, in place of channels and pixels; nulls for those with an error.
    content can be the media of a request to a model."""

    @F.pandas_udf("width int, height int, content binary")
    def made(width: pd.Series, height: pd.Series, channels: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        out = []
        for w, h, c, data in zip(width, height, channels, pixels, strict=True):
            small = None if data is None else shrunk(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(c)), largest)
            out.append((None, None, None) if small is None else (small.shape[1], small.shape[0], png(small)))
        return pd.DataFrame(out, columns=["width", "height", "content"]).astype({"width": "Int32", "height": "Int32"})

    others = [c for c in pictures.columns if c not in ("width", "height", "channels", "pixels", "error")]
    done = pictures.withColumn("made", made("width", "height", "channels", "pixels"))
    return done.select(*others, *[F.when(F.col("error").isNull(), F.col(f"made.{c}")).alias(c) for c in ("width", "height", "content")], "error")


def with_images(samples: DataFrame, pictures: DataFrame, column: str = "image_path") -> DataFrame:
    """samples with the content of the picture at their path, and error: that of the picture, or `missing`."""
    held = pictures.select(F.col("path").alias(column), "width", "height", "content", F.col("error").alias("picture_error"), F.lit(True).alias("there"))
    met = samples.join(held, column, "left")
    return met.withColumn("error", F.when(F.col("there").isNull(), "missing").otherwise(F.col("picture_error"))).drop("there", "picture_error")

