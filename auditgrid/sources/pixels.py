"""Pixels in binary columns: sizes from file headers, RGB decoding, grey windows, PNG files.

Decoding runs in tasks over Arrow batches; what is made leaves a worker as soon as it
holds BATCH_BYTES, so a worker holds one batch of files and some megabytes of pixels,
and never more than ``max_bytes`` for one image.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20
MAX_BYTES = 1 << 28
#: Fixed values of the PNG format: its first bytes, and the samples of a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
IMAGE = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary())])
IMAGES = "images array<struct<width:int,height:int,rgb:binary>>"


def png_size(data: Column) -> Column:
    """width and height of a PNG file, read from its header; null for other bytes."""
    side = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).try_cast("int")
    known = F.hex(F.substring(data, 1, 8)) == SIGNATURE.hex().upper()
    return F.when(known, F.struct(side(17).alias("width"), side(21).alias("height")))


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += size + 12


def _nearest(left: int, up: int, corner: int) -> int:
    """Of three neighbours the one nearest to left + up - corner; ties in this order."""
    aim = left + up - corner
    return min((left, up, corner), key=lambda v: abs(aim - v))


def _lines(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """The samples of each line, with its prediction from the neighbours added back."""
    read = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line, above = read[y, 0], read[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y + 1] = line + above
        elif kind in (3, 4):
            now, up = [0] * (step + stride), [0] * step + above.tolist()
            for x, value in enumerate(line.tolist(), step):
                guess = (now[x - step] + up[x]) // 2 if kind == 3 else _nearest(now[x - step], up[x], up[x - step])
                now[x] = (value + guess) & 255
            out[y + 1] = now[step:]
        else:
            raise ValueError(f"unknown line filter {kind}")
    return out[1:]


def _png(data: bytes, max_bytes: int) -> np.ndarray:
    parts = list(_chunks(data))
    header = next((body for name, body in parts if name == b"IHDR"), b"")
    if len(header) != 13:
        raise ValueError("a PNG without header")
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    depth, colour, interlaced = header[8], header[9], header[12]
    if depth != 8 or colour not in SAMPLES or interlaced:
        raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlacing {interlaced} cannot be read here")
    if width * height * 3 > max_bytes:
        raise ValueError(f"image of {width} x {height} is over {max_bytes} bytes")
    step = SAMPLES[colour]
    size = height * (width * step + 1)
    raw = zlib.decompressobj().decompress(b"".join(body for name, body in parts if name == b"IDAT"), size)
    if len(raw) != size:
        raise ValueError("a PNG that ends early")
    samples = _lines(raw, height, width * step, step).reshape(height, width, step)
    if colour == 3:
        palette = np.frombuffer(next(body for name, body in parts if name == b"PLTE"), np.uint8).reshape(-1, 3)
        return palette[samples[:, :, 0]]
    return samples[:, :, :3] if step >= 3 else np.repeat(samples[:, :, :1], 3, axis=2)


def rgb(data: bytes, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """height x width x 3 of an image file; alpha is dropped.

    PNG of 8 bits a sample is read here; other formats need Pillow.
    """
    if data.startswith(SIGNATURE) and data[24:25] == b"\x08" and data[28:29] == b"\0":
        return _png(data, max_bytes)
    import io

    try:
        from PIL import Image
    except ImportError:
        raise ValueError("an image that is no PNG of 8 bits a sample, and no Pillow to read it") from None
    with Image.open(io.BytesIO(data)) as opened:
        if opened.width * opened.height * 3 > max_bytes:
            raise ValueError(f"image of {opened.width} x {opened.height} is over {max_bytes} bytes")
        return np.asarray(opened.convert("RGB"))


def narrow_batches(spark: SparkSession, rows: int = 256, size: int = BATCH_BYTES) -> None:
    """Lower the session's limits of an Arrow batch (they are never raised), so that a worker holds few files at a time."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"(-?\d+)([kmg]?)b?", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) << 10 * " kmg".index(now[2] or " ") <= most:
            spark.conf.set(key, str(most))


def _added(rows: DataFrame, taken: list[str], added: str, kind: pa.DataType, make: Callable[..., tuple[object, int]]) -> DataFrame:
    """The rows without ``taken`` and with one more column: ``make`` of the taken values gives its value and size."""
    narrow_batches(rows.sparkSession)
    name = added.split(" ", 1)[0]
    kept = [c for c in rows.columns if c not in (*taken, name)]
    schema = StructType(rows.select(kept).schema.fields + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, columns = batch.select(kept), [batch.column(c) for c in taken]
            start, made, held = 0, [], 0
            for at in range(batch.num_rows):
                value, size = make(*[c[at].as_py() for c in columns])
                made.append(value)
                held += size
                if held >= BATCH_BYTES or at == batch.num_rows - 1:
                    part = others.slice(start, len(made))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, kind)], names=[*kept, name])
                    start, made, held = at + 1, [], 0

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``images`` (files as bytes) decoded to width, height and rgb, in their order.

    Null lists and null files stay null; a file that cannot be read, or that would be
    larger than ``max_bytes``, is an error.
    """

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        pixels = rgb(data, max_bytes)
        return {"width": pixels.shape[1], "height": pixels.shape[0], "rgb": pixels.tobytes()}

    def make(files: list[bytes | None] | None) -> tuple[object, int]:
        found = None if files is None else [one(f) for f in files]
        return found, sum(len(f["rgb"]) for f in found or () if f)

    return _added(rows, ["images"], IMAGES, pa.list_(IMAGE), make)


def grey_values(pixels: np.ndarray, centre: float | None, width: float | None, inverted: bool, low: float, high: float) -> np.ndarray:
    """Grey values 0 .. 255 of a window, halves rounded to even.

    The window is centre - width / 2 .. centre + width / 2; without a centre or a width
    above 0 it lies between two percentiles of the image's own values.  A window of no
    width (an image of one value) is black.
    """
    if pixels.size == 0:
        return np.zeros(0, np.uint8)
    if centre is None or width is None or not width > 0:
        first, last = np.percentile(pixels, (low, high))
    else:
        first, last = centre - width / 2, centre + width / 2
    if not last > first:
        return np.zeros(pixels.shape, np.uint8)
    grey = np.rint(np.clip((pixels - first) / (last - first), 0, 1) * 255).astype(np.uint8)
    return 255 - grey if inverted else grey


def windowed_pixels(rows: DataFrame, low: float = 1.0, high: float = 99.0, dtype: str = "<u2") -> DataFrame:
    """Replace pixels, centre, window, inverted by ``grey``: a byte for each pixel.

    ``pixels`` are the image's values as bytes of ``dtype``; null pixels give null.
    """

    def make(pixels: bytes | None, centre: float | None, window: float | None, inverted: bool | None) -> tuple[object, int]:
        if pixels is None:
            return None, 0
        grey = grey_values(np.frombuffer(pixels, dtype).astype(np.float64), centre, window, bool(inverted), low, high)
        return grey.tobytes(), grey.size

    return _added(rows, ["pixels", "centre", "window", "inverted"], "grey binary", pa.binary(), make)


def png_file(grey: bytes, width: int, height: int) -> bytes:
    """A grey PNG of 8 bits."""
    if len(grey) != width * height or not grey:
        raise ValueError(f"{len(grey)} pixels are not {width} x {height}")

    def chunk(name: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")

    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(grey, np.uint8).reshape(height, width)
    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes((8, 0, 0, 0, 0))
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def as_png(rows: DataFrame) -> DataFrame:
    """Replace grey, width and height by ``bytes``: the image as a PNG file; null pixels give null."""

    def make(grey: bytes | None, width: int | None, height: int | None) -> tuple[object, int]:
        made = None if grey is None else png_file(grey, width, height)
        return made, len(made or b"")

    return _added(rows, ["grey", "width", "height"], "bytes binary", pa.binary(), make)
