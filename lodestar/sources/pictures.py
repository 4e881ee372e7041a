"""PNG images with 8-bit channels: a scan-line decoder, square crops around what is visible, and resampling.

Decoded images, crops and resized images live in the batches of a task, one at a time.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Fixed values of the format: its signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png_bytes(image: np.ndarray) -> bytes:
    """A height x width x channels image of bytes; each line has the filter that makes its sum of absolute values least."""
    height, width, n = image.shape
    kind = next(k for k, c in CHANNELS.items() if c == n)
    before, lines = np.zeros(width * n, np.int64), []
    for row in image.reshape(height, -1).astype(np.int64):
        left, corner = np.append(np.zeros(n, np.int64), row[:-n]), np.append(np.zeros(n, np.int64), before[:-n])
        guesses = [0 * row, left, before, (left + before) // 2, _paeth(left, before, corner)]
        tried = [(row - g) % 256 for g in guesses]
        best = min(range(5), key=lambda f: int(np.minimum(tried[f], 256 - tried[f]).sum()))
        lines.append(bytes([best]) + tried[best].astype(np.uint8).tobytes())
        before = row
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, upper and corner the one nearest to a + b - c."""
    p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))


def decoded(content: bytes) -> np.ndarray:
    """A PNG of 8 bits a channel, without palette and interlacing, as height x width x channels."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], None
    while at < len(content):
        (size,) = struct.unpack(">I", content[at : at + 4])
        name, body = content[at + 4 : at + 8], content[at + 8 : at + 8 + size]
        if struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0] != zlib.crc32(name + body):
            raise ValueError(f"chunk {name.decode('latin1')} is damaged")
        if name == b"IHDR":
            width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or kind not in CHANNELS or interlaced:
                raise ValueError("only plain images of 8 bits a channel are read")
            shape = height, width, CHANNELS[kind]
        elif name == b"IDAT":
            data.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    height, width, n = shape
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width, n), np.int64)
    for y in range(height):
        out[y + 1] = _line(int(raw[y, 0]), raw[y, 1:].reshape(width, n).astype(np.int64), out[y])
    return out[1:].astype(np.uint8)


def _line(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A scan line without its filter."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0) % 256
    if kind == 2:
        return (line + above) % 256
    out, left, corner = np.empty_like(line), np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64)
    for x in range(len(line)):  # each pixel stands on the one before
        guess = (left + above[x]) // 2 if kind == 3 else _paeth(left, above[x], corner)
        left = out[x] = (line[x] + guess) % 256
        corner = above[x]
    return out


def visible_square(alpha: np.ndarray) -> tuple[int, int, int, int] | None:
    """left, top, right, bottom of the square about the box of pixels that aren't transparent; ends are truncated, the last
    ones left out. None if no pixel is visible."""
    ys, xs = alpha.nonzero()
    if not len(xs):
        return None
    half = max(int(xs.max()) - int(xs.min()), int(ys.max()) - int(ys.min())) / 2
    x, y = (int(xs.min()) + int(xs.max())) / 2, (int(ys.min()) + int(ys.max())) / 2
    return int(x - half), int(y - half), int(x + half), int(y + half)


def cropped(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part within the box; what lies beyond the image is transparent black."""
    left, top, right, bottom = box
    out = np.zeros((bottom - top, right - left, image.shape[2]), image.dtype)
    height, width = image.shape[:2]
    y0, y1, x0, x1 = max(top, 0), min(bottom, height), max(left, 0), min(right, width)
    if y0 < y1 and x0 < x1:
        out[y0 - top : y1 - top, x0 - left : x1 - left] = image[y0:y1, x0:x1]
    return out


@functools.lru_cache(256)
def resampling(n: int, size: int, lobes: int = 3) -> np.ndarray:
    """size x n weights of a Lanczos window, widened where the image shrinks; each row sums to 1."""
    scale = n / size
    at = (np.arange(n)[None, :] + 0.5 - (np.arange(size)[:, None] + 0.5) * scale) / max(scale, 1.0)
    weights = np.where(np.abs(at) < lobes, np.sinc(at) * np.sinc(at / lobes), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, size: int) -> np.ndarray:
    """size x size x channels, by rows and columns of weights; values stay within bytes, but are not rounded."""
    height, width, _ = image.shape
    across = np.einsum("iw,hwc->hic", resampling(width, size), image.astype(float))
    return np.clip(np.einsum("jh,hic->jic", resampling(height, size), across), 0, 255)


def conditioning(content: bytes, size: int) -> np.ndarray | None:
    """What of an RGBA image a model is shown: the visible square, resized, colours times alpha, channels first, 0 to 1."""
    image = decoded(content)
    if image.shape[2] != 4:
        raise ValueError("the image has no alpha channel")
    box = visible_square(image[:, :, 3])
    if box is None or box[0] >= box[2] or box[1] >= box[3]:
        return None
    small = resized(cropped(image, box), size) / 255
    return (small[:, :, :3] * small[:, :, 3:]).transpose(2, 0, 1)


def conditioning_images(files: DataFrame, size: int) -> DataFrame:
    """path, pixels (3 x size x size, flat) and error of PNG files (path, content); no pixels where less than two are visible."""
    ddl = "path string, pixels array<double>, error string"
    schema = _parse_datatype_string(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                row = {"path": path, "pixels": None, "error": None}
                try:
                    found = conditioning(content, size)
                    row["pixels"] = None if found is None else found.ravel().tolist()
                except (ValueError, struct.error, zlib.error, TypeError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return files.select("path", "content").mapInArrow(read, ddl)


def png_files(images: DataFrame, key: str, pixels: str, width: int, channels: int = 4) -> DataFrame:
    """key, png: images from flat arrays of numbers 0 to 255, line by line, pixel by pixel."""
    kind = images.schema[key].dataType.simpleString()
    schema = _parse_datatype_string(f"{key} {kind}, png binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = [png_bytes(np.array(x, np.uint8).reshape(-1, width, channels)) for x in batch.column(pixels).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.binary())], schema=arrow)

    return images.select(key, pixels).mapInArrow(write, f"{key} {kind}, png binary")
