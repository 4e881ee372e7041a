import struct
import zlib

import numpy as np
import pytest

from lodestar.sources import pictures


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_images_come_back_as_they_were(channels):
    rng = np.random.default_rng(channels)
    smooth = (np.add.outer(np.arange(23) * 7, np.arange(17) * 5)[..., None] + np.arange(channels) * 40) % 256
    for image in (rng.integers(0, 256, (23, 17, channels)), smooth, np.zeros((1, 1, channels))):
        image = image.astype(np.uint8)
        assert (pictures.decoded(pictures.png_bytes(image)) == image).all()


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    """Lines are filtered pixel by pixel here, as the format says."""
    rng = np.random.default_rng(7)
    image = rng.integers(0, 256, (5, 6, 3))
    body = b""
    for y in range(5):
        line = []
        for x in range(6):
            for c in range(3):
                a = int(image[y, x - 1, c]) if x else 0
                b = int(image[y - 1, x, c]) if y else 0
                d = int(image[y - 1, x - 1, c]) if x and y else 0
                near = min((a, b, d), key=lambda v: (abs(a + b - d - v), (a, b, d).index(v)))
                line.append((int(image[y, x, c]) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        body += bytes([kind, *line])
    data = zlib.compress(body)
    chunk = lambda name, part: struct.pack(">I", len(part)) + name + part + struct.pack(">I", zlib.crc32(name + part))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0))
    # the data in two chunks, with one that is not known between
    whole = pictures.SIGNATURE + head + chunk(b"IDAT", data[:7]) + chunk(b"tEXt", b"note") + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")
    assert (pictures.decoded(whole) == image).all()


def test_damaged_and_other_images_are_told(spark):
    good = pictures.png_bytes(np.full((4, 4, 4), 255, np.uint8))
    none = pictures.png_bytes(np.zeros((4, 4, 4), np.uint8))
    grey = pictures.png_bytes(np.full((4, 4, 1), 9, np.uint8))
    rows = [("good", good), ("none", none), ("grey", grey), ("text", b"no image"), ("bad", good[:40] + b"x" + good[41:]), ("empty", b"")]
    found = {r["path"]: r for r in pictures.conditioning_images(spark.createDataFrame(rows, "path string, content binary"), 2).collect()}
    assert found["good"]["pixels"] == pytest.approx([1.0] * 12) and found["good"]["error"] is None
    assert found["none"]["pixels"] is None and found["none"]["error"] is None
    assert "no alpha" in found["grey"]["error"] and "not a PNG" in found["text"]["error"] and "not a PNG" in found["empty"]["error"]
    assert "damaged" in found["bad"]["error"]


def test_the_square_about_what_is_visible():
    alpha = np.zeros((10, 12), int)
    assert pictures.visible_square(alpha) is None
    alpha[2, 3] = alpha[5, 9] = 1  # 6 wide, 3 high, about (6, 3.5)
    assert pictures.visible_square(alpha) == (3, 0, 9, 6)
    alpha[9, 3] = 1  # 7 high, 6 wide
    assert pictures.visible_square(alpha) == (2, 2, 9, 9)
    out = pictures.cropped(np.ones((4, 4, 1)), (-1, -2, 3, 2))
    assert out.shape == (4, 4, 1) and out.sum() == 6 and out[2:, 1:].sum() == 6


def test_resampling_keeps_constants_and_identity():
    assert np.allclose(pictures.resampling(7, 7), np.eye(7))
    for n, size in ((3, 8), (50, 4), (5, 5), (1, 3)):
        assert np.allclose(pictures.resized(np.full((n, n, 2), 77.0), size), 77.0)
    line = np.arange(40.0)[None, :, None].repeat(40, axis=0)
    assert np.allclose(pictures.resized(line, 10)[5, 2:-2, 0], np.arange(10)[2:-2] * 4 + 1.5, atol=0.1)
