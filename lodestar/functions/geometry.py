"""Geometry and colour as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN becomes the lower end: it passes `least` and `greatest` otherwise."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.nanvl(x, F.lit(low))))


def quantise_u8(x: Column) -> Column:
    """0..1 to 0..255, truncated."""
    return (clamp(x) * 255).cast("int").cast("smallint")


def dequantise_u8(q: Column, signed: bool = False) -> Column:
    return q / 255.0 * 2 - 1 if signed else q / 255.0


def voxel_offset(x: Column, resolution: int) -> Column:
    """Where in its cell a coordinate of the unit box lies, 0..1."""
    return x * resolution - F.floor(x * resolution)


def pack_bits(*flags: Column) -> Column:
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))


def unpack_bit(packed: Column, i: int) -> Column:
    return F.shiftright(packed, i).bitwiseAND(F.lit(1)).cast("boolean")


def cell_truncated(c: Column, low: int, high: int) -> Column:
    """trunc((c + 0.5) / low * (high // 16))"""
    return ((c + 0.5) / low * (high // 16)).cast("int")


def cell_half_even(c: Column, low: int, high: int) -> Column:
    """Rounds half to even, as `rint` does and `round` does not."""
    return F.rint((c + 0.5) / low * (high // 16 - 1)).cast("int")


def voxel_centre(c: Column, size: float, origin: float) -> Column:
    return (c + 0.5) * size + origin


def radical_inverse(i: Column, base: int, digits: int = 32) -> Column:
    """The digits of i in a base, mirrored at the point."""
    state = F.struct(i.cast("bigint").alias("rest"), F.lit(0.0).alias("value"), F.lit(1.0 / base).alias("unit"))
    step = lambda s, _: F.struct(
        F.floor(s["rest"] / base).cast("bigint").alias("rest"), (s["value"] + F.pmod(s["rest"], F.lit(base)) * s["unit"]).alias("value"),
        (s["unit"] / base).alias("unit"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), state, step)["value"]


def hammersley(i: Column, n: int) -> tuple[Column, Column]:
    return i / F.lit(float(n)), radical_inverse(i, 2)


def sphere_direction(u: Column, v: Column, remap: bool = True) -> tuple[Column, Column]:
    """(yaw, pitch) of a point of the unit square; remap spreads the first third and the rest evenly."""
    if remap:
        u = F.when(u < 0.25, 2 * u).otherwise(2.0 / 3.0 * u + 1.0 / 3.0)
    return v * 2 * math.pi, F.acos(1 - 2 * u) - math.pi / 2


def camera_radius(k: Column) -> Column:
    """A distance whose inverse square is k."""
    return 1 / F.sqrt(k)


def fov_of_radius(radius: Column) -> Column:
    """The field of view that the unit cube's sphere fills from a distance."""
    return 2 * F.asin(F.lit(math.sqrt(3) / 2) / radius)


def focal_pixels(fov: Column, size: float) -> Column:
    return F.lit(size / 2) / F.tan(fov / 2)


def fov_of_focal(focal: Column, size: float) -> Column:
    return 2 * F.atan(F.lit(size / 2) / focal)


def project_pinhole(x: Column, y: Column, z: Column, focal: float, width: int, height: int) -> dict[str, Column]:
    """Pixels, depth and whether the point is in the frame, for a camera that looks down -z."""
    depth = -z + F.lit(1e-8)
    u, v = x / depth * focal + width / 2, -y / depth * focal + height / 2
    inside = (depth > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return {"u": u, "v": v, "depth": depth, "inside": inside}


def rotate(m: list[list[float]], v: tuple[Column, Column, Column], shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> list[Column]:
    """A constant 3x3 matrix (and shift) applied to a vector."""
    return [sum((F.lit(float(a)) * c for a, c in zip(row, v)), F.lit(0.0)) + s for row, s in zip(m, shift)]


def product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """A product of small constant matrices, worked out while the plan is built."""
    return [[sum(x * y for x, y in zip(row, col)) for col in zip(*b)] for row in a]


def transpose(a: list[list[float]]) -> list[list[float]]:
    """Of a rotation: its inverse."""
    return [list(r) for r in zip(*a)]


def view_align(camera: list[list[float]], new: list[list[float]], initial: list[list[float]], back: list[list[float]]) -> list[list[float]]:
    """The rotation back * (new * camera^-1) * initial of one view; cameras are rotations."""
    return product(back, product(product(new, transpose(camera)), initial))


def export_axes(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return -x, -z, -y


def face_normal(a, b, c) -> list[Column]:
    """Unit normal of a triangle, turned so that it looks away from the origin."""
    e, f = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
    n = [e[1] * f[2] - e[2] * f[1], e[2] * f[0] - e[0] * f[2], e[0] * f[1] - e[1] * f[0]]
    length = F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    away = F.when(sum((x * p for x, p in zip(n, a)), F.lit(0.0)) <= 0, -1.0).otherwise(1.0)
    return [F.when(length > 0, x / length * away).otherwise(0.0) for x in n]


def bounding_box(df: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Per group least, greatest and centre per axis, and the largest extent."""
    box = df.groupBy(*by).agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))
    box = box.withColumns({f"centre_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in axes})
    return box.withColumn("extent", F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes)))


def bilinear_weights(u: Column, v: Column, width: int, height: int) -> Column:
    """The four pixels around a place in -1..1 and their weights (border clamped, pixel centres)."""
    px, py = (u + 1) * (width / 2) - 0.5, (v + 1) * (height / 2) - 0.5
    x0, y0 = F.floor(px), F.floor(py)
    fx, fy = px - x0, py - y0
    inside = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    corners = [(0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)]
    return F.array(*(F.struct(inside(x0 + i, width).alias("px"), inside(y0 + j, height).alias("py"), w.alias("w")) for i, j, w in corners))


def aces(x: Column) -> Column:
    """The usual rational fit of the ACES film curve, clamped."""
    return clamp((x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14))


def gamma(x: Column, g: float = 2.2) -> Column:
    return F.pow(clamp(x), F.lit(1 / g))


def linear_to_srgb(x: Column) -> Column:
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055)


def blend_mode(alpha_mode: Column, has_alpha_texture: Column) -> Column:
    """Opaque materials with an alpha texture blend."""
    return F.when((alpha_mode == "OPAQUE") & has_alpha_texture, "BLEND").otherwise(alpha_mode)


def material_index(mat_id: Column, materials: Column) -> Column:
    """-1 stands for the last (default) material."""
    return F.when(mat_id == -1, F.size(materials) - 1).otherwise(mat_id)


def projection_matrix(fx: Column, fy: Column, cx: Column, cy: Column, near: float, far: float) -> Column:
    """Normalised intrinsics as a 4x4 clip matrix, row by row."""
    z = F.lit(0.0)
    depth = F.lit(far / (far - near))
    return F.array(
        2 * fx, z, 2 * cx - 1, z,
        z, -2 * fy, -2 * cy + 1, z,
        z, z, depth, F.lit(near * far / (near - far)),
        z, z, F.lit(1.0), z,
    )


def absolute_error(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def relative_error(a: Column, b: Column) -> Column:
    """The difference against the larger of both sizes; 0 where both are 0."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most > 0, F.abs(a - b) / most).otherwise(0.0)


def unit_vector(v: tuple[Column, Column, Column]) -> list[Column]:
    length = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    return [F.when(length > 0, c / length).otherwise(0.0) for c in v]


def scene_normalised(points: DataFrame, by: list[str]) -> DataFrame:
    """Scaled by 1 / the largest extent, then moved so that the box's centre is the origin."""
    box = bounding_box(points, by).where("extent > 0").select(*by, "extent", *(f"centre_{a}" for a in "xyz"))
    return points.join(box, by).withColumns({a: (F.col(a) - F.col(f"centre_{a}")) / F.col("extent") for a in "xyz"}).drop("extent", *(f"centre_{a}" for a in "xyz"))


def truth_view(x: Column, y: Column, z: Column, resolution: int) -> tuple[Column, Column, Column]:
    """Cells turned to the projection grid's axes: x, the negated z, y."""
    return x, F.lit(resolution - 1) - z, y


def scaled_centre(c: Column, resolution: int, scale: Column) -> Column:
    """A cell's centre in a unit cube that was shrunk by `scale`."""
    return ((c + 0.5) / resolution - 0.5) / scale
