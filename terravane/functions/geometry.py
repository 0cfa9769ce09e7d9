"""Geometry as Column expressions: vectors, cameras, polygons and small statistics.

Vectors are ARRAY<DOUBLE>; 3x3 matrices are row-major arrays of nine. Everything here is a built-in
expression, so that Catalyst sees through it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def c(x: str | float | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def no_nan(x: str | Column) -> Column:
    """NaN and infinities as null: the only form of a missing number inside the engine."""
    x = c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def items(arr: str | Column, n: int) -> list[Column]:
    return [c(arr)[i] for i in range(n)]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> list[Column]:
    n = norm(a)
    return [F.try_divide(x, n) for x in a]


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    return F.least(F.greatest(x, c(lo)), c(hi))


# ---- cameras ---------------------------------------------------------------------------------------


def camera_centre(r: str | Column, t: str | Column) -> Column:
    """-R^T t."""
    m, v = items(r, 9), items(t, 3)
    return F.array(*(-(m[i] * v[0] + m[3 + i] * v[1] + m[6 + i] * v[2]) for i in range(3)))


def to_camera(p: Vec, r: str | Column, t: str | Column) -> list[Column]:
    m, v = items(r, 9), items(t, 3)
    return [m[3 * i] * p[0] + m[3 * i + 1] * p[1] + m[3 * i + 2] * p[2] + v[i] for i in range(3)]


def from_camera(p: Vec, r: str | Column, t: str | Column, r1: str | Column | None = None) -> Column:
    """World point of a camera point; r1 first undoes a rectifying rotation (point row vector times r1)."""
    if r1 is not None:
        m = items(r1, 9)
        p = [p[0] * m[j] + p[1] * m[3 + j] + p[2] * m[6 + j] for j in range(3)]
    m, v = items(r, 9), items(t, 3)
    q = [a - b for a, b in zip(p, v, strict=True)]
    return F.array(*(q[0] * m[j] + q[1] * m[3 + j] + q[2] * m[6 + j] for j in range(3)))


def distort(x: Column, y: Column, dist: Sequence[Column]) -> tuple[Column, Column]:
    """Radial (k1, k2, k3) and tangential (p1, p2) distortion; dist is (k1, k2, p1, p2, k3)."""
    k1, k2, p1, p2, k3 = dist
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def project(p: Vec, r: str | Column, t: str | Column, k: str | Column, dist: str | Column | None = None) -> tuple[Column, Column, Column]:
    """Pixel (u, v) and depth of a world point; null pixels where the depth is 0."""
    q = to_camera(p, r, t)
    x, y = F.try_divide(q[0], q[2]), F.try_divide(q[1], q[2])
    if dist is not None:
        x, y = distort(x, y, items(dist, 5))
    m = items(k, 9)
    return m[0] * x + m[1] * y + m[2], m[4] * y + m[5], q[2]


def undistort(u: Column, v: Column, k: str | Column, dist: str | Column | None = None, steps: int = 5) -> tuple[Column, Column]:
    """Normalized coordinates of a pixel: the inverse of K, exact without distortion, else a fixed number of fixed-point steps."""
    m = items(k, 9)
    y0 = (v - m[5]) / m[4]
    x0 = (u - m[2] - m[1] * y0) / m[0]
    if dist is None:
        return x0, y0
    k1, k2, p1, p2, k3 = items(dist, 5)
    start = F.struct(x0.alias("x"), y0.alias("y"))

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        r2 = x * x + y * y
        icd = 1 / (1 + r2 * (k1 + r2 * (k2 + r2 * k3)))
        return F.struct(((x0 - (2 * p1 * x * y + p2 * (r2 + 2 * x * x))) * icd).alias("x"), ((y0 - (p1 * (r2 + 2 * y * y) + 2 * p2 * x * y)) * icd).alias("y"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return s["x"], s["y"]


def distortion_vector(model: str | Column, params: str | Column) -> Column:
    """(k1, k2, p1, p2, k3) of a camera model; zeros for models without or of unknown distortion."""
    p, z = c(params), F.lit(0.0)
    name = c(model)
    return (
        F.when(name == "SIMPLE_RADIAL", F.array(p[3], z, z, z, z))
        .when(name == "RADIAL", F.array(p[3], p[4], z, z, z))
        .when(name == "OPENCV", F.array(p[4], p[5], p[6], p[7], z))
        .when(name == "FULL_OPENCV", F.array(p[4], p[5], p[6], p[7], p[8]))
        .otherwise(F.array(z, z, z, z, z))
    )


def intrinsics(model: str | Column, params: str | Column) -> Column:
    """K of a camera model: one focal length and centre, or two focal lengths."""
    p, z, one = c(params), F.lit(0.0), F.lit(1.0)
    single = c(model).isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    return F.when(single, F.array(p[0], z, p[1], z, p[0], p[2], z, z, one)).otherwise(F.array(p[0], z, p[2], z, p[1], p[3], z, z, one))


def look_at(eye: Vec, target: Vec, up: Vec) -> tuple[Column, Column]:
    """(R, t) of a camera at eye that looks at target."""
    f = unit([b - a for a, b in zip(eye, target, strict=True)])
    right = unit(cross(f, up))
    down = cross(f, right)
    rows = [right, down, f]
    return F.array(*(x for row in rows for x in row)), F.array(*(-dot(row, eye) for row in rows))


def ray_angle(x: Vec, a: Vec, b: Vec) -> Column:
    """Degrees between the rays from point x to two camera centres."""
    p, q = unit([i - j for i, j in zip(a, x, strict=True)]), unit([i - j for i, j in zip(b, x, strict=True)])
    return F.degrees(F.acos(clip(dot(p, q), -1.0, 1.0)))


def residual(u: Column, v: Column, px: Column, py: Column) -> Column:
    return F.hypot(u - px, v - py)


# ---- ground frame ----------------------------------------------------------------------------------


def ground_basis(up: Vec) -> tuple[list[Column], list[Column], list[Column]]:
    """(up, e1, e2): up normalized, e1 the X axis (Y where X is too close to up) made orthogonal, e2 = up x e1."""
    n = unit(up)
    steep = F.abs(n[0]) > 0.9
    seed = [F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0), F.lit(0.0)]
    d = dot(seed, n)
    e1 = unit([s - d * x for s, x in zip(seed, n, strict=True)])
    return n, e1, cross(n, e1)


def ground_coords(p: Vec, up: Vec, e1: Vec, e2: Vec) -> tuple[Column, Column, Column]:
    return dot(p, e1), dot(p, e2), dot(p, up)


def pixel_to_ground(col: Column, row: Column, u0: Column, v0: Column, res: Column) -> tuple[Column, Column]:
    return u0 + col * res, v0 + row * res


def ground_to_pixel(u: Column, v: Column, u0: Column, v0: Column, res: Column) -> tuple[Column, Column]:
    return (u - u0) / res, (v - v0) / res


def plane_coords(p: Vec, centre: Vec, normal: Vec, b1: Vec, b2: Vec) -> tuple[Column, Column, Column]:
    """(u, v, h): in-plane coordinates and the signed height."""
    q = [a - b for a, b in zip(p, centre, strict=True)]
    return dot(q, b1), dot(q, b2), dot(q, normal)


# ---- polygons: ARRAY<STRUCT<x, y>>, implicitly closed ----------------------------------------------


def roll(poly: str | Column) -> Column:
    """Every vertex's successor, cyclically."""
    p = c(poly)
    return F.when(F.size(p) > 0, F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))).otherwise(p)


def edges(poly: str | Column) -> Column:
    return F.zip_with(c(poly), roll(poly), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def polygon_area(poly: str | Column) -> Column:
    """Shoelace area."""
    return F.abs(total(F.transform(edges(poly), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2


def perimeter(poly: str | Column) -> Column:
    return total(F.transform(edges(poly), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])))


def side_lengths(poly: str | Column) -> Column:
    return F.transform(edges(poly), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def point_in_polygon(x: Column, y: Column, poly: str | Column) -> Column:
    """Parity of the edges that a ray to the right crosses; an edge owns its lower end. Null for null points."""
    crossed = F.filter(edges(poly), lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (y - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])))
    return F.when(x.isNotNull() & y.isNotNull(), F.size(crossed) % 2 == 1)


def boundary_distance(x: Column, y: Column, poly: str | Column) -> Column:
    """Distance to the nearest edge; a zero-length edge counts as its vertex."""

    def one(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        s = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        s = clip(s, 0.0, 1.0)
        return F.hypot(x - e["x1"] - s * dx, y - e["y1"] - s * dy)

    return F.array_min(F.transform(edges(poly), one))


Polygon = Sequence[tuple[float, float]]


def _sides(polygon: Polygon) -> list[tuple[float, float, float, float]]:
    p = [(float(x), float(y)) for x, y in polygon]
    return [(*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)]


def _between(x: Column, lo: float, hi: float) -> Column:
    return (x >= lo) & (x <= hi)


def in_polygon(x: Column, y: Column, polygon: Polygon) -> Column:
    """point_in_polygon() for a polygon known when the query is planned: a sum over its sides without lambdas, behind a test of its bounding box. False for null points."""
    sides = [(x1, y1, x2, y2) for x1, y1, x2, y2 in _sides(polygon) if y1 != y2]
    if not sides:
        return F.lit(False)
    xs, ys = [s[0] for s in sides] + [s[2] for s in sides], [s[1] for s in sides] + [s[3] for s in sides]
    # An edge owns its lower end: the ray crosses those with min(y1, y2) <= y < max(y1, y2).
    crossed = sum((((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)))).cast("int") for x1, y1, x2, y2 in sides), F.lit(0))
    box = _between(x, min(xs), max(xs)) & _between(y, min(ys), max(ys))
    return F.coalesce(F.when(box, crossed % 2 == 1).otherwise(False), F.lit(False)) & x.isNotNull() & y.isNotNull()


def side_distance(x: Column, y: Column, polygon: Polygon) -> Column:
    """boundary_distance() for a polygon known when the query is planned."""

    def squared(x1: float, y1: float, x2: float, y2: float) -> Column:
        dx, dy = x2 - x1, y2 - y1
        size = dx * dx + dy * dy
        if size == 0:
            return (x - x1) * (x - x1) + (y - y1) * (y - y1)
        s = clip(((x - x1) * dx + (y - y1) * dy) / size, 0.0, 1.0)
        u, v = x - x1 - s * dx, y - y1 - s * dy
        return u * u + v * v

    each = [squared(*side) for side in _sides(polygon)]
    return F.sqrt(F.least(*each) if len(each) > 1 else each[0])


def in_band(x: Column, y: Column, polygon: Polygon, inner: float, outer: float) -> Column:
    """Whether the distance to the boundary is in inner..outer; far points are told by the bounding box. False for null points."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    box = _between(x, min(xs) - outer - 1e-9, max(xs) + outer + 1e-9) & _between(y, min(ys) - outer - 1e-9, max(ys) + outer + 1e-9)
    return F.coalesce(F.when(box, _between(side_distance(x, y, polygon), inner, outer)).otherwise(False), F.lit(False))


def as_point(p: Column) -> Column:
    """STRUCT<x, y> of a VARIANT that is [x, y] or {x, y}."""
    get = lambda path: F.try_variant_get(p, path, "double")
    return F.struct(F.coalesce(get("$.x"), get("$[0]")).alias("x"), F.coalesce(get("$.y"), get("$[1]")).alias("y"))


# ---- measures --------------------------------------------------------------------------------------


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bits_to_long(bits: str | Column) -> Column:
    """64 booleans, first one highest, as BIGINT."""
    return F.aggregate(c(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("long")))


def dhash_bits(grid: str | Column, rows: int = 8, cols: int = 9) -> Column:
    """Row-major bits (right brighter than left) of a grid of rows x cols values."""
    g = c(grid)
    return F.array(*(g[i * cols + j + 1] > g[i * cols + j] for i in range(rows) for j in range(cols - 1)))


def slope_degrees(gx: Column, gy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(gx, gy)))


def relative_error(err: Column) -> Column:
    return clip(err, 0.005, 0.5)


def volume_error(sigma: Column, area: Column, net: Column, rel: Column) -> Column:
    """sigma * area; where a relative scale error is known and not 0, plus 2 * rel * |net|."""
    return sigma * area + F.when(rel.isNotNull() & (rel != 0), 2 * rel * F.abs(net)).otherwise(0.0)


def level_of_detection(sigma: Column) -> Column:
    return 1.96 * F.greatest(sigma, F.lit(1e-6))


def voxel_for_cap(voxel: Column, n: Column, most: int = 2_500_000) -> Column:
    """A voxel size that brings n points under the cap."""
    return F.when(n > most, voxel * F.sqrt(n / F.lit(float(most)))).otherwise(voxel)


def capped_voxel(voxel: float, n: int, most: int = 2_500_000) -> float:
    """voxel_for_cap() of plain numbers."""
    return voxel * (n / most) ** 0.5 if n > most else voxel


def quadratic_terms(u: Column, v: Column, s: Column) -> list[Column]:
    x, y = u / s, v / s
    return [F.lit(1.0), x, y, x * x, y * y, x * y]


SWELL = (1.0, 1.2, 1.25, 1.4)
