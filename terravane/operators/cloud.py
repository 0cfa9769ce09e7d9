"""Cloud aggregates: voxels, grids, the orthophoto raster and simple statistics.

A cloud is a table (point_id, x, y, z[, r, g, b]); further key columns (recon_id, pair_id) can be named in
`by`. Every aggregate is a groupBy with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
RGB = ("r", "g", "b")


def with_voxel(points: DataFrame, voxel: float | Column) -> DataFrame:
    """Add the voxel's integer coordinates vx, vy, vz."""
    v = voxel if isinstance(voxel, Column) else F.lit(float(voxel))
    return points.withColumns({f"v{a}": F.floor(F.col(a) / v).cast("long") for a in XYZ})


def voxel_downsample(points: DataFrame, voxel: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """One row a voxel: the mean position, the count and, with colours, the mean colour rounded half to even into 0..255."""
    aggs = [F.avg(a).alias(a) for a in XYZ] + [F.count("*").alias("n")]
    if all(a in points.columns for a in RGB):
        aggs += [F.least(F.greatest(F.rint(F.avg(a)), F.lit(0.0)), F.lit(255.0)).cast("short").alias(a) for a in RGB]
    return with_voxel(points, voxel).groupBy(*by, "vx", "vy", "vz").agg(*aggs)


def two_level_voxel(points: DataFrame, voxel: float, part: str = "pair_id", by: Sequence[str] = ()) -> DataFrame:
    """Voxels of each part, then of all parts together: the unweighted mean of the parts' means."""
    return voxel_downsample(voxel_downsample(points, voxel, [*by, part]).drop("vx", "vy", "vz", "n"), voxel, by)


def extent(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The largest side of the bounding box."""
    return points.groupBy(*by).agg(F.greatest(*(F.max(a) - F.min(a) for a in XYZ)).alias("extent"))


def grid_bin_mean(points: DataFrame, cell: float | Column, value: str = "z", least: int = 3, by: Sequence[str] = (), u: str = "x", v: str = "y") -> DataFrame:
    """Mean value of every cell with at least `least` points, cells counted from the smallest coordinates. A missing row is a hole."""
    low = points.groupBy(*by).agg(F.min(u).alias("u_min"), F.min(v).alias("v_min"))
    joined = points.join(low, list(by)) if by else points.crossJoin(F.broadcast(low))  # without `by` a single row
    size = cell if isinstance(cell, Column) else F.lit(float(cell))
    ix, iy = F.floor((F.col(u) - F.col("u_min")) / size).cast("long"), F.floor((F.col(v) - F.col("v_min")) / size).cast("long")
    return joined.groupBy(*by, iy.alias("iy"), ix.alias("ix")).agg(F.avg(value).alias("h"), F.count("*").alias("n")).where(F.col("n") >= least)


def moments(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroid (cx, cy, cz), population covariances (xx, xy, xz, yy, yz, zz) and n."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(*by).agg(*(F.avg(a).alias(f"c{a}") for a in XYZ), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs), F.count("*").alias("n"))


def top_surface(points: DataFrame, res: float | Column, width: int, height: int, by: Sequence[str] = (), order: str = "point_id") -> DataFrame:
    """Orthophoto raster: the colour of the highest point of each covered cell (ties: the largest point_id). points: (u, v, h, r, g, b)."""
    low = points.groupBy(*by).agg(F.min("u").alias("u0"), F.min("v").alias("v0"))
    joined = points.join(low, list(by)) if by else points.crossJoin(F.broadcast(low))  # without `by` a single row
    size = res if isinstance(res, Column) else F.lit(float(res))
    index = lambda a, a0, n: F.least(F.greatest(F.floor((F.col(a) - F.col(a0)) / size).cast("long"), F.lit(0)), F.lit(n - 1))
    best = F.max_by(F.struct("r", "g", "b", "h"), F.struct("h", order)).alias("c")
    cells = joined.groupBy(*by, index("v", "v0", height).alias("iy"), index("u", "u0", width).alias("ix")).agg(best)
    return cells.select(*by, "iy", "ix", "c.r", "c.g", "c.b", "c.h")


def ortho_meta(points: DataFrame, by: Sequence[str] = (), pixels: int = 1400, least: int = 200) -> DataFrame:
    """Affine frame of an orthophoto: u0, v0, res = span / pixels, width, height; only for at least `least` points."""
    m = points.groupBy(*by).agg(F.min("u").alias("u0"), F.min("v").alias("v0"), (F.max("u") - F.min("u")).alias("su"), (F.max("v") - F.min("v")).alias("sv"), F.count("*").alias("n")).where(F.col("n") >= least)
    res = F.greatest(F.col("su"), F.col("sv")) / pixels
    return m.select(*by, "u0", "v0", res.alias("res"), (F.floor(F.try_divide(F.col("su"), res)) + 1).cast("long").alias("width"), (F.floor(F.try_divide(F.col("sv"), res)) + 1).cast("long").alias("height"), "n")


def scale_bar(res: Column, width: Column) -> Column:
    """The first length in metres that is drawn between 60 pixels and min(240, 40 % of the width); null if none is."""
    lengths = [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0]
    most = F.least(F.lit(240.0), 0.4 * width)
    return F.coalesce(*(F.when((F.lit(x) / res >= 60) & (F.lit(x) / res <= most), F.lit(x)) for x in lengths))


def covered_cells(raster: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return raster.groupBy(*by).agg(F.count_distinct("iy", "ix").alias("covered"))


def strided(points: DataFrame, most: int = 20_000, order: str = "point_id") -> DataFrame:
    """A deterministic subsample for statistics: every step-th point by a hash of its id, about `most` rows."""
    n = points.count()
    return points if n <= most else points.where(F.pmod(F.xxhash64(order), F.lit(n // most)) == 0)
