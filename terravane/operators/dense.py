"""The dense cloud: left/right consistency, back-projection and fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.operators.cloud import extent, voxel_downsample
from terravane.operators.fits import up_direction
from terravane.operators.knn import ground_facing, remove_outliers, spacing, support_filter, support_radius
from terravane.session import materialize


def consistent(left: DataFrame, right: DataFrame, width: int, tolerance: float = 1.5) -> DataFrame:
    """Left disparities that the right image confirms. left, right: (pair_id, row, col, disp); right disparities are negative."""
    col = G.clip(F.col("col") - F.rint("disp"), 0.0, float(width - 1)).cast("int")
    other = right.select("pair_id", "row", F.col("col").alias("_c"), F.col("disp").alias("_d"))
    return left.withColumn("_c", col).join(other, ["pair_id", "row", "_c"]).where(F.abs(F.col("_d") + F.col("disp")) <= tolerance).drop("_c", "_d")


def reproject(disparities: DataFrame, q: str = "q") -> DataFrame:
    """Rectified camera points of disparities by the 4x4 matrix in column q (row-major); null at infinity."""
    m, x = [F.col(q)[i] for i in range(16)], [F.col("col"), F.col("row"), F.col("disp"), F.lit(1.0)]
    h = [sum((m[4 * i + j] * x[j] for j in range(1, 4)), m[4 * i] * x[0]) for i in range(4)]
    return disparities.withColumn("p", F.array(*(F.try_divide(h[i], h[3]) for i in range(3))))


def back_project(points: DataFrame) -> DataFrame:
    """World points x, y, z of rectified camera points p, with r1 (rectification), r and t of the left view."""
    w = G.from_camera(G.items("p", 3), "r", "t", "r1")
    return points.withColumn("_w", w).withColumns({a: F.col("_w")[i] for i, a in enumerate("xyz")}).drop("_w")


@dataclass(frozen=True)
class Fused:
    """A dense cloud (point_id, x, y, z, r, g, b), the voxel used and the scene's up."""

    points: DataFrame
    voxel: float
    up: tuple[float, ...]


def fuse(pair_cloud: DataFrame, sparse: DataFrame, centres: DataFrame, most: int = 2_500_000) -> Fused | None:
    """Fuse per-pair clouds (pair_id, x, y, z, r, g, b): voxels of each pair, of all, outlier removal, support by the sparse cloud, the cap, the surface filter. None without points (use the sparse cloud then)."""
    size = extent(sparse).first()["extent"] or 0.0
    voxel = max(float(size) / 900, 1e-6)
    numbered = lambda df: df.drop("vx", "vy", "vz", "n").withColumn("point_id", F.xxhash64("x", "y", "z"))
    merged = materialize(numbered(voxel_downsample(voxel_downsample(pair_cloud, voxel, ["pair_id"]).drop("vx", "vy", "vz", "n"), voxel)))
    if merged.isEmpty():
        return None
    cloud = remove_outliers(merged)
    gap = float(spacing(sparse).first()[0] or 0.0)
    cloud = materialize(support_filter(cloud, sparse.select("point_id", "x", "y", "z"), support_radius(voxel, gap, float(size))))
    n = cloud.count()
    grown = G.capped_voxel(voxel, n, most)
    if grown > voxel:
        voxel = grown
        cloud = materialize(numbered(voxel_downsample(cloud, voxel)))
    up = up_direction(centres, sparse)
    cloud = ground_facing(cloud, up)
    return Fused(cloud.withColumns({a: F.col(a).cast("float") for a in "xyz"}), voxel, up)
