"""A synthetic scene with a known volume: a noisy slope with a cosine bowl, cameras on an arc, and a marker board."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G


@dataclass(frozen=True)
class Scene:
    """Fixed values of the scene: the terrain's extent and grid, the bowl, the traced polygon, the cameras and the marker."""

    extent: float = 36.0
    grid: int = 170
    bowl: tuple[float, float, float, float] = (17.5, 18.5, 6.0, 2.0)  # x, y, radius, depth
    polygon_radius: float = 5.6
    views: int = 21
    span_deg: float = 96.0
    eye_radius: float = 26.0
    eye_height: float = 7.0
    focal: float = 1600.0
    image: tuple[int, int] = (1200, 900)


#: Octaves of the noise: cells along a side, amplitude.
OCTAVES = ((6, 0.35), (12, 0.15), (24, 0.08), (48, 0.04))


def lattice_value(i: Column, j: Column, seed: int) -> Column:
    """A fixed pseudo-random number of 0..1 for a lattice point."""
    return F.pmod(i * 7919 + j * 104729 + (i * j) * 31 + seed * 15485863, F.lit(65521)).cast("double") / 65521.0


def value_noise(x: Column, y: Column, cells: int, extent: float, seed: int) -> Column:
    """Bilinear noise between lattice points."""
    u, v = x * (cells / extent), y * (cells / extent)
    i, j = F.floor(u), F.floor(v)
    a, b = u - i, v - j
    at = lambda p, q: lattice_value(p, q, seed)
    return (at(i, j) * (1 - a) + at(i + 1, j) * a) * (1 - b) + (at(i, j + 1) * (1 - a) + at(i + 1, j + 1) * a) * b


def bowl_depth(x: Column, y: Column, scene: Scene) -> Column:
    """The depth that the bowl is cut into the ground at (x, y)."""
    cx, cy, radius, depth = scene.bowl
    r = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    return F.when(r < radius, depth * 0.5 * (1 + F.cos(F.pi() * r / radius))).otherwise(0.0)


def terrain(spark: SparkSession, scene: Scene = Scene()) -> DataFrame:  # noqa: B008
    """(point_id, iy, ix, x, y, ground, bowl, z) of the terrain's lattice."""
    n = scene.grid
    at = spark.range(n * n).select(F.col("id").alias("point_id"), F.floor(F.col("id") / n).alias("iy"), (F.col("id") % n).alias("ix"))
    step = scene.extent / (n - 1)
    at = at.withColumns({"x": F.col("ix") * step, "y": F.col("iy") * step})
    x, y = F.col("x"), F.col("y")
    ground = sum((amp * value_noise(x, y, cells, scene.extent, k) for k, (cells, amp) in enumerate(OCTAVES)), 0.10 * x + 0.03 * y)
    return at.withColumn("ground", ground).withColumn("bowl", bowl_depth(x, y, scene)).withColumn("z", F.col("ground") - F.col("bowl"))


def true_volumes(terrain_rows: DataFrame, scene: Scene = Scene()) -> DataFrame:  # noqa: B008
    """(full, polygon): the volume of the bowl, and of its part inside the traced circle, as sums over the lattice."""
    cx, cy, _, _ = scene.bowl
    area = (scene.extent / (scene.grid - 1)) ** 2
    inside = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)) < scene.polygon_radius
    return terrain_rows.agg((F.sum("bowl") * area).alias("full"), (F.sum(F.when(inside, F.col("bowl")).otherwise(0.0)) * area).alias("polygon"))


def cameras(spark: SparkSession, target_z: float, mean_z: float, scene: Scene = Scene()) -> DataFrame:  # noqa: B008
    """Views (name, image_id, r, t, k, dist, width, height, eye) on an arc around the bowl, looking at its centre."""
    cx, cy, _, _ = scene.bowl
    yaw = F.radians(-scene.span_deg / 2 + scene.span_deg * F.col("id") / (scene.views - 1))
    at = spark.range(scene.views).withColumns({"ex": cx + scene.eye_radius * F.sin(yaw), "ey": cy - scene.eye_radius * F.cos(yaw), "ez": F.lit(mean_z + scene.eye_height)})
    r, t = G.look_at([F.col("ex"), F.col("ey"), F.col("ez")], [F.lit(cx), F.lit(cy), F.lit(target_z)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    w, h = scene.image
    lits = lambda *v: F.array(*(F.lit(float(a)) for a in v))
    k = lits(scene.focal, 0, w / 2, 0, scene.focal, h / 2, 0, 0, 1)
    return at.select(F.format_string("IMG_%02d.png", "id").alias("name"), F.col("id").alias("image_id"), r.alias("r"), t.alias("t"), k.alias("k"), lits(0, 0, 0, 0, 0).alias("dist"), F.lit(w).alias("width"), F.lit(h).alias("height"), F.array("ex", "ey", "ez").alias("eye"))


def circle(scene: Scene = Scene(), sides: int = 72) -> list[tuple[float, float]]:  # noqa: B008
    """The traced polygon in ground coordinates."""
    cx, cy, _, _ = scene.bowl
    return [(cx + scene.polygon_radius * math.cos(2 * math.pi * i / sides), cy + scene.polygon_radius * math.sin(2 * math.pi * i / sides)) for i in range(sides)]
