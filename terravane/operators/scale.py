"""Metric scale from a printed marker or from a clicked segment of known length.

Observations are tables; triangulation is fits.triangulate. Results are one row per reconstruction with a
status: `ok`, or why the scale is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.operators.fits import triangulate


def normalized(obs: DataFrame, views: DataFrame) -> DataFrame:
    """Join observations (view_name, px, py) with views and add normalized coordinates (u, v)."""
    joined = obs.join(views.select(F.col("name").alias("view_name"), "r", "t", "k", "dist"), "view_name")
    u, v = G.undistort(F.col("px"), F.col("py"), "k", "dist")
    return joined.withColumns({"u": u, "v": v})


def reprojection(points: DataFrame, obs: DataFrame, by: str) -> DataFrame:
    """Add `error`, the pixel distance between observations and the projections of their points (by, x, y, z). obs holds r, t, k, dist."""
    j = obs.join(points, by)
    u, v, _ = G.project([F.col(a) for a in "xyz"], "r", "t", "k", "dist")
    return j.withColumn("error", G.residual(u, v, F.col("px"), F.col("py")))


def best_marker(obs: DataFrame, by: tuple[str, ...] = ("recon_id",)) -> DataFrame:
    """(by, dict, marker_id, n_views): the marker seen in most views; ties go to the one met first in view name order, then dictionary order (dict_order), then id."""
    seen = obs.groupBy(*by, "dict", "marker_id").agg(F.count_distinct("view_name").alias("n_views"), F.min(F.struct("view_name", "dict_order", "marker_id")).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n_views"), "first")
    return seen.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "first")


def marker_sides(corners: DataFrame) -> DataFrame:
    """(recon_id, model_sides, mean_side, side_spread_rel) of markers given by their corners (recon_id, corner_idx, x, y, z): the lengths around, their mean, and their population deviation against it."""
    ring = corners.groupBy("recon_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner_idx", "x", "y", "z"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z"))).alias("c"))
    far = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) + (a["z"] - b["z"]) * (a["z"] - b["z"]))
    sides = ring.select("recon_id", F.zip_with("c", G.roll("c"), far).alias("model_sides"))
    mean = G.total(F.col("model_sides")) / F.size("model_sides")
    spread = F.sqrt(G.total(F.transform("model_sides", lambda s: (s - F.col("mean_side")) * (s - F.col("mean_side")))) / F.size("model_sides"))
    return sides.withColumn("mean_side", mean).withColumn("side_spread_rel", F.try_divide(spread, F.col("mean_side")))


def marker_scale(obs: DataFrame, views: DataFrame, side_m: float, marker_id: int | None = None) -> DataFrame:
    """Scale of each reconstruction from marker corners (recon_id, dict, dict_order, marker_id, view_name, corner_idx, px, py).

    The corners of the best marker are triangulated; scale = side / mean model side. The relative error is the
    larger of the spread of the sides and the mean reprojection error against the mean side in pixels, clipped.
    """
    if side_m <= 0:
        raise ValueError("the marker side must be positive")
    obs = obs if marker_id is None else obs.where(F.col("marker_id") == marker_id)
    best = best_marker(obs)
    own = normalized(obs.join(best, ["recon_id", "dict", "marker_id"]), views).withColumn("key", F.concat_ws("|", "recon_id", "corner_idx"))
    xyz = triangulate(own, "key")
    corners = own.select("key", "recon_id", "corner_idx").distinct().join(xyz, "key")
    sides = marker_sides(corners)
    err = reprojection(xyz, own, "key").groupBy("recon_id").agg(F.avg("error").alias("reproj_px_mean"))
    px = own.groupBy("recon_id", "view_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner_idx", "px", "py"))), lambda s: F.struct(s["px"].alias("x"), s["py"].alias("y"))).alias("p"))
    side_px = px.groupBy("recon_id").agg(F.avg(G.total(G.side_lengths("p")) / F.size("p")).alias("px_side"), F.array_sort(F.collect_list("view_name")).alias("views_used"))
    out = best.join(sides, "recon_id", "left").join(err, "recon_id", "left").join(side_px, "recon_id", "left")
    status = F.when(F.col("n_views") < 2, "marker in one photo only").when(F.col("mean_side").isNull() | F.isnan("mean_side") | (F.col("mean_side") <= 0), "triangulation degenerated").otherwise("ok")
    ok = F.col("status") == "ok"
    rel = G.relative_error(F.greatest(F.col("side_spread_rel"), F.col("reproj_px_mean") / F.col("px_side")))
    warn = F.when(F.col("side_spread_rel") > 0.05, F.array(F.lit("corner sides differ by more than 5 %"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("status", status).select("recon_id", "status", F.lit("aruco").alias("method"), "dict", "marker_id", F.lit(side_m).alias("side_m"), "views_used", "model_sides", "side_spread_rel", "reproj_px_mean", F.when(ok, side_m / F.col("mean_side")).alias("scale"), F.when(ok, rel).alias("scale_rel_error"), warn.alias("warnings"))


def segment_gate(m: DataFrame) -> DataFrame:
    """Judge measured segments (model_len, length_m, reproj_px_mean, reproj_px_max, angle_deg, px_len): add status, warnings, scale, scale_rel_error."""
    bad = F.col("model_len").isNull() | F.isnan("model_len") | (F.col("model_len") < 1e-9)
    status = (
        F.when(F.col("length_m") <= 0, "length must be positive")
        .when(bad, "triangulation failed")
        .when((F.col("reproj_px_mean") > 15) | (F.col("reproj_px_max") > 40), "clicked endpoints don't match")
        .when(F.col("angle_deg") < 0.3, "photos view the reference from the same direction")
        .otherwise("ok")
    )
    warn = [F.when(F.col("reproj_px_mean") > 8, "sloppy clicks"), F.when(F.col("angle_deg") < 1.5, "small viewing angle"), F.when(F.col("px_len") < 50, "short reference")]
    ok = F.col("status") == "ok"
    return (
        m.withColumn("status", status)
        .withColumn("warnings", F.filter(F.array(*warn), lambda w: w.isNotNull()))
        .withColumn("scale", F.when(ok, F.try_divide(F.col("length_m"), F.col("model_len"))))
        .withColumn("scale_rel_error", F.when(ok, G.relative_error(F.col("reproj_px_mean") / F.greatest(F.col("px_len"), F.lit(1e-6)))))
    )


def manual_scale(clicks: DataFrame, views: DataFrame, length_m: float) -> DataFrame:
    """Scale of each reconstruction from a segment clicked in two photos: clicks (recon_id, view_name, p1 STRUCT<x, y>, p2 STRUCT<x, y>)."""
    if length_m <= 0:
        raise ValueError("the reference length must be positive")
    checks = clicks.groupBy("recon_id").agg(F.count_distinct("view_name").alias("photos"), F.bool_or((F.col("p1.x") == F.col("p2.x")) & (F.col("p1.y") == F.col("p2.y"))).alias("same"))
    ends = F.explode(F.array(F.struct(F.lit(1).alias("e"), F.col("p1.x").alias("px"), F.col("p1.y").alias("py")), F.struct(F.lit(2).alias("e"), F.col("p2.x").alias("px"), F.col("p2.y").alias("py"))))
    obs = normalized(clicks.select("recon_id", "view_name", ends.alias("s")).select("recon_id", "view_name", "s.*"), views).withColumn("key", F.concat_ws("|", "recon_id", "e"))
    xyz = triangulate(obs, "key")
    named = obs.select("key", "recon_id", "e").distinct().join(xyz, "key")
    end = lambda k: named.where(F.col("e") == k).select("recon_id", *(F.col(a).alias(f"{a}{k}") for a in "xyz"))
    length = end(1).join(end(2), "recon_id").select("recon_id", G.norm([F.col(f"{a}1") - F.col(f"{a}2") for a in "xyz"]).alias("model_len"))
    err = reprojection(xyz, obs, "key").groupBy("recon_id").agg(F.avg("error").alias("reproj_px_mean"), F.max("error").alias("reproj_px_max"))
    centres = clicks.select("recon_id", "view_name").distinct().join(views.select(F.col("name").alias("view_name"), G.camera_centre("r", "t").alias("c")), "view_name")
    two = centres.groupBy("recon_id").agg(F.min_by("c", "view_name").alias("ca"), F.max_by("c", "view_name").alias("cb"), F.array_sort(F.collect_list("view_name")).alias("images"))
    angle = named.join(two, "recon_id").groupBy("recon_id").agg(F.min(G.ray_angle([F.col(a) for a in "xyz"], G.items("ca", 3), G.items("cb", 3))).alias("angle_deg"))
    px = clicks.groupBy("recon_id").agg(F.avg(F.hypot(F.col("p1.x") - F.col("p2.x"), F.col("p1.y") - F.col("p2.y"))).alias("px_len"))
    m = checks.join(two.select("recon_id", "images"), "recon_id", "left")
    for t in (length, err, angle, px):
        m = m.join(t, "recon_id", "left")
    out = segment_gate(m.withColumn("length_m", F.lit(float(length_m))))
    status = F.when(F.col("photos") < 2, "pick two different photos").when(F.col("same"), "endpoints coincide").otherwise(F.col("status"))
    ok = status == "ok"
    return out.select("recon_id", status.alias("status"), F.lit("manual").alias("method"), "length_m", "model_len", "images", F.when(ok, F.col("scale")).alias("scale"), "reproj_px_mean", "reproj_px_max", "angle_deg", F.when(ok, F.col("scale_rel_error")).alias("scale_rel_error"), "px_len", "warnings")


def clicks_from_json(specs: DataFrame, column: str = "spec") -> DataFrame:
    """Clicked points given as [x, y] or {x, y}: (recon_id, view_name, p1, p2) of JSON texts {image, p1, p2}."""
    v = specs.withColumn("_v", F.try_parse_json(column))
    point = lambda path: G.as_point(F.try_variant_get("_v", path, "variant"))
    return v.select("recon_id", F.try_variant_get("_v", "$.image", "string").alias("view_name"), point("$.p1").alias("p1"), point("$.p2").alias("p2"))


def swell(measurements: DataFrame, factors: Column | None = None) -> DataFrame:
    """Loose volumes: a row for every factor above 1 with cut and |net| multiplied."""
    f = F.array(*(F.lit(x) for x in G.SWELL)) if factors is None else factors
    rows = measurements.withColumn("factor", F.explode(f)).where(F.col("factor") > 1)
    return rows.withColumn("loose_cut", F.col("cut") * F.col("factor")).withColumn("loose_net", F.abs("net") * F.col("factor"))


def scale_volume_error(measurements: DataFrame) -> DataFrame:
    """Replace the volume error by the one with the scale's part, where scale_rel_error is known."""
    return measurements.withColumn("est_volume_error_m3", G.volume_error(F.col("datum_rms_m"), F.col("area_m2"), F.col("net_volume_m3"), F.col("scale_rel_error")))
