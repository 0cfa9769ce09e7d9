"""The registered queries over the driver's tables, and their DuckDB SQL.

Sums of doubles depend on the order of rows, so that results are rounded to 3, 4 or 6 digits on both sides,
after a shift that moves exact decimals off the ties.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.operators import attempts as AT
from terravane.operators import cloud as CL
from terravane.operators import fits as FT
from terravane.operators import graph as GR
from terravane.operators import knn as KN
from terravane.operators import photos as PH
from terravane.operators import region as RG
from terravane.operators import scale as SC
from terravane.operators import segments as SG
from terravane.operators import surface as SF
from terravane.plans import relations as R
from terravane.session import discard, materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

POLY = R.polygon()
_POLY_ROWS = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {POLY[(i + 1) % len(POLY)][0]!r}::DOUBLE, {POLY[(i + 1) % len(POLY)][1]!r}::DOUBLE)" for i, (x, y) in enumerate(POLY))
EDGES = f"edges(i, x1, y1, x2, y2) AS (VALUES {_POLY_ROWS})"
CLOUD, TRACKS, VIEWS, PHOTOS = (f"{n} AS ({s})" for n, s in (("cloud", R.CLOUD_SQL), ("tracks", R.TRACKS_SQL), ("views", R.VIEWS_SQL), ("photos", R.PHOTOS_SQL)))


SHIFT = {3: "1.23e-7", 4: "1.23e-7", 6: "1.23e-9"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = re.sub(r", ([346])\) \+ 0\.0", lambda m: f" + {SHIFT[int(m[1])]}::DOUBLE, {m[1]}) + 0.0", sql)
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*((F.round(F.col(c) + float(SHIFT[digits]), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---- clouds ----------------------------------------------------------------------------------------


@query(f"WITH {CLOUD} SELECT CAST(floor(x) AS BIGINT) AS vx, CAST(floor(y) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, round(avg(z), 4) + 0.0 AS z, count(*) AS n, CAST(least(greatest(round_even(avg(r), 0), 0), 255) AS SMALLINT) AS r, CAST(least(greatest(round_even(avg(g), 0), 0), 255) AS SMALLINT) AS g, CAST(least(greatest(round_even(avg(b), 0), 0), 255) AS SMALLINT) AS b FROM cloud GROUP BY ALL")
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CL.voxel_downsample(R.cloud(spark, sf_dir), 1.0))


@query(f"WITH {CLOUD}, a AS (SELECT pair_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cloud GROUP BY pair_id, floor(x / 2), floor(y / 2), floor(z / 2)) SELECT CAST(floor(x / 2) AS BIGINT) AS vx, CAST(floor(y / 2) AS BIGINT) AS vy, CAST(floor(z / 2) AS BIGINT) AS vz, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, round(avg(z), 4) + 0.0 AS z, count(*) AS n FROM a GROUP BY ALL")
def two_level_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CL.two_level_voxel(R.cloud(spark, sf_dir).drop("r", "g", "b"), 2.0))


GRID = "lo AS (SELECT min(x) AS ux, min(y) AS vy FROM cloud), grid AS (SELECT CAST(floor((y - vy) / 1.0) AS BIGINT) AS iy, CAST(floor((x - ux) / 1.0) AS BIGINT) AS ix, avg(z) AS h, count(*) AS n FROM cloud, lo GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {CLOUD}, {GRID} SELECT iy, ix, round(h, 4) + 0.0 AS h, n FROM grid")
def grid_bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CL.grid_bin_mean(R.cloud(spark, sf_dir), 1.0))


def _uvh(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"x": "u", "y": "v", "z": "h"})


@query(f"WITH {CLOUD}, lo AS (SELECT min(x) AS u0, min(y) AS v0 FROM cloud), c AS (SELECT least(greatest(CAST(floor((y - v0) / 0.5) AS BIGINT), 0), 100) AS iy, least(greatest(CAST(floor((x - u0) / 0.5) AS BIGINT), 0), 100) AS ix, z, point_id, r, g, b FROM cloud, lo), k AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY z DESC, point_id DESC) AS rn FROM c) SELECT iy, ix, r, g, b, round(z, 4) + 0.0 AS h FROM k WHERE rn = 1")
def ortho_top_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CL.top_surface(_uvh(R.cloud(spark, sf_dir)), R.RES, R.WIDTH, R.WIDTH))


@query(f"WITH {CLOUD}, m AS (SELECT min(x) AS u0, min(y) AS v0, max(x) - min(x) AS su, max(y) - min(y) AS sv, count(*) AS n FROM cloud) SELECT round(u0, 4) + 0.0 AS u0, round(v0, 4) + 0.0 AS v0, round(greatest(su, sv) / 1400, 6) + 0.0 AS res, CAST(floor(su / (greatest(su, sv) / 1400)) AS BIGINT) + 1 AS width, CAST(floor(sv / (greatest(su, sv) / 1400)) AS BIGINT) + 1 AS height, n, (SELECT min(b) FROM (VALUES (0.5::DOUBLE), (1), (2), (5), (10), (20), (50)) t(b) WHERE b / (greatest(su, sv) / 1400) >= 60 AND b / (greatest(su, sv) / 1400) <= least(240, 0.4::DOUBLE * (CAST(floor(su / (greatest(su, sv) / 1400)) AS BIGINT) + 1))) AS bar_m FROM m WHERE n >= 200")
def ortho_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.ortho_meta(_uvh(R.cloud(spark, sf_dir))).select(*((F.round(F.col(c) + float(SHIFT[d]), d) + 0.0).alias(c) for c, d in (("u0", 4), ("v0", 4), ("res", 6))), "width", "height", "n", CL.scale_bar(F.col("res"), F.col("width")).alias("bar_m"))


@query(f"WITH {CLOUD}, lo AS (SELECT min(x) AS u0, min(y) AS v0 FROM cloud) SELECT count(DISTINCT (least(greatest(CAST(floor((y - v0) / 0.5) AS BIGINT), 0), 100), least(greatest(CAST(floor((x - u0) / 0.5) AS BIGINT), 0), 100))) AS covered FROM cloud, lo")
def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.covered_cells(CL.top_surface(_uvh(R.cloud(spark, sf_dir)), R.RES, R.WIDTH, R.WIDTH))


@query(f"WITH {CLOUD} SELECT round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 4) + 0.0 AS extent FROM cloud")
def cloud_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CL.extent(R.cloud(spark, sf_dir)))


# ---- polygons and regions --------------------------------------------------------------------------

MARKS = f"{EDGES}, xy AS (SELECT DISTINCT x, y FROM cloud), pe AS (SELECT x, y, x1, y1, x2, y2, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS s FROM xy, edges), marks AS (SELECT x, y, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) THEN 1 ELSE 0 END) % 2 = 1 AS interior, min(sqrt(pow(x - x1 - s * (x2 - x1), 2) + pow(y - y1 - s * (y2 - y1), 2))) AS d FROM pe GROUP BY x, y), split AS (SELECT c.*, interior, d >= 0.5 AND d <= 3.0 AND NOT interior AS rim FROM cloud c JOIN marks m ON c.x = m.x AND c.y = m.y)"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = R.cloud(spark, sf_dir).withColumns({"u": F.col("x"), "v": F.col("y")})
    return RG.ortho_split(cloud, POLY, R.RIM_INNER, R.RIM_OUTER).drop("u", "v")


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the region and its rim, written once for queries that read them several times."""
    cloud = R.cloud(spark, sf_dir).select("point_id", "x", "y", "z", F.col("x").alias("u"), F.col("y").alias("v"))
    return materialize(RG.ortho_region(cloud, POLY, R.RIM_INNER, R.RIM_OUTER).drop("u", "v"))


@query(f"WITH {CLOUD}, {MARKS} SELECT point_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, interior FROM split WHERE interior")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_split(spark, sf_dir).where("interior").select("point_id", "x", "y", "interior"))


@query(f"WITH {CLOUD}, {MARKS} SELECT interior, rim, count(*) AS n, round(avg(z), 4) + 0.0 AS mean_z FROM split GROUP BY ALL")
def ring_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_split(spark, sf_dir).groupBy("interior", "rim").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z")))


@query(f"WITH {EDGES} SELECT round(abs(sum(x1 * y2 - x2 * y1)) / 2, 4) + 0.0 AS area, round(sum(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))), 4) + 0.0 AS perimeter, count(*) AS n FROM edges")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.range(1).select(RG.polygon_literal(POLY).alias("p"))
    return rounded(p.select(G.polygon_area("p").alias("area"), G.perimeter("p").alias("perimeter"), F.size("p").cast("long").alias("n")))


# ---- fits ------------------------------------------------------------------------------------------


@query(f"WITH {CLOUD}, {MARKS} SELECT round(avg(x), 4) + 0.0 AS cx, round(avg(y), 4) + 0.0 AS cy, round(avg(z), 4) + 0.0 AS cz, round(covar_pop(x, x), 4) + 0.0 AS xx, round(covar_pop(x, y), 4) + 0.0 AS xy, round(covar_pop(x, z), 4) + 0.0 AS xz, round(covar_pop(y, y), 4) + 0.0 AS yy, round(covar_pop(y, z), 4) + 0.0 AS yz, round(covar_pop(z, z), 4) + 0.0 AS zz, count(*) AS n FROM split WHERE rim")
def plane_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(CL.moments(_split(spark, sf_dir).where("rim")))


MOMENTS = "m AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, count(*) AS n FROM split WHERE rim)"
PLANE = f"""{MOMENTS},
e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m),
e2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p,
  (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) AS det FROM e1),
e3 AS (SELECT *, q + 2 * p * cos(acos(least(greatest(det / (2 * p * p * p), -1), 1)) / 3 + 2.0943951023931953::DOUBLE) AS low FROM e2),
e4 AS (SELECT *, xy * yz - xz * (yy - low) AS vx, xz * xy - (xx - low) * yz AS vy, (xx - low) * (yy - low) - xy * xy AS vz FROM e3),
plane AS (SELECT cx, cy, cz, vx / l * sign(vz) AS nx, vy / l * sign(vz) AS ny, vz / l * sign(vz) AS nz, n FROM (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS l FROM e4))"""


@query(f"WITH {CLOUD}, {MARKS}, {PLANE} SELECT round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy, round(cz, 4) + 0.0 AS cz, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz, n FROM plane")
def tls_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FT.tls_plane(_split(spark, sf_dir).where("rim")).select("cx", "cy", "cz", "nx", "ny", "nz", "n"))


def _over_plane(region: DataFrame) -> DataFrame:
    """Interior points with their height over the rim's plane; the plane is one row."""
    plane = FT.tls_plane(region.where("rim")).drop("n")
    inside = region.where("interior").crossJoin(F.broadcast(plane))
    h = (F.col("x") - F.col("cx")) * F.col("nx") + (F.col("y") - F.col("cy")) * F.col("ny") + (F.col("z") - F.col("cz")) * F.col("nz")
    return inside.select("point_id", "x", "y", "z", h.alias("h"))


OVER = f"{CLOUD}, {MARKS}, {PLANE}, over AS (SELECT point_id, x, y, z, (x - cx) * nx + (y - cy) * ny + (z - cz) * nz AS h FROM split, plane WHERE interior)"


@query(f"WITH {OVER} SELECT count(*) AS n, count(*) FILTER (WHERE h > 1.5) AS n_high, round(avg(h), 4) + 0.0 AS mean_h, round(min(h), 4) + 0.0 AS min_h, round(max(h), 4) + 0.0 AS max_h, round(sqrt(avg(h * h)), 4) + 0.0 AS rms, round(median(abs(h)), 4) + 0.0 AS median_abs, round(1.4826 * median(abs(h)), 4) + 0.0 AS mad_scale, round(quantile_cont(h, 0.01), 4) + 0.0 AS p1, round(quantile_cont(h, 0.99), 4) + 0.0 AS p99 FROM over")
def signed_height_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _over_plane(_region(spark, sf_dir))
    mad = F.median(F.abs("h"))
    return rounded(h.agg(F.count("*").alias("n"), F.sum((F.col("h") > 1.5).cast("long")).alias("n_high"), F.avg("h").alias("mean_h"), F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("rms"), mad.alias("median_abs"), (1.4826 * mad).alias("mad_scale"), F.percentile("h", F.lit(0.01)).alias("p1"), F.percentile("h", F.lit(0.99)).alias("p99")))


_TERMS = ["1.0::DOUBLE", "x / 25", "y / 25", "x / 25 * (x / 25)", "y / 25 * (y / 25)", "x / 25 * (y / 25)"]


@query(f"WITH {CLOUD}, {MARKS} SELECT " + ", ".join(f"round(sum(({_TERMS[i]}) * ({_TERMS[j]})), 4) + 0.0 AS s{i}{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"round(sum(({_TERMS[i]}) * z), 4) + 0.0 AS t{i}" for i in range(6)) + ", round(sum(z * z), 4) + 0.0 AS hh, count(*) AS n FROM split WHERE rim")
def quad_normal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FT.quadratic_sums(_uvh(_split(spark, sf_dir).where("rim")), 25.0))


_HYPOTHESES = [(i, -20.0 + i, 15.0 - i / 2, 0.05 * i - 1.0, 0.01 * (i - 10), 0.005 * i - 0.1, 1.0) for i in range(40)]


@query(f"WITH {CLOUD}, {MARKS}, hyp(hypothesis, px, py, pz, nx, ny, nz) AS (VALUES " + ", ".join("(" + ", ".join([str(t[0]), *(f"{v!r}::DOUBLE" for v in t[1:])]) + ")" for t in _HYPOTHESES) + "), d AS (SELECT hypothesis, abs((x - px) * nx + (y - py) * ny + (z - pz) * nz) AS d FROM split, hyp WHERE rim) SELECT hypothesis, round(sum(least(d, 0.25::DOUBLE)), 4) + 0.0 AS score, CAST(count(*) FILTER (WHERE d < 0.25::DOUBLE) AS BIGINT) AS inliers FROM d GROUP BY hypothesis")
def msac_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = spark.createDataFrame(_HYPOTHESES, "hypothesis int, px double, py double, pz double, nx double, ny double, nz double")
    return rounded(FT.msac_scores(_split(spark, sf_dir).where("rim"), planes, 0.25))


@query()
def robust_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust plane of the rim, and how many of its points it keeps."""
    rim = materialize(_split(spark, sf_dir).where("rim").select("point_id", "x", "y", "z"))
    plane, keep = FT.robust_plane(rim)
    kept = rim.agg(F.sum(keep.cast("long")), F.count("*")).first()
    discard(rim)
    return spark.createDataFrame([(*map(float, FT.upward(plane).normal), *kept)], "nx double, ny double, nz double, n_kept long, n long")


# ---- surfaces --------------------------------------------------------------------------------------

LATTICE = f"{OVER}, lo AS (SELECT min(x) AS ux, min(y) AS vy FROM over), g AS (SELECT CAST(floor((y - vy) / 2.0) AS BIGINT) AS iy, CAST(floor((x - ux) / 2.0) AS BIGINT) AS ix, avg(h) AS h FROM over, lo GROUP BY ALL HAVING count(*) >= 3), sq AS (SELECT a.iy, a.ix, a.h AS ha, b.h AS hb, c.h AS hc, d.h AS hd FROM g a JOIN g b ON b.iy = a.iy AND b.ix = a.ix + 1 JOIN g c ON c.iy = a.iy + 1 AND c.ix = a.ix JOIN g d ON d.iy = a.iy + 1 AND d.ix = a.ix + 1), tri AS (SELECT 2.0::DOUBLE AS area, (ha + hb + hc) / 3 AS height FROM sq UNION ALL SELECT 2.0::DOUBLE, (hb + hd + hc) / 3 FROM sq)"


def _lattice(region: DataFrame) -> DataFrame:
    """Triangles of the lattice over the rim's plane; the lattice is written once."""
    over = materialize(_over_plane(region).select("x", "y", "h"))
    grid = materialize(CL.grid_bin_mean(over, 2.0, "h").select("iy", "ix", "h"))
    discard(over)
    return SF.triangle_facts(SF.lattice_triangles(grid, 2.0))


@query(f"WITH {LATTICE} SELECT round(coalesce(sum(-area * height) FILTER (WHERE height < 0), 0), 4) + 0.0 AS cut, round(coalesce(sum(area * height) FILTER (WHERE height > 0), 0), 4) + 0.0 AS fill, round(sum(area), 4) + 0.0 AS area, round(coalesce(sum(area * height) FILTER (WHERE height > 0), 0) - coalesce(sum(-area * height) FILTER (WHERE height < 0), 0), 4) + 0.0 AS net FROM tri")
def lattice_cut_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SF.cut_fill(_lattice(_region(spark, sf_dir))))


@query(f"WITH {LATTICE}, s AS (SELECT sqrt(avg(((x - cx) * nx + (y - cy) * ny + (z - cz) * nz) * ((x - cx) * nx + (y - cy) * ny + (z - cz) * nz))) AS sigma FROM split, plane WHERE rim) SELECT round(sigma, 4) + 0.0 AS sigma, round(1.96 * greatest(sigma, 1e-6), 4) + 0.0 AS lod, round(coalesce(sum(area) FILTER (WHERE abs(height) > 1.96 * greatest(sigma, 1e-6)), 0) / sum(area), 4) + 0.0 AS sig_area_frac, round(sigma * sum(area), 4) + 0.0 AS est_error, round(sigma * sum(area) + 2 * 0.02::DOUBLE * abs(sum(area * height)), 4) + 0.0 AS est_error_scaled FROM tri, s GROUP BY sigma")
def lod_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _region(spark, sf_dir)
    rim = region.where("rim")
    h = (F.col("x") - F.col("cx")) * F.col("nx") + (F.col("y") - F.col("cy")) * F.col("ny") + (F.col("z") - F.col("cz")) * F.col("nz")
    sigma = rim.crossJoin(F.broadcast(FT.tls_plane(rim).drop("n"))).agg(F.sqrt(F.avg(h * h)).alias("sigma"))
    facts = _lattice(region).crossJoin(F.broadcast(sigma))
    lod = G.level_of_detection(F.col("sigma"))
    area = F.sum("area")
    out = facts.groupBy("sigma").agg(area.alias("area"), F.sum(F.when(F.abs("height") > lod, F.col("area")).otherwise(0.0)).alias("sig"), F.sum("volume").alias("net"))
    return rounded(out.select("sigma", lod.alias("lod"), (F.col("sig") / F.col("area")).alias("sig_area_frac"), G.volume_error(F.col("sigma"), F.col("area"), F.col("net"), F.lit(None).cast("double")).alias("est_error"), G.volume_error(F.col("sigma"), F.col("area"), F.col("net"), F.lit(0.02)).alias("est_error_scaled")))


GRADIENT = f"{CLOUD}, {GRID}, b AS (SELECT min(iy) AS y0, max(iy) AS y1, min(ix) AS x0, max(ix) AS x1 FROM grid), fr AS (SELECT iy, unnest(range(x0, x1 + 1)) AS ix, y0, y1, x0, x1 FROM (SELECT *, unnest(range(y0, y1 + 1)) AS iy FROM b)), gr AS (SELECT f.iy, f.ix, CASE WHEN x0 = x1 THEN NULL WHEN f.ix = x0 THEN e.h - m.h WHEN f.ix = x1 THEN m.h - w.h ELSE (e.h - w.h) / 2 END AS gx, CASE WHEN y0 = y1 THEN NULL WHEN f.iy = y0 THEN n.h - m.h WHEN f.iy = y1 THEN m.h - s.h ELSE (n.h - s.h) / 2 END AS gy FROM fr f LEFT JOIN grid m ON m.iy = f.iy AND m.ix = f.ix LEFT JOIN grid e ON e.iy = f.iy AND e.ix = f.ix + 1 LEFT JOIN grid w ON w.iy = f.iy AND w.ix = f.ix - 1 LEFT JOIN grid n ON n.iy = f.iy + 1 AND n.ix = f.ix LEFT JOIN grid s ON s.iy = f.iy - 1 AND s.ix = f.ix), sl AS (SELECT degrees(atan(sqrt(gx * gx + gy * gy))) AS s FROM gr WHERE gx IS NOT NULL AND gy IS NOT NULL)"


@query(f"WITH {GRADIENT} SELECT round(max(s), 4) + 0.0 AS max_slope_deg, round(avg(s), 4) + 0.0 AS mean_slope_deg, round(CAST(count(*) FILTER (WHERE s > 20) AS DOUBLE), 4) AS area_steep_m2 FROM sl")
def slope_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SF.slope_summary(CL.grid_bin_mean(R.cloud(spark, sf_dir), 1.0), 1.0, 20.0))


@query(f"WITH {GRADIENT} SELECT round(avg(CASE WHEN s <= 25 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS gentle, round(avg(CASE WHEN s > 25 AND s <= 35 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS warn, round(avg(CASE WHEN s > 35 THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS steep FROM sl")
def slope_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SF.slope_shares(CL.grid_bin_mean(R.cloud(spark, sf_dir), 1.0), 1.0))


@query()
def prism_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurement over every position of the cloud."""
    region = _region(spark, sf_dir)
    return SF.prism_volume(region.where("interior"), region.where("rim"), (0.0, 0.0, 1.0))


# ---- neighbours: the SQL looks in 27 cells of 3 m, which hold the nearest 16 of every point of these clouds --------


def near_sql(queries: str, targets: str, others: bool) -> str:
    """pairs (p, q, d, x, y, z): each point p of `queries` with the points q around it."""
    cells = "floor(x / 3.0::DOUBLE) AS cx, floor(y / 3.0::DOUBLE) AS cy, floor(z / 3.0::DOUBLE) AS cz"
    return f"""tc AS (SELECT point_id, x, y, z, {cells} FROM {targets}),
qc AS (SELECT point_id, x, y, z, cx + i AS cx, cy + j AS cy, cz + k AS cz FROM (SELECT point_id, x, y, z, {cells} FROM {queries}), (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j), (VALUES (-1), (0), (1)) c(k)),
pairs AS (SELECT a.point_id AS p, b.point_id AS q, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d, b.x, b.y, b.z FROM qc a JOIN tc b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz{" WHERE a.point_id <> b.point_id" if others else ""})"""


def normals_sql(k: int) -> str:
    """normals (p, ax, ay, az: the longest eigenvector candidate, l: its squared length) of the k nearest of pairs."""
    return f"""nb AS (SELECT p, unnest(arg_min({{'x': x, 'y': y, 'z': z}}, d, {k})) AS t FROM pairs GROUP BY p),
cv AS (SELECT p, covar_pop(t.x, t.x) AS xx, covar_pop(t.x, t.y) AS xy, covar_pop(t.x, t.z) AS xz, covar_pop(t.y, t.y) AS yy, covar_pop(t.y, t.z) AS yz, covar_pop(t.z, t.z) AS zz FROM nb GROUP BY p),
v1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cv),
v2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s, (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz) AS det FROM v1),
v3 AS (SELECT *, q + 2 * s * cos(acos(least(greatest(det / (2 * s * s * s), -1), 1)) / 3 + 2.0943951023931953::DOUBLE) AS low FROM v2),
v4 AS (SELECT p, xy * yz - xz * (yy - low) AS ax, xz * xy - (xx - low) * yz AS ay, (xx - low) * (yy - low) - xy * xy AS az, (xx - low) * yz - xy * xz AS bz, xz * xz - (xx - low) * (zz - low) AS by_, xy * (zz - low) - yz * xz AS bx, (yy - low) * (zz - low) - yz * yz AS cx, yz * xz - xy * (zz - low) AS cy, xy * yz - (yy - low) * xz AS cz FROM v3),
normals AS (SELECT p, CASE WHEN a2 >= b2 AND a2 >= c2 THEN abs(az) / sqrt(a2) WHEN b2 >= c2 THEN abs(bz) / sqrt(b2) ELSE abs(cz) / sqrt(c2) END AS up FROM (SELECT *, ax * ax + ay * ay + az * az AS a2, bx * bx + by_ * by_ + bz * bz AS b2, cx * cx + cy * cy + cz * cz AS c2 FROM v4))"""


@query(f"WITH {CLOUD}, {near_sql('cloud', 'cloud', True)} SELECT round(median(d), 4) + 0.0 AS spacing FROM (SELECT p, min(d) AS d FROM pairs GROUP BY p)")
def nn_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(KN.spacing(R.cloud(spark, sf_dir)))


@query(f"WITH {CLOUD}, {near_sql('cloud', 'cloud', True)}, k AS (SELECT p, list_avg(min(d, 10)) AS mean_d FROM pairs GROUP BY p), lim AS (SELECT avg(mean_d) + 2 * stddev_pop(mean_d) AS lim FROM k) SELECT p AS point_id, round(mean_d, 4) + 0.0 AS mean_d FROM k, lim WHERE mean_d <= lim")
def sor_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(KN.outlier_stats(R.cloud(spark, sf_dir), 10))
    limit = stats.agg((F.avg("mean_d") + 2 * F.stddev_pop("mean_d")).alias("lim"))  # one row
    return rounded(stats.crossJoin(F.broadcast(limit)).where("mean_d <= lim").select("point_id", "mean_d"))


@query(f"WITH {CLOUD}, sp AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cloud GROUP BY floor(x / 2), floor(y / 2), floor(z / 2)), sc AS (SELECT *, floor(x / 0.75::DOUBLE) AS cx, floor(y / 0.75::DOUBLE) AS cy, floor(z / 0.75::DOUBLE) AS cz FROM sp), c27 AS (SELECT point_id, x, y, z, floor(x / 0.75::DOUBLE) + i AS cx, floor(y / 0.75::DOUBLE) + j AS cy, floor(z / 0.75::DOUBLE) + k AS cz FROM cloud, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j), (VALUES (-1), (0), (1)) c(k)) SELECT DISTINCT v.point_id, round(v.x, 4) + 0.0 AS x FROM c27 v JOIN sc s ON v.cx = s.cx AND v.cy = s.cy AND v.cz = s.cz WHERE sqrt((v.x - s.x) * (v.x - s.x) + (v.y - s.y) * (v.y - s.y) + (v.z - s.z) * (v.z - s.z)) <= 0.75::DOUBLE")
def support_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that a sparse cloud (the voxels of 2 m) supports."""
    cloud = R.cloud(spark, sf_dir).select("point_id", "x", "y", "z")
    return rounded(KN.support_filter(cloud, CL.voxel_downsample(cloud, 2.0), 0.75).select("point_id", "x")).distinct()


@query(f"WITH {CLOUD}, {near_sql('cloud', 'cloud', False)}, {normals_sql(16)} SELECT p AS point_id, round(up, 4) + 0.0 AS up FROM normals")
def local_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.cloud(spark, sf_dir)
    return rounded(KN.neighbour_normals(c, c, 16).select("point_id", F.abs("nz").alias("up")))


@query(f"WITH {CLOUD}, {MARKS}, rimp AS (SELECT point_id, x, y, z FROM split WHERE rim), both_ AS (SELECT point_id, x, y, z FROM split WHERE rim OR interior), {near_sql('rimp', 'both_', False)}, {normals_sql(10)} SELECT p AS point_id FROM normals WHERE CAST(up AS FLOAT) < 0.9975::FLOAT")
def steep_rim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rim points whose ground leans by more than some 4 degrees."""
    region = _region(spark, sf_dir)
    return SF.steep_rim(region.where("rim"), region.where("interior"), (0.0, 0.0, 1.0), 0.9975)


# ---- graph -----------------------------------------------------------------------------------------

COVIS = "covis AS (SELECT least(l.image_id, r.image_id) AS a, greatest(l.image_id, r.image_id) AS b, count(*) AS shared FROM tracks l JOIN tracks r ON l.point3d_id = r.point3d_id AND l.elem_idx < r.elem_idx GROUP BY ALL)"


@query(f"WITH {TRACKS}, {COVIS} SELECT a, b, shared FROM covis")
def covisibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.covisibility(R.tracks(spark, sf_dir))


@query(f"WITH {TRACKS} SELECT image_id, count(*) AS n_points FROM tracks GROUP BY image_id")
def points_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.points_per_image(R.tracks(spark, sf_dir))


@query(f"WITH {TRACKS}, {COVIS}, two AS (SELECT a AS image_id, b AS neighbour, shared FROM covis WHERE a <> b UNION ALL SELECT b, a, shared FROM covis WHERE a <> b) SELECT image_id, neighbour, shared, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, neighbour DESC) AS rn FROM two) WHERE rn <= 3")
def top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.top_neighbours(GR.covisibility(R.tracks(spark, sf_dir)), 3)


DEPTH = "dep AS (SELECT image_id, median(d) AS dm FROM (SELECT image_id, views.r[7] * x + views.r[8] * y + views.r[9] * z + t[3] AS d FROM cloud, views) WHERE d > 0 GROUP BY image_id HAVING count(*) >= 20)"


@query(f"WITH {CLOUD}, {VIEWS}, {DEPTH} SELECT image_id, round(dm, 4) + 0.0 AS median_depth FROM dep")
def median_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(GR.median_depths(R.cloud(spark, sf_dir), R.views(spark, sf_dir)))


BASE = f"{CLOUD}, {VIEWS}, {TRACKS}, {COVIS}, {DEPTH}, ctr AS (SELECT image_id, -(r[1] * t[1] + r[4] * t[2] + r[7] * t[3]) AS x, -(r[2] * t[1] + r[5] * t[2] + r[8] * t[3]) AS y, -(r[3] * t[1] + r[6] * t[2] + r[9] * t[3]) AS z FROM views), base AS (SELECT a, b, shared, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS baseline, coalesce(da.dm, db.dm) AS dm FROM covis JOIN ctr p ON p.image_id = a JOIN ctr q ON q.image_id = b LEFT JOIN dep da ON da.image_id = a LEFT JOIN dep db ON db.image_id = b WHERE shared >= 2)"


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = R.views(spark, sf_dir)
    return GR.baseline_pairs(GR.covisibility(R.tracks(spark, sf_dir)), views, GR.median_depths(R.cloud(spark, sf_dir), views), least=2)


@query(f"WITH {BASE} SELECT a, b, shared, round(baseline, 4) + 0.0 AS baseline, round(dm, 4) + 0.0 AS median_depth FROM base WHERE baseline >= 0.1 * dm AND baseline <= 1.5 * dm")
def baseline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_base(spark, sf_dir))


@query(f"WITH RECURSIVE {BASE}, p AS (SELECT a, b, shared, row_number() OVER (ORDER BY shared DESC, a, b) AS rn FROM base WHERE baseline >= 0.1 * dm AND baseline <= 1.5 * dm), g AS (SELECT 0 AS step, 0::BIGINT AS rn, []::BIGINT[] AS used UNION ALL SELECT any_value(g.step) + 1, min(p.rn), list_concat(any_value(g.used), [arg_min(p.a, p.rn), arg_min(p.b, p.rn)]) FROM g, p WHERE p.rn > g.rn AND g.step < 30 AND len(list_filter(g.used, lambda u: u = p.a)) < 2 AND len(list_filter(g.used, lambda u: u = p.b)) < 2 HAVING count(*) > 0) SELECT 0 AS recon_id, p.a, p.b, p.shared FROM g JOIN p ON p.rn = g.rn")
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.greedy_pairs(_base(spark, sf_dir).withColumn("recon_id", F.lit(0)).select("recon_id", "a", "b", "shared"))


# ---- cameras ---------------------------------------------------------------------------------------

#: Every line item is an observation of its position by the camera of its supplier.
PROJECT = "q AS (SELECT point_id, image_id, (x + t[1]) AS cx, (-z + t[2]) AS cy, (y + t[3]) AS cz FROM cloud JOIN views ON pair_id = image_id), n AS (SELECT *, cx / nullif(cz, 0) AS a, cy / nullif(cz, 0) AS b FROM q), w AS (SELECT *, a * a + b * b AS r2 FROM n), uv AS (SELECT *, 800 * (a * (1 + r2 * (0.05::DOUBLE + r2 * (-0.01::DOUBLE + r2 * 0.003::DOUBLE))) + 2 * 0.001::DOUBLE * a * b + -0.002::DOUBLE * (r2 + 2 * a * a)) + 320 AS u, 800 * (b * (1 + r2 * (0.05::DOUBLE + r2 * (-0.01::DOUBLE + r2 * 0.003::DOUBLE))) + 0.001::DOUBLE * (r2 + 2 * b * b) + 2 * -0.002::DOUBLE * a * b) + 240 AS v FROM w)"


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v, d = G.project([F.col(a) for a in "xyz"], "r", "t", "k", "dist")
    seen = R.cloud(spark, sf_dir).select("point_id", F.col("pair_id").alias("image_id"), "x", "y", "z").join(R.views(spark, sf_dir), "image_id")
    return seen.select("point_id", "image_id", u.alias("u"), v.alias("v"), d.alias("depth"))


@query(f"WITH {CLOUD}, {VIEWS}, {PROJECT} SELECT point_id, image_id, round(u, 3) + 0.0 AS u, round(v, 3) + 0.0 AS v, round(cz, 3) + 0.0 AS depth FROM uv")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_projected(spark, sf_dir), 3)


@query(f"WITH {CLOUD}, {VIEWS}, {PROJECT}, e AS (SELECT image_id, sqrt(pow(u - round(u / 4) * 4, 2) + pow(v - round(v / 4) * 4, 2)) AS e FROM uv) SELECT image_id, round(avg(e), 3) + 0.0 AS mean_px, round(max(e), 3) + 0.0 AS max_px, count(*) AS n FROM e GROUP BY image_id")
def reprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _projected(spark, sf_dir)
    e = G.residual(F.col("u"), F.col("v"), F.round(F.col("u") / 4) * 4, F.round(F.col("v") / 4) * 4)
    return rounded(p.select("image_id", e.alias("e")).groupBy("image_id").agg(F.avg("e").alias("mean_px"), F.max("e").alias("max_px"), F.count("*").alias("n")), 3)


@query(f"WITH {VIEWS} SELECT image_id, round(-(r[1] * t[1] + r[4] * t[2] + r[7] * t[3]), 4) + 0.0 AS x, round(-(r[2] * t[1] + r[5] * t[2] + r[8] * t[3]), 4) + 0.0 AS y, round(-(r[3] * t[1] + r[6] * t[2] + r[9] * t[3]), 4) + 0.0 AS z FROM views")
def camera_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.views(spark, sf_dir).select("image_id", G.camera_centre("r", "t").alias("c"))
    return rounded(c.select("image_id", *(F.col("c")[i].alias(a) for i, a in enumerate("xyz"))))


# ---- scale -----------------------------------------------------------------------------------------

SEGMENTS = "seg AS (SELECT event_id, value AS length_m, (user_id % 5) * 0.5::DOUBLE AS model_len, value * 1.5 AS reproj_px_mean, value * 3 AS reproj_px_max, (user_id % 40) / 10.0::DOUBLE AS angle_deg, 20.0::DOUBLE + user_id AS px_len FROM events)"


@query(f"WITH {SEGMENTS}, st AS (SELECT *, CASE WHEN length_m <= 0 THEN 'length must be positive' WHEN model_len < 1e-9 THEN 'triangulation failed' WHEN reproj_px_mean > 15 OR reproj_px_max > 40 THEN 'clicked endpoints don''t match' WHEN angle_deg < 0.3::DOUBLE THEN 'photos view the reference from the same direction' ELSE 'ok' END AS status FROM seg) SELECT event_id, status, CAST((reproj_px_mean > 8)::INT + (angle_deg < 1.5::DOUBLE)::INT + (px_len < 50)::INT AS INTEGER) AS n_warnings, CASE WHEN status = 'ok' THEN round(length_m / model_len, 4) + 0.0 END AS scale, CASE WHEN status = 'ok' THEN round(least(greatest(reproj_px_mean / greatest(px_len, 1e-6), 0.005::DOUBLE), 0.5::DOUBLE), 4) + 0.0 END AS scale_rel_error FROM st")
def manual_scale_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.read(spark, sf_dir, "events")
    u = F.col("user_id")
    m = e.select("event_id", F.col("value").alias("length_m"), ((u % 5) * F.lit(0.5)).alias("model_len"), (F.col("value") * 1.5).alias("reproj_px_mean"), (F.col("value") * 3).alias("reproj_px_max"), ((u % 40) / F.lit(10.0)).alias("angle_deg"), (F.lit(20.0) + u).alias("px_len"))
    return rounded(SC.segment_gate(m).select("event_id", "status", F.size("warnings").alias("n_warnings"), "scale", "scale_rel_error"))


@query("WITH obs AS (SELECT o_custkey % 50 AS recon_id, o_orderpriority AS dict, CAST(o_orderkey % 4 AS INTEGER) AS marker_id, 'v' || CAST(o_orderkey % 31 AS VARCHAR) AS view_name, ascii(o_orderpriority) AS dict_order FROM orders), seen AS (SELECT recon_id, dict, marker_id, count(DISTINCT view_name) AS n_views, min((view_name, dict_order, marker_id)) AS first FROM obs GROUP BY ALL) SELECT recon_id, dict, marker_id, n_views FROM (SELECT *, row_number() OVER (PARTITION BY recon_id ORDER BY n_views DESC, first) AS rn FROM seen) WHERE rn = 1")
def best_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.read(spark, sf_dir, "orders")
    obs = o.select((F.col("o_custkey") % 50).alias("recon_id"), F.col("o_orderpriority").alias("dict"), (F.col("o_orderkey") % 4).cast("int").alias("marker_id"), F.concat(F.lit("v"), (F.col("o_orderkey") % 31).cast("string")).alias("view_name"), F.ascii("o_orderpriority").alias("dict_order"))
    return SC.best_marker(obs)


@query(f"WITH {LATTICE}, tot AS (SELECT coalesce(sum(-area * height) FILTER (WHERE height < 0), 0) AS cut, sum(area * height) AS net FROM tri) SELECT f AS factor, round(cut * f, 4) + 0.0 AS loose_cut, round(abs(net) * f, 4) + 0.0 AS loose_net FROM tot, (VALUES (1.0::DOUBLE), (1.2::DOUBLE), (1.25::DOUBLE), (1.4::DOUBLE)) t(f) WHERE f > 1")
def swell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SC.swell(SF.cut_fill(_lattice(_region(spark, sf_dir)))).select("factor", "loose_cut", "loose_net"))


# ---- attempts, keypoints, photos -------------------------------------------------------------------


@query("SELECT o_custkey % 100 AS recon_id, median(o_orderkey % 5000) AS median_keypoints FROM orders WHERE o_orderkey % 5000 > 0 AND o_orderkey % 3 = 0 GROUP BY 1")
def median_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.read(spark, sf_dir, "orders")
    k = o.select((F.col("o_custkey") % 100).alias("recon_id"), (F.col("o_orderkey") % 3).alias("table_id"), (F.col("o_orderkey") % 5000).alias("rows"))
    return AT.median_keypoints(k, ("recon_id",))


ATTEMPTS = "att AS (SELECT o_orderstatus || CAST(o_custkey % 40 AS VARCHAR) AS recon_id, o_orderkey AS idx, o_orderpriority AS label, CAST(floor(o_totalprice) AS BIGINT) % 30 AS nreg, CAST(floor(o_totalprice) AS BIGINT) % 997 AS npts, 25 AS n_photos FROM orders), sc AS (SELECT *, CASE WHEN npts >= 30 * greatest(nreg, 1) THEN 1 ELSE 0 END AS usable FROM att), stop AS (SELECT recon_id, min(idx) AS stop FROM sc WHERE usable = 1 AND nreg >= greatest(3, floor(0.9 * n_photos)) GROUP BY recon_id)"


@query(f"WITH {ATTEMPTS}, k AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.recon_id ORDER BY usable DESC, nreg DESC, npts DESC, idx) AS rn FROM sc LEFT JOIN stop ON stop.recon_id = sc.recon_id WHERE stop IS NULL OR idx <= stop.stop) SELECT recon_id, idx, label, nreg, npts, usable, CASE WHEN nreg < greatest(3, floor(0.5 * n_photos)) THEN 'too few images' WHEN usable = 0 THEN 'thin geometry' ELSE 'ok' END AS status FROM k WHERE rn = 1")
def attempt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.read(spark, sf_dir, "orders")
    p = F.floor("o_totalprice").cast("long")
    a = o.select(F.concat("o_orderstatus", (F.col("o_custkey") % 40).cast("string")).alias("recon_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("label"), (p % 30).alias("nreg"), (p % 997).alias("npts"), F.lit(25).alias("n_photos"))
    return AT.choose(a).select("recon_id", "idx", "label", "nreg", "npts", "usable", "status")


CULL = f"{PHOTOS}, st AS (SELECT recon_id, median(lap) AS med, count(*) AS n FROM photos GROUP BY recon_id), f AS (SELECT p.*, n, lap < greatest(6.0::DOUBLE, 0.25::DOUBLE * med) AS soft, row_number() OVER (PARTITION BY p.recon_id ORDER BY lap, seq) AS rk FROM photos p JOIN st USING (recon_id)), g AS (SELECT *, sum(soft::INT) OVER (PARTITION BY recon_id) > 0.5 * n AS fail FROM f)"


@query(f"WITH {CULL} SELECT seq, recon_id, CASE WHEN fail AND rk <= floor(n / 2) THEN 'blurry' WHEN clipped >= 0.5 THEN 'over/under-exposed' WHEN NOT fail AND soft THEN 'blurry' END AS reason FROM g")
def exposure_blur_cull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PH.exposure_blur(R.photos(spark, sf_dir), ("recon_id",)).select("seq", "recon_id", "reason")


#: The fold over the frames of a set in order, three of a set at least kept.
FOLD = f"{CULL}, r1 AS (SELECT seq, recon_id, lap, clipped, dhash, CASE WHEN fail AND rk <= floor(n / 2) THEN 'blurry' WHEN clipped >= 0.5 THEN 'over/under-exposed' WHEN NOT fail AND soft THEN 'blurry' END AS reason FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY recon_id ORDER BY seq) AS rn FROM r1 WHERE reason IS NULL), fold AS (SELECT recon_id, rn, seq AS kept, lap, dhash, NULL::BIGINT AS gone FROM o WHERE rn = 1 UNION ALL SELECT o.recon_id, o.rn, CASE WHEN near AND o.lap <= f.lap THEN f.kept ELSE o.seq END, CASE WHEN near AND o.lap <= f.lap THEN f.lap ELSE o.lap END, CASE WHEN near AND o.lap <= f.lap THEN f.dhash ELSE o.dhash END, CASE WHEN near THEN CASE WHEN o.lap <= f.lap THEN o.seq ELSE f.kept END END FROM fold f JOIN (SELECT * FROM o) o ON o.recon_id = f.recon_id AND o.rn = f.rn + 1, LATERAL (SELECT bit_count(xor(o.dhash, f.dhash)) <= 3 AS near)), r2 AS (SELECT r1.seq, r1.recon_id, clipped, lap, CASE WHEN d.gone IS NOT NULL THEN 'near-duplicate' ELSE reason END AS reason FROM r1 LEFT JOIN (SELECT DISTINCT recon_id, gone FROM fold WHERE gone IS NOT NULL) d ON d.recon_id = r1.recon_id AND d.gone = r1.seq), culled AS (SELECT seq, recon_id, reason, reason IS NOT NULL AND NOT (count(*) FILTER (WHERE reason IS NULL) OVER (PARTITION BY recon_id) < 3 AND row_number() OVER (PARTITION BY recon_id ORDER BY clipped, lap DESC, seq) <= 3) AS dropped FROM r2)"


@query(f"WITH RECURSIVE {FOLD} SELECT seq, recon_id, reason, dropped FROM culled")
def near_dup_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PH.cull(R.photos(spark, sf_dir), ("recon_id",)).select("seq", "recon_id", "reason", "dropped")


@query(f"WITH {PHOTOS} SELECT recon_id, seq, CAST(bit_count(xor(dhash, prev)) AS INTEGER) AS bits FROM (SELECT *, lag(dhash) OVER (PARTITION BY recon_id ORDER BY seq) AS prev FROM photos) WHERE prev IS NOT NULL")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.photos(spark, sf_dir).withColumn("prev", F.lag("dhash").over(Window.partitionBy("recon_id").orderBy("seq"))).where("prev IS NOT NULL")
    return p.select("recon_id", "seq", G.hamming(F.col("dhash"), F.col("prev")).alias("bits"))


@query("SELECT vec_id, round(var_pop(l), 6) + 0.0 AS lap, round(avg(CASE WHEN abs(v) >= 0.25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS clipped FROM (SELECT vec_id, embedding[i + 1]::DOUBLE AS v, (CASE WHEN i % 8 = 0 THEN embedding[i + 2] ELSE embedding[i] END)::DOUBLE + (CASE WHEN i % 8 = 7 THEN embedding[i] ELSE embedding[i + 2] END)::DOUBLE + (CASE WHEN i < 8 THEN embedding[i + 9] ELSE embedding[i - 7] END)::DOUBLE + (CASE WHEN i >= 56 THEN embedding[i - 7] ELSE embedding[i + 9] END)::DOUBLE - 4 * embedding[i + 1]::DOUBLE AS l FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)) GROUP BY vec_id")
def photo_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.posexplode("embedding").alias("i", "v"))
    px = e.select("name", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("gray"))
    clipped = px.groupBy("name").agg(F.avg((F.abs("gray") >= 0.25).cast("double")).alias("clipped"))
    return rounded(PH.sharpness(px).join(clipped, "name").withColumnRenamed("name", "vec_id"), 6)


@query(f"WITH RECURSIVE {FOLD} SELECT reason, count(*) AS n, min(seq) AS first_seq FROM culled WHERE reason IS NOT NULL GROUP BY reason")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PH.reason_counts(PH.cull(R.photos(spark, sf_dir), ("recon_id",)))


# ---- segmentation responses ------------------------------------------------------------------------


@query("WITH r AS (SELECT event_id, k, round(0.2::DOUBLE + (user_id % 8) / 10.0::DOUBLE, 2) AS confidence, value * 2 * user_id * 3 * k AS area FROM events, (VALUES (1), (2)) s(k)) SELECT event_id, 'area' AS class, confidence, round(area, 1) + 0.0 AS area_px, CAST(row_number() OVER (PARTITION BY event_id ORDER BY area DESC, k) AS INTEGER) AS rank FROM r WHERE confidence >= 0.35 AND area >= 100")
def regions_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.read(spark, sf_dir, "events")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, v, u = F.lit(0.0), F.col("value"), F.col("user_id")
    box = lambda k: F.array(pt(zero, zero), pt(v * k, zero), pt(v * k, u.cast("double")), pt(zero, u.cast("double")))
    good = lambda k: F.struct(F.lit("area").alias("class"), F.round(F.lit(0.2) + (u % 8) / F.lit(10.0), 2).cast("string").alias("confidence"), box(k).alias("points"))
    bad = F.struct(F.lit("bad").alias("class"), F.lit("x").alias("confidence"), F.array().cast("array<struct<x:double,y:double>>").alias("points"))
    body = e.select("event_id", F.to_json(F.struct(F.array(good(1), bad, good(2)).alias("predictions"))).alias("body"))
    return SG.parse_polygons(body, "body", 2.0, 3.0).select("event_id", "class", "confidence", "area_px", "rank")


@query("SELECT event_id, CASE WHEN lower(event_type) LIKE '%click%' THEN CAST(user_id AS INTEGER) ELSE 1 END AS class_id FROM events")
def region_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.read(spark, sf_dir, "events")
    return e.select("event_id", SG.class_id(F.create_map(F.col("user_id").cast("string"), F.col("event_type")), "Click").alias("class_id"))

