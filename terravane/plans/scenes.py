"""Further registered queries: synthetic scenes, cameras, frames, regions on photos, photo intake and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.operators import attempts as AT
from terravane.operators import cloud as CL
from terravane.operators import dense as DN
from terravane.operators import fits as FT
from terravane.operators import photos as PH
from terravane.operators import region as RG
from terravane.operators import scale as SC
from terravane.operators import surface as SF
from terravane.operators.graph import covisibility, tracks_of
from terravane.plans import relations as R
from terravane.plans.catalogue import CLOUD, COVIS, GRID, MARKS, OVER, PLANE, TRACKS, VIEWS, _region, _split, query, rounded
from terravane.session import materialize
from terravane.sources import synthetic as SY

# ---- synthetic scene -------------------------------------------------------------------------------

_STEP = 36.0 / 169
_NOISE = " + ".join(
    f"{amp!r}::DOUBLE * (SELECT (v(i, j) * (1 - a) + v(i + 1, j) * a) * (1 - b) + (v(i, j + 1) * (1 - a) + v(i + 1, j + 1) * a) * b FROM (SELECT floor(x * {cells / 36.0!r}::DOUBLE) AS i, floor(y * {cells / 36.0!r}::DOUBLE) AS j, x * {cells / 36.0!r}::DOUBLE - floor(x * {cells / 36.0!r}::DOUBLE) AS a, y * {cells / 36.0!r}::DOUBLE - floor(y * {cells / 36.0!r}::DOUBLE) AS b))".replace("v(", f"n{k}(")
    for k, (cells, amp) in enumerate(SY.OCTAVES)
)
_LATTICE_VALUE = "(CAST({i} AS BIGINT) * 7919 + CAST({j} AS BIGINT) * 104729 + (CAST({i} AS BIGINT) * CAST({j} AS BIGINT)) * 31 + {k} * 15485863) % 65521 / 65521.0::DOUBLE"


def _plain(sql: str) -> str:
    """Write the lattice values n<k>(i, j) out: DuckDB macros would need a statement of their own."""
    for k in range(len(SY.OCTAVES)):
        for i in ("i", "i + 1"):
            for j in ("j", "j + 1"):
                sql = sql.replace(f"n{k}({i}, {j})", "(" + _LATTICE_VALUE.format(i=f"({i})", j=f"({j})", k=k) + ")")
    return sql


BOWL = "CASE WHEN sqrt((x - 17.5::DOUBLE) * (x - 17.5::DOUBLE) + (y - 18.5::DOUBLE) * (y - 18.5::DOUBLE)) < 6.0 THEN 2.0::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * sqrt((x - 17.5::DOUBLE) * (x - 17.5::DOUBLE) + (y - 18.5::DOUBLE) * (y - 18.5::DOUBLE)) / 6.0::DOUBLE)) ELSE 0.0::DOUBLE END"
TERRAIN = _plain(f"lat AS (SELECT id AS point_id, id // 170 AS iy, id % 170 AS ix, (id % 170) * {_STEP!r}::DOUBLE AS x, (id // 170) * {_STEP!r}::DOUBLE AS y FROM (SELECT unnest(range(28900)) AS id)), terrain AS (SELECT *, {BOWL} AS bowl, 0.1::DOUBLE * x + 0.03::DOUBLE * y + {_NOISE} AS ground FROM lat)")


@query(f"WITH {TERRAIN} SELECT point_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(ground - bowl, 4) + 0.0 AS z, round(bowl, 4) + 0.0 AS bowl FROM terrain")
def synthetic_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice of a synthetic scene with a known bowl."""
    return rounded(SY.terrain(spark).select("point_id", "x", "y", "z", "bowl"))


@query(f"WITH {TERRAIN} SELECT round(sum(bowl) * {_STEP!r}::DOUBLE * {_STEP!r}::DOUBLE, 4) + 0.0 AS full_m3, round(sum(CASE WHEN sqrt((x - 17.5::DOUBLE) * (x - 17.5::DOUBLE) + (y - 18.5::DOUBLE) * (y - 18.5::DOUBLE)) < 5.6::DOUBLE THEN bowl ELSE 0 END) * {_STEP!r}::DOUBLE * {_STEP!r}::DOUBLE, 4) + 0.0 AS polygon_m3 FROM terrain")
def synthetic_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SY.true_volumes(SY.terrain(spark)).withColumnsRenamed({"full": "full_m3", "polygon": "polygon_m3"}))


@query("WITH e AS (SELECT i, 17.5::DOUBLE + 26.0::DOUBLE * sin(radians(-48.0::DOUBLE + 96.0::DOUBLE * i / 20)) AS ex, 18.5::DOUBLE - 26.0::DOUBLE * cos(radians(-48.0::DOUBLE + 96.0::DOUBLE * i / 20)) AS ey, 9.0::DOUBLE AS ez FROM (SELECT unnest(range(21)) AS i)), f AS (SELECT *, (17.5::DOUBLE - ex) / n AS fx, (18.5::DOUBLE - ey) / n AS fy, (2.0::DOUBLE - ez) / n AS fz FROM (SELECT *, sqrt((17.5::DOUBLE - ex) * (17.5::DOUBLE - ex) + (18.5::DOUBLE - ey) * (18.5::DOUBLE - ey) + (2.0::DOUBLE - ez) * (2.0::DOUBLE - ez)) AS n FROM e)), r AS (SELECT *, fy / sqrt(fx * fx + fy * fy) AS rx, -fx / sqrt(fx * fx + fy * fy) AS ry FROM f) SELECT i AS image_id, round(rx, 4) + 0.0 AS r0, round(ry, 4) + 0.0 AS r1, round(-fz * ry, 4) + 0.0 AS r3, round(fz * rx, 4) + 0.0 AS r4, round(fx, 4) + 0.0 AS r6, round(fz, 4) + 0.0 AS r8, round(-(rx * ex + ry * ey), 4) + 0.0 AS t0, round(-(fx * ex + fy * ey + fz * ez), 4) + 0.0 AS t2 FROM r")
def synthetic_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses that look at the bowl from an arc."""
    c = SY.cameras(spark, 2.0, 2.0)
    return rounded(c.select("image_id", *(F.col("r")[i].alias(f"r{i}") for i in (0, 1, 3, 4, 6, 8)), *(F.col("t")[i].alias(f"t{i}") for i in (0, 2))))


# ---- cameras and frames ----------------------------------------------------------------------------

_MODELS = ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "FULL_OPENCV")


@query("WITH cam AS (SELECT n_nationkey AS camera_id, CASE n_nationkey % 6 WHEN 0 THEN 'SIMPLE_PINHOLE' WHEN 1 THEN 'PINHOLE' WHEN 2 THEN 'SIMPLE_RADIAL' WHEN 3 THEN 'RADIAL' WHEN 4 THEN 'OPENCV' ELSE 'FULL_OPENCV' END AS model, [500.0::DOUBLE + n_nationkey, 320, 240, 0.01::DOUBLE * n_nationkey, 0.02::DOUBLE, 0.03::DOUBLE, 0.04::DOUBLE, 0.05::DOUBLE, 0.06::DOUBLE] AS p FROM nation) SELECT s_suppkey AS image_id, camera_id, p[1] AS fx, CASE WHEN model IN ('SIMPLE_PINHOLE', 'SIMPLE_RADIAL', 'RADIAL') THEN p[1] ELSE p[2] END AS fy, CASE WHEN model IN ('SIMPLE_PINHOLE', 'SIMPLE_RADIAL', 'RADIAL') THEN p[2] ELSE p[3] END AS cx, CASE model WHEN 'SIMPLE_RADIAL' THEN p[4] WHEN 'RADIAL' THEN p[4] WHEN 'OPENCV' THEN p[5] WHEN 'FULL_OPENCV' THEN p[5] ELSE 0 END AS k1, CASE model WHEN 'RADIAL' THEN p[5] WHEN 'OPENCV' THEN p[6] WHEN 'FULL_OPENCV' THEN p[6] ELSE 0 END AS k2, CASE WHEN model IN ('OPENCV', 'FULL_OPENCV') THEN p[7] ELSE 0 END AS p1, CASE model WHEN 'FULL_OPENCV' THEN p[9] ELSE 0 END AS k3 FROM supplier JOIN cam ON s_nationkey = camera_id WHERE s_acctbal > 0")
def posed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered images with the matrix and distortion of their camera's model."""
    n = F.col("n_nationkey")
    model = F.element_at(F.array(*(F.lit(m) for m in _MODELS)), (n % 6 + 1).cast("int"))
    params = F.array(F.lit(500.0) + n, F.lit(320.0), F.lit(240.0), F.lit(0.01) * n, *(F.lit(x) for x in (0.02, 0.03, 0.04, 0.05, 0.06)))
    cams = R.read(spark, sf_dir, "nation").select(n.alias("camera_id"), model.alias("model"), params.alias("params"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    zero = F.array(F.lit(0.0))
    images = R.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("camera_id"), (F.col("s_acctbal") > 0).alias("has_pose"), zero.alias("r"), zero.alias("t"))
    v = AT.posed_images(images, cams)
    return v.select("image_id", "camera_id", F.col("k")[0].alias("fx"), F.col("k")[4].alias("fy"), F.col("k")[2].alias("cx"), F.col("dist")[0].alias("k1"), F.col("dist")[1].alias("k2"), F.col("dist")[2].alias("p1"), F.col("dist")[4].alias("k3"))


@query("WITH m AS (SELECT o_custkey % 200 AS recon_id, o_orderkey AS idx, o_orderstatus AS model, CAST(floor(o_totalprice) AS BIGINT) % 7 AS nreg FROM orders) SELECT recon_id, idx, model, nreg FROM (SELECT *, row_number() OVER (PARTITION BY recon_id ORDER BY nreg DESC, idx) AS rn FROM m WHERE nreg > 0) WHERE rn = 1")
def largest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.read(spark, sf_dir, "orders")
    return AT.largest_model(o.select((F.col("o_custkey") % 200).alias("recon_id"), F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("model"), (F.floor("o_totalprice").cast("long") % 7).alias("nreg")))


@query("SELECT c_custkey, round((c_custkey * 37 % 640 - 320.5::DOUBLE) / 800.0::DOUBLE, 6) + 0.0 AS u, round((c_custkey * 53 % 480 - 240.25::DOUBLE) / 790.0::DOUBLE, 6) + 0.0 AS v FROM customer")
def undistorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized coordinates of pixels of a pinhole camera."""
    k = F.array(*(F.lit(float(x)) for x in (800, 0, 320.5, 0, 790, 240.25, 0, 0, 1)))
    u, v = G.undistort((F.col("c_custkey") * 37 % 640).cast("double"), (F.col("c_custkey") * 53 % 480).cast("double"), k)
    return rounded(R.read(spark, sf_dir, "customer").select("c_custkey", u.alias("u"), v.alias("v")), 6)


@query("WITH up AS (SELECT c_custkey, c_custkey % 21 - 10.0::DOUBLE AS a, c_custkey % 5 - 2.0::DOUBLE AS b, 1.0::DOUBLE + c_custkey % 3 AS c, c_acctbal / 1000.0::DOUBLE AS x, c_nationkey * 1.0::DOUBLE AS y, 2.5::DOUBLE AS z FROM customer), n AS (SELECT *, a / l AS n0, b / l AS n1, c / l AS n2 FROM (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM up)), s AS (SELECT *, CASE WHEN abs(n0) > 0.9::DOUBLE THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS sx, CASE WHEN abs(n0) > 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sy FROM n), g AS (SELECT *, sx - d * n0 AS g0, sy - d * n1 AS g1, -d * n2 AS g2 FROM (SELECT *, sx * n0 + sy * n1 AS d FROM s)), e AS (SELECT *, g0 / m AS e0, g1 / m AS e1, g2 / m AS e2 FROM (SELECT *, sqrt(g0 * g0 + g1 * g1 + g2 * g2) AS m FROM g)) SELECT c_custkey, round(x * e0 + y * e1 + z * e2, 4) + 0.0 AS u, round(x * (n1 * e2 - n2 * e1) + y * (n2 * e0 - n0 * e2) + z * (n0 * e1 - n1 * e0), 4) + 0.0 AS v, round(x * n0 + y * n1 + z * n2, 4) + 0.0 AS h, round(100.0::DOUBLE + c_custkey % 70 * 0.05::DOUBLE, 4) + 0.0 AS pu FROM e")
def ground_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground coordinates under many directions of up, and a pixel's place on the ground."""
    k = F.col("c_custkey")
    c = R.read(spark, sf_dir, "customer").select(k, (k % 21 - 10).cast("double").alias("a"), (k % 5 - 2).cast("double").alias("b"), (1 + k % 3).cast("double").alias("c"), (F.col("c_acctbal") / 1000.0).alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(2.5).alias("z"))
    n, e1, e2 = G.ground_basis([F.col("a"), F.col("b"), F.col("c")])
    u, v, h = G.ground_coords([F.col("x"), F.col("y"), F.col("z")], n, e1, e2)
    pu, _ = G.pixel_to_ground((k % 70).cast("double"), F.lit(0.0), F.lit(100.0), F.lit(0.0), F.lit(0.05))
    return rounded(c.select("c_custkey", u.alias("u"), v.alias("v"), h.alias("h"), pu.alias("pu")))


_CENTRES = "ctr AS (SELECT image_id, -(r[1] * t[1] + r[4] * t[2] + r[7] * t[3]) AS x, -(r[2] * t[1] + r[5] * t[2] + r[8] * t[3]) AS y, -(r[3] * t[1] + r[6] * t[2] + r[9] * t[3]) AS z FROM views)"


@query(f"WITH {VIEWS}, {TRACKS}, {COVIS}, {_CENTRES}, ray AS (SELECT a, b, n_nationkey, n_nationkey - 12.0::DOUBLE AS x, n_nationkey % 5 * 4.0::DOUBLE - 8.0::DOUBLE AS y, n_regionkey * 0.5::DOUBLE AS z FROM covis, nation WHERE a <> b AND shared >= 3), ang AS (SELECT ray.a, ray.b, degrees(acos(least(greatest(((p.x - ray.x) * (q.x - ray.x) + (p.y - ray.y) * (q.y - ray.y) + (p.z - ray.z) * (q.z - ray.z)) / sqrt((p.x - ray.x) * (p.x - ray.x) + (p.y - ray.y) * (p.y - ray.y) + (p.z - ray.z) * (p.z - ray.z)) / sqrt((q.x - ray.x) * (q.x - ray.x) + (q.y - ray.y) * (q.y - ray.y) + (q.z - ray.z) * (q.z - ray.z)), -1), 1))) AS deg FROM ray JOIN ctr p ON p.image_id = a JOIN ctr q ON q.image_id = b) SELECT a, b, round(min(deg), 3) + 0.0 AS angle_deg FROM ang GROUP BY a, b")
def ray_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest angle under which two cameras see any of some points, for pairs with three shared points or more."""
    views = R.views(spark, sf_dir).select("image_id", G.camera_centre("r", "t").alias("c"))
    pairs = covisibility(R.tracks(spark, sf_dir)).where("a <> b AND shared >= 3")
    n = F.col("n_nationkey")
    points = R.read(spark, sf_dir, "nation").select(F.array((n - 12).cast("double"), (n % 5 * 4 - 8).cast("double"), F.col("n_regionkey") * 0.5).alias("x"))
    both = pairs.join(views.withColumnsRenamed({"image_id": "a", "c": "ca"}), "a").join(views.withColumnsRenamed({"image_id": "b", "c": "cb"}), "b").crossJoin(F.broadcast(points))  # the 25 rows of nation
    return rounded(both.groupBy("a", "b").agg(F.min(G.ray_angle(G.items("x", 3), G.items("ca", 3), G.items("cb", 3))).alias("angle_deg")), 3)


@query("SELECT l_suppkey, round(CASE WHEN count(*) * 20000 > 2500000 THEN 0.05::DOUBLE * sqrt(count(*) * 20000 / 2500000.0::DOUBLE) ELSE 0.05::DOUBLE END, 6) + 0.0 AS voxel FROM lineitem GROUP BY l_suppkey")
def voxel_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.count("*") * 20000).alias("n"))
    return rounded(n.select("l_suppkey", G.voxel_for_cap(F.lit(0.05), F.col("n")).alias("voxel")), 6)


@query(f"WITH {VIEWS}, {_CENTRES}, m AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz, count(*) AS n FROM ctr), {PLANE[PLANE.index('e1 AS'):]}, {CLOUD}, side AS (SELECT (cx - (SELECT avg(x) FROM cloud)) * nx + (cy - (SELECT avg(y) FROM cloud)) * ny + (cz - (SELECT avg(z) FROM cloud)) * nz AS s FROM plane) SELECT round(CASE WHEN s >= 0 THEN nx ELSE -nx END, 4) + 0.0 AS ux, round(CASE WHEN s >= 0 THEN ny ELSE -ny END, 4) + 0.0 AS uy, round(CASE WHEN s >= 0 THEN nz ELSE -nz END, 4) + 0.0 AS uz FROM plane, side")
def up_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal of the camera centres, on their side of the cloud."""
    c = R.views(spark, sf_dir).select(G.camera_centre("r", "t").alias("c")).select(*(F.col("c")[i].alias(a) for i, a in enumerate("xyz")))
    up = FT.up_direction(c, R.cloud(spark, sf_dir))
    return rounded(spark.createDataFrame([tuple(map(float, up))], "ux double, uy double, uz double"))


@query(f"WITH {CLOUD}, {MARKS}, {PLANE} SELECT round(median(abs((x - cx) * nx + (y - cy) * ny + (z - cz) * nz)), 4) + 0.0 AS residual, round(max(z) FILTER (WHERE rim) - min(z) FILTER (WHERE rim), 4) + 0.0 AS rim_span FROM split, plane WHERE interior OR rim")
def rim_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median distance of the region and its rim from the rim's plane, and the height that the rim spans."""
    region = _region(spark, sf_dir)
    plane = FT.plane_of(region.where("rim"))
    span = region.where("rim").agg(F.max("z") - F.min("z")).first()[0]
    return rounded(spark.createDataFrame([(FT.median_residual(region, plane), float(span))], "residual double, rim_span double"))


@query(f"WITH {OVER} SELECT round(sqrt(pow(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), 2) + pow(quantile_cont(y, 0.99) - quantile_cont(y, 0.01), 2)), 4) + 0.0 AS diameter, count(*) FILTER (WHERE h <= 0.5) AS n_low FROM over")
def region_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonal of the box of percentiles 1 to 99, and the points that are not high over the plane."""
    from terravane.plans.catalogue import _over_plane

    p = lambda c, q: F.percentile(c, F.lit(q))
    over = _over_plane(_region(spark, sf_dir))
    return rounded(over.agg(F.hypot(p("x", 0.99) - p("x", 0.01), p("y", 0.99) - p("y", 0.01)).alias("diameter"), F.sum((F.col("h") <= 0.5).cast("long")).alias("n_low")))


@query(f"WITH {CLOUD}, {GRID.replace('/ 1.0)', '/ 2.0)')}, q AS (SELECT c_custkey, c_custkey % 97 * 0.5::DOUBLE AS x, c_custkey % 89 * 0.5::DOUBLE AS y FROM customer), f AS (SELECT *, CAST(floor(x / 2) AS BIGINT) AS i, CAST(floor(y / 2) AS BIGINT) AS j, x / 2 - floor(x / 2) AS fx, y / 2 - floor(y / 2) AS fy FROM q) SELECT c_custkey, round((a.h * (1 - fx) + b.h * fx) * (1 - fy) + (c.h * (1 - fx) + d.h * fx) * fy, 4) + 0.0 AS h FROM f LEFT JOIN grid a ON a.iy = j AND a.ix = i LEFT JOIN grid b ON b.iy = j AND b.ix = i + 1 LEFT JOIN grid c ON c.iy = j + 1 AND c.ix = i LEFT JOIN grid d ON d.iy = j + 1 AND d.ix = i + 1")
def bilinear_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = materialize(CL.grid_bin_mean(R.cloud(spark, sf_dir), 2.0).select("iy", "ix", "h"))
    k = F.col("c_custkey")
    q = R.read(spark, sf_dir, "customer").select(k, (k % 97 * 0.5).alias("x"), (k % 89 * 0.5).alias("y"))
    return rounded(SF.bilinear(grid, q, 2.0).select("c_custkey", "h"))


# ---- regions on photos -----------------------------------------------------------------------------

PHOTO_POLYGON = [(150.0, 450.0), (500.0, 430.0), (620.0, 560.0), (420.0, 720.0), (130.0, 640.0)]
_PHOTO_EDGES = "pe(x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {d!r}::DOUBLE)" for (a, b), (c, d) in zip(PHOTO_POLYGON, PHOTO_POLYGON[1:] + PHOTO_POLYGON[:1], strict=True)) + ")"


@query(f"WITH {CLOUD}, {VIEWS}, {TRACKS}, {COVIS}, {_PHOTO_EDGES}, own AS (SELECT min(image_id) AS i FROM views), nb AS (SELECT CASE WHEN a = i THEN b ELSE a END AS i FROM covis, own WHERE (a = i OR b = i) AND a <> b ORDER BY shared DESC, 1 DESC LIMIT 1), chosen AS (SELECT i, 1.0::DOUBLE AS m FROM own UNION ALL SELECT i, 2.0::DOUBLE FROM nb), q AS (SELECT point_id, m, x + t[1] AS cx, -z + t[2] AS cy, y + t[3] AS cz FROM cloud, views JOIN chosen ON image_id = i), n AS (SELECT *, cx / cz AS a, cy / cz AS b FROM q), w AS (SELECT *, a * a + b * b AS r2 FROM n), uv AS (SELECT point_id, m, 800 * (a * (1 + r2 * (0.05::DOUBLE + r2 * (-0.01::DOUBLE + r2 * 0.003::DOUBLE))) + 2 * 0.001::DOUBLE * a * b + -0.002::DOUBLE * (r2 + 2 * a * a)) + 320 AS u, 800 * (b * (1 + r2 * (0.05::DOUBLE + r2 * (-0.01::DOUBLE + r2 * 0.003::DOUBLE))) + 0.001::DOUBLE * (r2 + 2 * b * b) + 2 * -0.002::DOUBLE * a * b) + 240 AS v FROM w), s AS (SELECT *, least(greatest(((u - x1) * (x2 - x1) + (v - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS s FROM uv, pe), d AS (SELECT point_id, m, sum(CASE WHEN (y1 > v) <> (y2 > v) AND u < x1 + (v - y1) * ((x2 - x1) / (y2 - y1)) THEN 1 ELSE 0 END) % 2 = 1 AS inside, min(sqrt(pow(u - x1 - s * (x2 - x1), 2) + pow(v - y1 - s * (y2 - y1), 2))) AS dist FROM s GROUP BY point_id, m), k AS (SELECT point_id, bool_and(inside) AS interior, bool_and(dist >= 6 * m AND dist <= 18 * m) AS ring FROM d GROUP BY point_id) SELECT interior, ring AND NOT interior AS rim, count(*) AS n, CAST(sum(point_id % 1000003) AS BIGINT) AS ids FROM k GROUP BY ALL")
def photo_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud split by a polygon on a photo and on the photo that shares most points with it."""
    views = materialize(R.views(spark, sf_dir))
    primary = views.agg(F.min("image_id")).first()[0]
    shared = covisibility(tracks_of(R.tracks(spark, sf_dir), primary))
    marks = RG.photo_marks(R.cloud(spark, sf_dir), RG.neighbour_views(primary, views, shared, 1), PHOTO_POLYGON, primary)
    return marks.groupBy("interior", "rim").agg(F.count("*").alias("n"), F.sum(F.col("point_id") % 1000003).alias("ids"))


_DISPARITY = "base AS (SELECT l_suppkey % 10 AS pair_id, CAST(l_orderkey % 100 AS INTEGER) AS row, CAST(l_partkey % 64 AS INTEGER) AS col, avg(l_quantity) / 10 AS d FROM lineitem GROUP BY ALL)"


@query(f"WITH {_DISPARITY} SELECT l.pair_id, l.row, l.col, round(l.d, 4) + 0.0 AS disp FROM base l JOIN base r ON r.pair_id = l.pair_id AND r.row = l.row AND r.col = CAST(least(greatest(l.col - round_even(l.d, 0), 0), 63) AS INTEGER) WHERE abs(l.d - r.d) <= 1.5")
def consistent_disparities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left disparities that the right image confirms."""
    li = R.read(spark, sf_dir, "lineitem")
    base = li.groupBy((F.col("l_suppkey") % 10).alias("pair_id"), (F.col("l_orderkey") % 100).cast("int").alias("row"), (F.col("l_partkey") % 64).cast("int").alias("col")).agg((F.avg("l_quantity") / 10).alias("disp"))
    base = materialize(base)
    return rounded(DN.consistent(base, base.withColumn("disp", -F.col("disp")), 64).select("pair_id", "row", "col", "disp"))


# ---- photos and markers ----------------------------------------------------------------------------


@query("SELECT vec_id, round(avg(CASE WHEN g <= 2 OR g >= 253 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS clipped FROM (SELECT vec_id, least(greatest(round_even((unnest(embedding)::DOUBLE + 0.3::DOUBLE) * 400, 0), 0), 255) AS g FROM embeddings) GROUP BY vec_id")
def clip_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.explode("embedding").alias("v"))
    px = e.select("name", G.clip(F.rint((F.col("v").cast("double") + F.lit(0.3)) * 400), 0.0, 255.0).alias("gray"))
    return rounded(PH.clip_fraction(px).withColumnRenamed("name", "vec_id"), 6)


@query("SELECT c_mktsegment, c_custkey, CAST(seq AS INTEGER) AS seq, printf('%03d_%s.jpg', seq, c_name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS seq FROM customer)")
def import_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture order and normalized names of uploads."""
    c = R.read(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat(F.lit("in/"), "c_name", F.lit(".JPEG")).alias("path"))
    return PH.import_names(c, "c_custkey", ("c_mktsegment",)).select("c_mktsegment", "c_custkey", "seq", "name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY l_orderkey) c WHERE l_orderkey = o_orderkey AND m >= o_orderdate)")
def stale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = R.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("mtime"))
    copies = R.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.max("l_shipdate").alias("mtime"))
    return PH.stale_copies(photos, copies).select(F.col("name").alias("o_orderkey"))


@query("WITH c AS (SELECT c_custkey // 4 AS recon_id, c_custkey % 4 AS i, CASE WHEN c_custkey % 4 IN (1, 2) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + c_acctbal / 100000.0::DOUBLE AS x, CASE WHEN c_custkey % 4 IN (2, 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, c_nationkey / 100.0::DOUBLE AS z FROM customer), s AS (SELECT a.recon_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS side FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY recon_id) AS n FROM c WINDOW w AS (PARTITION BY recon_id ORDER BY i)) a JOIN (SELECT *, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY recon_id ORDER BY i)) b ON a.recon_id = b.recon_id AND b.k = a.k % a.n + 1) SELECT recon_id, round(avg(side), 6) + 0.0 AS mean_side, round(stddev_pop(side) / avg(side), 6) + 0.0 AS side_spread_rel FROM s GROUP BY recon_id HAVING avg(side) > 0")
def marker_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean side and spread of quadrilateral markers."""
    k = F.col("c_custkey")
    i = k % 4
    c = R.read(spark, sf_dir, "customer").select(F.floor(k / 4).alias("recon_id"), i.alias("corner_idx"), (i.isin(1, 2).cast("double") + F.col("c_acctbal") / 100000.0).alias("x"), i.isin(2, 3).cast("double").alias("y"), (F.col("c_nationkey") / 100.0).alias("z"))
    return rounded(SC.marker_sides(c).where("mean_side > 0").select("recon_id", "mean_side", "side_spread_rel"), 6)


@query(f"WITH {CLOUD}, {MARKS} SELECT interior AND NOT rim AS only_interior, rim OR interior AS kept, count(*) AS n FROM split GROUP BY ALL")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir)
    return s.groupBy((F.col("interior") & ~F.col("rim")).alias("only_interior"), (F.col("rim") | F.col("interior")).alias("kept")).agg(F.count("*").alias("n"))


