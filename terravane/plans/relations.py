"""The driver's tables as clouds, tracks, photos, views and attempts: a fixed mapping, once as DataFrames and once as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOWL_R, BOWL_DEPTH = 18.0, 6.0
POLYGON_SIDES, POLYGON_R, RIM_INNER, RIM_OUTER = 24, 18.5, 0.5, 3.0
RES, WIDTH = 0.5, 101


def polygon(sides: int = POLYGON_SIDES, r: float = POLYGON_R) -> list[tuple[float, float]]:
    return [(round(r * math.cos(2 * math.pi * i / sides), 6), round(r * math.sin(2 * math.pi * i / sides), 6)) for i in range(sides)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLOUD_SQL = """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS point_id,
       l_suppkey AS pair_id, x, y,
       0.05::DOUBLE * x - CASE WHEN sqrt(x * x + y * y) < 18.0::DOUBLE THEN 3.0::DOUBLE * (1.0::DOUBLE + cos(pi() * sqrt(x * x + y * y) / 18.0::DOUBLE)) ELSE 0.0::DOUBLE END
         + (l_discount - 0.05::DOUBLE) * 0.2::DOUBLE AS z,
       CAST(l_orderkey % 256 AS SMALLINT) AS r, CAST(l_partkey % 256 AS SMALLINT) AS g, CAST(l_suppkey % 256 AS SMALLINT) AS b
FROM (SELECT *, l_quantity - 25.5::DOUBLE + (l_tax - 0.04::DOUBLE) * 10.0::DOUBLE AS x, l_extendedprice / 2100.0::DOUBLE - 25.0::DOUBLE AS y FROM lineitem)
"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tilted cosine bowl of radius 18 and depth 6 sampled by the line items."""
    d = lambda x: F.lit(float(x))
    li = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") - d(25.5) + (F.col("l_tax") - d(0.04)) * d(10)).withColumn("y", F.col("l_extendedprice") / d(2100) - d(25))
    rad = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    bowl = F.when(rad < BOWL_R, d(3) * (d(1) + F.cos(F.pi() * rad / d(BOWL_R)))).otherwise(d(0))
    pid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(pid.alias("point_id"), F.col("l_suppkey").alias("pair_id"), "x", "y", (d(0.05) * F.col("x") - bowl + (F.col("l_discount") - d(0.05)) * d(0.2)).alias("z"), *((F.col(c) % 256).cast("short").alias(a) for a, c in (("r", "l_orderkey"), ("g", "l_partkey"), ("b", "l_suppkey"))))


TRACKS_SQL = """
SELECT l_orderkey AS point3d_id, l_suppkey AS image_id, ((CAST(l_linenumber AS BIGINT) * 100000 + l_partkey) * 1000 + CAST(l_quantity AS BIGINT)) AS elem_idx FROM lineitem
"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    idx = (F.col("l_linenumber").cast("long") * 100000 + F.col("l_partkey")) * 1000 + F.col("l_quantity").cast("long")
    return li.select(F.col("l_orderkey").alias("point3d_id"), F.col("l_suppkey").alias("image_id"), idx.alias("elem_idx"))


VIEWS_SQL = """
SELECT s_suppkey AS image_id, s_name AS name, [1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0, 0.0]::DOUBLE[] AS r,
       [-(CAST(s_suppkey % 20 AS DOUBLE) - 10.0::DOUBLE), CAST(s_suppkey % 7 AS DOUBLE) - 3.0::DOUBLE + 20.0::DOUBLE, 40.0::DOUBLE + CAST(s_nationkey AS DOUBLE)]::DOUBLE[] AS t
FROM supplier
"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras south of the scene that look north; K and distortion are those of a small OPENCV camera."""
    s = read(spark, sf_dir, "supplier")
    lits = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    k = F.col("s_suppkey")
    t = F.array(-((k % 20).cast("double") - 10.0), (k % 7).cast("double") - 3.0 + 20.0, 40.0 + F.col("s_nationkey").cast("double"))
    return s.select(k.alias("image_id"), F.col("s_name").alias("name"), lits(1, 0, 0, 0, 0, -1, 0, 1, 0).alias("r"), t.alias("t"), lits(800, 0, 320, 0, 800, 240, 0, 0, 1).alias("k"), lits(0.05, -0.01, 0.001, -0.002, 0.003).alias("dist"))


PHOTOS_SQL = """
SELECT vec_id AS seq, label AS recon_id, list_sum(list_transform(embedding, lambda v: abs(v::DOUBLE))) * 3.0::DOUBLE AS lap,
       CAST(len(list_filter(embedding, lambda v: v::DOUBLE > 0.1::DOUBLE)) AS DOUBLE) / 25.0::DOUBLE AS clipped,
       CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN CAST(pow(2::DOUBLE, i % 12) AS BIGINT) ELSE 0 END)) AS BIGINT) AS dhash
FROM embeddings
"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo metrics from the embeddings: one set (recon_id) for each label."""
    e = read(spark, sf_dir, "embeddings")
    total = lambda a, zero: F.aggregate(a, zero, lambda s, v: s + v)
    bits = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.when(F.get("embedding", i) > F.get("embedding", i - 1), F.pow(F.lit(2.0), (i % 12).cast("double")).cast("long")).otherwise(F.lit(0).cast("long")))
    return e.select(F.col("vec_id").alias("seq"), F.col("label").alias("recon_id"), (total(F.transform("embedding", lambda v: F.abs(v.cast("double"))), F.lit(0.0)) * 3.0).alias("lap"), (F.size(F.filter("embedding", lambda v: v.cast("double") > F.lit(0.1))).cast("double") / 25.0).alias("clipped"), total(bits, F.lit(0).cast("long")).alias("dhash"))
