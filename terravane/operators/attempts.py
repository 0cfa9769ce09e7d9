"""Choosing among reconstruction attempts and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_PER_IMAGE = 30
LOW_CONTRAST = 2500


def score(nreg: str = "nreg", npts: str = "npts") -> Column:
    """Lexicographic rank: usable (30 points an image), registered images, points."""
    usable = (F.col(npts) >= POINTS_PER_IMAGE * F.greatest(F.col(nreg), F.lit(1))).cast("int")
    return F.struct(usable.alias("usable"), F.col(nreg).alias("nreg"), F.col(npts).alias("npts"))


def ladder(spark: SparkSession, n: int, size: int = 2400) -> DataFrame:
    """The retry ladder for n photos, cheapest first."""
    rows = [
        (0, "default", "exhaustive" if n <= 45 else "sequential", 12, size, False, False, None, None),
        (1, "dense sequential", "sequential", min(25, n - 1), 3200, False, False, None, None),
        (2, "enhanced", "sequential", min(25, n - 1), size, False, True, 0.0035, 15.0),
        (3, "shared intrinsics", "exhaustive" if n <= 60 else "sequential", 12, size, True, False, None, None),
    ]
    return spark.createDataFrame(rows, "idx int, label string, matcher string, overlap int, max_size int, shared_camera boolean, enhanced boolean, peak double, edge double")


def choose(attempts: DataFrame, by: tuple[str, ...] = ("recon_id",)) -> DataFrame:
    """The chosen attempt of each group and a status. attempts: (by, idx, label, nreg, npts, n_photos[, ...]).

    Attempts after the first that is done (usable, 90 % of the photos and at least 3) do not count; the best
    score wins, the earlier one on a tie. Fails under max(3, half the photos); warns of thin geometry.
    """
    rows = attempts.withColumn("score", score())
    done = (F.col("score.usable") == 1) & (F.col("nreg") >= F.greatest(F.lit(3), F.floor(0.9 * F.col("n_photos"))))
    best = F.max_by(F.struct("idx", "label", "nreg", "npts", "n_photos", "score"), F.struct("score", (-F.col("idx")).alias("i")))
    stop = rows.where(done).groupBy(*by).agg(F.min("idx").alias("_stop"))
    out = rows.join(stop, list(by), "left").where(F.col("_stop").isNull() | (F.col("idx") <= F.col("_stop"))).groupBy(*by).agg(best.alias("b")).select(*by, "b.idx", "b.label", "b.nreg", "b.npts", "b.n_photos", F.col("b.score.usable").alias("usable"))
    status = F.when(F.col("nreg") < F.greatest(F.lit(3), F.floor(0.5 * F.col("n_photos"))), "too few images").when(F.col("usable") == 0, "thin geometry").otherwise("ok")
    return out.withColumn("status", status)


def skip_enhanced(best_median_keypoints: float | None) -> bool:
    """The enhanced attempt is pointless where contrast is not the problem."""
    return best_median_keypoints is not None and best_median_keypoints >= LOW_CONTRAST


def largest_model(models: DataFrame, by: tuple[str, ...] = ("recon_id",)) -> DataFrame:
    """The model with most registered images (the first on a tie); empty ones don't count. models: (by, idx, model, nreg)."""
    return models.where("nreg > 0").groupBy(*by).agg(F.max_by(F.struct("idx", "model", "nreg"), F.struct("nreg", (-F.col("idx")).alias("i"))).alias("m")).select(*by, "m.*")


def posed_images(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Views: registered images with their camera's matrix and distortion."""
    from terravane.functions import geometry as G

    return images.where("has_pose").join(cameras, "camera_id").select("image_id", "name", "camera_id", "r", "t", G.intrinsics("model", "params").alias("k"), G.distortion_vector("model", "params").alias("dist"), "width", "height")


def sparse_colours(points: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """Colours of a sparse cloud: re-extracted ones where the given are all black (a maximum under 2), else gray 128 for missing."""
    top = points.agg(F.max(F.greatest("r", "g", "b")).alias("_top"))
    out = points.crossJoin(F.broadcast(top))
    dark = F.coalesce(F.col("_top"), F.lit(0)) < 2
    if extracted is not None:
        out = out.join(extracted.select("point_id", *(F.col(a).alias(f"_{a}") for a in "rgb")), "point_id", "left")
    new = {a: F.coalesce(F.when(dark, F.col(f"_{a}") if extracted is not None else F.lit(None)), F.when(~dark, F.col(a)), F.lit(128)) for a in "rgb"}
    return out.withColumns(new).select(*points.columns)


def median_keypoints(keypoints: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Median count of keypoints an image; null and zero counts don't count, nor tables other than 0 where there is a table_id. No rows: 0."""
    rows = keypoints.where("rows > 0")
    if "table_id" in keypoints.columns:
        rows = rows.where("table_id = 0")
    return rows.groupBy(*by).agg(F.coalesce(F.median("rows"), F.lit(0.0)).alias("median_keypoints"))
