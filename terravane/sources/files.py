"""Readers and writers of the small files around a measurement."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.session import materialize

UNREADABLE = -1
KEYPOINTS = "image_id long, table_id int, rows long, cols long"
VIEWS = "name string, image_id long, camera_id long, r array<double>, t array<double>, k array<double>, dist array<double>, width int, height int"
TRUTH = "volume_true_full_m3 double, volume_true_polygon_m3 double, K array<array<double>>, image_size array<int>, poses map<string,struct<R:array<array<double>>,t:array<double>,eye:array<double>>>, polygon_image string, polygon_px array<array<double>>"


def job_spec(spark: SparkSession, path: str) -> DataFrame:
    """A job specification: photos_dir, out_dir, scale, region, save_cloud; scale and region stay JSON."""
    text = spark.read.text(path, wholetext=True)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    return text.select(get("photos_dir").alias("photos_dir"), get("out_dir").alias("out_dir"), get("scale").alias("scale"), get("region").alias("region"), F.coalesce(get("save_cloud").try_cast("boolean"), F.lit(False)).alias("save_cloud"))


def synthetic_truth(spark: SparkSession, path: str) -> DataFrame:
    """A synthetic scene's ground truth: volumes, K, poses and the traced polygon."""
    return spark.read.json(path, schema=TRUTH, multiLine=True)


def truth_views(truth: DataFrame) -> DataFrame:
    """Views of a scene's poses, by name."""
    p = truth.select(F.flatten("K").alias("k"), "image_size", F.explode("poses").alias("name", "p"))
    return p.select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("image_id"), F.flatten("p.R").alias("r"), F.col("p.t").alias("t"), "k", F.array(*[F.lit(0.0)] * 5).alias("dist"), F.col("image_size")[0].alias("width"), F.col("image_size")[1].alias("height"))


def keypoint_counts(spark: SparkSession, path: str) -> DataFrame | None:
    """(image_id, table_id, rows, cols) of a feature database on any file system that Spark reads; table_id is 0 where the table has none. None where the file or the table can't be read (the median then counts as infinite)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in KEYPOINTS.split(", ")]
        for pdf in batches:
            for data in pdf["content"]:
                try:
                    with closing(sqlite3.connect(":memory:")) as db:
                        db.deserialize(bytes(data))
                        own = [r[1] for r in db.execute("PRAGMA table_info(keypoints)")]
                        if not own:
                            raise sqlite3.DatabaseError("no table of keypoints")
                        rows = db.execute(f"SELECT image_id, {'table_id' if 'table_id' in own else '0'}, rows, cols FROM keypoints")
                        while got := rows.fetchmany(10_000):
                            yield pd.DataFrame(got, columns=names).astype("Int64")
                except sqlite3.Error:
                    yield pd.DataFrame([(None, UNREADABLE, None, None)], columns=names).astype("Int64")

    try:
        content = spark.read.format("binaryFile").load(path).select("content")
    except AnalysisException:
        return None
    found = materialize(content.mapInPandas(read, KEYPOINTS))
    return found if found.where(F.col("table_id") == UNREADABLE).isEmpty() else None


def write_result(measurement: DataFrame, path: str) -> None:
    """A measurement (one row) as JSON."""
    measurement.coalesce(1).write.mode("overwrite").json(path)


def write_raster(cells: DataFrame, meta: DataFrame, path: str) -> None:
    """An orthophoto's covered cells as Parquet and its frame as JSON."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


LOG_TAIL = 400


def log_tail(column: str, n: int = LOG_TAIL) -> Column:
    """The last n lines of a log column (ARRAY<STRING>)."""
    c = F.col(column)
    return F.when(F.size(c) > n, F.slice(c, F.size(c) - n + 1, n)).otherwise(c)


def jobs_by_date(jobs: DataFrame) -> DataFrame:
    """Jobs (id, created, ...), the newest first, ties by id."""
    return jobs.orderBy(F.desc("created"), "id")


def write_job_states(jobs: DataFrame, path: str) -> None:
    """Job states as JSON lines, with the end of their logs and without the marker's pixels (marker_px)."""
    out = jobs.drop("marker_px")
    out = out.withColumn("log", log_tail("log")) if "log" in out.columns else out
    out.write.mode("overwrite").json(path)
