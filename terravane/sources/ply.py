"""PLY clouds (binary little endian: x, y, z as float32, then red, green, blue as bytes) on any file system that Spark reads.

Reading goes through Spark's binaryFile source, one row a file. Writing packs the points on the executors; the driver streams
the packed pieces, one partition at a time, into a single file through Hadoop's file system, under a temporary name that is
renamed at the end, so that a failed write leaves no file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.session import ship

RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])
SCHEMA = "x float, y float, z float, r short, g short, b short"


def header(n: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {a}" for a in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue")), "end_header", ""]
    return "\n".join(lines).encode()


def from_bytes(data: bytes) -> np.ndarray:
    end = data.index(b"end_header\n") + len(b"end_header\n")
    n = next(int(x.split()[2]) for x in data[:end].splitlines() if x.startswith(b"element vertex"))
    return np.frombuffer(data, RECORD, n, end)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """The points of a file, or of all .ply files of a folder."""
    ship(spark)

    def run(batch: pa.RecordBatch):  # noqa: ANN202
        for i in range(batch.num_rows):
            p = from_bytes(batch.column(0)[i].as_py())
            for k in range(0, len(p), 50_000):
                q = p[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(q[c]) if c in "xyz" else q[c].astype(np.int16)) for c in RECORD.names], list(RECORD.names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("content")
    return files.mapInArrow(lambda batches: (out for batch in batches for out in run(batch)), SCHEMA)


def write_ply(points: DataFrame, path: str) -> int:
    """Write (x, y, z, r, g, b) as one file; the number of points. Rows without a position are left out, missing colours are gray."""
    spark = ship(points.sparkSession)
    whole = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select(*(F.col(a).cast("float") for a in "xyz"), *(F.coalesce(F.col(c), F.lit(128)).cast("short").alias(c) for c in "rgb"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.empty(batch.num_rows, RECORD)
        for k, c in enumerate(RECORD.names):
            out[c] = batch.column(k).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["data", "n"])

    n = whole.count()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    unfinished = spark._jvm.org.apache.hadoop.fs.Path(f"{path}._writing")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(unfinished, True)
    try:
        out.write(bytearray(header(n)))
        for r in whole.mapInArrow(lambda batches: map(pack, batches), "data binary, n long").toLocalIterator():
            out.write(bytearray(r["data"]))
        out.close()
        fs.delete(target, False)
        fs.rename(unfinished, target)
    except Exception:
        out.close()
        fs.delete(unfinished, False)
        raise
    return n
