"""Photo intake: listing, naming, metrics and culling.

Photo metrics are a table (seq, name, lap, clipped, dhash); a set of photos is one upload, so that the
ordered fold over it (near-duplicates of the last kept frame) is one small array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geometry as G

#: The photo formats accepted.
SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


def list_photos(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the photos below a path, by suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*SUFFIXES))


def import_names(files: DataFrame, order: str = "path", by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Capture order and normalized names NNN_stem.jpg; the position is counted over the files of an upload (by) in order. Without `by` the files are one upload, a small table; under `least` files it is refused."""
    if not by and files.limit(least).count() < least:
        raise ValueError(f"at least {least} readable photos are needed")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    seq = F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy(order)) - 1
    return files.withColumn("seq", seq).withColumn("name", F.format_string("%03d_%s.jpg", F.col("seq"), stem))


def pixels(images: DataFrame) -> DataFrame:
    """(name, row, col, gray) of the rows of Spark's image source: luma of the BGR bytes, rounded to 0..255."""
    i = images.select(F.col("image.origin").alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("ch"), "image.data")
    at = i.select("name", "width", "ch", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("p") * F.col("ch") + 1 + k, F.lit(1))), 16, 10).cast("int")
    luma = F.when(F.col("ch") >= 3, F.rint(0.114 * byte(0) + 0.587 * byte(1) + 0.299 * byte(2))).otherwise(byte(0))
    return at.select("name", F.floor(F.col("p") / F.col("width")).cast("int").alias("row"), (F.col("p") % F.col("width")).cast("int").alias("col"), luma.cast("double").alias("gray"))


def block_mean(px: DataFrame, factor: int) -> DataFrame:
    """Downscale by an integer factor: means of blocks."""
    return px.groupBy("name", F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.avg("gray").alias("gray"))


def _spans(i: Column, size: Column, to: Column) -> Column:
    """(cell, part) of the target cells that pixel i of `size` covers when the axis is shrunk to `to` cells."""
    lo, hi = i * to / size, (i + 1) * to / size
    cells = F.sequence(F.floor(lo + 1e-12).cast("int"), F.greatest(F.floor(lo + 1e-12), F.ceil(hi - 1e-12) - 1).cast("int"))
    return F.transform(cells, lambda c: F.struct(c.alias("cell"), (F.least(hi, c + 1.0) - F.greatest(lo, c.cast("double"))).alias("part")))


def area_resize(px: DataFrame, most: int) -> DataFrame:
    """Downscale so that the longer side has at most `most` pixels: each target pixel is the mean of what it covers, by area, at any ratio. Smaller images stay."""
    size = px.groupBy("name").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    s = F.least(F.lit(1.0), most / F.greatest("_h", "_w"))
    to = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) * s).cast("int"))
    rows = px.join(size.withColumns({"_th": to("_h"), "_tw": to("_w")}), "name")
    rows = rows.withColumn("_r", F.explode(_spans(F.col("row"), F.col("_h"), F.col("_th")))).withColumn("_c", F.explode(_spans(F.col("col"), F.col("_w"), F.col("_tw"))))
    weight = F.col("_r.part") * F.col("_c.part")
    return rows.groupBy("name", F.col("_r.cell").alias("row"), F.col("_c.cell").alias("col")).agg((F.sum(F.col("gray") * weight) / F.sum(weight)).alias("gray"))


def scaled_intrinsics(k: str | Column, width: str | Column, height: str | Column, most: int) -> Column:
    """K of an image after area_resize(): its first two rows times min(1, most / longer side)."""
    s = F.least(F.lit(1.0), most / F.greatest(G.c(width), G.c(height)))
    return F.transform(G.c(k), lambda x, i: F.when(i < 6, x * s).otherwise(x))


def _mirrored(i: Column, last: Column) -> Column:
    return F.when(i < 0, -i).when(i > last, 2 * last - i).otherwise(i)


def sharpness(px: DataFrame) -> DataFrame:
    """(name, lap): population variance of the 4-neighbour Laplacian, borders mirrored without the edge."""
    w = px.groupBy("name").agg(F.max("row").alias("h1"), F.max("col").alias("w1"))
    base = px.join(w, "name")
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(k).alias("k")) for dy, dx, k in ((0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)))))
    want = base.select("name", "row", "col", "h1", "w1", steps.alias("s")).select("name", F.col("row").alias("r0"), F.col("col").alias("c0"), "s.k", _mirrored(F.col("row") + F.col("s.dy"), F.col("h1")).alias("row"), _mirrored(F.col("col") + F.col("s.dx"), F.col("w1")).alias("col"))
    lap = want.join(px, ["name", "row", "col"]).groupBy("name", "r0", "c0").agg(F.sum(F.col("k") * F.col("gray")).alias("l"))
    return lap.groupBy("name").agg(F.var_pop("l").alias("lap"))


def clip_fraction(px: DataFrame) -> DataFrame:
    """(name, clipped): share of pixels at or beyond the rails 2 and 253."""
    return px.groupBy("name").agg(F.avg(((F.col("gray") <= 2) | (F.col("gray") >= 253)).cast("double")).alias("clipped"))


def difference_hash(grids: DataFrame, grid: str = "grid") -> DataFrame:
    """Add dhash (BIGINT) of a 72-value grid (8 rows of 9)."""
    return grids.withColumn("dhash", G.bits_to_long(G.dhash_bits(grid)))


EXPOSURE, BLUR_FLOOR, BLUR_SHARE, NEAR = 0.5, 6.0, 0.25, 3


def exposure_blur(photos: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Add `reason`: over/under-exposed, blurry or null.

    Blurry is under max(6, a quarter of the median); if more than half of a set is, the metric has failed and
    the floor(n / 2) least sharp go instead (such a reason replaces exposure).
    """
    stats = photos.groupBy(*by).agg(F.median("lap").alias("_med"), F.count("*").alias("_n"))
    rows = photos.join(stats, list(by)) if by else photos.crossJoin(F.broadcast(stats))  # without `by` a single row
    soft = F.col("lap") < F.greatest(F.lit(BLUR_FLOOR), BLUR_SHARE * F.col("_med"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_soft", soft).withColumn("_fail", F.sum(F.col("_soft").cast("long")).over(over) > 0.5 * F.col("_n")).withColumn("_rank", F.row_number().over(over.orderBy("lap", "seq")))
    blown = F.col("clipped") >= EXPOSURE
    reason = F.when(F.col("_fail") & (F.col("_rank") <= F.floor(F.col("_n") / 2)), "blurry").when(blown, "over/under-exposed").when(~F.col("_fail") & F.col("_soft"), "blurry")
    return rows.withColumn("reason", reason).drop("_med", "_n", "_soft", "_fail", "_rank")


def near_duplicates(photos: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mark near-duplicates of the last kept frame: of two frames within 3 bits the blurrier goes (the later one on a tie). Rows with a reason are skipped. One ordered fold for each set."""
    rows = photos.withColumn("_s", F.struct("seq", "lap", "dhash"))
    kept = rows.where("reason IS NULL").groupBy(*by).agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    kind = kept.schema["_a"].dataType.elementType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("prev"), F.array().cast("array<long>").alias("gone"))

    def step(acc: Column, x: Column) -> Column:
        prev, gone = acc["prev"], acc["gone"]
        close = prev.isNotNull() & (G.hamming(prev["dhash"], x["dhash"]) <= NEAR)
        drop_new, drop_old = close & (x["lap"] <= prev["lap"]), close & (x["lap"] > prev["lap"])
        out = F.when(drop_new, F.concat(gone, F.array(x["seq"].cast("long")))).when(drop_old, F.concat(gone, F.array(prev["seq"].cast("long")))).otherwise(gone)
        return F.struct(F.when(drop_new, prev).otherwise(x).alias("prev"), out.alias("gone"))

    gone = kept.select(*by, F.explode(F.aggregate("_a", start, step)["gone"]).alias("seq")).withColumn("_dup", F.lit(True))
    return rows.drop("_s").join(gone, [*by, "seq"], "left").withColumn("reason", F.when(F.col("_dup"), "near-duplicate").otherwise(F.col("reason"))).drop("_dup")


def survivor_floor(photos: DataFrame, by: tuple[str, ...] = (), least: int = 3, compat: bool = False) -> DataFrame:
    """Where fewer than three photos survive, rescue three by best exposure, then sharpness (compat: the three worst exposed). Rescued photos keep their reason but are not dropped."""
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = [F.desc("clipped"), F.desc("lap"), F.desc("seq")] if compat else [F.asc("clipped"), F.desc("lap"), F.asc("seq")]
    left = F.sum(F.col("reason").isNull().cast("long")).over(over)
    return photos.withColumn("_l", left).withColumn("_r", F.row_number().over(over.orderBy(*order))).withColumn("dropped", F.col("reason").isNotNull() & ~((F.col("_l") < least) & (F.col("_r") <= least))).drop("_l", "_r")


def cull(photos: DataFrame, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """reason and dropped of every photo."""
    return survivor_floor(near_duplicates(exposure_blur(photos, by), by), by, compat=compat)


def reason_counts(culled: DataFrame) -> DataFrame:
    """Reasons by frequency, ties by the first photo."""
    return culled.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def stale_copies(photos: DataFrame, copies: DataFrame) -> DataFrame:
    """Photos whose enhanced copy is missing or older: (name, mtime) against (name, mtime)."""
    fresh = copies.select("name", F.col("mtime").alias("_m"))
    return photos.join(fresh, (photos["name"] == fresh["name"]) & (F.col("_m") >= photos["mtime"]), "left_anti")
