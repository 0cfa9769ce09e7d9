"""A whole measurement: scale, region, volume, and the results of a job specification."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.operators import cloud as CL
from terravane.operators import region as RG
from terravane.operators import scale as SC
from terravane.operators.fits import up_direction
from terravane.operators.graph import covisibility
from terravane.operators.knn import spacing
from terravane.operators.surface import SCHEMA, prism_volume
from terravane.session import discard, materialize
from terravane.sources.ply import write_ply

EXTRAS = (
    "mode string, image string, rim_band array<double>, polygon array<struct<x:double,y:double>>, scale double, scale_method string, "
    "scale_rel_error double, cloud string, n_cloud_points long"
)


@dataclass(frozen=True)
class Scene:
    """The tables of a reconstruction, in model units, and its metric scale (1 model unit = `scale` metres; None: not set).

    views: (name, image_id, r, t, k, dist); sparse, dense: (point_id, x, y, z[, r, g, b]); tracks: (point3d_id, elem_idx, image_id).
    """

    views: DataFrame
    sparse: DataFrame
    dense: DataFrame | None = None
    tracks: DataFrame | None = None
    scale: float | None = None
    scale_info: dict = field(default_factory=dict)

    def cloud(self, dense: bool) -> tuple[DataFrame, str]:
        """The dense cloud, or the sparse one where that is asked for or the dense one has no points."""
        return (self.dense, "dense") if dense and self.dense is not None and not self.dense.isEmpty() else (self.sparse, "sparse")

    def up(self) -> tuple[float, ...]:
        c = self.views.select(G.camera_centre("r", "t").alias("c")).select(*(F.col("c")[i].alias(a) for i, a in enumerate("xyz")))
        return up_direction(c, self.sparse)


def with_scale(scene: Scene, info: DataFrame) -> Scene:
    """The scene scaled by the one row of scale.marker_scale() or scale.manual_scale(); a refused scale is an error that says why."""
    r = info.first()
    if r is None:
        raise ValueError("no reference of known length was found")
    if r["status"] != "ok":
        raise ValueError(r["status"])
    got = r.asDict(recursive=True)
    return replace(scene, scale=float(r["scale"]), scale_info=got)


@dataclass(frozen=True)
class Frame:
    """The orthophoto's frame: ground axes and the affine map from pixels to metres."""

    u0: float
    v0: float
    res: float
    width: int
    height: int
    up: tuple[float, ...]
    e1: tuple[float, ...]
    e2: tuple[float, ...]

    def ground(self, points: DataFrame) -> DataFrame:
        """Add ground coordinates (u, v) and the height to points in metres."""
        p = [F.col(a) for a in "xyz"]
        lits = lambda v: [F.lit(float(x)) for x in v]
        u, v, h = G.ground_coords(p, lits(self.up), lits(self.e1), lits(self.e2))
        return points.withColumns({"u": u, "v": v, "h": h})

    def metres(self, polygon: Sequence[Sequence[float]]) -> list[tuple[float, float]]:
        return [(self.u0 + float(x) * self.res, self.v0 + float(y) * self.res) for x, y in polygon]


def ground_axes(up: Sequence[float]) -> tuple[tuple[float, ...], ...]:
    """(up, e1, e2) as geometry.ground_basis(), for one vector on the driver."""
    n = np.array(up, float) / np.linalg.norm(up)
    e1 = np.array([0.0, 1.0, 0.0] if abs(n[0]) > 0.9 else [1.0, 0.0, 0.0])
    e1 -= (e1 @ n) * n
    e1 /= np.linalg.norm(e1)
    return tuple(n), tuple(e1), tuple(np.cross(n, e1))


def scaled(points: DataFrame, scale: float) -> DataFrame:
    return points.withColumns({a: F.col(a).cast("double") * scale for a in "xyz"})


def ortho_frame(points: DataFrame, up: Sequence[float], pixels: int = 1400, least: int = 200) -> Frame:
    """The frame of a cloud in metres; under `least` points there is none."""
    n, e1, e2 = ground_axes(up)
    flat = Frame(0.0, 0.0, 1.0, 0, 0, n, e1, e2).ground(points)
    m = CL.ortho_meta(flat, pixels=pixels, least=least).first()
    if m is None:
        raise ValueError(f"an orthophoto needs at least {least} points")
    return Frame(m["u0"], m["v0"], m["res"], m["width"], m["height"], n, e1, e2)


def measure(scene: Scene, polygon: Sequence[Sequence[float]], mode: str = "photo", image: str | None = None, dense: bool = True, rim_px: float = 12.0, rim_inner_px: float | None = None, extra_views: int = 0, frame: Frame | None = None, max_above_datum: float | None = None) -> DataFrame:
    """One row (SCHEMA, EXTRAS): the measurement of a polygon traced on a photo, or (mode ortho) in pixels of the orthophoto."""
    if not scene.scale:
        raise ValueError("the metric scale is not set")
    if len(polygon) < 3:
        raise ValueError("a polygon needs at least 3 vertices")
    cloud, kind = scene.cloud(dense)
    own = materialize(cloud.select("point_id", *(F.col(a).cast("double") for a in "xyz")))
    up = scene.up()
    if mode == "photo":
        if scene.views.where(F.col("name") == image).isEmpty():
            raise ValueError(f"there is no photo {image!r}")
        shared = covisibility(scene.tracks) if extra_views and scene.tracks is not None else None
        views = RG.neighbour_views(image, scene.views, shared, extra_views if shared is not None else 0)
        split = RG.photo_split(own, views, polygon, image, rim_px, rim_inner_px)
        inner = rim_px * 0.5 if rim_inner_px is None else float(rim_inner_px)
        band = (inner, inner + rim_px)
        split = scaled(split, scene.scale)
    elif mode == "ortho":
        metric = scaled(own, scene.scale)
        frame = frame or ortho_frame(metric, up)
        up = frame.up
        flat = frame.ground(metric)
        gap = float(spacing(CL.strided(flat.select("point_id", F.col("u").alias("x"), F.col("v").alias("y"))), ("x", "y")).first()[0] or 0.0)
        band = RG.rim_band(gap)
        split = RG.ortho_split(flat, frame.metres(polygon), *band)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    split = materialize(split.where("interior OR rim").select("point_id", "x", "y", "z", "interior", "rim"))
    r = prism_volume(split.where("interior"), split.where("rim"), up, max_above_datum).first().asDict()
    n = own.count()
    discard(own, split)
    rel = scene.scale_info.get("scale_rel_error")
    if rel:
        r["est_volume_error_m3"] = r["datum_rms_m"] * r["area_m2"] + 2.0 * rel * abs(r["net_volume_m3"])
    r["warnings"] = [*r["warnings"], *(f"scale: {w}" for w in scene.scale_info.get("warnings") or [])]
    extras = (mode, image if mode == "photo" else None, [float(b) for b in band], [(float(x), float(y)) for x, y in polygon], float(scene.scale), scene.scale_info.get("method"), float(rel) if rel else None, kind, n)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return scene.views.sparkSession.createDataFrame([(*(r[c] for c in names), *extras)], f"{SCHEMA}, {EXTRAS}")


def measure_regions(scene: Scene, regions: DataFrame, frame: Frame | None = None) -> DataFrame:
    """Measurements of a table of regions (region_id, mode, image, polygon ARRAY<STRUCT<x, y>>): a row each, with `error` where a region cannot be measured. Regions are few; each is a distributed computation of its own."""
    rows = []
    schema = f"region_id {regions.schema['region_id'].dataType.simpleString()}, error string, {SCHEMA}, {EXTRAS}"
    width = len(f"{SCHEMA}, {EXTRAS}".split(", "))
    for g in regions.toLocalIterator():
        try:
            got = measure(scene, [(p["x"], p["y"]) for p in g["polygon"]], g["mode"], g["image"], frame=frame).first()
            rows.append((g["region_id"], None, *got))
        except ValueError as e:
            rows.append((g["region_id"], str(e), *[None] * width))
    return scene.views.sparkSession.createDataFrame(rows, schema)


def fingerprint(*tables: DataFrame) -> str:
    """A key of the contents of tables: rows in any order."""
    parts = []
    for t in tables:
        r = t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(20,0)"))).first()
        parts.append(f"{','.join(f'{c}:{k}' for c, k in t.dtypes)}|{r[0]}|{r[1]}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]


def cached(spark: SparkSession, root: str, build: Callable[[], DataFrame], *inputs: DataFrame, force: bool = False) -> DataFrame:
    """build()'s table, written below root under the fingerprint of its inputs and read from there the next time: other inputs never meet a stale result."""
    path = f"{root.rstrip('/')}/{fingerprint(*inputs)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: What a job specification looks like.
TEMPLATE = {
    "tables": "/path/to/the/reconstruction", "out_dir": "/path/to/output", "save_cloud": True,
    "scale": {"method": "marker", "side_m": 0.25, "id": 0},
    "region": {"mode": "photo", "image": "010_photo.jpg", "polygon": [[100, 200], [400, 180], [420, 500], [120, 520]], "dense": True, "rim_px": 12},
}


def load_scene(spark: SparkSession, folder: str) -> Scene:
    """A scene from Parquet tables: views and sparse, and where they are there dense and tracks."""
    fs_path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet")
    there = lambda n: fs_path(n).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path(n))
    read = lambda n: spark.read.parquet(f"{folder}/{n}.parquet") if there(n) else None
    return Scene(read("views"), read("sparse"), read("dense"), read("tracks"))


def apply_scale(spark: SparkSession, scene: Scene, spec: dict, folder: str) -> Scene:
    """The scene scaled as a specification says: marker (from the table marker_obs) or manual (a segment clicked in two photos)."""
    if spec["method"] in ("marker", "aruco"):
        obs = spark.read.parquet(f"{folder}/marker_obs.parquet")
        return with_scale(scene, SC.marker_scale(obs, scene.views, float(spec["side_m"]), spec.get("id")))
    if spec["method"] == "manual":
        clicks = SC.clicks_from_json(spark.createDataFrame([(0, json.dumps(spec[k])) for k in ("a", "b")], "recon_id long, spec string"))
        return with_scale(scene, SC.manual_scale(clicks, scene.views, float(spec["length_m"])))
    raise ValueError(f"unknown scale method {spec['method']!r}")


def run_spec(spark: SparkSession, spec: dict) -> DataFrame:
    """A whole job: the tables of a reconstruction are scaled and measured; result.json and, if asked for, the cloud in metres go to out_dir."""
    folder, out = spec["tables"], spec.get("out_dir")
    scene = apply_scale(spark, load_scene(spark, folder), spec["scale"], folder)
    g = spec["region"]
    result = measure(scene, g["polygon"], g.get("mode", "photo"), g.get("image"), g.get("dense", True), float(g.get("rim_px", 12.0)), g.get("rim_inner_px"), int(g.get("extra_views", 0)))
    if out:
        result.coalesce(1).write.mode("overwrite").json(f"{out}/result.json")
        if spec.get("save_cloud", True):
            cloud, _ = scene.cloud(g.get("dense", True))
            gray = {c: F.lit(128) for c in "rgb" if c not in cloud.columns}
            write_ply(scaled(cloud.withColumns(gray) if gray else cloud, scene.scale), f"{out}/pointcloud.ply")
    return result

