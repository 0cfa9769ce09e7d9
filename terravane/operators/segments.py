"""Regions proposed by a segmentation model: responses, masks and simplified outlines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geometry as G
from terravane.session import ship


def class_id(class_map: str | Column, keyword: str) -> Column:
    """Id of the first class whose name holds the keyword in any case, else 1. class_map: MAP<STRING, STRING>."""
    entries = F.map_entries(F.coalesce(G.c(class_map), F.create_map().cast("map<string,string>")))
    hits = F.filter(entries, lambda e: F.contains(F.lower(e["value"]), F.lit(keyword.lower())))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["key"].try_cast("int"), F.lit(1))


def parse_polygons(responses: DataFrame, column: str = "body", sx: float = 1.0, sy: float = 1.0, least_confidence: float = 0.35, least_area: float = 100.0, most: int | None = 120, default_class: str = "region") -> DataFrame:
    """Regions (id columns, idx, class, confidence, polygon, area_px, rank) of polygon-list responses; rank 1 is the largest of a response, ties by idx.

    Anything malformed is skipped by itself: a body that is no object, predictions that are no list, confidences that
    are no number, outlines under three points, and areas under the limit after scaling. Outlines are simplified to `most` points.
    """
    ids = [c for c in responses.columns if c != column]
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    preds = get(F.try_parse_json(column), "$.predictions", "array<variant>")
    rows = responses.select(*ids, F.posexplode(preds).alias("idx", "p"))
    point = lambda q: F.struct((get(q, "$.x", "double") * sx).alias("x"), (get(q, "$.y", "double") * sy).alias("y"))
    confidence = F.coalesce(get("p", "$.confidence", "double"), get("p", "$.confidence", "string").try_cast("double"))
    points = F.filter(F.transform(get("p", "$.points", "array<variant>"), point), lambda q: q["x"].isNotNull() & q["y"].isNotNull())
    rows = rows.select(*ids, "idx", F.coalesce(get("p", "$.class", "string"), F.lit(default_class)).alias("class"), confidence.alias("confidence"), points.alias("polygon"))
    rows = rows.where((F.col("confidence") >= least_confidence) & (F.size("polygon") >= 3)).withColumn("area_px", G.polygon_area("polygon")).where(F.col("area_px") >= least_area)
    over = Window.partitionBy(*ids).orderBy(F.desc("area_px"), "idx")
    rows = rows.withColumn("rank", F.row_number().over(over)).withColumn("confidence", F.round("confidence", 3)).withColumn("area_px", F.round("area_px", 1))
    return rows if most is None else simplify(rows, most)


def label_components(cells: pd.DataFrame) -> np.ndarray:
    """Component number (8 neighbours) of cells (row, col), by union-find."""
    at = {rc: i for i, rc in enumerate(zip(cells["row"], cells["col"], strict=True))}
    up = list(range(len(cells)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (r, c), i in at.items():
        for near in ((r, c - 1), (r - 1, c - 1), (r - 1, c), (r - 1, c + 1)):
            if (j := at.get(near)) is not None:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(cells))], int)


#: The eight neighbours of a cell, clockwise from the west.
_RING = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def outer_border(cells: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outer border of an 8-connected set of cells (row, col), followed clockwise from its first cell; cells on thin parts occur twice."""
    start = min(cells)
    chain, at, came = [start], start, 0  # the cell to the west of the first is outside
    first = None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            nxt = (at[0] + _RING[d][0], at[1] + _RING[d][1])
            if nxt in cells:
                break
        else:
            return chain  # a single cell
        if at == start and first is None:
            first = nxt
        elif at == start and nxt == first:
            return chain[:-1]
        # Go on from the last cell looked at that was outside, as seen from the new cell.
        back = (at[0] + _RING[(d - 1) % 8][0], at[1] + _RING[(d - 1) % 8][1])
        came = _RING.index((back[0] - nxt[0], back[1] - nxt[1]))
        at = nxt
        chain.append(at)


def corners_of(chain: list[tuple[int, int]]) -> np.ndarray:
    """(x, y) of a border without the cells inside its straight runs."""
    p = np.array([(c, r) for r, c in chain], float)
    if len(p) < 3:
        return p
    step, nxt = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    return p[np.any(step != nxt, axis=1)]


def _filled(cells: np.ndarray) -> np.ndarray:
    """The component's cells and its holes, in its box: (rows, cols) of all that the outside does not reach by its sides."""
    lo = cells.min(0) - 1
    box = np.zeros(cells.max(0) - lo + 2, bool)
    box[tuple((cells - lo).T)] = True
    out = np.zeros_like(box)
    out[0, :] = out[-1, :] = out[:, 0] = out[:, -1] = True
    while True:
        new = out.copy()
        new[1:] |= out[:-1]
        new[:-1] |= out[1:]
        new[:, 1:] |= out[:, :-1]
        new[:, :-1] |= out[:, 1:]
        new &= ~box
        if (new == out).all():
            return np.argwhere(~out) + lo
        out = new


def mask_regions(mask: DataFrame, by: str, class_id: int = 1, sx: float = 1.0, sy: float = 1.0, least_confidence: float = 0.35, most: int = 120) -> DataFrame:
    """(by, rank, n_cells, confidence, area_px, polygon) of the connected parts of a class in masks given by their pixels (by, row, col, class[, conf 0..255]), largest first.

    One kernel an image. The polygon is the outer border through the centres of its pixels, simplified to `most` points; parts whose border encloses less than
    max(100, 5e-4 * pixels) before scaling are specks. The confidence is the mean over all that the border encloses, 1 without conf.
    """
    ship(mask.sparkSession)
    rows_of = mask if "conf" in mask.columns else mask.withColumn("conf", F.lit(255.0))
    kind = mask.schema[by].dataType.simpleString()

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        least = max(100.0, 5e-4 * len(pdf))
        conf = dict(zip(zip(pdf["row"], pdf["col"], strict=True), pdf["conf"], strict=True))
        own = pdf[pdf["class"] == class_id].sort_values(["row", "col"]).reset_index(drop=True)
        own["component"] = label_components(own)
        found = []
        for _, part in own.groupby("component"):
            chain = corners_of(outer_border(set(zip(part["row"], part["col"], strict=True))))
            x, y = chain.T
            area = 0.5 * abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) if len(chain) > 2 else 0.0
            if area < least:
                continue
            sure = float(np.mean([conf[r, c] for r, c in _filled(part[["row", "col"]].to_numpy()).tolist() if (r, c) in conf])) / 255
            if sure >= least_confidence:
                outline = simplify_outline(chain * [sx, sy], most)
                found.append((pdf[by].iloc[0], len(part), round(sure, 3), round(area * sx * sy, 1), [{"x": float(a), "y": float(b)} for a, b in outline]))
        found.sort(key=lambda f: -f[3])
        return pd.DataFrame([(f[0], k + 1, *f[1:]) for k, f in enumerate(found)], columns=[by, "rank", "n_cells", "confidence", "area_px", "polygon"])

    return rows_of.select(by, "row", "col", "class", "conf").groupBy(by).applyInPandas(kernel, f"{by} {kind}, rank int, n_cells long, confidence double, area_px double, polygon array<struct<x:double,y:double>>")


def _farthest(p: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    a, b = p[lo], p[hi % len(p)]
    q = p[lo + 1 : hi]
    d, size = b - a, math.hypot(*(b - a))
    dist = np.abs(d[0] * (q[:, 1] - a[1]) - d[1] * (q[:, 0] - a[0])) / size if size else np.hypot(*(q - a).T)
    i = int(dist.argmax())
    return float(dist[i]), lo + 1 + i


def douglas_peucker(points: np.ndarray, eps: float) -> np.ndarray:
    """Simplify a closed outline, split first at the point farthest from its start."""
    n = len(points)
    if n < 3:
        return points
    far = int(np.hypot(*(points - points[0]).T).argmax())
    keep, todo = {0, far}, [(0, far), (far, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            d, i = _farthest(points, lo, hi)
            if d > eps:
                keep.add(i)
                todo += [(lo, i), (i, hi)]
    return points[sorted(keep)]


def simplify_outline(points: np.ndarray, most: int) -> np.ndarray:
    """At most `most` points where twelve rounds of a growing tolerance (from 0.2 % of the perimeter, times 1.6) reach that; the original if fewer than three remain."""
    ring = np.vstack([points, points[:1]])
    eps = 0.002 * max(float(np.hypot(*np.diff(ring, axis=0).T).sum()), 1.0)
    out = points
    for _ in range(12):
        out = douglas_peucker(points, eps)
        if len(out) <= most:
            break
        eps *= 1.6
    return out if len(out) >= 3 else points


def simplify(regions: DataFrame, most: int = 64, column: str = "polygon") -> DataFrame:
    """The regions with simplified polygons."""
    ship(regions.sparkSession)

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def shorter(polys: pd.Series) -> pd.Series:
        def one(poly):  # noqa: ANN001, ANN202
            p = np.array([[q["x"], q["y"]] for q in poly], float)
            return [{"x": x, "y": y} for x, y in simplify_outline(p, most).tolist()] if len(p) >= 3 else list(poly)

        return polys.map(one)

    return regions.withColumn(column, shorter(column))
