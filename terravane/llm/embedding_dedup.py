"""Near-duplicate embeddings by an inverted multi-index.

The two halves of the unit vectors have codebooks of their own (k-means on at most SAMPLE vectors); a cell
is a pair of their entries, and every vector lies in its nearest cell. A vector visits the cells of the
product grid in the order of their distance (multi-sequence traversal) while that exceeds the nearest
cell's by at most `reach`; a pair is found if either visits the other's cell. The reach is set for the target recall, from
two kinds of links of QUERIES_N vectors: real ones, found by brute force against all vectors (each vector counts by its
farthest link, however many links it has), and planted ones, PLANTED random neighbours of each at exactly the least cosine,
so that links of groups too few to be met by chance are covered, too. It covers RECALL of either kind, and a margin.
Visited vectors are verified by cosine in double precision.

Equal vectors form one class with a count. A cell is compared in blocks of RESIDENTS x VISITORS classes,
dealt as groups of their own; a block gives the numbers of links and a spanning forest of
its links, so that a large group of near copies is never expanded into pairs. A link counts once at either end: for the
visitor here, and for the resident where its own traversal stops short of the visitor's cell.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have another
length than the commonest link with nothing; rows that share a vec_id count as vectors of their own but are
one node; rows with null vec_id link with nothing; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from terravane.llm.common import map_batches, table
from terravane.llm.components import components
from terravane.session import discard, materialize, ship

COSINE = 0.95
#: Vectors that the codebooks are fitted on, at most (about); an entry has ENTRY of them at least, so that the grid has up to (SAMPLE / ENTRY)^2 cells.
SAMPLE, ENTRY = 50_000, 4
QUERIES_N = 512
RECALL, PLANTED = 0.999, 8
MARGIN = 1.15
#: Vectors of a cell, about.
CELL = 64
RESIDENTS, VISITORS = 512, 1024


def units(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision, of raw little-endian floats or doubles."""
    x = np.frombuffer(b"".join(raw), f"<f{len(raw[0]) // dim}").reshape(-1, dim).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _valid(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v): v the components as bytes, null where the vector links with nothing. Components keep the width of the table."""

    width = 4 if isinstance(vectors.schema["e"].dataType.elementType, FloatType) else 8

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, col = batch.column(0), batch.column(1)
        ok = np.asarray(col.value_lengths().fill_null(-1)) == dim
        out: list[bytes | None] = [None] * len(ok)
        at = np.flatnonzero(ok)
        if len(at):
            x = np.asarray(col.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), f"<f{width}").reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            for i, row in zip(at[good], x[good], strict=True):
                out[i] = row.tobytes()
        return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], ["vec_id", "v"])

    return map_batches(vectors, run, "vec_id long, v binary")


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm; empty clusters keep their centre."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Codebooks of the two halves, and the reach of the traversal."""

    def __init__(self, sample: np.ndarray, n: int) -> None:
        self.dim, self.half = sample.shape[1], sample.shape[1] // 2
        k = int(max(2, min(len(sample) // ENTRY, math.ceil(math.sqrt(n / CELL)))))
        self.books = [kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)]
        self.reach = 0.0

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of the halves to the entries of their codebooks."""
        return [np.maximum(((p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1)), 0) for p, c in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def reaches(self, a: np.ndarray, b: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the traversal of each row (distances a, b) visits each of the cells: rows x cells."""
        i, j = np.divmod(cells, len(self.books[1]))
        return a[:, i] + b[:, j] <= (a.min(1) + b.min(1) + self.reach)[:, None]

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Multi-sequence traversal for one vector, given its distances: cells by growing distance."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        most, width, out = a[i[0]] + b[j[0]] + self.reach, len(b), []
        heap, seen = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}
        while heap:
            d, s, t = heapq.heappop(heap)
            if d > most:
                break
            out.append(int(i[s]) * width + int(j[t]))
            for p, q in ((s + 1, t), (s, t + 1)):
                if p < len(i) and q < len(j) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (a[i[p]] + b[j[q]], p, q))
        return out


def _some(rows: DataFrame, n: int, most: int) -> list:
    """At most about `most` of n rows, by a hash of the id: the bound of what reaches the driver."""
    return [r for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(n, 1)))).select("v").toLocalIterator()]


def planted(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector a random one at exactly this cosine."""
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
    return cosine * x + math.sqrt(1 - cosine * cosine) * z


def excess(index: Index, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of rows the least reach at which either visits the other's cell."""
    out = []
    for a, b in ((x, y), (y, x)):
        p, q = index.distances(a)
        i, j = np.divmod(index.home(b), len(index.books[1]))
        rows = np.arange(len(a))
        out.append(p[rows, i] + q[rows, j] - p.min(1) - q.min(1))
    return np.minimum(*out)


def fit(classes: DataFrame, dim: int, cosine: float = COSINE) -> Index | None:
    """The index; its reach is calibrated on planted links and by brute force of QUERIES_N vectors against all."""
    n = classes.count()
    sample = [bytes(r["v"]) for r in _some(classes, n, SAMPLE)] or [bytes(r["v"]) for r in classes.select("v").limit(1).collect()]
    if not sample:
        return None
    sample.sort()
    x = units(sample, dim)
    index = Index(x, n)
    spark = classes.sparkSession
    rng = np.random.default_rng(9)
    q = x[rng.choice(len(x), min(QUERIES_N, len(x)), replace=False)]
    shared = spark.sparkContext.broadcast((index, q))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, q = shared.value
        y = units(batch.column(0).to_pylist(), dim) if batch.num_rows else np.empty((0, dim))
        s, t = np.nonzero(q @ y.T >= cosine)
        far = np.zeros(len(q))
        for k in range(0, len(s), 4096):
            np.maximum.at(far, s[k : k + 4096], excess(index, q[s[k : k + 4096]], y[t[k : k + 4096]]))
        at = np.flatnonzero(far > 1e-9)  # a query's link with itself says nothing
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(far[at], pa.float64())], ["query", "far"])

    rows = map_batches(classes.select("v"), run, "query int, far double").groupBy("query").agg(F.max("far").alias("far")).collect()
    many = np.repeat(q, PLANTED, axis=0)
    kinds = [excess(index, many, planted(many, cosine, rng)), np.array([r["far"] for r in rows])]
    index.reach = max(float(np.quantile(e, RECALL, method="higher")) for e in kinds if len(e)) * MARGIN + 1e-9
    return index


def _blocks(rows: DataFrame, dim: int, cosine: float, shared: Broadcast) -> DataFrame:
    """rows: (cell, r, p, visitor, no, id, n, v), one group per (cell, r, p); shared: the index. Gives (kind, a, b): kind 0, class number a has b links here; kind 1, the ids a and b are connected here."""

    def compare(group: list[tuple]) -> tuple[list, list, list]:
        res, vis = [g for g in group if not g[0]], [g for g in group if g[0]]
        if not res or not vis:
            return [], [], []
        ri, vi, rid, vid, rn, vn = (np.array([g[k] for g in side]) for k in (1, 2, 3) for side in (res, vis))
        rx, vx = units([g[4] for g in res], dim), units([g[4] for g in vis], dim)
        link = vx @ rx.T >= cosine
        link &= vi[:, None] != ri[None, :]
        hit, met = link.any(1), link.any(0)
        if not hit.any():
            return [], [], []
        link, vi, ri, vid, rid, vn, rn, vx, rx = link[hit][:, met], vi[hit], ri[met], vid[hit], rid[met], vn[hit], rn[met], vx[hit], rx[met]
        index = shared.value
        back = index.reaches(*index.distances(rx), index.home(vx)).T  # the resident meets the visitor elsewhere, too
        n, m = link @ rn, (link & ~back).T @ vn
        big = np.iinfo(np.int64).max
        lr = rid.copy()
        while True:  # smallest id over the connected part of the block
            lv = np.minimum(vid, np.where(link, lr, big).min(1))
            new = np.minimum(lr, np.where(link, lv[:, None], big).min(0))
            if (new == lr).all():
                break
            lr = new
        a, b = np.concatenate([vid, rid]), np.concatenate([lv, lr])
        apart = a != b
        a, b = a[apart], b[apart]
        only = m > 0
        return [0] * (len(vi) + int(only.sum())) + [1] * len(a), [*vi.tolist(), *ri[only].tolist(), *a.tolist()], [*n.tolist(), *m[only].tolist(), *b.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: tuple[list, list, list] = ([], [], [])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["kind", "a", "b"])

        for batch in batches:
            for *at, visitor, no, i, n, v in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if at != key:
                    for o, x in zip(out, compare(group), strict=True):
                        o += x
                    key, group = at, []
                group.append((visitor, no, i, n, v))
            yield batch_of()
            out = ([], [], [])
        for o, x in zip(out, compare(group), strict=True):
            o += x
        yield batch_of()

    return rows.repartition("cell", "r", "p").sortWithinPartitions("cell", "r", "p").mapInArrow(run, "kind int, a long, b long")


def _numbers(table_: DataFrame, vector_col: str) -> Column:
    """The vector column as floats, where it holds floats, else as doubles."""
    kind = table_.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return F.col(vector_col).cast("array<float>" if single else "array<double>")


def near_duplicates(table_: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = ship(table_.sparkSession)
    given = table_.select(F.col(id_col).cast("long").alias("vec_id"), _numbers(table_, vector_col).alias("e"))
    usual = given.where("size(e) > 0").groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = usual[0]["d"] if usual else 1
    rows = materialize(_valid(given, dim))
    usable = rows.where("v IS NOT NULL AND vec_id IS NOT NULL")
    # Written once, so that the numbers of the classes stay.
    classes = materialize(usable.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()))
    index = fit(classes, dim, cosine) if dim > 1 else None
    if dim == 1 and usual:  # halves need two components: with one, the sign decides
        index = Index(np.array([[1.0], [-1.0]]), 1)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(index)

    def cells(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k in range(0, len(ids), 256):
            x = units(raw[k : k + 256], dim)
            home = shared.value.home(x)
            visits = [shared.value.visits(a, b) for a, b in zip(*shared.value.distances(x), strict=True)]
            own = [(c, i, False) for c, i in zip(home.tolist(), ids[k : k + 256], strict=True)]
            own += [(c, i, True) for cs, i in zip(visits, ids[k : k + 256], strict=True) for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in own], pa.int32()), pa.array([o[1] for o in own], pa.int64()), pa.array([o[2] for o in own], pa.bool_())], ["cell", "no", "visitor"])

    placed = materialize(map_batches(classes.select("no", "v"), cells, "cell int, no long, visitor boolean"))
    counted = placed.groupBy("cell").agg(F.sum(F.when(F.col("visitor"), 0).otherwise(1)).alias("res"), F.sum(F.when(F.col("visitor"), 1).otherwise(0)).alias("vis"))
    counted = counted.where("res > 0 AND vis > 0 AND res + vis > 2").select("cell", F.ceil(F.col("res") / RESIDENTS).cast("int").alias("nr"), F.ceil(F.col("vis") / VISITORS).cast("int").alias("np"))
    own = F.when(F.col("visitor"), F.pmod(F.hash("no"), F.col("np"))).otherwise(F.pmod(F.hash("no"), F.col("nr"))).alias("own")
    other = F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("nr") - 1)).otherwise(F.sequence(F.lit(0), F.col("np") - 1))).alias("other")
    dealt = placed.join(counted, "cell").select("cell", "no", "visitor", own, other)
    dealt = dealt.select("cell", F.when(F.col("visitor"), F.col("other")).otherwise(F.col("own")).alias("r"), F.when(F.col("visitor"), F.col("own")).otherwise(F.col("other")).alias("p"), "visitor", "no")
    dealt = dealt.join(classes, "no").select("cell", "r", "p", "visitor", "no", "id", "n", "v")
    found = materialize(_blocks(dealt, dim, cosine, shared))
    discard(placed)
    links = found.where("kind = 0").groupBy(F.col("a").alias("no")).agg(F.sum("b").alias("links"))
    mark = F.xxhash64("v")
    several = usable.groupBy("vec_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("vec_id")  # ids of different vectors
    same = usable.join(several, "vec_id").join(classes.select("v", "id"), "v").select(F.col("vec_id").alias("u"), F.col("id").alias("v"))
    comp = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")).union(same))
    by_class = classes.join(links, "no", "left").join(comp, "id", "left").select(F.col("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v"))).join(by_class, "v", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
SQL = {
    "op4_embedding_dedup": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS u, b.vec_id AS v
  FROM embeddings a, embeddings b
  WHERE a.vec_id <> b.vec_id
    AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
reach AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings
  UNION
  SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.id),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id
JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON m.id = e.vec_id
"""
}
