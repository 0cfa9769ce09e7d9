"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes gives both its minimum and its maximum, so that 70 hash
evaluations a shingle give 140 unbiased signature values, kept as 16 bits each; 28 bands of 5 values propose documents. A
pair at the threshold of 0.8 is missed with probability (1 - 0.8^5)^28 < 2e-5, and less above it.

Documents with equal shingle sets become one class (128-bit digest of the sorted set). Classes that share
a band are compared in three rounds: every class with the hubs (the first class of each band of it), once with the first
hub and once with those that are still apart; then, in bands that still hold classes of different components, all others of
different components: those outside the band's largest component, in blocks, with each other and with the classes of the
largest, which stream past them. Every comparison begins with the sizes and the signatures: at a similarity of 0.8 or
more, fewer than 60 % of 140 values agree with probability < 1e-8. Only classes that some signature suspects are
compared by their full sets of 64-bit hashes, which then decide. A block gives a spanning forest of its links: no round makes
all pairs of a group, copies and near copies merge around the hubs first, and no link that joins components is lost.

Shingles are 64-bit hashes of word sequences (XXH3); two sets are equal or similar as their hash sets are.

Defined results: a text with fewer words than a shingle has its whole word sequence as only shingle; null,
empty and blank texts have no shingles and link with nothing; rows that share a doc_id are one node, whatever their texts;
rows with null doc_id link with nothing and are kept, with null component_id; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from terravane.llm.common import id_text, map_batches, table
from terravane.llm.components import components
from terravane.session import discard, materialize, ship

PERMUTATIONS, BANDS, ROWS = 70, 28, 5
THRESHOLD = 80
#: Share of equal signature values from which a pair is compared by its sets.
ESTIMATE = 0.6
#: Classes of a block, and the shingles that the classes of a block hold together, about; and of the leaders that pass one task.
BLOCK, WEIGHT = 256, 1 << 21
LEAD = 1024
CHUNK = 64
#: Rows (32 bytes each) that are sent to all tasks rather than shuffling the texts, at most.
BROADCAST = 500_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation; a set of one hash has equal ones."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(hashes), 4096):
        x = hashes[k : k + 4096][None, :] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """100 * intersection >= threshold * union, for sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < threshold * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def _signed(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every row; digest and sig (the low 16 bits of the values) are null without shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, sigs = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, width)
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append((signature(s) & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])

    return map_batches(texts, run, "doc_id long, n_shingles long, digest binary, sig binary")


def _narrow(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """rows joined with the table `few` (materialized), which is sent to all tasks where it has at most BROADCAST rows; else both are shuffled."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST else few, key)


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(no, hashes) of the wanted classes (no, doc_id, digest), from a row of that id whose set has that digest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nos, out = [], []
        for text, no, digest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            s = shingles(text, width).tobytes()
            if hashlib.blake2b(s, digest_size=16).digest() == digest:
                nos.append(no)
                out.append(s)
        return pa.RecordBatch.from_arrays([pa.array(nos, pa.int64()), pa.array(out, pa.binary())], ["no", "hashes"])

    return map_batches(_narrow(texts, wanted, "doc_id").select("text", "no", "digest"), run, "no long, hashes binary").dropDuplicates(["no"])


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1)


def _suspected(pairs: DataFrame, sigs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures allow, with the ids of both (ia, ib). sigs: (no, id, n, sig)."""
    side = lambda x: sigs.select(F.col("no").alias(x), F.col("id").alias(f"i{x}"), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        na, nb = np.asarray(batch.column(4)), np.asarray(batch.column(5))
        ok = 100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)
        if batch.num_rows:
            ok &= (_matrix(batch.column(6).to_pylist()) == _matrix(batch.column(7).to_pylist())).mean(1) >= ESTIMATE
        return batch.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ib", "na", "nb", "sa", "sb")
    return map_batches(both, run, "a long, b long, ia long, ib long")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The ids (u, v) of the pairs (a, b, ia, ib) whose full sets are similar. Partners of a hub a are dealt in chunks, each after one copy of the hub's set."""
    ship(pairs.sparkSession)
    chunk = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK))).cast("int")
    dealt = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a").select("a", "b", "ia", "ib", chunk.alias("chunk"))
    hubs = dealt.select("a", "chunk").distinct().join(sets, F.col("a") == F.col("no")).select("a", "chunk", *(F.lit(None).cast("long").alias(x) for x in ("b", "ia", "ib")), "hashes")
    partners = dealt.join(sets, F.col("b") == F.col("no")).select("a", "chunk", "b", "ia", "ib", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for b, i, j, x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x = np.frombuffer(x, np.uint64)
                if b is None:
                    hub = x
                elif similar(hub, x, threshold):
                    out.append((i, j))
            yield _pairs(out, ("u", "v"))

    rows = hubs.unionByName(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "u long, v long")


def _pairs(rows: list[tuple[int, int]], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], list(names))


Member = tuple  # (block, no, id, component, n, sig, hashes or None)
Test = Callable[[list[Member], bool, int], Iterator[tuple[int, int]]]


def _allowed(rows: list[Member], same_block: bool, threshold: int) -> np.ndarray:
    """Upper triangle of the pairs of different components that sizes and signatures allow; rows of one block are compared if `same_block`."""
    block, no, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 3, 4))
    sig = _matrix([r[5] for r in rows])
    maybe = np.zeros((len(rows), len(rows)), bool)
    for x in range(len(rows)):
        at = np.flatnonzero((comp != comp[x]) & (no > no[x]) & (100 * np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x])) & ((block != block[x]) | same_block))
        maybe[x, at] = (sig[at] == sig[x]).mean(1) >= ESTIMATE
    return maybe


def _flagged(rows: list[Member], same_block: bool, threshold: int) -> Iterator[tuple[int, int]]:
    """(no, id) of the rows that have an allowed partner."""
    maybe = _allowed(rows, same_block, threshold)
    for x in np.flatnonzero(maybe.any(0) | maybe.any(1)):
        yield rows[x][1], rows[x][2]


def _linked(rows: list[Member], same_block: bool, threshold: int) -> Iterator[tuple[int, int]]:
    """A forest of links (ids) between the components of the rows, by their full sets."""
    maybe = _allowed(rows, same_block, threshold)
    at = np.flatnonzero(maybe.any(0) | maybe.any(1))
    if not len(at):
        return
    sets = [np.frombuffer(rows[x][6], np.uint64) for x in at]
    size = np.array([len(v) for v in sets])
    owner = np.repeat(np.arange(len(at)), size)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(at), len(at)))
    for k in range(0, len(values), 16384):
        lo, hi = np.searchsorted(code, (k, k + 16384))
        grid = np.zeros((len(at), min(16384, len(values) - k)), np.float32)
        grid[owner[lo:hi], code[lo:hi] - k] = 1
        common += grid @ grid.T
    close = (100 * common >= threshold * (size[:, None] + size[None, :] - common)) & maybe[np.ix_(at, at)]
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while up.get(c, c) != c:
            c = up[c]
        return c

    for x, y in zip(*np.nonzero(close), strict=True):
        a, b = rows[at[x]], rows[at[y]]
        if (p := root(a[3])) != (q := root(b[3])):
            up[p] = q
            yield a[2], b[2]


def _blocks(members: DataFrame, test: Test, names: tuple[str, str], threshold: int) -> DataFrame:
    """What `test` gives for the groups of rows that cover every pair of different components of a band. members: (key, no, id, component, n, sig, hashes).

    In a band, the largest component leads; its classes need no comparison with each other. The rest is cut into blocks of
    about BLOCK classes and WEIGHT shingles: every pair of blocks is a group of its own, and every block meets the leaders, LEAD of
    them a group, that stream past it. A leader is copied once a block of the rest, and one of the rest once for LEAD leaders and
    once for each block of the rest."""
    ship(members.sparkSession)
    counts = members.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    bands = counts.groupBy("key").agg(F.sum("c").alias("m"), F.sum("w").alias("w"), F.max(F.struct("c", "component", "w")).alias("x"))
    cut = lambda c, w, most, weight: F.greatest(F.ceil(c / most), F.ceil(w / weight)).cast("int")
    sized = materialize(bands.select("key", F.col("x.component").alias("lead"), cut(F.col("m") - F.col("x.c"), F.col("w") - F.col("x.w"), BLOCK, WEIGHT).alias("blocks"), cut(F.col("x.c"), F.col("x.w"), LEAD, 16 * WEIGHT).alias("chunks")))
    own = members.join(sized.where("blocks > 0"), "key").withColumn("leads", F.col("component") == F.col("lead"))
    own = own.withColumn("own", F.pmod(F.xxhash64("no", "key"), F.when(F.col("leads"), F.col("chunks")).otherwise(F.col("blocks"))).cast("int"))
    # Group (i, j): blocks i <= j of the rest, or, where i is negative, block j of the rest and the leaders of chunk -1 - i.
    dealt = own.withColumn("o", F.explode(F.sequence(F.when(F.col("leads"), 0).otherwise(-F.col("chunks")), F.col("blocks") - 1)))
    i = F.when(F.col("leads"), -1 - F.col("own")).when(F.col("o") < 0, F.col("o")).otherwise(F.least("own", "o"))
    j = F.when(F.col("leads"), F.col("o")).when(F.col("o") < 0, F.col("own")).otherwise(F.greatest("own", "o"))
    dealt = dealt.select("key", i.alias("i"), j.alias("j"), F.when(F.col("leads"), -1).otherwise(F.col("own")).alias("block"), "no", "id", "component", "n", "sig", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, passing, heavy, out = None, [], [], 0, []

        def tested() -> list[tuple[int, int]]:
            """Two blocks of the rest, or a block and the leaders that pass it."""
            return list(test(rows + passing, group[1] == group[2], threshold)) if group and len(rows) + len(passing) > 1 and (group[1] >= 0 or passing) else []

        for batch in batches:
            for key, i, j, *rest in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if (key, i, j) != group:
                    out += tested()
                    group, rows, passing, heavy = (key, i, j), [], [], 0
                if rest[0] < 0:
                    passing.append(rest)
                    heavy += rest[4]
                    if len(passing) == BLOCK or heavy >= WEIGHT:
                        out += tested()
                        passing, heavy = [], 0
                else:
                    rows.append(rest)
            if len(out) > 10_000:
                yield _pairs(out, names)
                out = []
        out += tested()
        yield _pairs(out, names)

    # Blocks of the rest come before the leaders (block -1) of their group.
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("block").desc()).mapInArrow(run, f"{names[0]} long, {names[1]} long").distinct()


def _labelled(rows: DataFrame, comp: DataFrame, col: str, name: str) -> DataFrame:
    """Add `name`: the component of the id in `col`, or that id where it has no links."""
    c = comp.select(F.col("id").alias("_i"), F.col("component").alias("_c"))
    return rows.join(c, F.col(col) == F.col("_i"), "left").withColumn(name, F.coalesce("_c", col)).drop("_c", "_i")


def _shared_ids(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) from ids that rows of different sets share to the ids of their classes."""
    mark = F.xxhash64("digest")
    several = usable.groupBy("doc_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("doc_id")
    return usable.join(several, "doc_id").join(classes.select("digest", "id"), "digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    texts = id_text(docs, id_col, text_col)
    signed = materialize(_signed(texts, width))
    usable = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    grouped = usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"))
    # Written once, so that the numbers of the classes stay.
    classes = materialize(grouped.withColumn("no", F.monotonically_increasing_id()))
    size = 2 * ROWS
    keyed = classes.select("no", F.explode(F.array(*(F.xxhash64(F.lit(k), F.substring("sig", k * size + 1, size)) for k in range(BANDS)))).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("no").alias("hub")).where("m > 1").select("key", "hub"))
    members = materialize(keyed.join(shared, "key").where("no <> hub"))  # what is not the first of its band
    discard(shared)
    pairs = materialize(members.select(F.col("hub").alias("a"), F.col("no").alias("b")).distinct())
    inside = materialize(pairs.select(F.col("a").alias("no")).union(pairs.select("b")).distinct())
    sigs = materialize(_narrow(classes, inside, "no").select("no", "id", "n", "sig", "digest"))
    discard(inside)
    suspected = materialize(_suspected(pairs, sigs, threshold))
    discard(pairs)

    def sets_of(nos: DataFrame) -> DataFrame:
        wanted = materialize(sigs.join(nos, "no").select("no", F.col("id").alias("doc_id"), "digest"))
        out = materialize(_sets(texts, wanted, width))
        discard(wanted)
        return out

    def merged(found: DataFrame, old: DataFrame | None) -> DataFrame:
        """Components after the confirmed links are added."""
        new = materialize(components(found if old is None else found.union(old.select("id", "component"))))
        discard(old)
        return new

    sets = sets_of(suspected.select(F.col("a").alias("no")).union(suspected.select("b")).distinct())
    first = suspected.groupBy("b").agg(F.min("a").alias("a"))
    comp = merged(_confirm(suspected.join(first, ["a", "b"]), sets, threshold).union(_shared_ids(usable, classes)), None)
    apart = materialize(_labelled(_labelled(suspected, comp, "ia", "ca"), comp, "ib", "cb").where("ca <> cb").select("a", "b", "ia", "ib").join(first, ["a", "b"], "left_anti"))
    if not apart.isEmpty():
        comp = merged(_confirm(apart, sets, threshold), comp)
    discard(apart, suspected, sets)
    now = materialize(_labelled(members.select("key", "no").join(sigs.select("no", "id"), "no"), comp, "id", "component"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    left = materialize(now.join(mixed, "key").join(sigs.select("no", "n", "sig"), "no").select("key", "no", "id", "component", "n", "sig"))
    discard(members, now)
    if not left.isEmpty():
        flagged = materialize(_blocks(left.withColumn("hashes", F.lit(None).cast("binary")), _flagged, ("no", "id"), threshold).select("no"))
        if not flagged.isEmpty():
            sets = sets_of(flagged)
            links = _blocks(left.join(flagged, "no", "left_semi").join(sets, "no").select("key", "no", "id", "component", "n", "sig", "hashes"), _linked, ("u", "v"), threshold)
            comp = merged(links, comp)
            discard(sets)
        discard(flagged)
    discard(left, sigs)
    by_class = _labelled(classes.select("digest", "id"), comp, "id", "component").select("digest", F.col("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates stays (five-word shingles)."""
    gone = near_duplicates(docs, width=5).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
SQL = {
    "op2_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]]
         ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS c FROM documents
  UNION
  SELECT e.v, r.c FROM reach r JOIN both_ways e ON e.u = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) m ON m.id = d.doc_id
"""
}
