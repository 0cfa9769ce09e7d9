"""Line dedup with two Bloom filters.

One pass over the texts sets the bits of every line key in a filter "seen once"; a bit that is set again
by another part of the table goes into the filter "seen twice" (`twice |= once & part`), which therefore
holds every key that two documents share, and few others. Parts travel as sparse segments of the bit
array. A second pass finds the keys of each text that the twice-filter holds. Only these are shuffled, as (digest,
doc_id): they are grouped exactly, the smallest doc_id of a key keeps it, and the others get the digest on
their drop list. Texts without a suspected key are done after that pass; only the others meet their drop lists.

The filters have a bit for every 16 characters, at most MAX_BITS (64 MB), which bounds what is broadcast: some 20 bits
a key up to 8 GB of text and 5 at 30 GB. From some 300 GB on nearly all keys are suspects, 24 bytes each, about 7 % of the
text: the exact grouping then carries all of them in one shuffle with the same result. A digest is 128 bits of BLAKE2b.

Defined results: null or empty text is one empty line; keys of under 10 code points always stay; rows that
share a doc_id count as one document; rows with null doc_id take no part and stay whole; an empty table
gives an empty result; further columns are kept by `drop_repeated_lines` and not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from terravane.llm.common import id_text, map_batches, table, with_n_chars
from terravane.session import materialize, ship

SPACE = " \t\n\x0b\x0c\r"
LEAST = 10
HASHES = 4
SEGMENT = 1 << 16
MIN_BITS, MAX_BITS = 1 << 18, 1 << 29
FLUSH = 2_000_000


def keys_of(text: str, least: int = LEAST) -> list[bytes | None]:
    """The key of every line; None where it is too short to count."""
    return [s.encode("utf-8", "replace").lower() if len(s := line.strip(SPACE)) >= least else None for line in text.split("\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit numbers for each 64-bit hash, by double hashing."""
    h1, h2 = hashes, (hashes >> np.uint64(32)) * np.uint64(2) + np.uint64(1)
    return np.stack([(h1 + np.uint64(i) * h2) & np.uint64(bits - 1) for i in range(HASHES)]).astype(np.int64)


def filter_bits(chars: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, chars // 16 - 1).bit_length()))


def _segments(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct bit numbers as rows (segment, bits of once, bits of twice), two bytes a bit."""
    segs = np.unique(once // SEGMENT)
    cut = lambda x: [(x[a:b] % SEGMENT).astype("<u2").tobytes() for a, b in zip(np.searchsorted(x, segs * SEGMENT), np.searchsorted(x, (segs + 1) * SEGMENT), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(segs.astype(np.int32)), pa.array(cut(once), pa.binary()), pa.array(cut(twice), pa.binary())], ["seg", "once", "twice"])


def _part(hashes: list[int], bits: int) -> pa.RecordBatch:
    """hashes: each key once a document. The filters of this part of the table."""
    keys, n = np.unique(np.array(hashes, np.uint64), return_counts=True)
    return _segments(np.unique(positions(keys, bits)), np.unique(positions(keys[n > 1], bits)))


def _build(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    hashes: list[int] = []
    for batch in batches:
        for text in batch.column(1).to_pylist():
            hashes += map(xxh3_64_intdigest, {k for k in keys_of(text) if k is not None})
            if len(hashes) >= FLUSH:
                yield _part(hashes, bits)
                hashes = []
    if hashes:
        yield _part(hashes, bits)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-filter of each segment, as bytes of bits."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for seg, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            seen, again = held.setdefault(seg, (np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)))
            at = np.frombuffer(once, "<u2")
            again[at] |= seen[at]
            seen[at] = True
            again[np.frombuffer(twice, "<u2")] = True
    for seg, (_, again) in held.items():
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], ["seg", "twice"])


def twice_filter(texts: DataFrame) -> tuple[int, bytes]:
    """(bits, the twice-filter) of a table (doc_id, text)."""
    ship(texts.sparkSession)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = filter_bits(chars)
    parts = texts.mapInArrow(partial(_build, bits=bits), "seg int, once binary, twice binary")
    merged = parts.repartition("seg").mapInArrow(_merge, "seg int, twice binary")
    whole = np.zeros(bits // 8, np.uint8)
    step = SEGMENT // 8
    for r in merged.toLocalIterator():
        whole[r["seg"] * step : (r["seg"] + 1) * step] = np.frombuffer(bytes(r["twice"]), np.uint8)
    return bits, whole.tobytes()


def suspected(held: np.ndarray, bits: int, texts: list[str], known: list[bool]) -> list[list[bytes]]:
    """For each text the digests of its keys that the twice-filter holds; none where `known` is false."""
    rows = [(i, k) for i, (t, ok) in enumerate(zip(texts, known, strict=True)) if ok for k in {k for k in keys_of(t) if k is not None}]
    out: list[list[bytes]] = [[] for _ in texts]
    if rows:
        at = positions(np.array([xxh3_64_intdigest(k) for _, k in rows], np.uint64), bits)
        for j in np.flatnonzero(((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)):
            out[rows[j][0]].append(digest(rows[j][1]))
    return out


def drop_lists(marked: DataFrame) -> DataFrame:
    """(doc_id, keys): the line digests that a document loses. marked: (doc_id, suspects)."""
    found = marked.where("size(suspects) > 0").select("doc_id", F.explode("suspects").alias("key"))
    # Written out: a join of two plain scans is one whose hot keys adaptive execution can split.
    first = materialize(found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"))
    return found.join(first, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def keep_lines(text: str, drop: list[bytes] | None) -> tuple[str, int, int]:
    """(kept text, lines, dropped lines)."""
    lines = text.split("\n")
    if not drop:
        return text, len(lines), 0
    gone = set(drop)
    kept = [line for line, k in zip(lines, keys_of(text), strict=True) if k is None or digest(k) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    texts = id_text(docs, id_col, text_col)
    bits, data = twice_filter(texts.where("doc_id IS NOT NULL"))
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, got = batch.column(0), batch.column(1).to_pylist()
        found = suspected(np.frombuffer(shared.value, np.uint8), bits, got, ids.is_valid().to_pylist())
        done = [not f for f in found]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(found, pa.list_(pa.binary())), pa.array([None if d else t for t, d in zip(got, done, strict=True)], pa.string()), pa.array([t.count("\n") + 1 for t in got], pa.int64()), pa.array([hexed(t) if d else None for t, d in zip(got, done, strict=True)], pa.string())],
            ["doc_id", "suspects", "text", "n_lines", "kept_sha256"],
        )

    marked = materialize(map_batches(texts, look, "doc_id long, suspects array<binary>, text string, n_lines long, kept_sha256 string"))
    done = marked.where("size(suspects) = 0").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "kept_sha256")
    joined = marked.where("size(suspects) > 0").select("doc_id", "text").join(drop_lists(marked), "doc_id", "left").select("doc_id", "text", "keys")

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [keep_lines(t, d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([d for _, _, d in rows], pa.int64()), pa.array([hexed(t) for t, _, _ in rows], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return done.unionByName(map_batches(joined, drop, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", emptied: bool = True) -> DataFrame:
    """The table with the repeated lines gone from its texts; all columns stay, n_chars follows. emptied: keep also the rows that lose every line with a word."""
    texts = id_text(docs, id_col, text_col)
    bits, data = twice_filter(texts.where("doc_id IS NOT NULL"))
    shared = docs.sparkSession.sparkContext.broadcast(data)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    whole = docs.select(row, F.col(id_col).cast("long").alias("doc_id"))
    at = docs.columns.index(text_col)

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [t or "" for t in batch.column(0).field(at).to_pylist()]
        found = suspected(np.frombuffer(shared.value, np.uint8), bits, got, batch.column(1).is_valid().to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["row", "doc_id", "suspects"])

    row_type = StructField("row", docs.schema)
    marked = materialize(map_batches(whole, look, StructType([row_type, StructField("doc_id", LongType()), StructField("suspects", ArrayType(BinaryType()))])))
    joined = marked.where("size(suspects) > 0").select("row", "doc_id").join(drop_lists(marked), "doc_id", "left").select("row", "keys")

    def drop(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column(0)
        cols, new, stays = rows.flatten(), [], []
        for t, d in zip(cols[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
            kept, _, gone = keep_lines(t or "", d)
            new.append(t if t is None else kept)
            stays.append(emptied or not gone or bool(kept.strip(SPACE)))
        cols[at] = pa.array(new, cols[at].type)
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(cols, fields=list(rows.type))], ["row"]).filter(pa.array(stays, pa.bool_()))

    dropped = map_batches(joined, drop, StructType([row_type]))
    return with_n_chars(marked.where("size(suspects) = 0").select("row").unionByName(dropped).select("row.*"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lose every line with a word go: their lines stand in documents of smaller ids."""
    return drop_repeated_lines(docs, emptied=False)


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": """
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM parts),
firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT d.doc_id, d.i, d.line, (f.first_doc IS NOT NULL AND f.first_doc <> d.doc_id) AS dropped
  FROM keyed d LEFT JOIN firsts f ON d.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
