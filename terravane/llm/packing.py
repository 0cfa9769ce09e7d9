"""Best-fit packing of documents into token sequences by hierarchical residual merging.

Every input partition tokenizes its texts, cuts documents longer than a sequence into pieces, and packs
its pieces by best-fit decreasing. Nearly full sequences are final. The underfull ones are items of the
next round: they are dealt to fewer partitions and packed again, until one partition holds them all or a
round no longer helps. A round's partition holds at most `per_task` items, whatever the size of the input.

Defined results: null text counts as empty; every document ends with id 0, so an empty one is the single
id 0; repeated rows and rows with equal or null ids are packed as documents of their own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm.byte_bpe import byte_chars
from terravane.llm.common import id_text, map_batches, table
from terravane.session import materialize, ship

WORDS = public_tokenizers.path("word_bpe_49k.json")
LENGTH = 2048
MEMBER = "array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
#: The tokenizer's split pattern, a fixed value of its file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordCodec(dict):
    """Memo from a normalized word to its ids as little-endian unsigned 32-bit integers. No token spans white space, so a text is the join of its words."""

    def __init__(self, path: str = WORDS, memo: int = 600_000) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer
        self.split, self.memo, self.table = regex.compile(PATTERN), memo, dict(enumerate(byte_chars()))
        self.by_word = path == WORDS  # what follows about words holds for this tokenizer
        self.beyond = regex.compile(r"[^\x00-˿]")
        self.control = regex.compile(r"[\x1c-\x1f]")

    def __missing__(self, word: str) -> bytes:
        if self.beyond.search(word):  # character classes of newer Unicode versions differ between libraries
            parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]
        else:
            parts = [p.encode().decode("latin-1").translate(self.table) for p in self.split.findall(word)]
        ids = [t.id for p in parts for t in self.model.tokenize(p)]
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.memo:
                self.clear()
            self[word] = out
        return out

    def encode_bytes(self, text: str) -> bytes:
        """As the tokenizer encodes; characters below U+0300 are in normal form, and Python lowers them as the tokenizer does."""
        if not self.by_word or self.control.search(text):  # white space for Python but not for the tokenizer
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.normal.normalize_str(text).split(" ") if self.beyond.search(text) else text.lower().split()
        return b"".join(map(self.__getitem__, words))


@cache
def codec(path: str = WORDS) -> WordCodec:
    """One for each Python worker."""
    return WordCodec(path)


def pieces(doc_id: int | None, ids: bytes, length: int = LENGTH) -> list[tuple]:
    """(doc_id, piece, start, length, crc32) of a document's pieces; ids already end with 0."""
    step = 4 * length
    return [(doc_id, k, k * length, len(part) // 4, zlib.crc32(part)) for k, part in enumerate(ids[i : i + step] for i in range(0, len(ids), step))]


def best_fit(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Bins are kept by free room, and a bit mask of the rooms in use finds the tightest one."""
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        n = sizes[i]
        if fits := mask >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = length, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        mask |= 1 << (room - n)
    return bins


def _batch(bins: list[list[tuple]], length: int, slack: int) -> pa.RecordBatch:
    totals = [sum(m[3] for m in b) for b in bins]
    flat = list(zip(*(m for b in bins for m in b), strict=True)) or [()] * len(FIELDS)
    members = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(flat, FIELDS, strict=True)], [n for n, _ in FIELDS])
    ends = pa.array(np.cumsum([0, *map(len, bins)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([t >= length - slack for t in totals], pa.bool_()), pa.array(totals, pa.int32()), pa.ListArray.from_arrays(ends, members)], ["full", "total", "members"])


def _packed(items: list[list[tuple]], length: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Pack items (lists of members) and give the bins in batches."""
    bins = [[m for i in b for m in items[i]] for b in best_fit([sum(m[3] for m in x) for x in items], length)]
    for k in range(0, len(bins), 2000):
        yield _batch(bins[k : k + 2000], length, slack)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, slack: int = 4, per_task: int = 50_000, tokenizer: str = WORDS) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    schema = f"full boolean, total int, members {MEMBER}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[list[tuple]] = []
        c = codec(tokenizer)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items += [[p] for p in pieces(i, c.encode_bytes(text) + b"\0\0\0\0", length)]
                if len(items) >= per_task:
                    yield from _packed(items, length, slack)
                    items = []
        yield from _packed(items, length, slack)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[list[tuple]] = []
        for batch in batches:
            rows: list[Any] = batch.column(0).to_pylist()
            items += [[tuple(m[n] for n, _ in FIELDS) for m in r] for r in rows]
            if len(items) >= per_task:
                yield from _packed(items, length, slack)
                items = []
        yield from _packed(items, length, slack)

    # The parts stay: the rows of the result are read from them.
    rest = materialize(id_text(docs, id_col, text_col).mapInArrow(first, schema))
    done, n = [], math.inf
    while True:
        done.append(rest.where("full"))
        left = rest.where("not full")
        now = left.count()
        tasks = math.ceil(now / (per_task // 2))
        if now == 0 or now > 0.97 * n:
            done.append(left)
            break
        n = now
        # Dealt by a hash of the bin, not round robin: a retried task must deal the same rows.
        key = F.xxhash64(F.element_at("members", 1), "total")
        rest = materialize(left.select("members", key.alias("k")).repartition(tasks, "k").select("members").mapInArrow(again, schema))
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    bins = bins.select("members", F.monotonically_increasing_id().alias("sequence_id"))

    def flat(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, seq = batch.column(0), batch.column(1)
        m = lists.flatten()
        sizes = m.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        ends = np.cumsum(sizes)
        at = np.cumsum(counts) - counts
        base = np.concatenate([[0], ends])[at]
        offset = ends - sizes - np.repeat(base, counts)
        return pa.RecordBatch.from_arrays([*(m.field(n) for n, _ in FIELDS), pa.array(np.repeat(seq.to_numpy(zero_copy_only=False), counts), pa.int64()), pa.array(offset, pa.int64())], [*(n for n, _ in FIELDS), "sequence_id", "offset"])

    return map_batches(bins, flat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
SQL: dict[str, str] = {}
