"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

The ranks of a tiktoken file become a BPE model of the tokenizers library: every byte is written as one
character (the usual byte-to-character table), and the merges are the pairs that build each token from
parts of lower rank. The split pattern cuts a text into pieces; every piece is encoded alone, and a piece
met before in the same Python worker is taken from a bounded memo. Decoding joins the bytes of the
tokens; a character whose bytes lie in several tokens is whole again after the join, and the offsets give
such tokens the range of the whole character.

Defined results: null text counts as empty; an empty text has no tokens and decodes to no bytes; null ids decode to
an empty text; rows with equal ids or null ids are encoded like any other; other columns are not read; an empty table
gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import models

from terravane.llm.common import id_text, map_batches, map_rows, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MEMO = 600_000


def byte_chars() -> list[str]:
    """The character of every byte: printable ones stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in chars:
            chars[b], spare = chr(spare), spare + 1
    return [chars[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_parts(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes] | None:
    """The last merge that builds a token: its parts under merges of lower rank."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN, memo: int = MEMO) -> None:
        ranks = read_ranks(path)
        chars = byte_chars()
        self.table = {i: c for i, c in enumerate(chars)}
        text = {t: t.decode("latin-1").translate(self.table) for t in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.__getitem__):
            if len(token) > 1:
                first = merge_parts(ranks, token)
                splits = [(token[:i], token[i:]) for i in range(len(token) - 1, 0, -1) if token[:i] in ranks and token[i:] in ranks and max(ranks[token[:i]], ranks[token[i:]]) < ranks[token]]
                merges += [(text[a], text[b]) for a, b in ([first] if first else []) + [s for s in splits if s != first]]
        self.model = models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.split = regex.compile(pattern)
        self.memo, self.by_space = memo, pattern == public_tokenizers.PATTERN
        self.whole = _Chunks(self, " ")
        self.first = _Chunks(self, "")

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        tokens = self.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.table))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text. By the usual pattern a space between two other characters begins a piece, so that a text whose white space is single can be cut there and the chunks memoized; any other text, and any other pattern, goes through the pattern as a whole."""
        if not text:
            return b""
        if not self.by_space:
            return b"".join(map(self.piece_memo, self.split.findall(text)))
        head, *rest = text.split(" ")
        try:
            return b"".join([self.first[head], *map(self.whole.__getitem__, rest)])
        except _Spaces:
            return b"".join(map(self.piece_memo, self.split.findall(text)))

    def piece_memo(self, piece: str) -> bytes:
        return self.whole.pieces(piece)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the code point range of every token; tokens that share a character share its range. The library's offsets are those of the characters that stand for bytes, written as UTF-8."""
        ids: list[int] = []
        spans: list[tuple[int, int]] = []
        first = 0  # code points before the piece
        for piece in self.split.findall(text):
            data = piece.encode("utf-8", "replace")
            char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
            mapped = data.decode("latin-1").translate(self.table)
            byte = np.cumsum((np.frombuffer(mapped.encode(), np.uint8) & 0xC0) != 0x80) - 1  # of the piece, by the library's offset
            for t in self.model.tokenize(mapped):
                ids.append(t.id)
                spans.append((first + int(char[byte[t.offsets[0]]]), first + int(char[byte[t.offsets[1] - 1]]) + 1))
            first += len(piece)
        return ids, spans


class _Spaces(Exception):
    """White space at the end of a chunk: it may join the next one."""


class _Chunks(dict):
    """Memo from a chunk (after `lead`) to its ids; computed where missing."""

    def __init__(self, codec: Codec, lead: str) -> None:
        super().__init__()
        self.codec, self.lead, self.known = codec, lead, {}

    def pieces(self, piece: str) -> bytes:
        if (out := self.known.get(piece)) is None:
            if len(self.known) >= self.codec.memo:
                self.known.clear()
            out = self.codec.piece(piece)
            if len(piece) <= 64:
                self.known[piece] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Spaces
        if "\n" in chunk:  # a single line break between two other characters is a piece of its own
            head, *rest = chunk.split("\n")
            first = self.codec.first
            return b"".join([self[head], *(x for r in rest for x in (first.pieces("\n"), first[r]))])
        out = b"".join(map(self.pieces, self.codec.split.findall(self.lead + chunk)))
        if len(chunk) <= 64:
            if len(self) >= self.codec.memo:
                self.clear()
            self[chunk] = out
        return out


@cache
def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, offsets: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the code point ranges of the tokens (starts, ends)."""

    def row(i: int | None, text: str) -> tuple:
        c = codec(path)
        if not offsets:
            return i, c.encode(text)
        ids, spans = c.tokens(text)
        return i, ids, [a for a, _ in spans], [b for _, b in spans]

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return map_rows(id_text(docs, id_col, text_col), row, "doc_id long, ids array<long>" + extra, [pa.int64(), pa.list_(pa.int64())] + [pa.list_(pa.int32())] * (2 * offsets))


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = RANKS) -> DataFrame:
    """doc_id and text, from ids; bytes that are no UTF-8 become U+FFFD."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec(path).decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")), run, "doc_id long, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(i: int | None, text: str) -> tuple:
        c = codec()
        data = c.encode_bytes(text)
        ids = np.frombuffer(data, "<u4").tolist()
        return i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(c.decode_bytes(ids)).hexdigest()

    return map_rows(id_text(table(spark, sf_dir, "documents")), row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.int64(), pa.string(), pa.string()])


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
SQL: dict[str, str] = {}
