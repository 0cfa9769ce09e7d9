"""What the text operators share.

Words are runs of `[^\\x20\\x09-\\x0D]`: `bytes.split()` on UTF-8 splits on those six white-space bytes
and no others, and `bytes.lower()` lowers A-Z and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terravane.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string, null text as empty): names of further columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """One Arrow batch at a time; memory is bounded by the batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[int | None, str], tuple], schema: str, types: list[pa.DataType]) -> DataFrame:
    """fn(doc_id, text) -> the output row; df has the columns of id_text()."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [fn(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return map_batches(df, run, schema)


def hash_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n: the fixed folds."""
    return F.crc32(F.col(id_col).cast("string")) % n


def with_n_chars(df: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df
