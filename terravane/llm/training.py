"""Labelled rows for the two classifiers: folds by id, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import hash_mod

#: Labelled rows that a classifier is fitted on, at most (about; rows are taken by a hash of their id).
SAMPLE = 50_000


def held_out(folds: int, fold: int, id_col: str = "doc_id") -> Column:
    """True for rows of the fold that learning must not see; false without an id."""
    return F.coalesce(hash_mod(id_col, folds) == fold, F.lit(False))


def training_labels(labels: DataFrame, label: str, folds: int, fold: int, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label 0/1) outside the held-out fold; each id once, the higher label if rows disagree."""
    rows = (
        labels.where(f"doc_id IS NOT NULL AND {label} IN (0, 1)").where(~held_out(folds, fold))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    )
    n = rows.count()
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))))


def sample_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(label, text) of the sample; the sample is bounded by its parameter, so that it can be sent to all tasks."""
    return texts.join(F.broadcast(rows), "doc_id").select("label", "text")
