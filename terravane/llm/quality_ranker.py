"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text: twelve numbers of its form, cut into bins, too, and its words, as the
shares of LEXICON hashed groups of them. The weights come from preference pairs (a labelled
good text is preferred to a labelled bad one) by logistic loss on feature differences. The threshold is a
quantile of the training scores; scores are moved so that it lies at 0.3 and squeezed into 0..1.

Labels of the held-out fold (crc32 of the id modulo 5 is 0) are never read. The weights are fitted on at
most training.SAMPLE labelled rows and PAIRS pairs; every text is scored as a whole.

Defined results: null text counts as empty and is scored like any text; without labels of both kinds every
score is 0.5; rows with null doc_id are scored and not held out; repeated rows get equal scores; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from terravane.llm.common import id_text, map_batches, table
from terravane.llm.quality_rules import text_counts
from terravane.llm.training import SAMPLE, held_out, sample_texts, training_labels

FOLDS, FOLD = 5, 0
PAIRS = 100_000
CHUNK = 10_000
BINS = 12
LEXICON = 128
CUT = 0.3
NAMES = ["symbols", "repeated lines", "repeated words", "upper case", "word length", "marks", "digits", "distinct", "words", "words per line", "bytes beyond ASCII", "bars and exclamations"]


def features(text: str) -> np.ndarray:
    """The twelve numbers of NAMES and the shares of the LEXICON groups of words; they depend on nothing but the text."""
    n, chars, symbols, dup, repeated, lines, upper, lower, digits, marks, distinct = text_counts(text)
    w = max(n, 1)
    data = text.encode("utf-8", "replace")
    size = len(data)
    form = [symbols / w, dup / max(lines, 1), repeated / w, upper / max(upper + lower, 1), chars / w, marks / w, digits / max(chars, 1), distinct / w, float(np.log1p(n)), float(np.log1p(n / max(lines, 1))), (size - len(text)) / max(size, 1), text.count("|") / w + text.count("!") / w]
    words = data.lower().split()
    group = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64(LEXICON - 1)
    return np.concatenate([form, np.bincount(group.astype(np.int64), minlength=LEXICON) / w])


class Ranker:
    """Weights over the features and the quantile bins of the first twelve."""

    def __init__(self, rows: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> None:
        self.ok = bool((label == 1).any() and (label == 0).any())
        if not self.ok:
            return
        self.edges = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in rows.T[: len(NAMES)]]
        self.mean, self.std = rows.mean(0), rows.std(0) + 1e-9
        x = self.expand(rows)
        rng = np.random.default_rng(seed)
        m = min(pairs, 20 * len(label))
        good, bad = (rng.choice(np.flatnonzero(label == k), m) for k in (1, 0))
        w = np.zeros(x.shape[1])
        for _ in range(12):  # Newton steps of the ridge-penalized logistic loss on differences, a chunk of pairs at a time
            g, h = -1e-3 * w, 1e-3 * np.eye(len(w))
            for k in range(0, m, CHUNK):
                d = x[good[k : k + CHUNK]] - x[bad[k : k + CHUNK]]
                p = 1 / (1 + np.exp(-np.clip(d @ w.astype(np.float32), -60, 60)))
                g += d.T @ (1 - p) / m
                h += d.T @ (d * (p * (1 - p))[:, None]) / m
            step = np.linalg.solve(h, g)
            w = w + step
            if np.abs(step).max() < 1e-3:
                break
        self.w = w
        s = x @ w
        grid = np.quantile(s, np.linspace(0.01, 0.99, 197))
        right = [((s >= c) == label).mean() for c in grid]
        best = np.flatnonzero(np.isclose(right, max(right)))
        self.cut = float(grid[best[len(best) // 2]])

    def expand(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.std, -4, 4)
        hot = [np.eye(len(e) + 1, dtype=np.float32)[np.searchsorted(e, x, side="right")] for e, x in zip(self.edges, rows.T[: len(NAMES)], strict=True)]
        return np.hstack([z.astype(np.float32), *hot])

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.ok:
            return np.full(len(rows), 0.5)
        s = np.clip(self.expand(rows) @ self.w - self.cut + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-s))


def _rows(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES) + LEXICON)


def fit(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """texts: (doc_id, text). Features of the sample are computed by the executors; at most `sample` rows of numbers come to the driver, as float32."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_rows(batch.column(1).to_pylist()).astype(np.float32)), pa.list_(pa.float32()))], ["label", "x"])

    got = map_batches(sample_texts(texts, training_labels(labels, "quality", FOLDS, FOLD, sample)), run, "label int, x array<float>").toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(NAMES) + LEXICON) if got.num_rows else np.empty((0, len(NAMES) + LEXICON), np.float32)
    y = np.array(got.column("label").to_pylist(), int)
    order = np.lexsort((*x.T, y))  # the order of rows must not matter
    return Ranker(x[order], y[order])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    texts = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, labels))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_rows(batch.column(1).to_pylist())))], ["doc_id", "score"])

    scored = map_batches(texts, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
SQL: dict[str, str] = {}
