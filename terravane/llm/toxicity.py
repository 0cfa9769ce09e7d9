"""Toxicity by maximum-scoring segments.

Tokens and their beginnings (4 to 8 bytes, for inflected and compound forms) get log-odds between toxic and
clean labelled texts under an informative Dirichlet prior. A text counts each of its tokens once; a beginning has the counts of
all its tokens; the prior's weights are the shares of occurrences in all documents. A token scores the best significant
log-odds among itself and its beginnings; every other token scores MISS. A linear-time scan finds all maximal scoring
segments of a text. The Karlin-Altschul parameters (lambda from the token scores of all documents, K from clean labelled
texts) turn a segment score into an extreme-value E-value; segments with E <= SIGNIFICANT are toxic
passages, and a logistic curve over the evidence of the segments alone gives the score.

Labels of the held-out fold (crc32 of the id modulo 3 is 1) are never read. Log-odds come from at most
training.SAMPLE labelled rows, for every token that a toxic one of them holds; occurrences are counted in all documents and
stay distributed; whole texts are scanned.

Defined results: null text counts as empty; a text without a scoring token has the lowest score of the
curve; without labels of both kinds every score is 0; rows with null doc_id are scored and not held out; repeated rows
and texts of equal evidence get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm.common import id_text, map_batches, table
from terravane.llm.training import SAMPLE, held_out, sample_texts, training_labels
from terravane.session import discard, materialize, ship

FOLDS, FOLD = 3, 1
CUT = 0.7
MISS = -0.25
Z = 4.5
PRIOR = 1000.0
SIGNIFICANT = 0.05
#: A token scores only where so many toxic texts among those that hold it are this improbable.
LEVEL = 1e-5
#: Distinct tokens that a task counts before it passes the counts on.
FLUSH = 400_000
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of bytes beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split()


def segments(hits: list[tuple[int, float]], miss: float = MISS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    hits: (position, positive score) in order; every token between two hits scores `miss`. Each entry of
    the stack knows its score sum before and after it and the nearest entry below with a smaller sum before.
    """
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, score in hits:
        total += miss * (at - last - 1)
        start, before = at, total
        total += score
        last = at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((start, at, before, total, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def parts(word: bytes) -> list[bytes]:
    """What a token is known by: itself, and its beginnings marked with a space."""
    return [word, *(b" " + word[:n] for n in range(4, min(9, len(word))))]


class _Scores(dict):
    """Memo from a token to its score, 0 without one."""

    def __init__(self, known: dict[bytes, float], memo: int = 500_000) -> None:
        super().__init__()
        self.known, self.memo = known, memo

    def __missing__(self, word: bytes) -> float:
        out = max((self.known.get(p, 0.0) for p in parts(word)), default=0.0)
        if len(self) >= self.memo:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out

    def __reduce__(self) -> tuple:
        return _Scores, (self.known, self.memo)


class Model:
    """Token scores, extreme-value parameters and the score curve."""

    def __init__(self, scores: dict[bytes, float], lam: float = 1.0) -> None:
        self.scores, self.lam, self.k, self.curve = _Scores(scores), lam, 1.0, ()

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(position, score) of the scoring tokens, wherever and however often they occur."""
        score = self.scores.__getitem__
        known = {w: s for w in set(words) if (s := score(w))}
        return [(i, known[w]) for i, w in enumerate(words) if w in known] if known else []

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens, and the maximal scoring segments."""
        words = tokens(text)
        return len(words), segments(self.hits(words))

    def evidence(self, n: int, score: float) -> float:
        """-log E of a segment score in a text of n tokens."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The toxic passages among the segments: (first token, last token, E-value)."""
        e = [(a, b, math.exp(-max(-700.0, min(700.0, self.evidence(n, s))))) for a, b, s in found]
        return [x for x in e if x[2] <= SIGNIFICANT]

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        return self.significant(*self.scan(text))

    def summary(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        """What the curve reads, all from the segments: the best evidence, the significant evidence summed, the number of significant segments, the scores of all segments summed, and the share of the text that significant ones cover."""
        each = [self.evidence(n, s) for _, _, s in found]
        least = -math.log(SIGNIFICANT)
        strong = [(x, b - a + 1) for x, (a, b, _) in zip(each, found, strict=True) if x >= least]
        best = max(each, default=-math.log(self.k * max(n, 1)))
        return [max(best, -20.0), math.log1p(sum(x for x, _ in strong)), math.log1p(len(strong)), math.log1p(sum(s for _, _, s in found)), sum(w for _, w in strong) / max(n, 1)]

    def score(self, text: str) -> float:
        return float(logistic(np.array([self.summary(*self.scan(text))]), self.curve)[0])


def logistic(x: np.ndarray, curve: tuple) -> np.ndarray:
    if len(curve) < 3:
        return np.zeros(len(x))
    mean, std, w = curve
    s = np.clip(np.hstack([np.ones((len(x), 1)), (x - mean) / std]) @ w, -30, 30)
    return 1 / (1 + np.exp(-s))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple:
    mean, std = x.mean(0), x.std(0) + 1e-9
    d = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + 0.1 * np.eye(len(w)), d.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, std, w


def _texts_with(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts that hold each token, by label (column 0); all together under the empty token."""
    by: dict[int, Counter] = {}
    for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        words = set(tokens(text))
        c = by.setdefault(label, Counter())
        c.update(words)
        c[b""] += len(words)
    rows = [(label, w, n) for label, c in by.items() for w, n in c.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["label", "token", "n"])


def occurrences(texts: DataFrame) -> DataFrame:
    """(token, n) over all documents."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(tokens(text))
            if len(c) > FLUSH:
                yield _counted(c)
                c.clear()
        yield _counted(c)

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _counted(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "n"])


def _parts() -> Column:
    """parts() of the column `token`, as an array."""
    beginnings = F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.octet_length("token") - 1)), lambda n: F.concat(F.lit(b" "), F.substring(F.col("token"), F.lit(1), n)))
    return F.when(F.octet_length("token") > 4, F.concat(F.array("token"), beginnings)).otherwise(F.array("token"))


def chance(toxic: int, clean: int, share: float) -> float:
    """Bound (Chernoff) of the probability that so many of the texts with a token, or more, are toxic, where any of them is with probability `share`."""
    q = toxic / (toxic + clean)
    if q <= share:
        return 1.0
    return math.exp(-toxic * math.log(q / share) - (clean * math.log((1 - q) / (1 - share)) if clean else 0.0))


def log_odds(toxic: dict[bytes, int], clean: dict[bytes, int], background: dict[bytes, int]) -> dict[bytes, float]:
    """Log-odds of the significant tokens; the empty token holds the totals."""
    nt, nc, nb = (max(x.get(b"", 0), 1) for x in (toxic, clean, background))
    out = {}
    for w in toxic:
        if w and chance(toxic[w], clean.get(w, 0), nt / (nt + nc)) <= LEVEL:
            yt, yc, prior = toxic[w], clean.get(w, 0), PRIOR * max(background.get(w, 0), 1) / nb
            delta = math.log((yt + prior) / (nt + PRIOR - yt - prior)) - math.log((yc + prior) / (nc + PRIOR - yc - prior))
            if delta / math.sqrt(1 / (yt + prior + 0.5) + 1 / (yc + prior + 0.5)) >= Z and delta > 0.5:
                out[w] = delta
    return out


def solve_lambda(scores: np.ndarray, n: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * score)) = 1, given how often each score occurs; 0 stands for MISS."""
    if not (scores > 0).any():
        return 1.0
    s, p = np.where(scores > 0, scores, MISS), n / n.sum()
    if (p * s).sum() >= 0:
        return 1e-3
    f = lambda x: (p * np.exp(x * s)).sum() - 1
    lo, hi = 0.0, 1e-3
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def fit(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = texts.sparkSession
    rows = training_labels(labels, "toxic", FOLDS, FOLD, sample)
    chosen = materialize(sample_texts(texts, rows))
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    seen = materialize(map_batches(chosen, _texts_with, "label int, token binary, n long").groupBy("token").agg(of(1).alias("toxic"), of(0).alias("clean")))
    empty = F.octet_length("token") == 0
    total = [(r["toxic"], r["clean"]) for r in seen.where(empty).collect()]
    if not total or not all(total[0]):
        discard(chosen, seen)
        return Model({})
    words = materialize(occurrences(texts))
    spread = words.agg(F.sum("n")).first()[0]
    split = lambda df, *n: df.where(~empty).select(F.explode(_parts()).alias("token"), *n).groupBy("token").agg(*(F.sum(x).alias(x) for x in n))
    # Only beginnings and tokens of toxic texts can score.
    both = split(seen, "toxic", "clean").where("toxic > 0").join(split(words, "n"), "token").select("token", "toxic", "clean", "n")

    def significant(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, clean, every = ({b"": n, **dict(zip(batch.column(0).to_pylist(), batch.column(k).to_pylist(), strict=True))} for k, n in ((1, total[0][0]), (2, total[0][1]), (3, spread)))
        got = log_odds(toxic, clean, every)
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.float64())], ["token", "score"])

    model = Model({bytes(r["token"]): r["score"] for r in map_batches(both, significant, "token binary, score double").collect()})
    known = spark.sparkContext.broadcast(model.scores)

    def histogram(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(known.value.__getitem__, batch.column(0).to_pylist())), pa.float64()), batch.column(1)], ["score", "n"])

    found = map_batches(words, histogram, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    model.lam = solve_lambda(found["score"].to_numpy(float), found["n"].to_numpy(float))
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.scan(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([[{"first": a, "last": b, "score": x} for a, b, x in f] for _, f in got], kind)], ["label", "n", "segments"])

    scanned = materialize(map_batches(chosen, scan, "label int, n long, segments array<struct<first:int,last:int,score:double>>"))
    discard(chosen, seen, words)
    tops = scanned.where("label = 0").select("n", F.coalesce(F.array_max(F.transform("segments", lambda x: x["score"])), F.lit(0.0)).alias("best")).toPandas()
    # K makes the E-value exact where it decides: a share SIGNIFICANT of the clean texts reaches it.
    reach = (tops.n.clip(lower=1) * np.exp(-model.lam * tops.best)).to_numpy(float)
    model.k = float(np.clip(SIGNIFICANT / max(np.quantile(reach, SIGNIFICANT), 1e-300), 1e-6, 1e6)) if len(reach) else 1.0
    again = spark.sparkContext.broadcast((model.lam, model.k))

    def facts(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = Model({}, again.value[0])
        m.k = again.value[1]
        got = [m.summary(n, [(x["first"], x["last"], x["score"]) for x in f]) for n, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], ["label", "x"])

    data = map_batches(scanned, facts, "label int, x array<double>").toArrow()
    discard(scanned)
    x, y = np.array(data.column("x").to_pylist(), float), np.array(data.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))
    model.curve = fit_logistic(x[order], y[order])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages (first and last token, E-value)."""
    texts = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, labels))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("e_value", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scans = [m.scan(t) for t in batch.column(1).to_pylist()]
        found = [[{"first": a, "last": b, "e_value": e} for a, b, e in m.significant(*x)] for x in scans]
        score = logistic(np.array([m.summary(*x) for x in scans]).reshape(len(scans), -1), m.curve)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "passages"])

    scored = map_batches(texts, run, "doc_id long, score double, passages array<struct<first:int,last:int,e_value:double>>")
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "passages")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("n_passages", F.size("passages")).drop("passages")


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
