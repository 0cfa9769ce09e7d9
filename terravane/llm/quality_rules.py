"""Quality rules with risk-controlled cutoffs.

Every rule compares one feature of a text with a cutoff, by stratum of text length. The labelled rows (quality
1: good, 0: bad) that pass the base are halved by a hash of their id. The fitting half gives each rule its start: the
loosest cutoff that rejects none of its good texts; rules that reject no bad text there are left out. All
cutoffs of a stratum then move together, from so loose that nothing is rejected to ever stricter, and the
other half, the holdout, tests each step: that more than `risk` of the good texts are rejected by the rules
together must be refuted by an exact binomial test. Steps are tested in this fixed order until one fails, which needs no
correction for their number; the strata share the level `delta` (Bonferroni). So with probability 1 - delta the
rules reject at most `risk` of the good texts of every stratum. Of the certified steps that one is used that
rejects most bad texts, each good one rejected counting as `cost` bad ones.

A stratum whose holdout could not certify anything even without a rejection is joined with its smaller
neighbour before any text is tested: strata depend on numbers of labels alone. Fitting and tests use every labelled
row; the driver gets the largest bins of each stratum and a number of texts for each step.

Defined results: null text counts as empty; an empty text has zero counts and fails the base; a table
without enough labels certifies nothing, so that the base alone decides; repeated rows are judged alike; labels that
disagree on an id count as good; rows with null doc_id are judged but carry no label; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terravane.llm.common import id_text, map_batches, table
from terravane.session import discard, materialize

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, MARKS = b"0123456789", b"!?.,;:"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA)


GRID = 64
STRATA = (200, 1000)
RISK, DELTA, COST = 0.02, 0.05, 20.0


def _rules() -> dict[str, tuple[Column, float]]:
    """Rule: feature (rejected above its cutoff), and the largest cutoff of its grid."""
    n, letters = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "symbols per word": (F.col("n_symbols") / n, 2.0),
        "repeated lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 1.0),
        "repeated words": (F.col("n_repeat_words") / n, 1.0),
        "upper case": (F.col("n_upper") / letters, 1.0),
        "long words": (F.col("word_chars") / n, 32.0),
        "marks per word": (F.col("n_marks") / n, 2.0),
        "digits": (F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1)), 1.0),
        "few distinct words": (1 - F.col("n_distinct") / n, 1.0),
    }


def _holding(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside 3-word windows that occur at least twice, distinct words)."""
    n, index = len(words), dict(zip(dict.fromkeys(words), count(), strict=False))
    if n < 4:
        return 0, len(index)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    v = len(index)
    if v < 1 << 20:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * v + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0, v
    at = np.isin(key, twice)
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= at
    return int(cover.sum()), v


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of COUNTS and EXTRA for one text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    seen: set[bytes] = set()
    dup = 0
    lines = data.split(b"\n")
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeated, distinct = repeat_words(words)
    return (len(words), len(text) - _holding(data, SPACE), _holding(data, SYMBOLS), dup, repeated, len(lines), _holding(data, UPPER), _holding(data, LOWER), _holding(data, DIGITS), _holding(data, MARKS), distinct)


def measure(texts: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts of every text, and the columns `carry`. texts: (doc_id, text, ...)."""
    names = COUNTS + EXTRA

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [text_counts(t) for t in batch.column(1).to_pylist()]
        cols = list(zip(*counts, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols), *(batch.column(2 + k) for k in range(len(carry)))], ["doc_id", *names, *carry])

    extra = "".join(f", {c} {texts.schema[c].dataType.simpleString()}" for c in carry)
    return map_batches(texts.select("doc_id", "text", *carry), run, SCHEMA + extra)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def stratum() -> Column:
    return sum(((F.col("n_words") >= x).cast("int") for x in STRATA), F.lit(0))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials, exactly summed in logarithms."""
    i = np.arange(k + 1, dtype=float)
    lg = np.vectorize(math.lgamma, otypes=[float])
    logs = math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


@dataclass(frozen=True)
class Cutoffs:
    """The certified rules: (number of words from which a stratum begins, {rule: cutoff}), and what the holdout showed of each stratum (good texts, those rejected, the bound on the share rejected)."""

    strata: tuple[tuple[int, dict[str, float]], ...] = ()
    shown: tuple[tuple[int, int, float], ...] = ()


def needed(risk: float, level: float) -> int:
    """Good texts of a holdout without any rejection that certify the risk."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def merged_strata(good: list[int], risk: float, delta: float) -> list[list[int]]:
    """Neighbouring strata joined until each has the good texts that a certificate needs at its share of delta; good: numbers of holdout texts."""
    groups = [[i] for i in range(len(good))]
    while len(groups) > 1:
        size = [sum(good[i] for i in g) for g in groups]
        short = [k for k, n in enumerate(size) if n < needed(risk, delta / len(groups))]
        if not short:
            break
        k = min(short, key=size.__getitem__)
        near = min((j for j in (k - 1, k + 1) if 0 <= j < len(groups)), key=size.__getitem__)
        lo, hi = sorted((k, near))
        groups[lo : hi + 1] = [groups[lo] + groups[hi]]
    return groups


def upper_bound(k: int, n: int, level: float) -> float:
    """The largest share that k of n do not refute at the level (Clopper and Pearson), by bisection."""
    lo, hi = k / n if n else 1.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid <= 0 or mid < 1 and binomial_cdf(k, n, mid) > level else (lo, mid)
    return hi


def _steps(over: np.ndarray, test: np.ndarray, good: np.ndarray, bad: np.ndarray, n: int, risk: float, level: float, cost: float) -> tuple[int, tuple[int, int, float]] | None:
    """The step used, and what the holdout showed, or None. test, good, bad: numbers of texts with each value of `over`; n: good texts of the holdout. A text is rejected at step t if its `over` exceeds t."""
    best, pick, shown = 0.0, None, (n, 0, 1.0)
    for t in range(int(over.max()) - 1, -GRID - 1, -1):
        k = int(test[over > t].sum())
        if k > risk * n or binomial_cdf(k, n, risk) > level:
            break
        gain = float(bad[over > t].sum()) - cost * float(good[over > t].sum())
        if gain > best:
            best, pick, shown = gain, t, (n, k, upper_bound(k, n, level))
    return None if pick is None else (pick, shown)


def certify(bins: np.ndarray, good: np.ndarray, holdout: np.ndarray, risk: float, level: float, cost: float) -> tuple[dict[int, int], tuple[int, int, float]] | None:
    """({rule number: bin above which it rejects}, what the holdout showed) for one stratum, or None. bins: texts x rules."""
    test = good & holdout
    n = int(test.sum())
    if n < needed(risk, level):
        return None
    fit = good & ~holdout
    start = bins[fit].max(0, initial=0)
    use = np.flatnonzero((bins[~good & ~holdout] > start).any(0))
    if not len(use):
        return None
    got = _steps((bins[:, use] - start[use]).max(1), test, good, ~good, n, risk, level, cost)
    return None if got is None else ({int(j): int(start[j]) + got[0] for j in use}, got[1])


def _bins() -> list[Column]:
    return [F.greatest(F.lit(0), F.least(F.ceil(f * GRID / top), F.lit(GRID))).cast("int").alias(f"b{j}") for j, (f, top) in enumerate(_rules().values())]


def cutoffs(texts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> Cutoffs:
    """Certified cutoffs. texts: (doc_id, text)."""
    return fitted(measure(texts), labels, risk, delta, cost)


def fitted(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cost: float = COST) -> Cutoffs:
    """Certified cutoffs of measured texts, by certify() in aggregates over all labelled rows: only small numbers are joined with the labels."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    if marks.isEmpty():
        return Cutoffs()
    m = len(_rules())
    half = (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)) == 0).alias("holdout")
    few = counts.where(~base_failed()).select("doc_id", stratum().cast("int").alias("stratum"), half, *_bins())
    rows = materialize(few.join(marks, "doc_id").select("stratum", (F.col("quality") == 1).alias("good"), "holdout", *(f"b{j}" for j in range(m))))
    top = lambda which: [F.max(F.when(which & ~F.col("holdout"), F.col(f"b{j}"))) for j in range(m)]
    seen = {r[0]: r for r in rows.groupBy("stratum").agg(F.sum((F.col("good") & F.col("holdout")).cast("long")), *top(F.col("good")), *top(~F.col("good"))).collect()}
    n_of = [int(seen[i][1]) if i in seen else 0 for i in range(len(STRATA) + 1)]
    groups = merged_strata(n_of, risk, delta)
    level = delta / len(groups)
    starts: dict[int, dict[int, int]] = {}
    for k, g in enumerate(groups):
        high = lambda j, g=g: max((seen[i][j] for i in g if i in seen and seen[i][j] is not None), default=None)
        start = [high(2 + j) or 0 for j in range(m)]
        use = {j: start[j] for j in range(m) if (x := high(2 + m + j)) is not None and x > start[j]}
        if sum(n_of[i] for i in g) >= needed(risk, level) and use:
            starts[k] = use
    group, over = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, use in starts.items():
        inside = F.col("stratum").isin(*groups[k])
        group = F.when(inside, F.lit(k)).otherwise(group)
        over = F.when(inside, F.array_max(F.array(*(F.col(f"b{j}") - c for j, c in use.items())))).otherwise(over)
    cells = rows.select(group.alias("k"), over.alias("over"), "good", "holdout").where("k IS NOT NULL").groupBy("k", "over", "good", "holdout").agg(F.count("*").alias("n")).collect() if starts else []
    discard(rows)
    found, shown, names, tops = [], [], list(_rules()), [x for _, x in _rules().values()]
    for k, g in enumerate(groups):
        own = [r for r in cells if r["k"] == k]
        good, n = np.array([r["good"] for r in own], bool), np.array([r["n"] for r in own], np.int64)
        test = good & np.array([r["holdout"] for r in own], bool)
        got = _steps(np.array([r["over"] for r in own], np.int64), n * test, n * good, n * ~good, sum(n_of[i] for i in g), risk, level, cost) if own else None
        found.append((0 if g[0] == 0 else STRATA[g[0] - 1], {names[j]: (c + got[0]) * tops[j] / GRID for j, c in starts[k].items()} if got else {}))
        shown.append(got[1] if got else (0, 0, 1.0))
    return Cutoffs(tuple(found), tuple(shown))


def _verdict(df: DataFrame, found: Cutoffs) -> DataFrame:
    """Add base_failed, broken (the rules that a text broke) and kept to a table with the counts."""
    rules, broken = _rules(), []
    for k, (least, own) in enumerate(found.strata):
        inside = F.col("n_words") >= least
        if k + 1 < len(found.strata):
            inside &= F.col("n_words") < found.strata[k + 1][0]
        broken += [F.when(inside & (rules[r][0] > c), F.lit(r)) for r, c in own.items()]
    broken = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return df.withColumns({"base_failed": base_failed(), "broken": broken}).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the names of the rules that a text broke."""
    counts = materialize(measure(id_text(docs, id_col, text_col)))  # numbers alone, read twice
    return _verdict(counts, fitted(counts, labels)).select("doc_id", *COUNTS, "base_failed", "kept", "broken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, found: Cutoffs, text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, each judged by its own text: nothing is joined back, so rows without an id or with a shared one are safe."""
    names, at = COUNTS + EXTRA, docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [text_counts(t or "") for t in batch.column(at).to_pylist()]
        cols = list(zip(*counts, strict=True)) or [()] * len(names)
        whole = pa.StructArray.from_arrays([batch.column(i) for i in range(batch.num_columns)], fields=list(batch.schema))
        return pa.RecordBatch.from_arrays([whole, *(pa.array(c, pa.int64()) for c in cols)], ["row", *names])

    out = StructType([StructField("row", docs.schema), *(StructField(c, LongType()) for c in names)])
    return _verdict(map_batches(docs, run, out), found).where("kept").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, cutoffs(id_text(docs), table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_rules": op6_quality_rules}
SQL: dict[str, str] = {}
