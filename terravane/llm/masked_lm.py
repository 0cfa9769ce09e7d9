"""Language-model scoring by masked pseudo-likelihood.

A bidirectional window network predicts the token at every position from SPAN tokens on both sides:
embeddings of the neighbours by place, a tanh layer, and a softmax in two levels (a group of tokens, then the
token in its group), trained in numpy by cross entropy. All words are counted over all documents. The commonest
have tokens of their own, and their number grows with the root of the counted positions; the rest share tail
tokens by hash, and each has its share of its token's count: p(word | sides) = p(token | sides) * n(word) / n(token).
In a group of tail tokens, which stand for nothing but hashes, a token has its share of the group's count; the network
predicts the group. Token 0 is the text's edge.

Every position of every document is trained on once: in each of ROUNDS parts of the documents the executors
go through their own rows from the same parameters, which are then averaged by positions. Word counts stay
distributed and are joined to the rare words of the documents; what reaches the driver is the vocabulary and the
parameters. The averages, and so the last digits of the scores, depend on how the rows are dealt to tasks.

Defined results: null or empty text has no tokens, a sum of 0, and no mean (null); repeated rows count
repeatedly and get scores that are equal but for rounding; rows with null doc_id are counted, trained on and scored like any; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from terravane.llm.common import id_text, map_batches, table
from terravane.session import materialize, ship

LEAST_WORDS = 95
SHARE = 0.5
SPAN = 2
WIDTH = 24
ROUNDS = 2
BATCH = 32_768
#: Rows of a matrix that stay in the processor's cache.
CACHED = 4096
RATE = 0.05
PIECE = 1 << 13
#: Positions that a task counts at once, about.
SORTED = 4_000_000


def hash_of(word: bytes) -> int:
    """64 bits of a word's hash, signed."""
    h = xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def hashes(text: str) -> np.ndarray:
    """The words of a text, as 64-bit hashes."""
    words = words_of(text)
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all documents."""
    ship(texts.sparkSession)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate([np.empty(0, np.int64), *parts]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(hashes(t))
                size += len(held[-1])
            if size > SORTED:
                yield counted(held)
                held, size = [], 0
        yield counted(held)

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Tokens: 0 the edge, then the words with tokens of their own (commonest first), then the tail."""

    def __init__(self, words: np.ndarray, tail: int) -> None:
        self.order = np.argsort(words)
        self.words, self.tail = words[self.order], tail
        self.size = 1 + len(words) + tail
        bucket = (self.words >> 48) + (1 << 15)
        self.first = np.searchsorted(bucket, np.arange((1 << 16) + 1)).astype(np.int32)
        self.filled = np.diff(self.first).astype(np.int16)  # words of each bucket: few, as hashes are even
        self.depth = int(self.filled.max())

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The tokens of hashed words. The words lie in buckets by 16 bits of their hash, each looked through as far as the fullest one goes."""
        out = np.zeros(len(h), np.int64)
        bucket = (h >> 48) + (1 << 15)
        at, open_ = self.first[bucket], np.flatnonzero(self.filled[bucket])
        for k in range(self.depth):
            i = at[open_] + k
            found = self.words[i] == h[open_]
            out[open_[found]] = 1 + self.order[i[found]]
            open_ = open_[~found & (self.filled[bucket[open_]] > k + 1)]
        rest = np.flatnonzero(out == 0)
        out[rest] = 1 + len(self.words) + h[rest] % self.tail
        return out

    def split(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """ids() of each of some hashed texts, looked up together."""
        return np.split(self.ids(np.concatenate([np.empty(0, np.int64), *texts])), np.cumsum([len(t) for t in texts])[:-1])

    def rare(self, ids: np.ndarray) -> np.ndarray:
        return ids > len(self.words)


def own_words(positions: int) -> int:
    """How many words have tokens of their own."""
    return max(LEAST_WORDS, math.ceil(SHARE * math.sqrt(positions)))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Of the counted words; words that occur equally often are in together or out together."""
    bins = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    most, least, taken = own_words(sum(n * w for n, w in bins)), None, 0
    for n, w in bins:
        if taken + w > most:
            break
        least, taken = n, taken + w
    rows = [] if least is None else counts.where(F.col("n") >= least).collect()
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    return Vocabulary(np.array([r["word"] for r in rows], np.int64), max(32, most // 3))


#: The places of the neighbours.
SIDES = [d for d in range(-SPAN, SPAN + 1) if d]


def stream(texts: list[np.ndarray]) -> np.ndarray:
    """The tokens of texts in a row, with SPAN edges around each."""
    gap = np.zeros(SPAN, np.int64)
    return np.concatenate([gap, *(x for t in texts for x in (t, gap))])


class Network:
    """Embeddings e (by token, the places side by side), bias b, groups (w, c) and tokens in their group (u, d), and the sums of squared gradients."""

    def __init__(self, v: int, width: int = WIDTH, seed: int = 3, tail: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.v, self.width, self.tail = v, width, tail
        self.each = math.ceil(math.sqrt(v))
        self.groups = math.ceil(v / self.each)
        self.learnt = math.ceil((v - tail) / self.each)  # the groups from here on hold tail tokens only
        p = {"e": rng.normal(0, 0.3, (v, len(SIDES) * width)), "b": np.zeros(width), "w": rng.normal(0, 0.1, (width, self.groups)), "c": np.zeros(self.groups), "u": rng.normal(0, 0.1, (self.groups, width, self.each)), "d": np.zeros((self.groups, self.each))}
        p["u"][self.learnt :] = 0
        p["d"].reshape(-1)[v:] = -1e9  # places of the last group that hold no token
        self.p = {k: x.astype(np.float32) for k, x in p.items()}
        self.m = {k: np.full_like(x, 1e-8) for k, x in self.p.items()}

    def start(self, unigram: np.ndarray) -> None:
        """Biases that give the tokens their shares of all positions."""
        n = np.zeros(self.groups * self.each)
        n[: self.v] = unigram + 1.0
        n = n.reshape(self.groups, self.each)
        self.p["c"] = np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.p["d"] = np.where(n > 0, np.log(np.maximum(n, 1e-9) / n.sum(1, keepdims=True)), -1e9).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for part in (self.p, self.m) for x in part.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.m):
            for k, x in part.items():
                part[k] = flat[at : at + x.size].astype(np.float32).reshape(x.shape)
                at += x.size

    def _place(self, k: int) -> slice:
        return slice(k * self.width, (k + 1) * self.width)

    def hidden(self, s: np.ndarray) -> np.ndarray:
        """The hidden layer at each position of a stream but its first and last SPAN."""
        e, n = self.p["e"][s], len(s) - 2 * SPAN
        x = np.broadcast_to(self.p["b"], (n, self.width)).copy()
        for k, d in enumerate(SIDES):
            x += e[SPAN + d : SPAN + d + n, self._place(k)]
        return np.tanh(x, out=x)

    def _runs(self, token: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(group, first, end) of the runs of sorted tokens."""
        ends = np.searchsorted(token, np.arange(1, self.groups + 1) * self.each)
        for k in np.flatnonzero(np.diff(ends, prepend=0)):
            yield int(k), int(ends[k - 1]) if k else 0, int(ends[k])

    def _logs(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log-probabilities of sorted tokens."""
        out = np.empty(len(token))
        d = self.p["d"].reshape(-1)
        for g, a, b in self._runs(token):
            for i in range(a, b, CACHED):
                j = min(b, i + CACHED)
                z = _logits(h[i:j], self.p["w"], self.p["c"])
                got = z[:, g].astype(np.float64)
                got -= np.log(_exps(z))
                if g < self.learnt:
                    got += _picked(_logits(h[i:j], self.p["u"][g], self.p["d"][g]), token[i:j] - g * self.each)
                else:
                    got += d[token[i:j]]
                out[i:j] = got
        return out

    def logs(self, s: np.ndarray) -> np.ndarray:
        """Log-probability of every token of a stream that is no edge, between its neighbours."""
        inner = s[SPAN : len(s) - SPAN]
        order = _order(inner)
        order = order[int((inner == 0).sum()) :]  # edges come first
        out = np.zeros(len(inner))
        out[order] = self._logs(self.hidden(s)[order], inner[order])
        return out[inner != 0]

    def between(self, sides: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log-probability of each token between its sides (one column a place)."""
        h = np.tanh(self.p["b"] + sum(self.p["e"][sides[:, k], self._place(k)] for k in range(len(SIDES))))
        order = _order(token)
        out = np.empty(len(token))
        out[order] = self._logs(h[order], token[order])
        return out

    def step(self, s: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad on the mean cross entropy of a stream; only what it touches moves."""
        h = self.hidden(s)
        inner = s[SPAN : len(s) - SPAN]
        order = _order(inner)
        order = order[int((inner == 0).sum()) :]
        token, x, n = inner[order], h[order], len(order)
        if not n:
            return
        q = _softmax(_logits(x, self.p["w"], self.p["c"]))
        one = np.ones(n, np.float32)
        runs = list(self._runs(token))
        for g, a, b in runs:
            q[a:b, g] -= 1
        dx = q @ self.p["w"].T
        self._move("w", slice(None), x.T @ q / n, rate)
        self._move("c", slice(None), one @ q / n, rate)
        own = [r for r in runs if r[0] < self.learnt]
        gu, gd = np.empty((len(own), *self.p["u"].shape[1:]), np.float32), np.empty((len(own), self.each), np.float32)
        for k, (g, a, b) in enumerate(own):
            r = _softmax(_logits(x[a:b], self.p["u"][g], self.p["d"][g]))
            r.reshape(-1)[np.arange(0, (b - a) * self.each, self.each) + (token[a:b] - g * self.each)] -= 1
            dx[a:b] += r @ self.p["u"][g].T
            np.matmul(x[a:b].T, r, out=gu[k])
            np.matmul(one[a:b], r, out=gd[k])
        at = np.array([g for g, _, _ in own], np.int64)
        self._move("u", at, gu / n, rate)
        self._move("d", at, gd / n, rate)
        x *= x
        np.subtract(1, x, out=x)
        x *= dx
        x /= n
        self._move("b", slice(None), one @ x, rate)
        # What a position's neighbours get from it lies at their places of the stream; equal tokens are summed.
        m = len(inner)
        back = np.zeros((m, self.width), np.float32)
        back[order] = x
        each = np.zeros((len(s), len(SIDES) * self.width), np.float32)
        for k, d in enumerate(SIDES):
            each[SPAN + d : SPAN + d + m, self._place(k)] = back
        every = _order(s)
        ids = s[every]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        self._move("e", ids[first], _sums(each, every, first), rate)

    def _move(self, k: str, at: slice | np.ndarray, g: np.ndarray, rate: float) -> None:
        m = self.m[k][at] + g * g
        self.m[k][at] = m
        np.sqrt(m, out=m)
        np.divide(g, m, out=m)
        m *= rate
        self.p[k][at] -= m


def _sums(x: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows x[order] from each `first` to the next: long runs by a product, short ones all together, row by row."""
    n = np.diff(first, append=len(order))
    out = x[order[first]]
    short = np.flatnonzero((n > 1) & (n < 16))
    for k in range(1, 16):
        short = short[n[short] > k]
        out[short] += x[order[first[short] + k]]
    for i in np.flatnonzero(n >= 16):
        rows = x[order[first[i] : first[i] + n[i]]]
        out[i] = np.ones(len(rows), x.dtype) @ rows
    return out


def _order(ids: np.ndarray) -> np.ndarray:
    """Stable order of token numbers; 16 bits, where they do, are sorted by radix."""
    return np.argsort(ids.astype(np.uint16) if len(ids) and int(ids.max()) < 1 << 16 else ids, kind="stable")


def _logits(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """h @ w + c, for h within -1..1. Where they may be so large that exp overflows, far beyond what training reaches, they are cut at 60."""
    z = h @ w
    z += c
    if float(np.abs(w).sum(0).max()) + float(c.max()) > 60:
        np.minimum(z, 60, out=z)
    return z


def _exps(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, and the sums of its rows."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    z /= _exps(z)[:, None]
    return z


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of one entry a row."""
    out = z[np.arange(len(at)), at].astype(np.float64)
    return out - np.log(_exps(z))


def fit(texts: DataFrame, words: Vocabulary, unigram: np.ndarray) -> Network:
    """Goes through all positions once; tasks start a round from the same parameters, and these are averaged by positions."""
    spark = ship(texts.sparkSession)
    net = Network(words.size, tail=words.tail)
    net.start(unigram)

    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((words, net))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, net = shared.value
            own = Network(net.v, tail=net.tail)
            own.load(net.flat())
            held, size, total = [], 0, 0
            for batch in batches:
                for ids in words.split([hashes(t) for t in batch.column(0).to_pylist()]) if batch.num_rows else []:
                    total += len(ids)
                    for a in range(0, len(ids), BATCH):  # a very long text is learnt in parts
                        held.append(ids[a : a + BATCH])
                        size += len(held[-1])
                        if size >= BATCH:
                            own.step(stream(held))
                            held, size = [], 0
            if size:
                own.step(stream(held))
            flat = own.flat() if total else np.empty(0, np.float32)
            for a in range(0, len(flat), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([a // PIECE], pa.int32()), pa.array([total], pa.int64()), pa.array([flat[a : a + PIECE].tobytes()], pa.binary())], ["piece", "n", "x"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for piece, n, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    x = np.frombuffer(x, np.float32) * float(n)
                    had = sums.get(piece)
                    sums[piece] = [x.astype(np.float64), n] if had is None else [had[0] + x, had[1] + n]
            for piece, (x, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([(x / n).astype(np.float32).tobytes()], pa.binary())], ["piece", "x"])

        part = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k)
        got = part.mapInArrow(learn, "piece int, n long, x binary").repartition("piece").sortWithinPartitions("piece", "n", "x").mapInArrow(average, "piece int, x binary")
        flat = net.flat()
        for r in got.toLocalIterator():
            x = np.frombuffer(bytes(r["x"]), np.float32)
            flat[r["piece"] * PIECE : r["piece"] * PIECE + len(x)] = x
        shared.unpersist()
        net.load(flat)
    return net


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over positions, natural logarithm), mean_log_likelihood, perplexity."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    counts = materialize(word_counts(texts))
    words = vocabulary(counts)
    known = spark.sparkContext.broadcast(words)

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.bincount(known.value.ids(np.asarray(batch.column(0))), batch.column(1), known.value.size)
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at].astype(np.int64))], ["token", "n"])

    unigram = np.zeros(words.size)
    for r in map_batches(counts, tokens, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        unigram[r["token"]] = r["n"]
    shared = spark.sparkContext.broadcast((words, fit(texts, words, unigram), np.log(np.maximum(unigram, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net, logs = shared.value
        lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
        for batch in batches:
            known = [hashes(t) for t in batch.column(1).to_pylist()]
            sizes, out, found, times = list(map(len, known)), [], [], []
            every = words.split(known) if known else []
            first = 0
            while first < len(known):  # texts together, so that a group of tokens meets many positions
                last, size = first, 0
                while last < len(known) and (last == first or size + sizes[last] <= 2 * BATCH):
                    size, last = size + sizes[last], last + 1
                ids = np.concatenate(every[first:last])
                got = net.logs(stream(every[first:last])) - np.where(words.rare(ids), logs[ids], 0.0)
                out += [float(x.sum()) for x in np.split(got, np.cumsum(sizes[first:last])[:-1])]
                first = last
            for h, ids in zip(known, every, strict=True):
                w, n = np.unique(h[words.rare(ids)], return_counts=True)
                found.append(w)
                times.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.float64()), lists(found), lists(times)], ["doc_id", "n_tokens", "log_likelihood", "words", "times"])

    # A rare word adds the logarithm of its count, from the counts of all documents.
    rows = materialize(texts.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, words array<long>, times array<long>").withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rare = each.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n").cast("double"))).alias("rare"))
    scored = rows.select("row", "doc_id", "n_tokens", "log_likelihood").join(rare, "row", "left")
    scored = scored.select("doc_id", "n_tokens", F.least(F.lit(0.0), F.col("log_likelihood") + F.coalesce("rare", F.lit(0.0))).alias("log_likelihood"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select("*", mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op9_masked_lm": op9_masked_lm}
SQL: dict[str, str] = {}
