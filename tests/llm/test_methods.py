"""The methods by themselves: against brute force, planted cases, exact sums and held-out rows; rows with odd ids; the pipeline by stage."""

from __future__ import annotations

import base64
import math
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from terravane.llm import byte_bpe, embedding_dedup, line_dedup, masked_lm, minhash, packing, pii, quality_ranker, quality_rules, toxicity
from terravane.llm.common import id_text

MID = "/root/testdata/sf0.01"
BODY = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
OTHER = " ".join(f"gamma{i} delta{i * 5 % 37}" for i in range(60))
ODD = [(None, BODY), (None, None), (6, BODY), (6, BODY), (6, OTHER), (7, BODY + " tail"), (8, "a line that is shared\nown"), (None, "a line that is shared\nelse"), (9, "a line that is shared"), (9, "a line that is shared\nmore")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows without ids and rows that share one, beside columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", None, None if t is None else len(t), "r", [b"x"], 1, "t") for i, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, suspects array<binary>, no int, token string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (None, 0, 1), (8, 0, 1), (6, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (4, None)]
    spark.createDataFrame([(i, v, "c", 0) for i, v in vectors], "vec_id long, embedding array<float>, cell string, n int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def rows_of(spark, module, folder):
    (f,) = module.QUERIES.values()
    return [r.asDict() for r in f(spark, folder).collect()]


@pytest.mark.parametrize("module", [pii, minhash, byte_bpe, packing, quality_rules, toxicity, line_dedup, masked_lm, quality_ranker])
def test_odd_ids(spark, odd, module):
    """Every row has its result, rows of one text equal ones."""
    rows = rows_of(spark, module, odd)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    if module is minhash:
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(None, None, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False)}
    elif module is line_dedup:
        assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] in (8, 9)) == [(8, 2, 0), (9, 1, 1), (9, 2, 1)]
        assert all(r["n_dropped"] == 0 for r in rows if r["doc_id"] is None)
    elif module is not packing:
        plain = [repr([float(f"{v:.6g}") if isinstance(v, float) else v for k, v in sorted(r.items())]) for r in rows if r["doc_id"] == 6]
        assert len(set(plain)) <= 2


def test_odd_vectors(spark, odd):
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows_of(spark, embedding_dedup, odd)]
    assert sorted(got, key=repr) == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)], key=repr)


# ---- byte-level BPE ---------------------------------------------------------------------------------

TRICKY = ["", "plain words", "naïve café 中文字 \U0001f600\U0001f9d1‍\U0001f680 x", "Ünï\n\n  ço∂é\t\t", "\U00012000\U00012001 odd", "don't stop 12345 ABC"]


def test_offsets_and_split_characters(spark):
    codec = byte_bpe.codec()
    shared = 0
    for text in TRICKY:
        ids, spans = codec.tokens(text)
        assert ids == codec.encode(text)
        at, data = 0, text.encode()
        where = [i for i, c in enumerate(text) for _ in c.encode()]
        for k, (a, b) in zip(ids, spans, strict=True):
            size = len(codec.bytes_of[k])
            assert codec.bytes_of[k] == data[at : at + size] and (a, b) == (where[at], where[at + size - 1] + 1)
            at += size
        assert at == len(data)
        shared += sum(p[1] > q[0] for p, q in zip(spans, spans[1:], strict=False))
    assert shared > 3  # characters that lie in several tokens
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    coded = byte_bpe.encode_documents(docs, offsets=True)
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) for r in coded.collect())
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(coded).collect()} == dict(enumerate(TRICKY))
    half = spark.createDataFrame([(1, codec.encode("\U00012000")[:1]), (2, None)], "doc_id long, ids array<long>")
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(half).collect()} == {1: "�", 2: ""}


def test_another_pattern():
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), r"[^\s]+|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(path, pattern)
    for text in TRICKY:
        assert codec.encode(text) == t.encode_ordinary(text)


def test_word_codec_by_the_library_alone():
    fast, plain = packing.WordCodec(), packing.WordCodec()
    plain.by_word = False
    t = Tokenizer.from_file(packing.WORDS)
    t.encode_special_tokens = True
    for text in TRICKY:
        assert fast.encode_bytes(text) == plain.encode_bytes(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# ---- quality rules ----------------------------------------------------------------------------------


def test_binomial_sums_are_exact():
    for n, k, p in ((7, 2, Fraction(1, 5)), (40, 0, Fraction(1, 50)), (150, 9, Fraction(3, 100)), (12, 12, Fraction(1, 2))):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality_rules.binomial_cdf(k, n, float(p)) - float(exact)) < 1e-12
    n = quality_rules.needed(0.02, 0.05)
    assert 0.98**n <= 0.05 < 0.98 ** (n - 1)
    bound = quality_rules.upper_bound(3, 200, 0.05)
    assert abs(quality_rules.binomial_cdf(3, 200, bound) - 0.05) < 1e-6


def test_strata_are_joined_until_each_can_certify():
    need = quality_rules.needed(0.02, 0.05 / 3)
    assert quality_rules.merged_strata([need, need, need], 0.02, 0.05) == [[0], [1], [2]]
    assert quality_rules.merged_strata([need, 3, need + 9], 0.02, 0.05) == [[0, 1], [2]]
    assert quality_rules.merged_strata([5, 5, 5], 0.02, 0.05) == [[0, 1, 2]]


def test_certified_cutoffs_keep_their_promise():
    """Over many samples from one population, the share of good texts rejected exceeds the risk in no more than the level of them; most bad texts go."""
    rng = np.random.default_rng(5)
    draw = lambda n: (np.minimum(64, rng.gamma(2.0, 6.0, (n, 3))).astype(int), rng.random(n) < 0.85)
    population = draw(40_000)[0]
    broken, certified, caught = 0, 0, []
    for _ in range(200):
        bins, good = draw(600)
        bad = np.flatnonzero(~good)
        bins[bad, 0] = np.minimum(64, bins[bad, 0] + 30)
        got = quality_rules.certify(bins, good, rng.random(600) < 0.5, 0.05, 0.05, 5.0)
        if got is None:
            continue
        certified += 1
        cuts, (n, k, bound) = got
        assert bound <= 0.05 + 1e-9 and k <= 0.05 * n
        out = np.zeros(len(population), bool)
        for j, c in cuts.items():
            out |= population[:, j] > c
        broken += out.mean() > 0.05
        caught.append(np.mean([any(bins[i, j] > c for j, c in cuts.items()) for i in bad]))
    assert certified > 100 and broken <= 0.05 * 200 + 8 and np.mean(caught) > 0.3


def test_rules_are_certified_on_few_labels(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_rules.cutoffs(id_text(docs), labels)
    assert any(own for _, own in found.strata) and all(bound <= quality_rules.RISK + 1e-9 for n, _, bound in found.shown if n)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in rows_of(spark, quality_rules, MID) if r["doc_id"] in truth and not r["base_failed"]]
    bad = [r["kept"] for r in rows if truth[r["doc_id"]] == 0]
    good = [r["kept"] for r in rows if truth[r["doc_id"]] == 1]
    assert len(bad) > 10 and np.mean(bad) <= 0.2 and np.mean(good) >= 0.98
    none = quality_rules.cutoffs(id_text(docs), labels.where("quality = 0"))
    assert not any(own for _, own in none.strata)


def test_cutoffs_use_every_label(spark):
    """More labelled texts than any bound of old; the aggregates give what certify() gives on the rows themselves."""
    rng = np.random.default_rng(21)
    n = 260_000
    words, symbols, digits, good = rng.integers(50, 2000, n), rng.integers(0, 40, n), rng.integers(0, 300, n), rng.random(n) < 0.8
    symbols[~good] += rng.integers(0, 4000, (~good).sum())
    zeros = dict.fromkeys(quality_rules.COUNTS + quality_rules.EXTRA, 0)
    cols = {"doc_id": np.arange(n), **{k: np.full(n, v) for k, v in zeros.items()}, "n_words": words, "word_chars": words * 5, "n_symbols": symbols, "n_digits": digits, "n_distinct": words // 2}
    counts, labels = spark.createDataFrame(pd.DataFrame(cols)), spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "quality": good.astype(int)}))
    found = quality_rules.fitted(counts, labels)
    rows = counts.select("doc_id", quality_rules.stratum().alias("s"), (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)) == 0).alias("h"), *quality_rules._bins()).toPandas().sort_values("doc_id")
    bins, s, h = rows[[f"b{j}" for j in range(len(quality_rules._rules()))]].to_numpy(), rows["s"].to_numpy(), rows["h"].to_numpy()
    tops, names = [x for _, x in quality_rules._rules().values()], list(quality_rules._rules())
    for k in range(3):
        cuts, shown = quality_rules.certify(bins[s == k], good[s == k], h[s == k], quality_rules.RISK, quality_rules.DELTA / 3, quality_rules.COST)
        assert found.shown[k] == shown and found.strata[k][1] == {names[j]: c * tops[j] / quality_rules.GRID for j, c in cuts.items()}
    assert sum(x[0] for x in found.shown) == int((good & h).sum()) > 100_000


# ---- toxicity and quality ---------------------------------------------------------------------------


def plain_segments(scores):
    """The definition: the best stretch, then the same on either side of it."""

    def inside(lo, hi):
        sums = np.concatenate([[0.0], np.cumsum(scores[lo:hi])])
        best, at = 1e-12, None
        for a in range(hi - lo):
            for b in range(a + 1, hi - lo + 1):
                if sums[b] - sums[a] > best + 1e-12:
                    best, at = sums[b] - sums[a], (lo + a, lo + b)
        return [] if at is None else inside(lo, at[0]) + [(at[0], at[1] - 1, round(best, 9))] + inside(at[1], hi)

    return inside(0, len(scores))


def test_segments_are_those_of_the_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 28))
        at = np.flatnonzero(rng.random(n) < 0.4)
        s = np.round(rng.random(len(at)) * 1.3 + 0.1001, 4)
        scores = np.full(n, toxicity.MISS)
        scores[at] = s
        got = [(a, b, round(x, 9)) for a, b, x in toxicity.segments(list(zip(at.tolist(), s.tolist(), strict=True)))]
        assert got == plain_segments(scores)


def test_lambda_and_chance():
    s, n = np.array([0.0, 2.0, 3.0]), np.array([900.0, 20.0, 5.0])
    lam = toxicity.solve_lambda(s, n)
    p = n / n.sum()
    assert abs(p[0] * math.exp(lam * toxicity.MISS) + p[1] * math.exp(2 * lam) + p[2] * math.exp(3 * lam) - 1) < 1e-6
    for yt, yc, share in ((5, 0, 0.1), (7, 3, 0.2), (30, 40, 0.25)):
        tail = sum(math.comb(yt + yc, i) * share**i * (1 - share) ** (yt + yc - i) for i in range(yt, yt + yc + 1))
        assert tail <= toxicity.chance(yt, yc, share) * (1 + 1e-9) and toxicity.chance(yt, yc, share) <= 1
    assert toxicity.chance(1, 9, 0.2) == 1.0


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    values, first, n = np.unique(np.asarray(s)[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (n + 1) / 2, n)
    pos = y.sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality_ranker, "quality", 0.95)])
def test_held_out_power(spark, module, label, least):
    """Held-out rows: ranking, recall and false positives, all out of reach for a constant answer."""
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = [r for r in rows_of(spark, module, MID) if r["held_out"] and r["doc_id"] in truth]
    y, p = np.array([truth[r["doc_id"]] for r in rows]), np.array([r["predicted"] for r in rows])
    assert 0 < y.sum() < len(y) and auc(y, np.array([r["score"] for r in rows])) >= least
    assert p[y == 1].mean() >= 0.7 and p[y == 0].mean() <= 0.1


# ---- masked pseudo-likelihood -----------------------------------------------------------------------


def test_pseudo_likelihood_by_brute_force(spark):
    """Sums of log-probabilities, each from softmaxes over all groups and all tokens of a group, written out."""
    rng = np.random.default_rng(1)
    texts = ["", None, "one"] + [" ".join(f"w{int(i)}" for i in rng.integers(0, 140, 30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in masked_lm.score(docs).collect()}
    words_in = {i: (t or "").split() for i, t in enumerate(texts)}
    n = Counter(w for ws in words_in.values() for w in ws)
    counts = masked_lm.word_counts(id_text(docs))
    assert {r["word"]: r["n"] for r in counts.collect()} == {masked_lm.hash_of(w.encode()): k for w, k in n.items()}
    words = masked_lm.vocabulary(counts)
    token = {w: int(words.ids(np.array([masked_lm.hash_of(w.encode())]))[0]) for w in n}
    unigram = np.zeros(words.size)
    for w, k in n.items():
        unigram[token[w]] += k
    net = masked_lm.fit(id_text(docs), words, unigram)
    p = {k: v.astype(float) for k, v in net.p.items()}
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, ws in words_in.items():
        ids = [token[w] for w in ws]
        total = 0.0
        for k, (w, t) in enumerate(zip(ws, ids, strict=True)):
            sides = [ids[k + d] if 0 <= k + d < len(ids) else 0 for d in (-2, -1, 1, 2)]
            h = np.tanh(p["b"] + sum(p["e"][s][place * net.width : (place + 1) * net.width] for place, s in enumerate(sides)))
            g, j = divmod(t, net.each)
            total += math.log(soft(h @ p["w"] + p["c"])[g]) + math.log(soft(h @ p["u"][g] + p["d"][g])[j])
            if t > len(words.words):
                total += math.log(n[w] / unigram[t])
        assert got[i]["n_tokens"] == len(ws) and abs(got[i]["log_likelihood"] - min(0.0, total)) < 1e-3 * max(1.0, -total)
        assert (got[i]["mean_log_likelihood"] is None) == (not ws)


def test_both_sides_help(spark):
    """On a language where the neighbours tell the word, the network is far better than word shares."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{(a + k) % 50}" for k in range(60)) for a in rng.integers(0, 50, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = masked_lm.score(docs).selectExpr("sum(log_likelihood) / sum(n_tokens) AS m").first()
    assert r["m"] > math.log(1 / 50) + 1.0


# ---- personal data ----------------------------------------------------------------------------------

#: Written for this test, not by the generator of the training set.
PERSONAL = [
    ("email", "please write to maria.lopez (at) posteo (dot) de before friday"), ("email", "contact: j_smith[at]example[dot]org"), ("email", "mail bob at example dot com today"),
    ("ip", "login from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 was refused"), ("ip", "host 10[.]0[.]3[.]77 is down"),
    ("card", "visa 4111/1111/1111/1111 exp 04"), ("card", "card 5500.0000.0000.0004 please"), ("phone", "call (415) 555-0132 after six"), ("phone", "tel: 030 1234 5678 90"), ("phone", "mobile 0171 2345 6789"),
]
HARMLESS = ["the meeting at noon. bring notes", "version 10.4.2.1288 of the order 2024-11-03", "page 12 of 340, total 1.299,00 EUR", "from 10:30 to 11:45 on 03/04/2021", "isbn 978 3 16 148410 0", "ratio 16:9:4:3:2 in the table", "invoice 4000 1234 99 paid"]


def test_added_spans():
    m = pii.Model()
    found = [any(s[0] == kind and s not in base for s in every) for kind, (base, every) in ((k, m.spans(t)) for k, t in PERSONAL)]
    assert np.mean(found) >= 0.7
    assert np.mean([len(m.spans(t)[1]) for t in HARMLESS]) <= 0.3
    fresh = pii.synthetic(1500, seed=99)
    p = m.probability(np.array([pii.describe(t, c) for t, c, _ in fresh], float))
    chosen = np.array([q >= m.threshold[c[0]] for q, (_, c, _) in zip(p, fresh, strict=True)])
    real = np.array([r for *_, r in fresh])
    assert real[chosen].mean() >= 0.95 and chosen[real == 1].mean() >= 0.5


def test_trees_isotonic_and_overlaps():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((pii.Trees(x, y).margin(x) > 0) == y).mean() > 0.95
    at, p = pii.isotonic(x[:, 0], y)
    assert (np.diff(at) > 0).all() and (np.diff(p) > 0).all()
    order = np.argsort(x[:, 0])
    blocks = np.searchsorted(at, x[order, 0], side="right") - 1
    assert np.allclose([y[order][blocks == k].mean() for k in range(len(p))], p)
    for _ in range(50):
        spans = [("ip", int(a), int(a + n)) for a, n in zip(rng.integers(0, 200, 12), rng.integers(1, 9, 12), strict=True)]
        taken = pii.Taken(spans)
        for a in range(0, 210, 3):
            c = ("ip", a, a + 4)
            assert taken.touches(c) == any(c[1] < s[2] and s[1] < c[2] for s in spans)


def test_many_candidates_take_linear_time():
    m = pii.model()
    text = " ".join(f"(0{i % 900 + 100}) {i % 900 + 100}-{i % 9000 + 1000} mail a{i}@b.co" for i in range(20_000))
    began = time.perf_counter()
    assert len(m.spans(text)[1]) >= 20_000
    assert time.perf_counter() - began < 60


def test_redaction():
    text = "mail a.b@c.org or +1 (555) 123-4567, ip 10.0.0.1."
    assert pii.redact_text(text, pii.Model().spans(text)[1]) == "mail [EMAIL] or [PHONE], ip [IP]."


# ---- near duplicates --------------------------------------------------------------------------------


def joined_ids(links, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_minhash_of_rows_that_share_ids(spark):
    rows = [(3, BODY), (5, BODY + " tail"), (5, OTHER), (7, OTHER + " end"), (9, OTHER)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 3, False)}


def test_minhash_near_the_threshold(spark, monkeypatch):
    """Families whose members are about 0.8 alike, beside chains of them; blocks and leaders so small that every path is taken."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LEAD", 8)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rng = np.random.default_rng(6)
    texts = {}
    for family in range(12):
        words = [f"f{family}w{i}" for i in range(120)]
        for k in range(14):
            words = list(words) if k % 3 else [f"f{family}w{i}" for i in range(120)]
            for at in rng.choice(len(words), int(rng.integers(0, 4)), replace=False):
                words[at] = f"x{family}_{k}_{at}"
            texts[len(texts) * 3 + 1] = " ".join(words)
    sets = {i: minhash.shingles(t, 5) for i, t in texts.items()}
    links = [(i, j) for i in sets for j in sets if i < j and minhash.similar(sets[i], sets[j])]
    want = joined_ids(links, list(sets))
    rows = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and 12 <= len(set(want.values())) < len(want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            b = a.copy()
            k = round(400 * (1 - share) / (1 + share))
            b[:k] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
            x, y = (minhash.signature(s) & np.uint64(0xFFFF) for s in (a, b))
            errors.append((x == y).mean() - (400 - k) / (400 + k))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_planted_links_are_at_the_least_cosine():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = embedding_dedup.planted(x, 0.95, rng)
    assert np.allclose((x * y).sum(1), 0.95) and np.allclose(np.linalg.norm(y, axis=1), 1)


def test_recall_of_links_at_the_threshold(spark):
    """Pairs just above the least cosine, alone among unlike vectors: no link tells the calibration of them."""
    rng = np.random.default_rng(21)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = embedding_dedup.planted(x[:1000], 0.9501, rng)
    both = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    found = sum(got[3000 + i][1] == i for i in range(1000))
    assert found >= 995 and sum(n for n, _ in got.values()) == 2 * found


def test_embedding_links_and_components_by_brute_force(spark):
    """All links of planted groups, at both ends, and components; repeated, opposite and scaled vectors among them."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 32))
    near = np.repeat(base[:90], 6, axis=0) + rng.normal(size=(540, 32)) * 0.17
    x = np.concatenate([base, near, -base[:5], 3 * base[:10], base[20:40]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= embedding_dedup.COSINE
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = embedding_dedup.near_duplicates(df).collect()
    got = {r["vec_id"]: r["n_links"] for r in rows}
    found, want = sum(got.values()), int(link.sum())
    assert want > 300 and want >= found >= 0.98 * want and found % 2 == 0
    if found == want:
        assert {r["vec_id"]: r["component_id"] for r in rows} == joined_ids(np.argwhere(link).tolist(), range(len(x)))


# ---- lines and pipeline -----------------------------------------------------------------------------


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want = sorted(map(repr, rows_of(spark, line_dedup, folder)))
    monkeypatch.setattr(line_dedup, "MIN_BITS", 1 << 16)
    monkeypatch.setattr(line_dedup, "filter_bits", lambda chars: 1 << 16)
    monkeypatch.setattr(line_dedup, "positions", lambda hashes, bits: np.zeros((line_dedup.HASHES, len(hashes)), np.int64))
    assert sorted(map(repr, rows_of(spark, line_dedup, folder))) == want


def test_emptied_documents(spark):
    rows = [(1, "one whole line here\nand another one"), (2, "One whole line here \n\n"), (3, ""), (4, None), (5, "short\none whole line here")]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars int")
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert kept == {1: (rows[0][1], len(rows[0][1])), 2: ("\n", 1), 3: ("", 0), 4: (None, None), 5: ("short", 5)}
    assert {r["doc_id"] for r in line_dedup.drop_repeated_lines(docs, emptied=False).collect()} == {1, 3, 4, 5}


def test_pipeline_by_stage(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{MID}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    out, texts = {}, {}
    for name in list(stages)[:4]:
        before, docs = docs, stages[name](spark, docs, MID).cache()
        assert docs.schema == before.schema
        out[name] = docs
        texts[name] = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good, lines, near, clean = (texts[n] for n in list(stages)[:4])
    seen: dict[str, int] = {}
    want = {}
    for i in sorted(good):
        kept = []
        for line, key in zip(good[i].split("\n"), line_dedup.keys_of(good[i]), strict=True):
            if key is None or seen.setdefault(key, i) == i:
                kept.append(line)
        want[i] = "\n".join(kept)
    assert lines == {i: t for i, t in want.items() if t.strip() or not good[i].strip()} and len(lines) < len(good)
    assert all(t.strip() for t in lines.values())  # nothing empty reaches the packing
    sets = {i: minhash.shingles(t, 5) for i, t in lines.items()}
    by_size = sorted(sets, key=lambda i: len(sets[i]))
    links = []
    for k, i in enumerate(by_size):
        for j in by_size[k + 1 :]:
            if 100 * len(sets[i]) < 80 * len(sets[j]):
                break
            if minhash.similar(sets[i], sets[j]):
                links.append((i, j))
    group = joined_ids(links, list(sets))
    assert near == {i: lines[i] for i in lines if group[i] == i}
    assert clean == {i: pii.redact_text(t, pii.model().spans(t)[1]) for i, t in near.items()}
    packed = stages["best-fit packing"](spark, out["PII"], MID).collect()
    assert {r["doc_id"] for r in packed} == set(clean)


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    assert corpus_pipeline.run(spark, odd).count() >= 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
