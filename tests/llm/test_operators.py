"""Text operators against SQL, brute force and round trips, on the small tables and on a table of edge cases."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF, same
from tokenizers import Tokenizer

import corpus_pipeline
from terravane.llm import byte_bpe, embedding_dedup, line_dedup, masked_lm, minhash, packing, pii, quality_ranker, quality_rules, registry, toxicity

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
BODY = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, BODY), (7, BODY.upper()), (8, BODY + " tail"), (9, LONG), (10, LONG + " end"),
    (11, "A repeated line here\nshort\nA REPEATED LINE HERE \nother words"), (12, "a repeated line here\n\nnot this one at all"), (13, "mail a.b@c-d.org, 4111 1111 1111 1111, +1 (555) 123-4567, 10.0.0.255 and 1.2.3.999"),
    (14, "naïve   café 中文 \U0001f600\x1c\x1f 'll"), (15, "# * $ % & | < >"), (16, "go go go " * 40),
]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """The documents of EDGE beside further columns whose names the operators use themselves, and a few labels and vectors."""
    folder = str(tmp_path_factory.mktemp("edge"))
    rows = [(i, t, "en", "web", None if t is None else len(t), "k", 1, "s") for i, t in EDGE]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, component int, sig string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (15, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, float("nan")]), (6, [1.0, 0.1]), (7, [0.0, 1.0]), (8, [])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def rows_of(spark, module, folder):
    (f,) = module.QUERIES.values()
    return [r.asDict() for r in f(spark, folder).collect()]


def texts_of(spark, folder):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("where", ["small", "edge"])
@pytest.mark.parametrize("module", [minhash, line_dedup])
def test_sql(spark, edge, module, where):
    folder = SF if where == "small" else edge
    (sql,) = module.SQL.values()
    same(rows_of(spark, module, folder), sql, folder)


def test_embeddings(spark, edge):
    same(rows_of(spark, embedding_dedup, SF), embedding_dedup.SQL["op4_embedding_dedup"], SF)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows_of(spark, embedding_dedup, edge)}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (2, 3, True), 4: (2, 3, False), 5: (0, 5, True), 6: (2, 3, False), 7: (0, 7, True), 8: (0, 8, True)}


@pytest.mark.parametrize("where", ["small", "edge"])
def test_byte_bpe(spark, edge, where):
    folder = SF if where == "small" else edge
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(spark, folder)
    for r in rows_of(spark, byte_bpe, folder):
        ids = t.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("where", ["small", "edge"])
def test_packing(spark, edge, where):
    folder = SF if where == "small" else edge
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = {}
    for i, text in texts_of(spark, folder).items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048): (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)}
    rows, bins = rows_of(spark, packing, folder), defaultdict(list)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(b))])
        assert [o for o, _ in sorted(b)] == ends[:-1].tolist() and ends[-1] <= 2048
    assert len(bins) <= 1.05 * sum(v[1] for v in want.values()) / 2048 + 1


@pytest.mark.parametrize("where", ["small", "edge"])
def test_quality_rules(spark, edge, where):
    folder = SF if where == "small" else edge
    texts = texts_of(spark, folder)
    for r in rows_of(spark, quality_rules, folder):
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[k] for k in quality_rules.COUNTS) == want
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@pytest.mark.parametrize("where", ["small", "edge"])
def test_pii(spark, edge, where):
    folder = SF if where == "small" else edge
    texts = texts_of(spark, folder)
    for r in rows_of(spark, pii, folder):
        base = [f"{k}:{a}:{b}" for k, a, b in plain_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


@pytest.mark.parametrize("module", [toxicity, quality_ranker, masked_lm])
def test_scores_of_edge_cases(spark, edge, module):
    rows = rows_of(spark, module, edge)
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in EDGE]
    by = {r["doc_id"]: {k: v for k, v in r.items() if k not in ("doc_id", "held_out")} for r in rows}
    assert by[1] == by[2]  # null counts as empty
    if module is not masked_lm:
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= module.CUT) for r in rows)


def test_masked_lm(spark):
    rng = np.random.default_rng(0)
    net = masked_lm.Network(60, tail=20)
    net.start(rng.integers(1, 50, 60).astype(float))
    texts = [rng.integers(1, 60, n) for n in (7, 1, 30, 0, 12)]
    before = net.logs(masked_lm.stream(texts)).sum()
    for _ in range(30):
        net.step(masked_lm.stream(texts))
    assert net.logs(masked_lm.stream(texts)).sum() > before
    sides = rng.integers(0, 60, (8, 4))
    every = net.between(np.repeat(sides, 60, axis=0), np.tile(np.arange(60), 8)).reshape(8, 60)
    assert np.allclose(np.exp(every).sum(1), 1, atol=1e-4)
    plain = [net.between(np.array([[t[k + d] if 0 <= k + d < len(t) else 0 for d in masked_lm.SIDES]]), t[k : k + 1])[0] for t in texts for k in range(len(t))]
    assert np.allclose(net.logs(masked_lm.stream(texts)), plain, atol=1e-5)
    rows, texts = rows_of(spark, masked_lm, SF), texts_of(spark, SF)
    assert all(r["n_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and r["log_likelihood"] <= 0 for r in rows)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in registry.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "PII", "best-fit packing"]
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    first = {r["doc_id"] for r in rows_of(spark, quality_rules, SF) if r["kept"]}
    assert kept and kept <= first


def test_blocks_of_a_hot_band(spark, monkeypatch):
    """The pairs of different components of a band are found, in blocks and past the leaders, whatever their numbers; what comes out joins what they join, and nothing else."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LEAD", 16)
    monkeypatch.setattr(minhash, "ESTIMATE", 0.0)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = {}
    for i in range(70):
        x = base.copy()
        x[rng.choice(60, int(rng.integers(0, 8)), replace=False)] = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
        sets[i] = np.unique(x)
    comp = {i: 0 if i % 7 else i for i in range(70)} | {69: 63, 0: 0}
    sigs = {i: (minhash.signature(s) & np.uint64(0xFFFF)).astype("<u2").tobytes() for i, s in sets.items()}
    rows = [(key, 1000 + i, i, comp[i], len(sets[i]), bytearray(sigs[i]), bytearray(sets[i].tobytes())) for key in (1, 2) for i in range(70) if key == 1 or i < 30]
    df = spark.createDataFrame(rows, "key long, no long, id long, component long, n long, sig binary, hashes binary")
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if comp[i] != comp[j] and minhash.similar(sets[i], sets[j])}
    got = {tuple(sorted((r["u"], r["v"]))) for r in minhash._blocks(df, minhash._linked, ("u", "v"), 80).collect()}
    assert got and got <= want and all(comp[a] != comp[b] for a, b in got)

    def merged(pairs):
        label = dict(comp)
        for _ in range(70):
            for a, b in pairs:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if c == hi else c for i, c in label.items()}
        return label

    assert merged(got) == merged(want)
    flagged = {r["no"] - 1000 for r in minhash._blocks(df, minhash._flagged, ("no", "id"), 80).collect()}
    assert {i for p in want for i in p} <= flagged


def test_masked_lm_of_rare_words(spark):
    """Every counted word has a probability of its own, and at a place they sum to 1."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"c{int(i)}" for i in rng.integers(0, 95, 40)) for _ in range(60)]
    rare = {f"r{i}": 1 + i % 2 for i in range(100)}  # fewer occurrences than any common word
    texts += [f"c1 {w} c2" for w, n in rare.items() for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert masked_lm.own_words(4_000_000) > masked_lm.own_words(40_000) >= masked_lm.LEAST_WORDS
    got = {r["doc_id"]: r["log_likelihood"] for r in masked_lm.score(docs).collect()}
    by = defaultdict(set)
    for i, t in enumerate(texts):
        if t.split()[1] in rare:
            by[t.split()[1]].add(round(got[i], 6))
    assert all(len(x) == 1 for x in by.values())
    # Words of one tail token differ by the logarithm of their counts: the neighbours' terms are equal.
    tail = defaultdict(lambda: defaultdict(list))
    words = masked_lm.vocabulary(masked_lm.word_counts(docs.select("text")))
    for w in rare:
        token = int(words.ids(masked_lm.hashes(w))[0])
        assert words.rare(np.array([token]))[0]
        tail[token][rare[w]].append(by[w])
    both = [x for x in tail.values() if len(x) == 2]
    assert both and all(abs(next(iter(x[2][0])) - next(iter(x[1][0])) - np.log(2)) < 1e-4 for x in both)
    net = masked_lm.Network(50)
    assert np.isclose(np.exp(net.between(np.tile([3, 0, 7, 9], (50, 1)), np.arange(50))).sum(), 1, atol=1e-4)


def hot_vectors(n=6000, dim=64, seed=8):
    """A third in one group of cosine about 0.995, the others in groups of four at about 0.957."""
    rng = np.random.default_rng(seed)
    near = lambda centre, size, cosine: centre + rng.normal(size=(size, dim)) / np.sqrt(dim) * np.sqrt(1 / cosine - 1)
    unit = lambda: (lambda c: c / np.linalg.norm(c))(rng.normal(size=dim))
    return np.concatenate([near(unit(), n // 3, 0.995), *(near(unit(), 4, 0.957) for _ in range(n // 6))])


def test_embedding_recall_beside_a_hot_group(spark):
    """Links of small groups are found, whatever share of all links one large group has."""
    x = hot_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= embedding_dedup.COSINE).sum(1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    share = np.array([got[i] / want[i] for i in range(len(x)) if want[i]])
    cold = np.array([got[i] / want[i] for i in range(len(x) // 3, len(x)) if want[i]])
    assert len(cold) > 1000 and share.max() <= 1 and cold.mean() >= 0.99 and share.mean() >= 0.99


def test_rare_toxic_token_is_a_candidate(spark, monkeypatch):
    """A word of some toxic texts and no clean one scores, however many words are in more toxic texts."""
    monkeypatch.setattr(toxicity, "TOKENS", 20, raising=False)
    common = [f"common{i:02d}x" for i in range(60)]
    texts = [(i, " ".join(common) + (" vileword" if i % 6 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in texts], "doc_id long, toxic int")
    scores = toxicity.fit(docs, labels).scores.known
    assert b"vileword" in scores and not any(w.encode() in scores for w in common)


def test_toxic_passage_of_words_used_before():
    """A dense passage is found though its words occurred earlier in the text."""
    model = toxicity.Model({b"bad": 3.0, b"vile": 2.5})
    text = "bad vile " * 3 + "calm " * 2000 + "bad vile " * 8
    found = [(a, b) for a, b, _ in model.passages(text)]
    assert found == [(0, 5), (2006, 2021)]
