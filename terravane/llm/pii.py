"""Personal data: base patterns, and further spans chosen by candidate gradient boosting.

Base spans follow fixed patterns and are always kept. High-recall generators propose further, overlapping
candidates (obfuscated addresses, other separators, missing plus signs, IPv6 and the like). Boosted trees
read each candidate's format and its context, an isotonic calibration turns their sum into a probability,
and a threshold for each kind, set on a calibration split for the wanted precision, selects spans. Chosen
spans overlap neither base spans nor each other (higher probability first, then the earlier and longer).

There are no labels for personal data; the trees are trained on EXAMPLES seeded synthetic contexts with
planted personal data and look-alikes (times, prices, versions, identifiers), a fixed bound.

Patterns run in linear time: runs of digits are entered at their start only, and an address is read from
its @ sign outwards. Overlaps are looked up by bisection, so that a text with many candidates takes little more.

Defined results: null text counts as empty and holds nothing; repeated rows get equal spans; rows with
null doc_id are read like any other; an empty table gives an empty result; `redact` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from terravane.llm.common import id_text, map_batches, map_rows, table, with_n_chars

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def _phones(text: str) -> list[Span]:
    """The pattern needs at least one character between the first and the last digit."""
    out, at, end = [], text.find("+"), 0
    while at >= 0:
        if at >= end and (m := _PHONE.match(text, at)) and m.end() - at >= 4:
            end = m.end()
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", at, end))
        at = text.find("+", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += _phones(text)
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


#: High-recall generators: every match is a candidate.
GENERATORS: list[tuple[str, re.Pattern[str]]] = [
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,})+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){2}[ ./_-]{1,3}[0-9]{1,7}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}[ ./_-]{1,3}[0-9]{6}[ ./_-]{1,3}[0-9]{5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ ./-]?)?\(?0?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])(?:00|0)[1-9][0-9]{7,12}(?![0-9])")),
]
CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "from", "login", "client"),
    "card": ("card", "visa", "master", "amex", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "numero"),
}
AGAINST = ("order", "version", "isbn", "invoice", "price", "total", "date", "time", "ref", "sku", "page", "$", "eur", "%")
FEATURES = 22
WINDOW = 32


class Taken:
    """Stretches of a text, joined where they overlap."""

    def __init__(self, spans: list[Span]) -> None:
        self.at: list[tuple[int, int]] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.at and a < self.at[-1][1]:
                self.at[-1] = (self.at[-1][0], max(b, self.at[-1][1]))
            else:
                self.at.append((a, b))

    def touches(self, span: Span) -> bool:
        k = bisect_left(self.at, (span[2], 0))  # the stretches from k on begin at its end or later
        return k > 0 and self.at[k - 1][1] > span[1]

    def add(self, span: Span) -> None:
        """A span that touches none."""
        insort(self.at, span[1:])


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Proposals of all generators that do not touch a base span; they may overlap one another."""
    lower_at = " at" in text or "at)" in text or "at]" in text or "at}" in text
    digits = _DIGIT.search(text) is not None
    out = []
    for kind, pattern in GENERATORS:
        if (lower_at if kind == "email" else digits or (kind == "ip" and ":" in text)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    taken = Taken(base)
    return [c for c in dict.fromkeys(out) if not taken.touches(c)]


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - WINDOW) : a].lower(), text[b : b + WINDOW].lower()
    digits = [c for c in s if "0" <= c <= "9"]
    groups = re.findall(r"[0-9]+", s)
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(set(seps)), float(bool(digits) and luhn("".join(digits))), float(s[:1] == "0"),
        float("(at)" in s or "[at]" in s or "{at}" in s), float("dot" in s), s.count(":"), s.count("."), float(any(c in before for c in CUES[kind])), float(any(c in after for c in CUES[kind])), float(any(c in before for c in AGAINST)),
        float(any(c in after[:8] for c in AGAINST)), float(all(int(g) <= 255 for g in groups if len(g) <= 4) and len(groups) == 4), float(bool(re.fullmatch(r"(19|20)[0-9]{2}", groups[0])) if groups else 0.0),
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, depth 3, exact splits on quantile cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 3) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 24))) for c in x.T]
        self.depth, self.rate = depth, rate
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        f, self.trees = np.full(len(y), self.start), []
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(codes, y - q, q * (1 - q), np.arange(len(y)), 0)
            self.trees.append(tree)
            f += self.rate * self._walk(tree, x)

    def _grow(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, level: int) -> tuple:
        gain, split = 1e-6, None
        total = g[at].sum() ** 2 / (h[at].sum() + 1)
        if level < self.depth and len(at) >= 20:
            for j in range(codes.shape[1]):
                n = len(self.cuts[j]) + 1
                gs, hs = (np.cumsum(np.bincount(codes[at, j], v[at], n))[:-1] for v in (g, h))
                score = gs**2 / (hs + 1) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1) - total
                if len(score) and score.max() > gain:
                    gain, split = score.max(), (j, int(score.argmax()))
        if split is None:
            return (g[at].sum() / (h[at].sum() + 1),)
        left = codes[at, split[0]] <= split[1]
        return (split[0], self.cuts[split[0]][split[1]], self._grow(codes, g, h, at[left], level + 1), self._grow(codes, g, h, at[~left], level + 1))

    def _walk(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the probabilities that rise with them."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []
    for v, t in zip(s[order], y[order], strict=True):
        blocks.append([v, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, t2, n2 = blocks.pop()
            blocks[-1][1] += t2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


EXAMPLES = 6000


def synthetic(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, Span, int]]:
    """(text, candidate, 1 for personal data): planted spans and look-alikes in invented words, with or without cue words."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    words = lambda: " ".join(word() for _ in range(rng.integers(2, 7)))

    def card(sep: str, shape: tuple[int, ...]) -> str:
        d = str(rng.integers(3, 7)) + num(sum(shape) - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        parts, at = [], 0
        for k in shape:
            parts.append(d[at : at + k])
            at += k
        return sep.join(parts)

    def good(kind: str) -> str:
        sep = str(rng.choice([" ", "-", ".", "/"]))
        if kind == "email":
            at, dot = [("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot ")][rng.integers(5)]
            return f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
        if kind == "ip":
            if rng.random() < 0.6:
                return ":".join(f"{x:x}" for x in rng.integers(16, 65536, 8))
            return str(rng.choice(["[.]", "(.)"])).join(map(str, rng.integers(1, 256, 4)))
        if kind == "card":
            return card(str(rng.choice([" - ", ".", "/", "_", "--", "  "])), [(4, 4, 4, 4), (4, 6, 5)][rng.integers(2)])
        return [f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)}{sep}{num(3)}{sep}{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{rng.integers(1, 99)} {num(3)} {num(3)} {num(4)}", f"0{rng.integers(1, 10)}{num(9)}"][rng.integers(5)]

    def bad(kind: str) -> str:
        if kind == "email":
            return f"{word()} at {word()}. {word()}"
        if kind == "ip":
            return ":".join(num(2) for _ in range(rng.integers(4, 6)))
        if kind == "card":
            return [f"{num(4)} {num(4)}  {num(4)} {num(3)}", num(13), f"{num(4)}-{num(4)}--{num(4)}-{num(2)}", f"{num(4)}/{num(4)}/{num(4)}/{num(4)}"][rng.integers(4)]
        return [f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}/{num(2)}/{num(4)}", f"0{rng.integers(1, 10)}{num(8)}", f"{num(3)}.{num(3)}.{num(3)}"][rng.integers(6)]

    out: list[tuple[str, Span, int]] = []
    while len(out) < n:
        kind, real = KINDS[rng.integers(4)], int(rng.random() < 0.5)
        cue = rng.random()
        lead = f"{rng.choice(CUES[kind])}{rng.choice([': ', ' ', ' is '])}" if (cue < 0.6 if real else cue < 0.05) else f"{rng.choice(AGAINST)} " if not real and cue < 0.6 else ""
        text = f"{words()} {lead}{good(kind) if real else bad(kind)} {words()}"
        a = text.index(lead) + len(lead) if lead else 0
        for c in candidates(text, base_spans(text)):
            if c[0] == kind and c[1] >= a:
                out.append((text, c, real))
                break
    return out


class Model:
    """Trees, calibration, and the threshold of each kind."""

    def __init__(self, precision: float = 0.98) -> None:
        rows = synthetic()
        x, y = np.array([describe(t, c) for t, c, _ in rows], float), np.array([r for *_, r in rows], float)
        half = np.arange(len(y)) % 2 == 0
        self.trees = Trees(x[half], y[half])
        self.at, self.p = isotonic(self.trees.margin(x[~half]), y[~half])
        p = self.probability(x[~half])
        self.threshold = {}
        for k, kind in enumerate(KINDS):
            own = x[~half][:, k] == 1
            levels = [t for t in np.unique(p[own]) if y[~half][own][p[own] >= t].mean() >= precision]
            self.threshold[kind] = max(0.9, float(min(levels, default=1.1)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.p[np.clip(np.searchsorted(self.at, self.trees.margin(x), side="right") - 1, 0, None)]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start, then kind."""
        base = base_spans(text)
        found = candidates(text, base)
        if not found:
            return base, base
        p = self.probability(np.array([describe(text, c) for c in found], float))
        picked: list[Span] = []
        taken = Taken([])
        for q, c in sorted(zip(p, found, strict=True), key=lambda v: (-v[0], v[1][1], -v[1][2], ORDER[v[1][0]])):
            if q >= self.threshold[c[0]] and not taken.touches(c):
                picked.append(c)
                taken.add(c)
        return base, sorted(base + picked, key=lambda s: (s[1], ORDER[s[0]]))


@cache
def model() -> Model:
    """Trained once in each Python worker, from the seed alone."""
    return Model()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end in code points), base or chosen."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def row(i: int | None, text: str) -> tuple:
        base, every = model().spans(text)
        fixed = set(base)
        return i, [{"kind": k, "start": a, "end": b, "base": (k, a, b) in fixed} for k, a, b in every]

    return map_rows(id_text(docs, id_col, text_col), row, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>", [pa.int64(), kind])


def redact_text(text: str, spans: list[Span]) -> str:
    """Every span becomes its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    merged: list[list] = []
    for k, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[end:a], f"[{k.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with all spans of its texts redacted; all columns and rows stay, n_chars follows."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(i) for i in range(batch.num_columns)]
        cols[at] = pa.array([t and redact_text(t, model().spans(t)[1]) for t in cols[at].to_pylist()], cols[at].type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return with_n_chars(map_batches(docs, run, docs.schema))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(i: int | None, text: str) -> tuple:
        base, every = model().spans(text)
        return (i, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every))

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return map_rows(id_text(table(spark, sf_dir, "documents")), row, schema, [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


QUERIES = {"op1_pii": op1_pii}
SQL: dict[str, str] = {}
