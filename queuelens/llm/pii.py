"""Personal data by candidate spans and gradient-boosted trees.

Base rules find emails, IP addresses, cards and phone numbers. High-recall
generators then propose overlapping spans (digit groups, addresses written out,
assigned or long random strings). Boosted trees score each span by format and
context, and thresholds calibrated per kind on all documents outside the
fitting sample select the redactions; of overlapping selections the best stays, and base spans always do.

The trees are fitted on a bounded sample of documents (in hash order of id and
text): SAMPLE_DOCS of all, and SAMPLE_KIND of those with a confirmed candidate
of each kind, so that rare kinds are in it. Of a kind all of whose confirmed
documents would be in the sample, every third stays outside. The calibration
counts labelled candidates per kind and score bin in Spark. Labels: a candidate is positive where a base rule or an
assignment to a secret-like name confirms it, and where a confirmed span is
rewritten to a spelling the base rules miss (without plus sign, with ``at`` and
``dot``, without quotes); other candidates are negative.

Defined cases: null text is empty and has no spans; rows with repeated or null
ids are scanned one by one; an empty table gives no rows (no model is needed);
a sample without positives selects nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import stored, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents of the training sample at most, and code points of each candidate's context.
SAMPLE_DOCS, CONTEXT = 3000, 24
#: Documents with a confirmed candidate that the training sample holds per kind at most.
SAMPLE_KIND = 300
#: Score bins of the calibration, each as wide as the next.
BINS = 10_000
#: Share of right selections that a threshold must reach on held-out documents.
PRECISION = 0.98

Span = tuple[str, int, int]
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each base rule, in linear time."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _RUN.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            runs = [(r.start() + m.start(), r.end() + m.start()) for r in _RUN.finditer(m.group())]
            for i in range(0, len(runs) - 3, 4):
                parts = [text[a:b].lstrip("0") or "0" for a, b in runs[i:i + 4]]
                if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                    out.append(("ip", runs[i][0], runs[i + 3][1]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# Generators: bounded repeats keep them linear.
_NUMBERS = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9]){6,21}(?![0-9A-Za-z])")
_WRITTEN = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\x20?(?:\(at\)|\[at\]|@|\x20at\x20)\x20?[\w-]{1,64}"
                      r"(?:\x20?(?:\(dot\)|\[dot\]|\.|\x20dot\x20)\x20?[\w-]{1,64}){1,5}", re.A)
_RANDOM = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,200}(?![A-Za-z0-9_+/=-])")
_ASSIGNED = re.compile(r"(?:token|secret|password|passwd|api_?key|key)[\x20\"']{0,2}[=:][\x20\"']{0,2}\Z", re.I)
_WORDS = ("phone", "tel", "call", "card", "mail", "ip", "token", "key", "secret", "password", "version", "date")


def candidates(text: str) -> list[Span]:
    """Proposed spans of every kind; they may overlap and are often wrong."""
    out: list[Span] = []
    if "@" in text or " dot " in text or "(dot)" in text or "[dot]" in text:
        out += [("email", *m.span()) for m in _WRITTEN.finditer(text)]
    if not _RUN.search(text):       # all other kinds hold a digit
        return out
    for m in _NUMBERS.finditer(text):
        digits = len(_DIGITS.sub("", m.group()))
        if digits >= 12:
            out.append(("card", *m.span()))
        if digits <= 15:
            out.append(("phone", *m.span()))
        if m.group().count(".") == 3:
            out.append(("ip", *m.span()))
    for m in _RANDOM.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            out.append(("secret", *m.span()))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span."""
    kind, start, end = span
    s = text[start:end]
    digits = _DIGITS.sub("", s)
    counts = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values())
    before = text[max(0, start - CONTEXT):start].lower()
    after = text[end:end + 4]
    parts = s.split(".")
    return [KINDS.index(kind), len(s), len(digits), sum(c.isalpha() for c in s), entropy, s.startswith("+"),
            "(" in s, s.count("-"), s.count(" "), s.count("."), "@" in s, luhn(digits) if digits else 0,
            len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts),
            bool(_ASSIGNED.search(before)), before[-1:].isalnum(), after[:1].isalnum(), after[:1] in ("\"", "'"),
            bool(re.fullmatch(r"[0-9a-fA-F]+", s)), sum(c.isupper() for c in s),
            *(w in before for w in _WORDS)]


class BoostedTrees:
    """Logistic gradient boosting of depth-2 trees on binned features."""

    def __init__(self, rounds: int = 60, rate: float = 0.2, bins: int = 24):
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            tree = self._grow(x, g, h, cuts, np.arange(len(y)), 2)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, g, h, cuts, rows, depth):
        def gain(a, b):
            return a * a / (b + 1.0)

        best, total = (1e-6, None, None), gain(g[rows].sum(), h[rows].sum())
        if depth:
            for f, edges in enumerate(cuts):
                at = np.searchsorted(edges, x[rows, f], side="left")
                left_g = np.cumsum(np.bincount(at, g[rows], len(edges) + 1))
                left_h = np.cumsum(np.bincount(at, h[rows], len(edges) + 1))
                value = (gain(left_g, left_h) + gain(left_g[-1] - left_g, left_h[-1] - left_h) - total)[:-1]
                if len(value) and value.max() > best[0]:
                    best = (value.max(), f, edges[int(value.argmax())])
        if best[1] is None:
            return self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        low = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, cuts, rows[low], depth - 1),
                self._grow(x, g, h, cuts, rows[~low], depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        low = x[:, tree[0]] <= tree[1]
        return np.where(low, self._apply(tree[2], x), self._apply(tree[3], x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for tree in self.trees:
            score += self._apply(tree, x)
        return 1 / (1 + np.exp(-score))


def _rewritten(text: str, span: Span) -> tuple[str, Span] | None:
    """The span in a spelling that base rules miss, with its context."""
    kind, start, end = span
    s = text[start:end]
    if kind == "phone":
        s = s.lstrip("+")
    elif kind == "email":
        s = s.replace("@", " at ").replace(".", " dot ")
    elif kind == "secret":
        s = s.strip("\"'")
    else:
        return None
    head, tail = text[max(0, start - 2 * CONTEXT):start], text[end:end + 8]
    return head + s + tail, (kind, len(head), len(head) + len(s))


def labelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, weak labels and the text number of all candidates."""
    x, y, of = [], [], []
    for i, text in enumerate(texts):
        base = {(k, a, b) for k, a, b in base_spans(text)}
        taken = [(a, b) for _, a, b in base]
        for span in candidates(text):
            kind, a, b = span
            if kind == "secret":
                good = bool(_ASSIGNED.search(text[max(0, a - CONTEXT):a]))
            else:
                good = span in base
            if not good and any(a < d and c < b for c, d in taken):
                if any(k == kind for k, c, d in base if a < d and c < b):
                    continue        # a part or a wider cut of a true span teaches nothing
            x.append(features(text, span))
            y.append(good)
            of.append(i)
            again = _rewritten(text, span) if good else None
            if again:
                x.append(features(*again))
                y.append(True)
                of.append(i)
    return np.array(x or np.empty((0, 1)), float), np.array(y, float), np.array(of, int)


class SpanModel:
    """Boosted trees with one calibrated threshold per kind."""

    def __init__(self, texts: list[str], calibrate: bool = True):
        x, y, of = labelled(texts)
        self.trees, self.thresholds = None, {k: 2.0 for k in range(len(KINDS))}
        fit = of % 3 > 0 if calibrate else np.ones(len(of), bool)   # every third text calibrates the thresholds
        if fit.any() and 0 < y[fit].sum() < fit.sum():
            self.trees = BoostedTrees().fit(x[fit], y[fit])
            if calibrate:
                held = ~fit
                p = self.trees.probability(x[held]) if held.any() else np.empty(0)
                for k in range(len(KINDS)):
                    mine = x[held, 0] == k
                    self.thresholds[k] = self._threshold(p[mine], y[held][mine])

    def calibrate(self, counts: list[tuple[int, int, int, int]]) -> None:
        """Thresholds from (kind, score bin, candidates, confirmed ones)."""
        for k in range(len(KINDS)):
            mine = sorted(((b, n, good) for kind, b, n, good in counts if kind == k), reverse=True)
            n, good = (np.cumsum([m[i] for m in mine]) for i in (1, 2))
            # Nothing confirmed of the kind, or no precise prefix: select nothing.
            precise = np.flatnonzero(good >= PRECISION * n) if mine and good[-1] else []
            self.thresholds[k] = max(0.5, mine[precise[-1]][0] / BINS) if len(precise) else 2.0

    @staticmethod
    def _threshold(p: np.ndarray, y: np.ndarray) -> float:
        """Smallest threshold of at least 0.5 from which on selections are right often enough."""
        if not len(p) or not y.any():
            return 2.0              # nothing of the kind was confirmed: select nothing
        order = np.argsort(-p, kind="stable")
        precise = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= PRECISION
        if not precise.any():
            return 2.0
        return max(0.5, float(p[order][np.flatnonzero(precise)[-1]]))

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the method adds to the base spans."""
        if self.trees is None:
            return []
        taken = [(a, b) for _, a, b in base]
        free = [s for s in candidates(text) if not any(s[1] < b and a < s[2] for a, b in taken)]
        if not free:
            return []
        x = np.array([features(text, s) for s in free], float)
        p = self.trees.probability(x)
        chosen: list[Span] = []
        for i in np.argsort(-p, kind="stable"):
            kind, a, b = free[i]
            if p[i] >= self.thresholds[KINDS.index(kind)] and not any(a < d and c < b for _, c, d in chosen):
                chosen.append(free[i])
        return chosen


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans merge."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at:max(a, at)], f"<{kind}>"] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def _scan_batches(model: SpanModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = base + model.select(text, base)
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(),
                            joined(spans), redact(text, spans)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                        *[pa.int64()] * 4, *[pa.string()] * 3), strict=True))],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    return run


def _confirmed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, text) -> place and kind of each document with confirmed candidates of a kind."""
    for batch in batches:
        x, y, of = labelled([t.as_py() or "" for t in batch.column(1)])
        pairs = sorted({(int(i), int(k)) for i, k in zip(of[y > 0], x[y > 0, 0], strict=True)}) if len(of) else []
        places = batch.column(0).take(pa.array([i for i, _ in pairs], pa.int64()))
        yield pa.RecordBatch.from_arrays([places, pa.array([k for _, k in pairs], pa.int32())], names=["place", "kind"])


def _score_batches(model: SpanModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            x, y, _ = labelled([t.as_py() or "" for t in batch.column(0)])
            if len(y):
                bins = (model.trees.probability(x) * BINS).astype(int)
                found.update(zip(x[:, 0].astype(int).tolist(), bins.tolist(), y.astype(int).tolist(), strict=True))
        rows = [(k, b, n, n * good) for (k, b, good), n in found.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
            names=["kind", "bin", "n", "good"])

    return run


def trained(docs: DataFrame) -> SpanModel:
    """The model of a table: trees from the sample, thresholds from all other documents."""
    # Rows in a hash range that holds a few more than SAMPLE_DOCS reach the driver;
    # repeated rows count once.
    place = F.xxhash64("doc_id", "text")
    placed = docs.select(place.alias("place"), "text")
    low = F.pmod("place", F.lit(1 << 30))
    share = min(1.0, 1.3 * SAMPLE_DOCS / max(1, docs.count()))
    drawn = placed.where(low < F.lit(int(share * (1 << 30)))).select("place").distinct().collect()
    drawn = sorted((r["place"] for r in drawn), key=lambda p: (p % (1 << 30), p))[:SAMPLE_DOCS]
    # Of each kind the SAMPLE_KIND first places, by partial sorted prefixes of the tasks.
    kinds = stored(placed.mapInArrow(_confirmed_batches, "place long, kind int").distinct(), "confirmed")
    sample = set(drawn[i] for i in range(len(drawn)) if i % 3)
    outside = set(drawn) - sample
    for k in range(len(KINDS)):
        first = [r["place"] for r in kinds.where(F.col("kind") == k).orderBy(low, "place").limit(SAMPLE_KIND).collect()]
        sample |= {p for i, p in enumerate(first) if i % 3} - outside
    inside = F.broadcast(docs.sparkSession.createDataFrame([(p,) for p in sorted(sample)], "place long"))
    texts = placed.join(inside, "place", "left_semi").distinct().collect()
    model = SpanModel([r["text"] or "" for r in sorted(texts, key=lambda r: (r["place"] % (1 << 30), r["place"]))], calibrate=False)
    if model.trees is not None:
        rest = placed.join(inside, "place", "left_anti").select("text")
        bins = rest.mapInArrow(_score_batches(model), "kind int, bin int, n long, good long")
        model.calibrate([tuple(r) for r in bins.groupBy("kind", "bin").agg(F.sum("n"), F.sum("good")).collect()])
    return model


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts and digest, all spans, the redacted text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan_batches(trained(docs)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                                         "base_sha256 string, spans string, redacted string")


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents")).drop("redacted")
