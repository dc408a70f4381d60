"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy arrays.

The statistics are counted over every whole text. Trees are grown on a bounded, documented sample of labelled rows
(SAMPLE of each class), by histograms and second-order gains of the logistic loss. On the features of MONOTONE a
larger value may only lower the score: a split whose children go the other way isn't made, and the children are
bounded by the middle of their values. The forest is flattened into arrays (feature, threshold, left, right,
value), which a batch of rows walks level by level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, collected, labelled_sample, slices, texts

SAMPLE, TREES, DEPTH, RATE, BINS, LEAST = 4000, 60, 3, 0.2, 32, 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "shouts", "bars", "lines", "distinct", "stops"]
#: -1: the more, the worse.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "shouts": -1}
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", b"#*$%&|<>"
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text; all 0 for one without words, but for symbols (there are none then either)."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen = Counter(line for line in raw.split(b"\n") if line.strip())
    lines = sum(seen.values())
    copies = lines - len(seen)
    ids: dict[bytes, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeats = 0
    if n >= 4:
        v = len(ids)
        pair = number[:-1] * v + number[1:]
        if v**3 < 1 << 62:
            key = pair[:-1] * v + number[2:]
        else:
            key = np.unique(pair, return_inverse=True)[1][:-1] * v + number[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            again = np.zeros(n - 2, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeats = int(covered.sum())
    w, c = max(1, n), max(1, chars)
    features = [
        np.log1p(n), chars / w, symbols / w, copies / max(1, lines), repeats / w, (len(raw) - len(raw.translate(None, CAPITALS))) / c,
        (len(raw) - len(raw.translate(None, DIGITS))) / c, raw.count(b"!") / w, raw.count(b"|") / w, lines / w, len(ids) / w, (raw.count(b".") + raw.count(b",")) / w,
    ]
    return [n, chars, symbols, copies, repeats], [float(x) for x in features]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS (long) and features (array<double>, as FEATURES) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [statistics(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.record_batch([b.column(0), *counts, pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["doc_id", *COUNTS, "features"])

    return texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


@dataclass
class Forest:
    """Node arrays; a leaf is its own child, so that DEPTH steps end in a leaf from anywhere."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grown(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Forest:
    """Boosted trees for y in {0, 1}. Without rows of both classes: no trees, and the (smoothed) share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) == 2:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]
        margin = np.full(len(y), base)

        def leaf(g: float, h: float, low: float, high: float) -> float:
            return float(np.clip(-g / (h + ridge), low, high))

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            value, me = leaf(g.sum(), h.sum(), low, high), len(nodes)
            nodes.append([0, 0.0, me, me, value * rate])
            if level == depth or len(rows) < 2 * LEAST:
                margin[rows] += value * rate
                return me
            best, cut = 1e-6, None
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[j][rows]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gr, hr, nr = g.sum() - gs, h.sum() - hs, len(rows) - ns
                vl, vr = np.clip(-gs / (hs + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                # the loss that bounded leaves save
                gain = -(gs * vl + 0.5 * (hs + ridge) * vl**2 + gr * vr + 0.5 * (hr + ridge) * vr**2) + (g.sum() * value + 0.5 * (h.sum() + ridge) * value**2)
                gain[(ns < LEAST) | (nr < LEAST) | (monotone[j] * (vr - vl) < 0)] = -1
                if gain.max() > best:
                    best, cut = gain.max(), (j, int(gain.argmax()), float(vl[gain.argmax()]), float(vr[gain.argmax()]))
            if cut is None:
                margin[rows] += value * rate
                return me
            j, k, vl, vr = cut
            mid, to_left = (vl + vr) / 2, binned[j][rows] <= k
            bounds = {0: ((low, high), (low, high)), -1: ((mid, high), (low, mid)), 1: ((low, mid), (mid, high))}[monotone[j]]
            nodes[me][:4] = [j, float(edges[j][k]), grow(rows[to_left], level + 1, *bounds[0]), grow(rows[~to_left], level + 1, *bounds[1])]
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = np.array(nodes or [[0, 0, 0, 0, 0]], float)
    return Forest(flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], np.array(roots, int), depth, base)


def trained(features: DataFrame, labels: DataFrame, docs: DataFrame, per_class: int = SAMPLE) -> Forest:
    """A forest from at most per_class labelled rows of each class. features: what measured() returned."""
    sample = labelled_sample(docs.withColumn("text", F.lit("")), labels, "quality", per_class).select("doc_id", "label")
    # of several rows with one doc_id those with the least features count
    rows = features.select("doc_id", "features").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features"))
    x, y = collected(rows, ["features", "label"])
    monotone = [MONOTONE.get(name, 0) for name in FEATURES]
    return grown(x.reshape(len(y), len(FEATURES)).astype(float), y.astype(float), monotone)


def judged(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept, for each row of docs.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept: neither that nor a
    score under `least`. Null and empty texts have no words and fail. Repeated rows are judged each; without usable
    labels the score is the smoothed share of good rows, 0.5, and only base_failed decides.
    """
    found = checkpointed(measured(docs))
    forest = trained(found, labels, docs, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            rest = [b.column(c) for c in ["doc_id", *COUNTS]]
            yield pa.record_batch([*rest, pa.array(forest.score(x))], names=["doc_id", *COUNTS, "score"])

    scored = found.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= least)).alias("kept"))
