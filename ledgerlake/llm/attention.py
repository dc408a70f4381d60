"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words, all of them, however many. A passage is encoded by how often each
pair of neighbouring character classes occurs (square roots of shares), its length and its share of distinct words.
From labels of documents alone the network learns an embedding of passages, gated attention weights
(softmax of w'(tanh(Vh) * sigmoid(Uh))) and a logistic output on the attention-weighted embedding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, slices, texts
from .tokens import Words

PASSAGE, SAMPLE, HIDDEN, GATE, EPOCHS = 64, 1500, 24, 12, 150
#: Characters of labelled texts of a class that the network is learnt from.
CHARS = 8_000_000
#: Classes of bytes: other signs are 0; white space, line ends, small and large letters, digits, bytes of other letters, and some signs by themselves.
CLASSES = [" \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", None, ".", ",", "!", "|", "#*$%&<>"]
KINDS = len(CLASSES) + 1
WIDTH = KINDS * KINDS + 2


def class_table() -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[128:] = CLASSES.index(None) + 1
    for k, chars in enumerate(CLASSES):
        t[[ord(c) for c in chars or ""]] = k + 1
    return t


TABLE = class_table()


def encoded(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of the texts, and the text of each; a text without words is one passage."""
    raw = [t.encode() + b"\n" for t in batch]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    kind = TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    text = np.repeat(np.arange(len(raw)), lengths)
    solid = (kind == 0) | (kind > 2)
    begins = solid & np.concatenate(([True], ~solid[:-1]))
    words = np.cumsum(begins)
    at = np.concatenate(([0], np.cumsum(lengths)))
    before = np.where(at[:-1] > 0, words[at[:-1] - 1], 0)
    count = words[at[1:] - 1] - before
    bags = np.maximum(1, -(-count // PASSAGE))
    base = np.concatenate(([0], np.cumsum(bags)[:-1]))
    passage = base[text] + np.maximum(0, words - before[text] - 1) // PASSAGE
    n = int(bags.sum())
    pair = passage[:-1] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:]
    x = np.zeros((n, WIDTH))
    x[:, :-2] = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
    x[:, :-2] /= np.maximum(1, x[:, :-2].sum(axis=1, keepdims=True))
    np.sqrt(x, out=x)
    own = Words(raw)
    where = passage[np.flatnonzero(begins)]
    size = np.bincount(where, minlength=n)
    if len(where):
        order = np.lexsort((h := own.hashes(own.starts, own.ends), where))
        fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (where[order][1:] != where[order][:-1])))
        x[:, -1] = np.bincount(where[order], fresh, n) / np.maximum(1, size)
    x[:, -2] = size / PASSAGE
    return x, np.repeat(np.arange(len(raw)), bags)


@dataclass
class Network:
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """bag: the bag of each passage, in order, 0 to n-1."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (t * s) @ p["w"]
        start = np.searchsorted(bag, np.arange(n))
        e = np.exp(raw - np.maximum.reduceat(raw, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def score(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return self.forward(x, bag, n)["y"]


def fitted(x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5, epochs: int = EPOCHS, rate: float = 0.02, ridge: float = 1e-4) -> Network:
    """Full-batch Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    net = Network({k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()})
    p, m, v, n = net.p, {k: 0.0 for k in shape}, {k: 0.0 for k in shape}, len(y)
    for step in range(1, epochs + 1):
        f = net.forward(x, bag, n)
        dy = (f["y"] - y) * weight / weight.sum()
        dz = dy[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        start = np.searchsorted(bag, np.arange(n))
        draw = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[bag])
        dgate = draw[:, None] * p["w"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        grad = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ draw, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
        for k in p:
            g = grad[k] + ridge * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE) -> tuple[Network | None, float]:
    """The network from at most per_class labelled rows of each class, with CHARS characters (some 100 MB of encodings on
    the driver at most), and the share of label 1 among all labels
    outside the held-out fold, to which the classes are weighted; no network if a class is missing."""
    sample = labelled_sample(docs, labels, label, per_class, CHARS).select("doc_id", "text", "label")
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("ones")).first()
    share = (known["ones"] + 1) / (known["n"] + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, bag = encoded(b.column(1).to_pylist())
            rows = [x[bag == k].astype("<f4").tobytes() for k in range(b.num_rows)]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.binary()), b.column(2)], names=["doc_id", "x", "label"])

    got = sorted(sample.mapInArrow(run, "doc_id long, x binary, label int").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in got], float)
    if len(np.unique(y)) < 2:
        return None, float(share)
    bags = [np.frombuffer(r["x"], "<f4").astype(float).reshape(-1, WIDTH) for r in got]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return fitted(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y, weight), float(share)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages for each row of docs.

    Every passage of every text counts; a null or empty text is one empty passage. Without rows of both classes
    the score is the smoothed share of label 1. A null doc_id is scored, and not held out. Repeated rows get equal
    scores.
    """
    net, share = trained(docs, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, bag = encoded(b.column(1).to_pylist())
            y = net.score(x, bag, b.num_rows) if net else np.full(b.num_rows, share)
            yield pa.record_batch([b.column(0), pa.array(y), pa.array(np.bincount(bag, minlength=b.num_rows))], names=["doc_id", "score", "n_passages"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double, n_passages long")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "n_passages")
