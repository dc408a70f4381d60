"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes, distance-weighted votes.

The terms are all words of a bounded, documented sample of labelled rows; their document frequencies are counted over
all documents. A whole text is the vector of (1 + log tf) * idf * (PLAIN + mark) over its words, of length 1. `mark`
says how strongly the presence of a word marks a label in the sample: the phi coefficient, less what chance makes of
it (CHANCE off the chi-square); a word without one keeps the weight PLAIN, and a word that no example has counts in the
length of the text, with the largest idf. The sample's vectors are indexed by term in blocks of BLOCK examples that
resemble each other, each block of a term with its largest weight; the DENSE most frequent terms, whose postings are
most of all, are rows of a matrix instead, by which many texts are multiplied at once. For a text the blocks' bounds
are summed, from the largest product in the block on; the FIRST blocks with the highest bounds are scored, and then all
whose bound reaches the K-th best score so far, so the K nearest are exact (ties: the smaller doc_id). Each neighbour votes with 1 / (distance + SOFT), weighted so that the
sample's classes count as they do among all labels, and the score is the share of label 1 in the votes.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out, kept, labelled_sample, slices, texts

SAMPLE, BLOCK, FIRST, K, SOFT, PLAIN, CHANCE = 2500, 64, 2, 15, 0.05, 0.02, 10.0
#: Terms of the matrix, at most: those that BLOCK examples or more have, the most frequent first.
DENSE = 512
#: Texts that are looked up at once, and (term, block) cells and postings that are held for them.
QUERIES, CELLS, POSTINGS = 64, 1 << 19, 1 << 20
#: A-Z to small letters; ASCII signs other than letters and digits to spaces; bytes of other letters stay.
FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def marks(n_one: np.ndarray, n_zero: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """How strongly terms mark a label, 0 to 1, from the examples of either label that have them."""
    n = ones + zeros
    rest = n - n_one - n_zero
    cross = n_one * (zeros - n_zero) - n_zero * (ones - n_one)
    chi = np.divide(cross * cross * n, (n_one + n_zero) * rest * ones * zeros, out=np.zeros(len(rest)), where=(rest > 0) & (n_one + n_zero > 0) & (ones * zeros > 0))
    return np.sqrt(np.maximum(chi - CHANCE, 0) / max(1, n))


class Index:
    """Postings by term and block of examples, with the largest weight of each such cell; the most frequent terms stand
    in a matrix and have no postings."""

    def __init__(self, first: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int):
        """Example k has term[first[k]:first[k + 1]]; terms are below width."""
        self.n = len(first) - 1
        self.blocks = max(1, -(-self.n // BLOCK))
        example = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(first))
        frequent = np.bincount(term, minlength=width)
        # neighbours in the order have the same most frequent term (most often: the language) and the same heaviest one
        lead = [np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)]
        for k, value in enumerate((frequent, weight)):
            order = np.lexsort((value[term] if k == 0 else value, example))
            own = example[order]
            last = np.flatnonzero(np.append(own[1:] != own[:-1], True)) if len(order) else order
            lead[k][own[last]] = term[order[last]]
        self.example_at = np.lexsort((lead[1], lead[0]))
        place = np.empty(self.n, np.int32)
        place[self.example_at] = np.arange(self.n)
        at = place[example]
        del example
        dense = np.argsort(-frequent, kind="stable")[:DENSE]
        dense = dense[frequent[dense] >= BLOCK]
        self.dense_row = np.full(width, -1, np.int32)
        self.dense_row[dense] = np.arange(len(dense))
        some = np.flatnonzero(self.dense_row[term] >= 0)
        self.matrix = np.zeros((len(dense), self.blocks * BLOCK))
        self.matrix[self.dense_row[term[some]], at[some]] = weight[some]
        rest = np.flatnonzero(self.dense_row[term] < 0)
        order = rest[np.lexsort((at[rest], term[rest]))]
        del rest, some
        self.at, self.weight, term = at[order], weight[order], term[order]
        del order
        cell = term.astype(np.int64) * self.blocks + self.at // BLOCK
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        self.cell_block = (self.at[start] // BLOCK).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, start) if len(cell) else np.zeros(0)
        self.of_term = np.searchsorted(term[start], np.arange(width + 1))
        self.cell_start = np.append(start, len(cell))

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries (rows: query, term, weight; sorted by query) its k nearest examples with a common term
        and their cosines, the best first, ties by example."""
        size = self.of_term[term + 1] - self.of_term[term]
        cells, of, heft = ranges(self.of_term[term], size), np.repeat(query, size), np.repeat(weight, size)
        pair = of * self.blocks + self.cell_block[cells]
        frequent = np.flatnonzero(self.dense_row[term] >= 0)
        known = np.zeros((n, len(self.matrix)))
        known[query[frequent], self.dense_row[term[frequent]]] = weight[frequent]
        score = known @ self.matrix
        bound = score.reshape(n, self.blocks, BLOCK).max(axis=2) + np.bincount(pair, heft * self.cell_max[cells], n * self.blocks).reshape(n, self.blocks)
        ranked = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        chosen = np.zeros((n, self.blocks), bool)
        np.put_along_axis(chosen, ranked, True, axis=1)
        self.add(score, chosen, cells, of, pair, heft)
        best = np.take_along_axis(score.reshape(n, self.blocks, BLOCK), ranked[:, :, None], axis=1).reshape(n, -1)
        kth = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] >= k else np.zeros(n)
        self.add(score, (bound >= kth[:, None] - 1e-9) & (bound > 0) & ~chosen, cells, of, pair, heft)
        own = score[:, : self.n]
        least = np.partition(own, -k, axis=1)[:, -k] - 1e-9 if self.n > k else np.zeros(n)
        who, at = np.nonzero((own >= least[:, None]) & (own > 0))
        example, cosine = self.example_at[at], own[who, at]
        order = np.lexsort((example, -np.round(cosine, 9), who))
        example, cosine, cut = example[order], cosine[order], np.searchsorted(who, np.arange(n + 1)).tolist()
        return [(example[a : min(b, a + k)], cosine[a : min(b, a + k)]) for a, b in zip(cut, cut[1:], strict=False)]

    def add(self, score: np.ndarray, chosen: np.ndarray, cells: np.ndarray, of: np.ndarray, pair: np.ndarray, heft: np.ndarray) -> None:
        """Adds the products of the cells in the chosen (query, block) pairs to score (queries x places)."""
        some = np.flatnonzero(chosen.ravel()[pair])
        if not len(some):
            return
        cells, of, heft = cells[some], of[some], heft[some]
        start = self.cell_start[cells]
        size = self.cell_start[cells + 1] - start
        part = np.cumsum(size) // POSTINGS
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True):
            n, low, high = size[a:b], int(of[a]), int(of[b - 1]) + 1
            posting = ranges(start[a:b], n)
            flat = np.repeat((of[a:b] - low) * score.shape[1], n)
            flat += self.at[posting]
            value = np.repeat(heft[a:b], n)
            value *= self.weight[posting]
            del posting
            score[low:high] += np.bincount(flat, value, (high - low) * score.shape[1]).reshape(high - low, -1)


@dataclass
class Voter:
    """What a worker needs to score texts: terms and their weights, the examples' vectors and labels.

    Every task unpickles it, so the terms are one string, and arrays are narrow; a worker makes the rest once.
    """

    words: bytes  # the terms, with spaces between
    heft: np.ndarray  # idf * (PLAIN + mark) of each term
    rest: float  # of words that aren't terms
    first: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    y: np.ndarray
    votes: np.ndarray  # of each example's class
    ids: np.ndarray
    share: float
    name: str

    def prepared(self) -> tuple[Index, dict[bytes, int]]:
        """Index and terms, made once in a worker."""
        return kept(self.name, lambda: (Index(self.first, self.term, self.weight, len(self.heft)), places(self.words)))

    def scores(self, batch: list[str | None]) -> tuple[list[float], list[list[int]]]:
        """The share of weighted votes for label 1, and the doc_ids of the first three voters, of each text."""
        if len(np.unique(self.y)) < 2:
            return [self.share] * len(batch), [[] for _ in batch]
        index, place = self.prepared()
        shares, evidence = [], []
        vectors: list[tuple[np.ndarray, np.ndarray]] = []
        cells = 0

        def flush() -> None:
            nonlocal cells
            query = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
            term, weight = (np.concatenate([np.zeros(0, kind), *(v[k] for v in vectors)]) for k, kind in enumerate((np.int64, float)))
            for who, cosine in index.nearest(query, term, weight, len(vectors), K):
                vote = self.votes[who] / (1 - np.minimum(cosine, 1) + SOFT)
                shares.append(float((vote * self.y[who]).sum() / vote.sum()) if len(who) else self.share)
                evidence.append(self.ids[who[:3]].tolist())
            vectors.clear()
            cells = 0

        for text in batch:
            term, weight = vector(terms(text), place, self.heft, self.rest)
            own = int((index.of_term[term + 1] - index.of_term[term]).sum())
            if vectors and (len(vectors) == QUERIES or cells + own > CELLS):
                flush()
            vectors.append((term, weight))
            cells += own
        if vectors:
            flush()
        return shares, evidence


def places(words: bytes) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(words.split())}


def vector(words: list[bytes], place: dict[bytes, int], heft: np.ndarray, rest: float) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text, ascending, and their weights in its vector of length 1."""
    counts = Counter(words)
    ids = np.fromiter(map(place.get, counts, repeat(-1)), np.int64, len(counts))
    n = np.fromiter(counts.values(), np.int64, len(counts))
    others = n[ids < 0].astype(float)
    order = np.argsort(ids, kind="stable")[len(others) :]
    term, n = ids[order], n[order]
    weight = (1 + np.log(n)) * heft[term]
    length = np.sqrt((weight * weight).sum() + (((1 + np.log(others)) * rest) ** 2).sum())
    return term, weight / length if length else weight


def frequencies(docs: DataFrame, words: bytes) -> tuple[int, np.ndarray]:
    """The documents, and how many of them have each term; a task sends a row for each term that it met."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = kept(name, lambda: places(words))
        met, n = np.zeros(len(place) + 1, np.int64), 0
        for b in slices(batches):
            some = [i for text in b.column(0).to_pylist() for w in set(terms(text)) if (i := place.get(w)) is not None]
            met += np.bincount(np.array(some, np.int64), minlength=len(met))
            n += b.num_rows
        met[-1] = n
        some = np.flatnonzero(met)
        yield pa.record_batch({"term": pa.array(some, pa.int64()), "n": pa.array(met[some])})

    counted = texts(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(words.split()) + 1, np.int64)
    for r in counted.collect():  # at most a row for each term of the sample
        out[r["term"]] = r["n"]
    return int(out[-1]), out[:-1]


def voter(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE) -> Voter:
    """The index over at most per_class labelled rows of each class."""
    got = sorted(checkpointed(labelled_sample(docs, labels, label, per_class)).collect(), key=lambda r: r["doc_id"])
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out()).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("ones")).first()
    share = float((known["ones"] + 0.5) / (known["n"] + 2))
    y = np.array([r["label"] for r in got], float)
    words = sorted({w for r in got for w in terms(r["text"])})
    place = {w: i for i, w in enumerate(words)}
    joined = b" ".join(words)
    n, df = frequencies(docs, joined)
    have = [np.unique(np.array([place[w] for w in terms(r["text"])], np.int64)) for r in got]
    by_label = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(h for h, v in zip(have, y, strict=True) if v == k)]), minlength=len(words)).astype(float) for k in (1, 0)]
    mark = marks(*by_label, int(y.sum()), int(len(y) - y.sum()))
    heft = np.log(1 + n / (1 + df)) * (PLAIN + mark)
    rest = float(np.log(1 + n)) * PLAIN
    vectors = [vector(terms(r["text"]), place, heft, rest) for r in got]
    first = np.concatenate(([0], np.cumsum([len(t) for t, _ in vectors]))).astype(np.int64)
    term, weight = (np.concatenate([np.zeros(0, kind), *(v[k] for v in vectors)]) for k, kind in enumerate((np.int64, float)))
    classes = np.array([1 - share, share]) / np.maximum([len(y) - y.sum(), y.sum()], 1) * max(1, len(y))
    return Voter(joined, heft, rest, first, term.astype(np.int32), weight, y, classes[y.astype(int)], np.array([r["doc_id"] for r in got], np.int64), share, uuid.uuid4().hex)


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the nearest examples' doc_ids) for each row of docs.

    A text that shares no word with any example (null and empty ones among them) has no neighbour, and its score is the
    share of label 1 among all labels; so is every score without labelled rows of both classes (0.25 for no labels). A
    null doc_id is scored and not held out; repeated rows get equal scores. Very long texts are scored whole.
    """
    judge = voter(docs, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score, evidence = judge.scores(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(score, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "evidence")


def cleaned(docs: DataFrame, labels: DataFrame, label: str = "toxic", least: float = 0.5) -> DataFrame:
    """The rows of docs that score under `least`, with their columns; cases are those of scored().

    The score is a function of the text, so it is worked out in the row and no text is shuffled.
    """
    judge = voter(docs, labels, label)

    @F.arrow_udf("double")
    def toxic(part: pa.Array) -> pa.Array:
        return pa.array(judge.scores(part.to_pylist())[0], pa.float64())

    return docs.filter(toxic(F.col("text").cast("string")) < least)
