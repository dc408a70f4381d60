"""SimHash near-duplicates: 64-bit fingerprints linked within a Hamming radius by BK-trees.

A fingerprint is looked up only in the shards where it can have partners: the 64 bits are cut into `bands` bands,
and a shard holds the fingerprints that agree on one choice of `bands - radius` bands. Two fingerprints within the
radius differ in at most `radius` bands, so they meet in at least one shard: no link is lost. Each shard has a
BK-tree (children keyed by their integer distance to the parent), and a look-up follows only the edges within the
radius of the distance at hand, and only subtrees that aren't all linked to it already. A whole corpus of trees has no
bound on its size, so trees aren't broadcast: they are built where the shard's rows meet, many at once, as flat numpy
arrays level by level, and shards that grow too large are cut by further bands.

Results grow with the documents: a shard yields one edge for each fingerprint that has a partner (to the root of
its group there), and equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, every, identified, release, slices, small_side, texts
from .passages import AGREE, SAMPLED, candidates, common_tokens_of, found_links, held_in, streamed
from .tokens import Words, mixed

RADIUS, BANDS, SEED = 4, 6, 42
#: Words of a piece, on average, and how many pieces of a text are compared: those with the least SimHashes, mixed.
PIECE, SKETCH = 8, 12
#: How many of the texts before it a text is compared with, among those with an equal piece, and in how many rounds more.
WIDTH, FURTHER = 8, 1
#: Pairs of look-up and node that are held at once.
FRONTIER = 1 << 16
#: Fingerprints after which a task works through its whole shards so far, those of a shard that is dealt anew in finer
#: ones, and how often.
SHARD_ROWS, LARGE, FINER = 100_000, 20_000, 3


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """Signed 64-bit SimHash. Words of the text, A-Z lower-cased; its shingles (repeats count) or, if it has fewer
    words, the whole sequence; a bit is set if it is in over half the hashes. No words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_column(column: F.Column, shingle: int, seed: int = SEED) -> F.Column:
    @F.pandas_udf("long")
    def run(part: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in part], dtype="int64")

    return run(column)


class Forest:
    """BK-trees over several shards of distinct fingerprints; the first of each shard is its root."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values, n = values, len(values)
        first = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        here, at, keys, children = np.flatnonzero(~first), self.root[~first], [], []
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # children and their parents, from the roots down
        while len(here):
            edge = at * 65 + np.bitwise_count(values[here] ^ values[at]).astype(np.int64)
            key, lead, group = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(here[lead])
            self.levels.append((here[lead], at[lead]))
            rest = np.ones(len(here), bool)
            rest[lead] = False
            here, at = here[rest], here[lead][group[rest]]
        keys, children = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *children])
        order = np.argsort(keys, kind="stable")
        self.keys, self.children = keys[order], children[order]

    def within(self, radius: int, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (look-up, found) within the radius, some at a time.

        known: for each value its group so far, which the reader changes as pairs come. A look-up then leaves out the
        subtrees that lie wholly in its own group, so values that are all close to each other cost little once they
        are known to be linked.
        """
        step = max(1, FRONTIER // 16)
        for i in range(0, len(self.values), step):
            if known is not None:
                low_group, high_group = known.copy(), known.copy()
                for child, parent in reversed(self.levels):
                    np.minimum.at(low_group, parent, low_group[child])
                    np.maximum.at(high_group, parent, high_group[child])
            stack = [(np.arange(i, min(i + step, len(self.values))), self.root[i : i + step])]
            while stack:
                who, node = stack.pop()
                if known is not None:
                    mixed_tree = (low_group[node] != high_group[node]) | (known[low_group[node]] != known[who])
                    who, node = who[mixed_tree], node[mixed_tree]
                if len(who) > FRONTIER:
                    half = len(who) // 2
                    stack += [(who[:half], node[:half]), (who[half:], node[half:])]
                    continue
                far = np.bitwise_count(self.values[who] ^ self.values[node]).astype(np.int64)
                hit = (far <= radius) & (who != node)
                if hit.any():
                    yield who[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0), "left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), "right")
                count = high - low
                if count.any():
                    start = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
                    stack.append((np.repeat(who, count), self.children[start + np.arange(len(start))]))

    def groups(self, radius: int) -> np.ndarray:
        """For each value the least index of its connected group."""
        root = np.arange(len(self.values))

        def join(a: np.ndarray, b: np.ndarray) -> None:
            while True:
                x, y = root[a], root[b]
                apart = x != y
                if not apart.any():
                    return
                np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
                while ((up := root[root]) != root).any():
                    root[:] = up

        for child, parent in self.levels:  # a child is known to be near its parent without a look-up
            near = np.bitwise_count(self.values[child] ^ self.values[parent]) <= radius
            join(child[near], parent[near])
        for a, b in self.within(radius, root):
            join(a, b)
        return root


def shard_edges(batches: Iterator[pa.RecordBatch], radius: int, large: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp) sorted by shard to edges (a, b) from a fingerprint to the first of its group in the shard; of a
    shard with over `large` fingerprints all are returned instead, each with a null b."""

    def edges(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = Forest(fp.view(np.uint64), shard).groups(radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.record_batch({"a": pa.array(fp[linked]), "b": pa.array(fp[root[linked]])})

    def crowd(fp: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array(fp), "b": pa.nulls(len(fp), pa.int64())})

    def whole(s: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole shards, one after the other."""
        if large is not None and len(s):
            size = np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))
            many = np.repeat(size > large, size)
            if many.any():
                yield crowd(f[many])
                s, f = s[~many], f[~many]
        if len(s):
            yield edges(s, f)

    shards, fps, held, crowded = [], [], 0, None
    for b in batches:
        s, f = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp"))
        if crowded is not None:  # the shard that was found to be crowded goes on
            other = np.flatnonzero(s != crowded)
            cut = int(other[0]) if len(other) else len(s)
            yield crowd(f[:cut])
            s, f = s[cut:], f[cut:]
            if not len(s):
                continue
            crowded = None
        shards.append(s)
        fps.append(f)
        held += len(s)
        if held >= SHARD_ROWS:
            s, f = np.concatenate(shards), np.concatenate(fps)
            other = np.flatnonzero(s != s[-1])
            last = int(other[-1]) + 1 if len(other) else 0  # the last shard may go on in the next batch
            yield from whole(s[:last], f[:last])
            shards, fps, held = [s[last:]], [f[last:]], len(s) - last
            if large is not None and held > large:
                yield crowd(fps[0])
                crowded, shards, fps, held = s[-1], [], [], 0
    if held:
        yield from whole(np.concatenate(shards), np.concatenate(fps))


def shard_keys(fp: F.Column, radius: int, bands: int) -> F.Column:
    """The shards of a fingerprint: a choice of bands, and the bits there."""
    if not radius < bands <= 64:
        raise ValueError("more bands than the radius, and no more than 64, are needed")
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(bands), bands - radius)):
        bits = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask = bits - (1 << 64) if bits >> 63 else bits
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def link(fps: DataFrame, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """fp and component_fp, an unsigned-agnostic name of the group (its least signed fingerprint), for the distinct
    values of the column fp that have a partner within the radius. Shards may collide in a hash: that only adds
    look-ups, as distances are checked.

    The fingerprints of a shard with over LARGE of them are dealt anew with one band more, so with another band to
    agree in and smaller shards, FINER times at most; partners meet there as well. What is still together then agrees
    in over half its bits, and its look-ups leave out what is known to be linked.
    """
    if radius == 0:
        return fps.select("fp", F.col("fp").alias("component_fp")).limit(0)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, parts = fps.select("fp").distinct(), []
    for finer in range(FINER + 1):
        large = LARGE if finer < FINER else None
        shards = left.select(F.explode(shard_keys(F.col("fp"), radius, bands + finer)).alias("shard"), "fp").distinct()
        dealt = shards.repartition(n, "shard").sortWithinPartitions("shard", "fp")
        found = checkpointed(dealt.mapInArrow(lambda it, large=large: shard_edges(it, radius, large), "a long, b long"))
        parts.append(found.filter("b is not null"))
        left = checkpointed(found.filter("b is null").select(F.col("a").alias("fp")).distinct())
        if left.isEmpty():
            break
    return components(reduce(DataFrame.unionByName, parts)).select(F.col("node").alias("fp"), F.col("component").alias("component_fp"))


def near_duplicates(docs: DataFrame, shingle: int, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable, itself included): a row for each row of docs.

    Null texts are empty, and texts without words have fingerprint 0 and link like any other. Very long texts are
    used whole. Repeated rows stay repeated. A null doc_id gets its group's least id, or null if it has none.
    """
    prints = checkpointed(texts(docs).select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")))
    groups = link(prints, radius, bands)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(groups, "fp", "left").withColumn("component_fp", F.coalesce("component_fp", "fp"))
    ids = named.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "component_fp").join(ids, "component_fp"), "fp").select("doc_id", "fp", "component_id")


def pieces(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of all pieces of the texts, and the text of each.

    A piece begins where the hash of a word says so, about every PIECE words, so an edit changes the one or two
    pieces around it and no others. Its SimHash is of its shingles, which may reach into the next piece of the
    text; words at a text's end that begin no shingle belong to none, and shorter texts have no pieces.
    """
    token, at = words.shingles(shingle)
    if not len(token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = words.text_of[at]
    word = words.hashes(words.starts[at], words.ends[at])
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])) | (word % np.uint64(PIECE) == 0))
    out = np.zeros(len(begin), np.int64)
    ends = np.append(begin[1:], len(token))
    for a in range(0, len(begin), 2048):
        b = min(a + 2048, len(begin))
        part = token[begin[a] : ends[b - 1]]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[a:b] - begin[a], axis=0, dtype=np.int32)
        out[a:b] = np.packbits(ones * 2 > (ends[a:b] - begin[a:b])[:, None], axis=1, bitorder="little").view("<i8").ravel()
    return out, own[begin]


def bottom(found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SKETCH distinct values of each text that come first by a hash, the same ones wherever they occur."""
    order = np.lexsort((found, mixed(found.view(np.uint64), 9), text))
    found, text = found[order], text[order]
    fresh = np.concatenate(([True], (found[1:] != found[:-1]) | (text[1:] != text[:-1]))) if len(found) else np.zeros(0, bool)
    found, text = found[fresh], text[fresh]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    return found[place < SKETCH], text[place < SKETCH]


def before(found: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each value of a sketch the three before it there (before the first come the last), 21 bits of each: sorted
    by this, texts that share more of their sketches stand closer."""
    first = np.searchsorted(text, text)
    count = np.searchsorted(text, text, "right") - first
    place, out = np.arange(len(text)) - first, np.zeros(len(text), np.uint64)
    for k in range(1, 4):
        bits = found[first + (place - k) % np.maximum(count, 1)].view(np.uint64) >> np.uint64(43)
        out = (out << np.uint64(21)) | np.where(k < count, bits, np.uint64(0))
    return out.view(np.int64)


def sketches(words: Words, shingle: int, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each of n texts its sketch and what stands before each value: pieces, and, in texts with fewer than
    SKETCH of them, shingles as well, as an edit may touch all of a few pieces."""
    found, text = bottom(*pieces(words, shingle))
    few = np.bincount(text, minlength=n) < SKETCH
    token, at = words.shingles(shingle)
    own = words.text_of[at]
    more, short = bottom(mixed(token[few[own]], 11).view(np.int64), own[few[own]])
    ahead = np.concatenate((before(found, text), before(more, short)))
    found, text = np.concatenate((found, more)), np.concatenate((text, short))
    order = np.argsort(text, kind="stable")
    offsets = pa.array(np.searchsorted(text[order], np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(found[order])), pa.ListArray.from_arrays(offsets, pa.array(ahead[order]))


def distinct(words: Words, shingle: int, n: int) -> pa.Array:
    """How many different shingles each of n texts has."""
    token, at = words.shingles(shingle)
    own = words.text_of[at]
    order = np.lexsort((token, own))
    fresh = np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (own[order][1:] != own[order][:-1]))) if len(token) else np.zeros(0, bool)
    return pa.array(np.bincount(own[order][fresh], minlength=n), pa.int32())


def prefixes(words: Words, shingle: int, similarity: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all texts, and the text of each: texts whose sets of shingles are similar enough have AGREE in common.

    They share at least `similarity` of the n shingles of either, so if all are put in one order, AGREE stand among
    the first n - ceil(similarity * n) + AGREE of both. Common shingles (sorted) come last. Texts of fewer shingles than
    AGREE have each of them that many times.
    """
    token, at = words.shingles(shingle)
    if not len(token):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = words.text_of[at]
    by = np.lexsort((token, mixed(token, 5), held_in(token, common), own))
    token, own = token[by], own[by]
    fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (own[1:] != own[:-1])))
    token, own = token[fresh], own[fresh]
    n = np.bincount(own)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    kept = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + AGREE
    keep = np.arange(len(own)) - first[own] < kept[own]
    short = n[own] < AGREE
    parts = [(token[keep], own[keep]), *((mixed(token[short], 20 + k), own[short]) for k in range(1, AGREE))]
    return np.concatenate([mixed(t, 7) for t, _ in parts]), np.concatenate([o for _, o in parts])


def similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows as passages.streamed() sends them, told the sorted sets of shingles, to the pairs (a, b) whose sets are similar enough."""
    y = np.zeros(0, np.uint64)
    for batch in slices(batches):
        out = []
        for a, b, told in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            x = np.frombuffer(told, np.uint64)
            if a is None:
                y = x
            elif min(len(x), len(y)) >= similarity * max(len(x), len(y), 1):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    out.append((a, b))
        yield pa.record_batch({"a": pa.array([r[0] for r in out], pa.int64()), "b": pa.array([r[1] for r in out], pa.int64())})


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """The rows of docs without those that aren't the first (by doc_id, nulls last) of their group.

    Two texts are linked if their fingerprints are within the radius, or if a piece of both has the same SimHash
    and the Jaccard similarity of their sets of shingles, taken from the whole texts, is at least `similarity`:
    fingerprints of whole texts that are similar by 0.8 mostly differ in 6 to 14 bits, so the radius alone would
    miss them. SKETCH pieces of a text are compared (a min-hash sample; texts with fewer pieces add as many
    shingles). Texts with an equal piece are sorted by the pieces before it in their samples, and a text meets the
    first and the WIDTH ones before it there, so candidates stay in proportion to texts; groups that aren't one class
    then go into another round (passages.found_links). Last, all pairs of texts that are still in two groups and may be
    similar enough (those with AGREE equal prefixes()) are verified, so no link between two groups is left out.
    Equal texts are one node. Null texts are empty; texts without words are one group. Very long texts are used whole,
    repeated rows leave one of them, rows without doc_id come last, and an empty table stays empty. Columns may have
    any names but those that begin with two underscores.
    """
    plain = texts(docs)
    mark, known_nodes = identified(plain, first=F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")), n=F.count(F.lit(1)))
    known = mark(plain, "text", "node")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            texts_here = b.column(1).to_pylist()
            words = Words([t.encode().lower() for t in texts_here])
            lists, ahead = sketches(words, shingle, b.num_rows)
            prints, sizes = pa.array([fingerprint(t, shingle) for t in texts_here], pa.int64()), distinct(words, shingle, b.num_rows)
            yield pa.record_batch([b.column(0), prints, lists, ahead, sizes], names=["node", "fp", "pieces", "ahead", "size"])

    # copies are read once: the row with the least doc_id stands for its text
    copied = small_side(checkpointed(known_nodes.filter("n > 1").select("node", F.col("first.doc_id").alias("least"))).withColumn("copied", F.lit(True)))
    once = known.join(copied, "node", "left").filter(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")
    each = checkpointed(once.mapInArrow(read, "node long, fp long, pieces array<long>, ahead array<long>, size int").dropDuplicates(["node"]))
    # whole texts, by BK-trees: a node stands for its fingerprint's group
    groups = link(each, radius, bands)
    near = each.select("node", "fp").join(groups, "fp", "left").withColumn("group", F.coalesce("component_fp", "fp"))
    by_print = near.join(near.groupBy("group").agg(F.min("node").alias("b")), "group").filter("node <> b").select(F.col("node").alias("a"), "b")
    # pieces, verified on the texts
    signed = each.select(F.explode(F.arrays_zip("pieces", "ahead")).alias("s"), "node").select(F.col("s.pieces").alias("signature"), F.col("s.ahead").alias("ahead"), "node")
    met, members = candidates(signed, signed.filter(F.pmod("node", F.lit(SAMPLED)) == 0), ["ahead"], WIDTH, F.shiftright("ahead", 42))
    sizes = each.select("node", "size")
    common = common_tokens_of(checkpointed(once.filter(F.pmod("node", F.lit(SAMPLED)) == 0)), shingle)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            key, text = prefixes(Words([t.encode().lower() for t in b.column(1).to_pylist()]), shingle, similarity, common)
            yield pa.record_batch({"signature": pa.array(key.view(np.int64)), "node": pa.array(b.column(0).to_numpy(zero_copy_only=False)[text])})

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets of shingles are similar enough; sizes tell most of the others."""
        for s in "ab":
            pairs = pairs.join(small_side(sizes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"))), s)
        some = checkpointed(pairs.filter(F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")).select("a", "b"))
        return streamed(some, known.select("node", "text"), sizes, lambda t: np.unique(Words([t.encode().lower()]).shingles(shingle)[0]).tobytes(), lambda it: similar(it, similarity), "a long, b long")

    by_piece = found_links(met, members, alike, FURTHER, AGREE, once.mapInArrow(ahead, "signature long, node long").distinct())
    classes = components(by_print.unionByName(by_piece))
    placed = known_nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = placed.groupBy("component").agg(F.min(F.struct("first.nameless", "first.doc_id", "node")).alias("keeper"), F.sum("n").alias("rows")).filter("rows > 1")
    crowded = checkpointed(placed.join(firsts, "component").select(F.col("node").alias("__node"), F.col("keeper.doc_id").alias("__keep"), (F.col("keeper.node") == F.col("node")).alias("__first")))
    joined = mark(docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit(""))), "__text", "__node").drop("__text").join(small_side(crowded), "__node", "left")
    kept = joined.filter(F.col("__first") & F.col("doc_id").cast("long").eqNullSafe(F.col("__keep"))).dropDuplicates(["__node"])
    return joined.filter(F.col("__first").isNull()).select(*every(docs)).unionByName(kept.select(*every(docs)))
