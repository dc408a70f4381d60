"""What the operators of this subpackage share: reading, cutting lineage, components, bounded samples.

Words are runs of anything but the ASCII white space characters 0x20 and 0x09 to 0x0D. A null text counts as
an empty one everywhere.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and bytes of them, that a side of a join may have to be broadcast; what is above either is shuffled instead.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Characters of labelled texts of a class that a model is learnt from.
SAMPLE_CHARS = 32_000_000
#: Rows of text that Python handles at a time; a batch from Spark is sliced, so no list holds more.
SLICE_ROWS = 256
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, unless their PYTHONPATH has it already; and has
    Arrow batches hold BATCH_ROWS rows, as texts are long, unless the session chose a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root = Path(__file__).resolve().parents[2]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_ledgerlake_shipped", False):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "ledgerlake"), "zip", root, "ledgerlake")
    sc.addPyFile(made)
    sc._ledgerlake_shipped = True


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own only where the session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "ledgerlake-checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder now; its lineage ends there, so a lost executor costs nothing but a read."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df (checkpointed, so that counting is cheap) with a broadcast hint, if its rows and its bytes (strings and arrays
    by their lengths) are few enough, else as it is."""
    wide = [F.octet_length(F.col(f"`{c}`")) if t in ("string", "binary") else F.length(F.to_json(F.struct(F.col(f"`{c}`")))) for c, t in df.dtypes if t in ("string", "binary") or "<" in t]
    width = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 + 8 * len(df.columns)))
    told = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if told["n"] <= rows and told["bytes"] <= size else df


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null texts empty; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def identified(rows: DataFrame, text: str = "text", name: str = "node", **kept: Column) -> tuple[Callable[[DataFrame, str, str], DataFrame], DataFrame]:
    """A function that adds to a frame the node of its texts (frame, text column, name of the new column), and a
    checkpointed row for each node of rows with the aggregates `kept`.

    A node is the 64-bit hash of a text; where that is equal for texts whose second hash isn't, it is a hash of both,
    so texts are taken as equal at 128 equal bits. Such nodes are looked for among all rows; there are a handful of
    them in 10^10 texts, and none is the rule.
    """
    second = lambda c: F.xxhash64(F.lit(1), c)
    plain = rows.withColumn(name, F.xxhash64(text))
    groups = checkpointed(plain.groupBy(name).agg(F.min(second(F.col(text))).alias("__low"), F.max(second(F.col(text))).alias("__high"), *(c.alias(k) for k, c in kept.items())))
    doubled = checkpointed(groups.filter("__low <> __high").select(F.col(name).alias("__doubled")))
    if doubled.isEmpty():
        return lambda frame, text, name: frame.withColumn(name, F.xxhash64(text)), groups.drop("__low", "__high")
    few = small_side(doubled)

    def mark(frame: DataFrame, text: str, name: str) -> DataFrame:
        own = F.xxhash64(text)
        found = frame.join(few, own == F.col("__doubled"), "left")
        return found.withColumn(name, F.when(F.col("__doubled").isNotNull(), F.xxhash64(own, second(F.col(text)))).otherwise(own)).drop("__doubled")

    return mark, checkpointed(mark(rows, text, name).groupBy(name).agg(*(c.alias(k) for k, c in kept.items())))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


_KEPT: dict[str, object] = {}


def kept(name: str, build: Callable[[], object]) -> object:
    """What build makes, once in a worker; a worker keeps one such thing at a time."""
    if name not in _KEPT:
        release()
        _KEPT[name] = build()
        trim()
    return _KEPT[name]


def release() -> None:
    """Lets go of what the worker keeps: workers live on from one stage of a pipeline to the next."""
    _KEPT.clear()
    trim()


def trim() -> None:
    """Gives freed memory back to the system, where Arrow and the C library can: it would stay with the worker otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def every(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs stand in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out() -> F.Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, text and label of at most per_class rows of each class, never of the held-out fold.

    The rows with the least xxhash64(doc_id) are taken, so the sample depends on the data alone. A doc_id that is
    labelled twice keeps its larger label; null ids and labels other than 0 and 1 are ignored. Of several rows of docs
    with one doc_id the one with the least text counts. Texts of over a sixteenth of `chars` characters aren't learnt
    from, and of the others those that come first with `chars` in all by class, so the sample is bounded in size too.
    The ids (at most 2 * per_class) are broadcast, so the documents are scanned once and not shuffled.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    once = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [once.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    found = texts(docs).join(F.broadcast(reduce(DataFrame.unionByName, parts)), "doc_id").filter(F.length("text") <= chars // 16)
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    line = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("__sum", F.sum(F.length("text")).over(line)).filter(F.col("__sum") <= chars).select("doc_id", "text", "label")


def collected(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Columns of a frame of bounded size, ordered by doc_id."""
    rows = sorted(df.select("doc_id", *columns).collect(), key=lambda r: r["doc_id"])
    return [np.array([r[c] for r in rows]) for c in columns]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node and component (the least node reachable) for every node of the undirected edges (two long columns).

    Alternating large and small stars: every round shuffles the edges by a node and takes minima, which combine on
    the map side, so a node with a third of all edges is no bottleneck (the join back is split by AQE). Rounds grow
    with the logarithm of the longest path. Each round is checkpointed. Self edges and nulls are dropped; a node
    without other edges isn't returned.
    """
    use_checkpoints(edges.sparkSession)
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
