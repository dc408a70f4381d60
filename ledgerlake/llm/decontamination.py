"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts are canonicalised: small letters, signs other than letters and digits as spaces, and typed placeholders for
numbers (any word with a digit; separators within numbers don't count), units after a number, and names (a
capitalised word after a word in small letters). Windows of WINDOW canonical words (an item with fewer words is one
window) are hashed and joined to those of the benchmark; windows of placeholders alone are hashed with their values.
Matches on one diagonal (the same shift between document and item) form a run. Every placeholder in a run is a slot: a run counts if its slots are consistent, that is, each value of
the item always went to one value in the document, and no two of them to the same; so a question with new numbers or names is caught, and a chance
template isn't. Windows with under LITERALS words of their own say too little by themselves: adjacent ones count if
together they have LITERALS, if they are a whole item of LITERALS words, or if the document has the item's own values;
so shorter items count whole and with their values.

The documents' windows are hashed in one pass and only matches leave it: the benchmark is broadcast while it is
counted to be small, and else the hashes are shuffled. A window that several items share stands for each of them, as
each has its own values: matches multiply by the items that share a window. Documents' slots are read in a second pass, over the
matched documents alone, and only if the benchmark's windows have any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, every, let, small_side

WINDOW, LITERALS = 8, 5
#: The part of a diagonal that has all its windows with enough literal words.
WHOLE = -2
#: Stands before a name until it is replaced.
MARK = "\u0001"
# Units that may follow a number.
UNITS = "kg g mg lb lbs oz t km m cm mm mi mile miles ft feet foot in inch inches yd yard yards s sec second seconds min minute minutes h hour hours day days week weeks month months year years l ml litre litres liter liters gallon gallons usd eur gbp dollar dollars euro euros pound pounds cent cents percent pct degree degrees c f k kmh mph kb mb gb tb hz khz mhz ghz w kw v a j n pa".split()


def separators() -> str:
    """A class of all signs that aren't part of words, in small letters: what ASCII and Latin-1 have of them one by
    one, which Java looks up in a table, and blocks of punctuation, symbols and spaces beyond."""
    single = [chr(c) for c in range(256) if c != ord(MARK) and not chr(c).isalnum() and not chr(c).isupper()]
    return "[" + "".join(f"\\x{ord(c):02x}" for c in single) + r"\u2000-\u2bff\u2e00-\u2e7f\u3000-\u3004\u3008-\u3020\ufe10-\ufe6f\uff01-\uff0f]+"


SEPARATORS = separators()


def valued(text: Column) -> Column:
    """The canonical words with their own values, names marked; single spaces, none at the ends."""
    t = let(text, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "([0-9])[.,](?=[0-9])", "$1")).otherwise(x))
    t = F.regexp_replace(t, r" (?=\p{Lu}\p{Ll})(?<=[\p{Ll}\p{Lo},;] )", f" {MARK}")
    return F.trim(F.regexp_replace(F.lower(t), SEPARATORS, " "))


def templated(values: Column) -> Column:
    """The same words with placeholders."""
    numbers = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "#n"), rf"(?<=#n )(?:{'|'.join(UNITS)})(?![^ ])", "#u")
    return let(F.regexp_replace(values, rf"{MARK}[^ ]*+", "#p"), lambda t: F.when(t.rlike("[0-9]"), numbers(t)).otherwise(t))


def words(t: Column) -> Column:
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def window_hashes(template: Column, size: int) -> Column:
    """The hash of the window at each word; none if there are fewer words."""
    n = F.size(template) - size
    return F.when(n < 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(template, i + 1, F.lit(size)))))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """size, plain (hashed with its values, as it has no literal word), hash, item_id, item_pos, slots (array of
    struct(at, value)), literals (their places in the item), item_words: a row for each window of each item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), valued(F.coalesce(F.col("text"), F.lit(""))).alias("v"))
    items = items.select("item_id", words(F.col("v")).alias("v"), words(templated(F.col("v"))).alias("t")).filter(F.size("t") > 0)
    items = items.withColumn("size", F.least(F.size("t"), F.lit(window)))
    every = items.select("item_id", "size", "v", "t", F.size("t").alias("item_words"), F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("item_pos"))
    own = every.select("item_id", "size", "item_pos", "item_words", F.slice("t", F.col("item_pos") + 1, F.col("size")).alias("t"), F.slice("v", F.col("item_pos") + 1, F.col("size")).alias("v"))
    slots = F.filter(F.transform("t", lambda w, i: F.struct(i.alias("at"), F.when(w.startswith("#"), F.get(F.col("v"), i)).alias("value"))), lambda s: s["value"].isNotNull())
    literals = F.filter(F.transform("t", lambda w, i: F.when(~w.startswith("#"), F.col("item_pos") + i)), lambda at: at.isNotNull())
    told = own.withColumns({"slots": slots, "literals": literals}).withColumn("plain", F.size("literals") == 0)
    hashed = F.when(F.col("plain"), F.xxhash64(F.transform("v", lambda w: F.regexp_replace(w, MARK, "")))).otherwise(F.xxhash64("t"))
    return told.select("size", "plain", hashed.alias("hash"), "item_id", "item_pos", "slots", "literals", "item_words").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Consistent runs: doc_id, text_key, item_id, start and item_start (in canonical words), n_words, n_windows, exact.

    exact: no slot has another value than in the item. A null text is empty, and no text, item or table that is
    empty or too short matches; very long texts are searched whole. Repeated rows of a document give the same runs
    once; documents with equal ids but different texts are told apart by text_key. Null ids are kept.
    """
    targets = checkpointed(benchmark_windows(benchmark, window))
    sizes = sorted((r["size"], r["plain"]) for r in targets.select("size", "plain").distinct().collect())  # at most twice `window` of them
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.md5("text").alias("text_key"), "text")
    shape = "doc_id long, text_key string, pos int, item_id long, item_pos int, slots array<struct<at:int,value:string>>, literals array<int>, item_words int, size int"
    if not sizes:
        hits = docs.sparkSession.createDataFrame([], shape)
    else:
        template = keyed.select("doc_id", "text_key", words(templated(valued(F.col("text")))).alias("t"))
        bare = keyed.select("doc_id", "text_key", words(F.regexp_replace(valued(F.col("text")), MARK, "")).alias("t"))
        parts = []
        for size, plain in sizes:
            found = (bare if plain else template).select("doc_id", "text_key", F.posexplode(window_hashes(F.col("t"), size)).alias("pos", "hash"))
            side = small_side(targets.filter((F.col("size") == size) & (F.col("plain") == plain)).drop("size", "plain"))
            parts.append(found.join(side, "hash").select("doc_id", "text_key", "pos", "item_id", "item_pos", "slots", "literals", "item_words", F.lit(size).alias("size")))
        hits = reduce(DataFrame.unionByName, parts)
    hits = checkpointed(hits.distinct())
    diagonal = ["doc_id", "text_key", "item_id", "shift"]
    run = [*diagonal, "part"]
    shifted = hits.withColumn("shift", F.col("pos") - F.col("item_pos"))
    # the windows with enough literal words are a run of their own (WHOLE); with the others, adjacent ones are
    adjacent = shifted.withColumn("part", F.col("pos") - F.dense_rank().over(Window.partitionBy(*diagonal).orderBy("pos")))
    low = F.min(F.size("literals")).over(Window.partitionBy(*run)) < literals
    adjacent = adjacent.withColumn("low", low).filter("low").drop("low")
    placed = checkpointed(shifted.filter(F.size("literals") >= literals).withColumn("part", F.lit(WHOLE)).unionByName(adjacent))
    runs = placed.groupBy(*run).agg(
        F.min("pos").alias("start"), F.min("item_pos").alias("item_start"), (F.max(F.col("pos") + F.col("size")) - F.min("pos")).cast("long").alias("n_words"), F.count(F.lit(1)).alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_list("literals")))).alias("n_literals"), F.max("item_words").alias("item_words")
    )
    slots = placed.select(*run, "pos", F.explode("slots").alias("s")).select(*run, (F.col("pos") + F.col("s.at")).alias("at"), F.col("s.value").alias("value")).distinct()
    runs = runs.withColumn("exact", F.lit(True))
    if not targets.filter(F.size("slots") > 0).isEmpty():
        wanted = checkpointed(slots)
        texts_with = small_side(checkpointed(wanted.select("text_key").distinct()))
        # the words are read where the texts lie; behind the shuffle there are few partitions for so few rows
        values = keyed.join(texts_with, "text_key", "left_semi").select("text_key", words(valued(F.col("text"))).alias("v")).dropDuplicates(["text_key"])
        values = values.select("text_key", F.posexplode("v").alias("at", "doc_value"))
        asked = wanted.select("text_key", "at").distinct()
        read = wanted.join(values.join(asked, ["text_key", "at"], "left_semi"), ["text_key", "at"])
        each = read.groupBy(*run, "value").agg(F.min("doc_value").alias("least"), F.max("doc_value").alias("most"))
        back = read.groupBy(*run, "doc_value").agg((F.min("value") == F.max("value")).alias("one"))
        ways = each.select(*run, (F.col("least") == F.col("most")).alias("one"), (F.col("least") == F.col("value")).alias("own")).unionByName(back.select(*run, "one", F.lit(True).alias("own")))
        told = ways.groupBy(*run).agg(F.bool_and("one").alias("consistent"), F.bool_and("own").alias("same"))
        same = reduce(lambda a, b: a & b, [F.col(f"runs.{c}").eqNullSafe(F.col(f"told.{c}")) for c in run])
        joined = runs.drop("exact").alias("runs").join(told.alias("told"), same, "left").filter(F.coalesce(F.col("consistent"), F.lit(True)))
        runs = joined.select("runs.*", F.coalesce(F.col("same"), F.lit(True)).alias("exact"))
    entire = (F.col("n_words") == F.col("item_words")) & (F.col("item_words") >= literals) & (F.col("n_literals") > 0)
    runs = checkpointed(runs.filter(F.col("exact") | entire | (F.col("n_literals") >= literals)))
    strong = runs.filter(F.col("part") == WHOLE).select(*diagonal).alias("strong")
    known = reduce(lambda a, b: a & b, [F.col(f"runs.{c}").eqNullSafe(F.col(f"strong.{c}")) for c in diagonal])
    others = runs.filter(F.col("part") != WHOLE).alias("runs").join(strong, known, "left_anti")
    runs = runs.filter(F.col("part") == WHOLE).unionByName(others)
    return runs.select("doc_id", "text_key", "item_id", F.col("start").cast("long").alias("start"), F.col("item_start").cast("long").alias("item_start"), "n_words", "n_windows", "exact")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """The rows of docs in whose text no item of the benchmark was found, with their columns.

    Null and empty texts, and rows without doc_id, stay, as do all rows if the benchmark is empty; repeated rows stay
    or go together; very long texts are searched whole. Columns may have any names but `__text_key`.
    """
    bad = checkpointed(matches(docs, benchmark, window, literals).select(F.col("text_key").alias("__text_key")).distinct())
    marked = docs.withColumn("__text_key", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked.join(small_side(bad), "__text_key", "left_anti").select(*every(docs))
