"""Benchmark decontamination by SimHash windows and exact verification; DataFrame functions only.

Texts and items become lower-case words (runs of letters and digits), and those 64-bit hashes. A window has as many words as the
item it is held against. A window of similarity 0.8 shares 8 in 9 of its shingles with its item or more, so
only windows with that many places of the item's shingles are made; that leaves out no window that could
pass, and each is aligned with the item it may hold. Window and item get a 64-bit SimHash of their words. The bits are cut into
``RADIUS`` + 1 blocks: fingerprints within the radius agree in a block whole, so pairs without such a block go first,
then those beyond the radius. What is left is verified by the weighted Jaccard similarity of the shingles, each
weighing its number of occurrences.

A similarity of 0.8 needs a radius at which blocks have two or three bits. An index on them alone would bring
together three of four unlike fingerprints, so the blocks are compared within the aligned pairs, not joined on: that
gives the same pairs, one row each.

Only ids, hashes and places are shuffled. Windows are cut out of a second scan of the texts that have any. Spark broadcasts the
items' shingles and the list of windows where their written tables are small, and joins by shuffle beyond.

Defined results: null and empty texts and texts without words contain nothing, and such items are found
nowhere; an item under five words is one shingle; a text shorter than an item is one window; equal items
are all reported; rows of one id are told apart by a hash of their text; null ids are kept; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm._io import veiled, written

SHINGLE = 5
PERCENT = 80
RADIUS = 24
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _hashed(text: Column) -> Column:
    """The words of a text as hashes. Through explode they are made once, whatever refers to them."""
    return F.explode(F.array(F.transform(words(text), lambda w: F.xxhash64(w))))


def _shingles(of: Column, n: int) -> Column:
    """Hashes of the runs of n words, in order; none if there are fewer words."""
    last = F.size(of) - n
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(of, i + k) for k in range(n))))
    return F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>"))


def _shingles_by(k: Column, of: Column, most: int) -> Column:
    """Runs of k words, k up to most."""
    made = F.array().cast("array<bigint>")
    for n in range(1, most + 1):
        made = F.when(k == n, _shingles(of, n)).otherwise(made)
    return made


def _shared(a: Column, b: Column) -> Column:
    """Number of elements that two lists share as multisets: one pass over both, sorted together."""
    tag = lambda of, side: F.transform(of, lambda h: F.struct(h.alias("h"), F.lit(side).alias("side")))
    state = lambda h, x, y, same: F.struct(h.alias("h"), x.alias("x"), y.alias("y"), same.alias("same"))
    total = lambda s: s["same"] + F.least(s["x"], s["y"])

    def step(s: Column, e: Column) -> Column:
        again = e["h"] == s["h"]
        x, y = 1 - e["side"], e["side"]
        return state(e["h"], F.when(again, s["x"] + x).otherwise(x), F.when(again, s["y"] + y).otherwise(y), F.when(again, s["same"]).otherwise(total(s)))

    zero = F.lit(0)
    return F.aggregate(F.array_sort(F.concat(tag(a, 0), tag(b, 1))), state(zero.cast("long"), zero, zero, zero), step, total)


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint of a list of hashes: each bit as most of them have it."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int")))
    return F.aggregate(F.transform(ones, lambda n, b: F.when(n * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _near(apart: Column, radius: int) -> Column:
    """Whether fingerprints that differ in these bits agree in one of radius + 1 blocks and differ in radius bits at most."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    agree = F.lit(False)
    for a, b in zip(cuts[:-1], cuts[1:]):
        agree = agree | (F.shiftrightunsigned(apart, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) == 0)
    return agree & (F.bit_count(apart) <= radius)


def items_of(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item (hash of its words), n (words), k (words of its shingles), shingles, print, item_ids of the different items with a word."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _hashed(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)
    rows = rows.withColumn("n", F.size("hashes")).withColumn("k", F.least(F.lit(shingle), "n"))
    rows = rows.select("item_id", F.xxhash64("hashes").alias("item"), "n", "k", _shingles_by(F.col("k"), F.col("hashes"), shingle).alias("shingles"), simhash(F.col("hashes")).alias("print"))
    return rows.groupBy("item", "n", "k", "shingles", "print").agg(F.collect_list("item_id").alias("item_ids"))


def _starts(percent: int) -> Column:
    """Starts of the windows of n words that hold enough of places (where the item's shingles are) to pass."""
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    held = F.least(F.col("n"), F.col("size")) - F.col("k") + 1  # shingles of a window
    need = F.ceil(F.lit(percent) * (F.col("n") - F.col("k") + 1 + held) / F.lit(100.0 + percent) - 1e-9).cast("int")
    at = lambda i: F.get(F.col("places"), i)
    firsts = F.when(F.size("places") >= need, F.sequence(F.lit(0), F.size("places") - need)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(firsts, lambda i: at(i + need - 1) - at(i) < held)
    return F.array_distinct(F.flatten(F.transform(firsts, lambda i: F.sequence(F.greatest(F.lit(0), at(i + need - 1) - held + 1), F.least(at(i), last)))))


def windows_of(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark, windows: for each text that has any, the list of (item, n, start) that could pass."""
    sizes = [r["k"] for r in items.select("k").distinct().collect()]  # at most SHINGLE
    seeds = written(items.select("k", "n", "item", F.explode("shingles").alias("h")).distinct(), "seeds")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), _hashed(F.col("text")).alias("hashes"))
    met = docs.sparkSession.createDataFrame([], "doc_id long, mark long, size int, k int, n int, item long, at int")
    for k in sorted(sizes):
        runs = texts.select("doc_id", "mark", F.size("hashes").alias("size"), F.posexplode(_shingles(F.col("hashes"), k)).alias("at", "h"))
        met = met.unionByName(runs.join(seeds.where(F.col("k") == k), "h").drop("h"))
    placed = met.groupBy("doc_id", "mark", "size", "item", "n", "k").agg(F.sort_array(F.collect_set("at")).alias("places"))
    made = F.transform(_starts(percent), lambda start: F.struct(F.col("item"), F.col("n"), start.alias("start")))
    made = placed.select("doc_id", "mark", made.alias("windows")).where(F.size("windows") > 0)
    return made.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def hits(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """doc_id, mark, item_id, similarity (best), windows: every item found in every whole text."""
    items = written(items_of(benchmark, shingle), "items")
    windows = written(windows_of(docs, items, percent), "windows").toDF("id", "m", "windows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    texts = texts.join(windows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))).select("doc_id", "mark", "windows", _hashed(F.col("text")).alias("hashes"))
    cut = F.transform("windows", lambda w: F.struct(w["item"].alias("item"), w["start"].alias("start"), F.slice(F.col("hashes"), w["start"] + 1, w["n"]).alias("held")))
    pairs = texts.select("doc_id", "mark", F.explode(cut).alias("w")).select("doc_id", "mark", "w.*")
    pairs = pairs.join(items, "item").withColumn("apart", F.explode(F.array(simhash(F.col("held")).bitwiseXOR(F.col("print"))))).where(_near(F.col("apart"), radius))
    mine = _shingles_by(F.col("k"), F.col("held"), shingle)
    pairs = pairs.select("doc_id", "mark", "item_ids", "start", "shingles", F.explode(F.array(mine)).alias("mine"))
    pairs = pairs.select("doc_id", "mark", "item_ids", "start", (F.size("mine") + F.size("shingles")).alias("both"), F.explode(F.array(_shared(F.col("mine"), F.col("shingles")))).alias("same"))
    found = pairs.where(F.col("same") * 100 >= (F.col("both") - F.col("same")) * percent).select("doc_id", "mark", F.explode("item_ids").alias("item_id"), "start", (F.col("same") / (F.col("both") - F.col("same"))).alias("similarity"))
    return found.groupBy("doc_id", "mark", "item_id").agg(F.max("similarity").alias("similarity"), F.count_distinct("start").alias("windows"))


def cleaned(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, all their columns."""
    found = written(hits(docs, benchmark, **options).select(F.col("doc_id").alias("id"), F.col("mark").alias("m")).distinct(), "leaks")
    plain, own, names = veiled(docs)
    same = F.col(own["doc_id"]).cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(own["text"]) == F.col("m"))
    return plain.join(found, same, "left_anti").toDF(*names)
