"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only.

Sources weigh 1, 2, 3, repeating, in the order of their names, and share the words of all documents; no
source's target is above ``MAX_EPOCHS`` times its size, and what is over is shared again by weight. A source
takes all its documents as often as its target holds them whole; for the rest its documents stand in the
order of exponential keys, -ln(u) / quality weight, and are taken as long as the running sum of their
words fits. Documents that still fit what is left are then taken in the same order, in ``PASSES`` passes, and at
last one that goes over, if the sum comes nearer to the target with it.

The running sums are made in two steps, over ranges of the key's logarithm within each source and then
within a range, so no task holds a whole source.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own and
sorts last; rows that repeat an id are documents of their own; other columns are ignored, also those
with names used here; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm._io import discard, veiled, written

SEED = 17
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Ranges of the key for each doubling of it. Whatever the weights, one holds at most about a thousandth of its source.
RANGES = 256
PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """1 less ten times the share of symbols among the characters, 0.05 at least."""
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(chars > 0, F.greatest(F.lit(0.05), 1.0 - symbols * 10.0 / chars)).otherwise(F.lit(0.05))


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, key, mark: the key comes from the checksum of seed and doc_id, so reruns agree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(uniform) / quality_weight(text)).alias("key"), mark().alias("mark"))
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, epochs, budget from (source, source_size): one row for each source.

    With the sources in the order of their ceiling per weight, the first k are held at their ceilings
    for the least k at which no other is above its own; this is where repeated resharing ends.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    # Levels rise while sources are held; the first one that doesn't lift its source above the ceiling stands.
    open_level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(everything)["level"]
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(open_level * F.col("w"), F.col("cap").cast("double"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", epochs)
    return rows.select("source", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _fitting(rows: DataFrame) -> DataFrame:
    """rows (with source, bucket, key, doc_id, size, budget, picked) with those picked that fit in this pass.

    Candidates are the rows not picked yet whose size fits; sums over ranges of the key come first.
    """
    may = ~F.col("picked") & (F.col("size") <= F.col("budget"))
    flagged = rows.withColumn("may", may)
    totals = flagged.groupBy("source", "bucket").agg(F.sum(F.when(F.col("may"), F.col("size")).otherwise(0)).alias("total"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ahead", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead")
    joined = flagged.join(totals, _same("source", "s") & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = F.col("ahead") + F.sum(F.when(F.col("may"), F.col("size")).otherwise(0)).over(within)
    taken = joined.withColumn("now", F.col("may") & (running <= F.col("budget")))
    return taken.withColumn("picked", F.col("picked") | F.col("now")).drop("s", "b", "ahead", "may")


def planned(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, passes: int = PASSES) -> DataFrame:
    """doc_id, mark, source, size, source_size, target, times (how often the mix takes the document), taken."""
    rows = keyed_rows = written(keyed(docs, seed), "keyed")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = written(targets(sizes, weights, most), "targets")
    named = goals.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget")
    rows = rows.join(named, _same("source", "s")).drop("s")
    rows = rows.withColumn("bucket", F.floor(F.log2("key") * RANGES).cast("int")).withColumn("picked", F.lit(False)).withColumn("now", F.lit(False))
    before = [keyed_rows]
    for _ in range(passes):
        rows = written(_fitting(rows), "mix")
        discard(*before)
        before = [rows]
        spent = written(rows.where("now").groupBy("source").agg(F.sum("size").alias("spent")), "spent").withColumnRenamed("source", "s")
        rows = rows.join(spent, _same("source", "s"), "left").withColumn("budget", F.col("budget") - F.coalesce("spent", F.lit(0))).drop("s", "spent")
    # What is left may be nearer to a document that is too long than to nothing; the nearest one is then taken.
    near = rows.where(~F.col("picked") & (F.col("size") > 0) & (F.col("size") < 2 * F.col("budget")))
    near = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("budget")).alias("off"), "key", "doc_id", "size")).alias("m"))
    near = written(near.select(F.col("source").alias("s"), F.col("m.key").alias("k"), F.col("m.doc_id").alias("d"), F.col("m.size").alias("z")), "near")
    rows = rows.join(near, _same("source", "s"), "left")
    rows = rows.withColumn("picked", F.col("picked") | F.coalesce((F.col("key") == F.col("k")) & _same("doc_id", "d") & (F.col("size") == F.col("z")), F.lit(False)))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("picked").cast("long")).otherwise(0)
    return rows.select("doc_id", "mark", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them: all columns of docs, rows repeated, others left out.

    A document is known by its id and a hash of its text and source while the plan is joined back; rows
    equal in all three share the number of times planned for them.
    """
    plan = planned(docs, **options).groupBy("doc_id", "mark").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    plan = written(plan.where("times > 0").select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "times", "rows"), "plan")
    plain, own, names = veiled(docs)
    mine = F.xxhash64(own["text"], own["source"])
    joined = plain.join(plan, F.col(own["doc_id"]).cast("long").eqNullSafe(F.col("id")) & (mine == F.col("m")))
    each = F.row_number().over(Window.partitionBy("id", "m").orderBy(F.lit(1)))
    copies = F.when(F.col("rows") == 1, F.col("times")).otherwise(F.floor(F.col("times") / F.col("rows")) + (F.col("nth") <= F.col("times") % F.col("rows")).cast("long"))
    single = joined.where("rows = 1").withColumn("nth", F.lit(1))
    several = joined.where("rows > 1").withColumn("nth", each)
    out = single.unionByName(several).withColumn("copies", copies.cast("int")).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*plain.columns).toDF(*names)


def mark() -> Column:
    """Hash by which rows of one id are told apart."""
    return F.xxhash64("text", "source")
