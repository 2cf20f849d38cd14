"""Mixing sources to target weights by weighted fair queueing.

Sources, in order of code point and null last, weigh 3, 1, 2, repeating, and share a total budget (150 % of all words) by
weight; a target stops at twice its source's size and the excess goes to the others by weight until none is above.
Each document may be taken twice: every pass over a source shuffles its documents by a seeded hash. An item's virtual
finish time is its source's cumulative words, itself included, divided by the source's target; items sorted by finish
time over all sources and cut at the total budget make the mix.

Prefix sums over a source of any size need no task of its own: items fall into buckets by their place in the shuffle,
buckets into shelves. Shelves' sums (aggregated before the shuffle) give the offsets of shelves, buckets' sums those inside a
shelf, and only a bucket is summed row by row; a source of n documents is ordered in about the cube root of n rows at a
time. The same way the global order is cut: a histogram of finish times finds the bin where the budget ends, and only that
bin is sorted.

Native: DataFrame functions only.

Defined cases: a null text has size 0; documents of size 0 are taken 0 times; a source of size 0 has target 0; repeated
rows are documents of their own; ties in the shuffle go by doc_id, then by text; a null doc_id is a value like others; where
all sizes are 0 nothing is taken; extra columns of any type may stand beside (maps count by their entries' order); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, stored

#: Share of all words that the mix holds, passes over a source, documents in a bucket.
BUDGET, PASSES, BUCKET = 1.5, 2, 200
#: The weights in turn.
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """One row (source, source_size, documents, target) for each source; the only table that a single task orders."""
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    turn = F.row_number().over(Window.orderBy(F.encode("source", "UTF-8").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(turn - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = (F.lit(float(PASSES)) * F.col("source_size")).alias("cap")
    rows = every.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    # Sources that reach their cap are those of the smallest caps by weight. From the first that does not on, shares only fall.
    order = Window.orderBy("level", F.encode("source", "UTF-8").asc_nulls_last())
    before, total = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = (
        rows.withColumn("_budget", F.lit(BUDGET) * F.sum("source_size").over(total))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_share", F.col("_left") / F.col("_weight"))
    )
    level = F.max(F.when(F.col("_share") <= F.col("level"), F.col("_share"))).over(total)
    return rows.select("source", "source_size", "documents", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; a column with a map in it, which Spark doesn't hash, counts as its JSON text."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes])


def schedule(docs: DataFrame, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each item (a document in a pass) with its finish time: doc_id, source, size, row (a hash of the whole row), _copy, _pass, source_size, target, finish."""
    row = row_hash(docs).alias("row")
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), row)
    sized = stored(sized, "sizes")  # words are counted once, several passes follow
    goal = stored(targets(sized), "targets")
    # Equal rows are alike: they are counted, then numbered.
    items = sized.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).drop("_n")
    small = goal.count() <= 100_000
    items = items.join(F.broadcast(goal) if small else goal, items["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    items = items.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))))
    items = items.withColumn("_at", F.xxhash64(F.lit(seed), "_pass", "doc_id", "row", "_copy").cast("double") / 2.0**64 + 0.5)
    items = items.withColumn("_bucket", F.floor(F.col("_at") * F.ceil(F.col("documents") / BUCKET)))
    # A shelf holds the square of the buckets' cube root, so shelves, buckets of a shelf and documents of a bucket stay few alike.
    items = items.withColumn("_shelf", F.floor(F.col("_bucket") / F.ceil(F.sqrt(F.ceil(F.col("documents") / BUCKET)))))
    queue = ["source", "_pass", "_shelf", "_bucket"]
    sums = stored(items.groupBy(*queue).agg(F.sum("size").alias("_sum")), "bucket_sums")
    before = (Window.unboundedPreceding, -1)
    shelves = sums.groupBy("source", "_pass", "_shelf").agg(F.sum("_sum").alias("_sum"))
    shelves = shelves.withColumn("_shelves", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_pass", "_shelf").rowsBetween(*before)), F.lit(0))).drop("_sum")
    offsets = sums.withColumn("_buckets", F.coalesce(F.sum("_sum").over(Window.partitionBy("source", "_pass", "_shelf").orderBy("_bucket").rowsBetween(*before)), F.lit(0))).drop("_sum")
    x, y = offsets.alias("x"), shelves.alias("y")
    meet = F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x._pass") == F.col("y._pass")) & (F.col("x._shelf") == F.col("y._shelf"))
    offsets = x.join(y, meet).select("x.source", "x._pass", "x._bucket", (F.col("x._buckets") + F.col("y._shelves")).alias("_offset"))
    inside = Window.partitionBy("source", "_pass", "_bucket").orderBy("_at", "doc_id", "row", "_copy").rowsBetween(Window.unboundedPreceding, 0)
    a, b = items.withColumn("_inside", F.sum("size").over(inside)).alias("a"), offsets.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._pass") == F.col("b._pass")) & (F.col("a._bucket") == F.col("b._bucket"))
    summed = a.join(b, same).select("a.*", (F.col("b._offset") + F.col("a._inside")).alias("_sum"))
    # An item stands where its middle ends, so each source stops as near to its target as whole documents allow.
    finish = F.when(F.col("target") > 0, (F.col("_sum") - F.col("size") / 2) / F.col("target")).otherwise(F.lit(float(PASSES)))
    kept = ["doc_id", "source", "size", "row", "_copy", "_pass", "source_size", "target"]
    return stored(summed.select(*kept, finish.alias("finish")), "finish")


def cut(timed: DataFrame) -> DataFrame:
    """The items in global order of finish time as far as the total budget goes: adds ``kept``."""
    tie = ["finish", "source", "_pass", "doc_id", "row", "_copy"]
    # What has no size is never taken, so it needs no place in the order.
    empty = timed.where("size = 0").withColumn("kept", F.lit(False))
    timed = timed.where("size > 0")
    of = timed.groupBy("source").agg(F.max("target").alias("target"), F.count("*").alias("n")).agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    budget, n = of.first()
    # As many bins as the root of the items: few bins to sum up, few items in the one that is sorted.
    bins = max(64, int(n**0.5))
    binned = timed.withColumn("_bin", F.least(F.floor(F.col("finish") * bins), F.lit(PASSES * bins)))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("_bin").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = sums.where(F.col("before") <= budget).orderBy(F.desc("_bin")).first()
    at, had = (edge["_bin"], edge["before"]) if edge else (0, 0)
    run = F.sum("size").over(Window.orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)) + had - F.col("size") / 2 <= budget
    whole = binned.where(F.col("_bin") != at).withColumn("kept", F.col("_bin") < at)
    return whole.unionByName(binned.where(F.col("_bin") == at).withColumn("kept", run)).drop("_bin").unionByName(empty)


def mix(docs: DataFrame, seed: int = 17, **names: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document."""
    done = cut(schedule(docs, seed, **names))
    taken = F.sum(F.when(F.col("kept"), F.col("size")).otherwise(F.lit(0))).alias("taken")
    return done.groupBy("doc_id", "source", "size", "row", "_copy").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), taken).select("doc_id", "size", "source_size", "target", "taken")


def mixture(docs: DataFrame, seed: int = 17, **names: str) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, range-sorted by finish time."""
    done = cut(schedule(docs, seed, **names)).where("kept AND size > 0")
    times = done.groupBy(F.col("row").alias("_mix_row")).agg(F.collect_list(F.struct("_copy", "finish")).alias("_mix_times"))
    columns = docs.columns
    # A row may be there more than once; copy i takes the times of number i. Equal rows are few, as their hash takes in every column.
    numbered = docs.withColumn("_mix_row", row_hash(docs))
    numbered = numbered.withColumn("_mix_copy", F.row_number().over(Window.partitionBy("_mix_row").orderBy(F.lit(0))))
    each = numbered.join(times, "_mix_row").withColumn("_mix_item", F.explode(F.filter("_mix_times", lambda t: t["_copy"] == F.col("_mix_copy"))))
    each = each.withColumn("_mix_finish", F.col("_mix_item.finish"))
    return each.repartitionByRange("_mix_finish", "_mix_row").sortWithinPartitions("_mix_finish", "_mix_row").select(*columns)
