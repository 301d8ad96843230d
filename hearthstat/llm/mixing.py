"""Mixing sources to target weights along a curriculum.

A source's share of the mix follows its weight (1, 2, 3, repeating, over sources in code point order, null last);
the mix has as many words as the corpus; a source's target stops at ``most`` times its size and the excess is
shared again by weight.  Each source passes over its documents in a fixed pseudo-random order, whole passes first
and then the part that its target still needs, so a document is taken 0 to ``most`` times.

Curriculum: source s has the weight schedule w(t) = 1 - a + 2 a t over training time t in [0, 1] (a > 0 grows,
a < 0 fades).  Its integral F(t) = (1 - a) t + a t^2 is the part of the source's target that is due by t, so the
word at u of the target stands at the t that solves F(t) = u / target, in closed form.  ``mixed`` repeats documents
and sorts them by that position over ranges; ``mix`` sorts the copies without their texts and gives each one's place in the mix.

Scale: sizes are counted once and texts are not shuffled to plan.  Running sums go in two levels, over 4096 parts of
a source's order and within a part, so a source with a third of all rows is spread over 4096 keys.  Only totals of
sources and of ranges (one row each) are sorted in one task.

Defined results: a null text has size 0; a null source is a source; repeated rows are documents of their own; a
source without words has target 0; an empty table gives no rows; other columns pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MOST = 3
SLOPES = (-0.5, 0.0, 0.5)  # a, for weights 1, 2, 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key (order within the source) and part of that order, for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = C.row_key(docs)
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(C.WORD)).cast("long").alias("size"), key.alias("key"), F.substring(key, 1, 3).alias("part"))


def targets(totals: DataFrame, most: int = MOST) -> DataFrame:
    """``weight`` and ``target`` beside ``source`` and ``source_size``; one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = C.keep(totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double")), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:  # each round caps the sources that the last level puts over their limit; a few rounds settle
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, open_weight = t.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - capped) / open_weight
        if new <= level:
            break
        level = new
    return t.select("source", "source_size", "weight", F.when(full, F.col("cap")).otherwise(F.col("weight") * (F.lit(float(total)) - F.lit(capped or 0.0)) / F.lit(open_weight or 1.0)).alias("target"))


def plan(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, source, key, size, source_size, weight, target, before (words before it in its source), copies, taken."""
    rows = C.keep(sizes(docs), "sizes")
    by_part = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    totals = by_part.groupBy("source").agg(F.sum("n").alias("source_size"))
    w = Window.partitionBy("source").orderBy("part")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    t = targets(totals, most)
    base = by_part.withColumn("base", F.sum("n").over(w) - F.col("n"))
    base = base.join(t, same(base, t)).select(base["source"], "part", "base", "source_size", "weight", "target")
    base = C.keep(base, "parts").withColumnRenamed("source", "s").withColumnRenamed("part", "p")
    inner = F.sum("size").over(Window.partitionBy("source", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("before") + F.col("size") / 2 <= rest).cast("int")
    return (
        rows.withColumn("inner", inner)
        .join(base, rows["source"].eqNullSafe(F.col("s")) & (rows["part"] == F.col("p")))
        .withColumn("before", F.col("inner") + F.col("base"))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.least(whole + extra, F.lit(most))).otherwise(F.lit(1)).cast("long"))
        .select("doc_id", "source", "key", "size", "source_size", "weight", "target", "before", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def position(done: Column, slope: Column) -> Column:
    """The time t in [0, 1] by which the part ``done`` of a source's target is due."""
    curved = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * done)) / (2 * slope)
    return F.when(F.abs(slope) < 1e-9, done).otherwise(curved)


def schedule(planned: DataFrame, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """A row for each copy, with its ``position``."""
    slope = F.array(*[F.lit(float(s)) for s in slopes])[F.col("weight").cast("int") - 1]
    copy = planned.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    done = F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"))).otherwise(0.0)
    return copy.withColumn("position", position(done, slope))


def mixed(docs: DataFrame, most: int = MOST, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, sorted by position; columns of any name pass through.

    Files that it is written to hold the order: by partition, then by row.
    """
    key = lambda df: F.md5(F.concat_ws("/", C.row_key(df), F.coalesce(F.md5(df["source"]), F.lit("")))).alias("name")
    nth = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("name")))
    p = plan(docs, most)
    planned = schedule(nth(p.withColumn("name", F.md5(F.concat_ws("/", "key", F.coalesce(F.md5("source"), F.lit("")))))), slopes)
    one = planned.select("name", "nth", F.struct("position", "name", "nth", "copy").alias("place"))
    rows = nth(docs.select(key(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row")))
    return rows.join(one, ["name", "nth"]).repartitionByRange("place").sortWithinPartitions("place").select("row.*")


def placed(scheduled: DataFrame) -> DataFrame:
    """``scheduled`` rows (name, nth, copy, size, position) with ``start``: the words of the mix before each copy.

    Copies are sorted by position over ranges; running sums go within a range and over the ranges' totals.
    """
    place = ["position", "name", "nth", "copy"]
    rows = scheduled.select(*place, "size").repartitionByRange(*place).withColumn("range", F.spark_partition_id())
    rows = C.keep(rows.sortWithinPartitions(*place), "order")
    base = rows.groupBy("range").agg(F.sum("size").alias("n"))
    base = base.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("range").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("inner", inner).join(F.broadcast(base), "range").select(*place, "size", (F.col("base") + F.col("inner")).alias("start"))


def mix(docs: DataFrame, most: int = MOST, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """The contract's columns, the words taken being those of the copies that stand in the mix; where in training a document first
    stands; and ``starts``, the words of the mix before each of its copies."""
    named = plan(docs, most).withColumn("name", F.md5(F.concat_ws("/", "key", F.coalesce(F.md5("source"), F.lit("")))))
    p = C.keep(named.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("before"))), "plan")
    copies = placed(schedule(p, slopes)).groupBy("name", "nth").agg(
        F.sum("size").alias("words"), F.min("position").alias("first_position"), F.sort_array(F.collect_list("start")).alias("starts")
    )
    starts = F.coalesce("starts", F.array().cast("array<long>")).alias("starts")
    return p.join(copies, ["name", "nth"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_position", starts)
