"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, repeated up to `repeats` times. An entry's virtual finish time is the
source's cumulative size up to it, divided by the source's target. All entries are range-sorted by finish time, and the
mix ends in front of the first that passes the total budget. In each source the entries taken are the first of its queue,
so that where a source's service ends tells how often each of its documents is taken.

Both cumulative sums, in a source's queue and over all entries, come from a range sort: a partition sums its own rows, and
a row per partition gives what stands before it. So a source with most rows is dealt over many tasks.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own and comes last;
equal rows are separate documents; an empty table gives an empty mix; more than MOST_SOURCES sources are an error; shares()
returns narrow rows of its own, and mix() rows with the columns of its input as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, WORD_PATTERN, Scratch, attached, keyed

#: Sources whose sizes the driver holds at most, and of which a table is broadcast.
MOST_SOURCES, BROADCAST_SOURCES = 1 << 20, 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> list[tuple[str | None, int, float]]:
    """(source, size, target) of each source, by code point, null last.

    Targets share the sum of all sizes by weight; none passes `repeats` times its source's size, and what is cut off goes
    to the others by weight.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    target = [0.0] * len(ordered)
    left, free = float(sum(s for _, s in ordered)), set(range(len(ordered)))
    while free:
        share = left / sum(weight[i] for i in free)
        full = {i for i in free if share * weight[i] > repeats * ordered[i][1]}
        for i in full or free:
            target[i] = float(repeats * ordered[i][1]) if full else share * weight[i]
        left -= sum(target[i] for i in full)
        free -= full or free
    return [(name, size, t) for (name, size), t in zip(ordered, target, strict=True)]


def _running(rows: DataFrame, order: list[str], scratch: Scratch, value: str, name: str) -> DataFrame:
    """Adds the inclusive running sum of `value` over all rows in order, without bringing them to one task."""
    parts = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn(name, F.sum(value).over(inner)).join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def queue(sized: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7) -> DataFrame:
    """Adds source_size, target, taken, passes and finish to narrow rows with doc_id, source, size and the columns of KEY.

    `finish` is the virtual finish time of a row's first entry; rows that are never served have none.
    """
    spark = sized.sparkSession
    stats = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(stats) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    hint = F.broadcast if len(stats) <= BROADCAST_SOURCES else lambda df: df
    plan = targets([(r["source"], int(r["size"])) for r in stats], weights, repeats)
    earlier, total = [], 0
    for _, size, _ in plan:
        earlier.append(total)
        total += size
    per_source = spark.createDataFrame([(i, *x, b) for i, (x, b) in enumerate(zip(plan, earlier, strict=True))], "_s int, _name string, source_size long, target double, _earlier long")
    df = sized.drop("source_size", "target", "taken", "passes", "finish").join(hint(per_source), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    # The shuffle of a source's documents is their order by hash.
    df = df.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    df = _running(df, ["_s", "_h", "doc_id", *KEY], scratch, "size", "_end")
    df = scratch.save(df.withColumn("_end", F.col("_end") - F.col("_earlier")).drop("_earlier", "_h"))
    served = (F.col("size") > 0) & (F.col("target") > 0)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: k * F.col("source_size") + F.col("_end"))).alias("_at")
    entries = df.where(served).select("_s", "size", "target", at).select((F.col("_at") / F.col("target")).alias("_time"), "_s", "_at", "size")
    taken = _running(entries, ["_time", "_s", "_at"], scratch, "size", "_served").where(F.col("_served") <= total)
    ends = taken.groupBy("_s").agg(F.max("_at").alias("_until"))
    df = df.join(hint(ends), "_s", "left")
    passes = F.floor((F.col("_until") - F.col("_end")) / F.col("source_size")) + 1
    df = df.withColumn("passes", F.when(served & (F.col("_until") >= F.col("_end")), passes).otherwise(0).cast("int"))
    df = df.withColumn("taken", F.col("passes").cast("long") * F.col("size")).withColumn("finish", F.when(served, F.col("_end") / F.col("target")))
    return df.drop("_end", "_until", "_s")


def shares(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7) -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target, taken, passes, finish and the columns of KEY."""
    scratch = Scratch(docs.sparkSession)
    narrow = keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", *KEY, word_count(F.col("text")).alias("size"))
    return queue(scratch.save(narrow), scratch, weights, repeats, seed)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken, in order of virtual finish time."""
    chosen = F.struct("passes", "finish", (F.col("source_size") / F.col("target")).alias("lap"))
    plan = F.col("_weft_plan")
    joined = attached(docs, shares(docs, weights, repeats, seed), "finish", "inner", "source", _weft_plan=chosen).where(plan["passes"] > 0)
    times = F.transform(F.sequence(F.lit(0), plan["passes"] - 1), lambda i: plan["finish"] + i * plan["lap"])
    entries = joined.select(*docs.columns, F.explode(times).alias("_weft_at"))
    return entries.repartitionByRange("_weft_at").sortWithinPartitions("_weft_at").drop("_weft_at")
