"""Mixing sources to target weights by weighted fair queueing.

Each source's documents, shuffled by keyed hash, form a queue. A document's virtual finish time is the source's
cumulative words up to and with it, divided by the source's target; a source that is to be read more than once goes on
with its second pass. All queues are merged by finish time and the merged stream is cut at the total budget.

Both running sums are taken in two levels, so that no task sees more than a bucket of rows: sums of buckets first (a few
rows for each), then sums inside a bucket. The number of buckets is the square root of the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, table

#: Fixed values of the contract: weights of sources by order, percent of all words to take, most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 150, 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size) -> with target. Sources by code point, null last, take the weights in turn. A target stops
    at passes times its source; the excess goes to the others by weight. With every source sorted by size / weight the
    capped ones are a prefix, found by running sums: no loop over rounds."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = Window.orderBy("__r", F.col("source").isNull(), "source")
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    rest = rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sources.withColumn("weight", w.cast("double")).withColumn("__cap", passes * F.col("source_size")).withColumn("__r", F.col("__cap") / F.col("weight"))
    budget = F.sum("source_size").over(every) * share / 100
    # a source is capped if, with all below it capped, its part of the rest is still above its cap
    df = df.withColumn("__left", budget - F.coalesce(F.sum("__cap").over(before), F.lit(0))).withColumn("__weights", F.sum("weight").over(rest))
    df = df.withColumn("__capped", F.col("__left") * F.col("weight") >= F.col("__cap") * F.col("__weights"))
    free = ~F.col("__capped")
    level = F.first(F.when(free, F.col("__left") / F.col("__weights")), ignorenulls=True).over(every)
    df = df.withColumn("target", F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(F.col("weight") * level))
    return df.select("source", "source_size", "weight", "target")


def queue(sized: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, passes: int = PASSES, ties: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Rows with source, doc_id and size -> the same rows with source_size, target and __c (cumulative words of the
    source), and the total budget in words.

    sized is read more than once: give a table. Null doc_ids and sources are values like others. Repeated rows each
    stand in the queue; rows alike in doc_id and size come in any order unless columns in ties tell them apart. An empty
    table gives an empty one."""
    stats = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    buckets = max(16, math.isqrt(stats["n"]))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sources, weights, share, passes)
    u = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    # buckets are ranges of the keyed digest's first 32 bits
    bucket = F.floor(F.conv(F.substring("__u", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("long")
    rows = sized.withColumn("__u", u).withColumn("__b", bucket)
    by_bucket = Window.partitionBy("source").orderBy("__b")
    sums = rows.groupBy("source", "__b").agg(F.sum("size").alias("__s"))
    sums = sums.withColumn("__before", F.sum("__s").over(by_bucket) - F.col("__s")).drop("__s")
    for extra in (sums, aims):
        keys = [k for k in ("source", "__b") if k in extra.columns]
        right = extra.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in extra.columns if c not in keys])
        on = [rows[k].eqNullSafe(right[f"__k_{k}"]) for k in keys]
        rows = rows.join(right, on).drop(*[f"__k_{k}" for k in keys])
    inside = Window.partitionBy("source", "__b").orderBy("__u", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__c", F.col("__before") + F.sum("size").over(inside)).drop("__before"), stats["total"] * share // 100


def mix(sized: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, passes: int = PASSES, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with source, doc_id and size (a table) -> the same rows, with source_size, target and passes_taken: how
    often the mix takes the document (0 to passes). Documents without words are never taken.

    The cut: finish times fall into equal buckets; those before the one in which the budget is reached are taken whole,
    and inside that one documents are taken in order until the next would exceed the budget."""
    rows, budget = queue(sized, seed, weights, share, passes, ties)
    rows = materialize(rows, "mix-queue")
    buckets = max(16, math.isqrt(max(1, rows.count())))
    # the finish time of pass p; at 1 every source has given its target. A source's last is at most passes * size / target
    time = lambda p: (F.lit(p) * F.col("source_size") + F.col("__c")) / F.col("target")
    timed = rows.filter("size > 0 and target > 0").withColumn("__p", F.explode(F.array(*map(F.lit, range(passes)))))
    timed = timed.withColumn("__v", (F.col("__p") * F.col("source_size") + F.col("__c")) / F.col("target"))
    # times beyond 2 cannot be reached: at 1 the budget is used up but for parts of one document of each source
    slot = lambda v: F.least(F.floor(v * buckets), F.lit(2 * buckets)).cast("long")
    run = Window.orderBy("__slot")
    full = timed.groupBy(slot(F.col("__v")).alias("__slot")).agg(F.sum("size").alias("__s"))
    full = full.withColumn("__to", F.sum("__s").over(run))
    edge = full.filter(F.col("__to") > budget).orderBy("__slot").select("__slot", (F.col("__to") - F.col("__s")).alias("__from")).limit(1).collect()
    if edge:
        at, start = edge[0]
        order = Window.orderBy("__v", F.col("source").isNull(), "source", "__u", "doc_id", "size", *ties, "__p")
        inside = timed.filter(slot(F.col("__v")) == at).withColumn("__sum", start + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        cut = inside.filter(F.col("__sum") > budget).orderBy("__sum").select("__v").limit(1).collect()[0][0]
        taken = sum((F.when(time(p) < cut, 1).otherwise(0) for p in range(passes)), F.lit(0))
    else:
        taken = F.lit(passes)
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0))
    return rows.withColumn("passes_taken", taken.cast("int")).drop("__u", "__b", "__c")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, ties, repeated rows and empty tables as queue() and mix()
    state."""
    sized = materialize(sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    out = mix(sized)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes_taken")).alias("taken"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS u,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, {PASSES} * source_size AS cap, CAST([{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS DOUBLE) AS weight FROM s0),
s2 AS (SELECT *, cap / weight AS r, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, total * {SHARE} / 100 - coalesce(CAST(sum(cap) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest,
  sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s2),
s4 AS (SELECT *, rest * weight >= cap * weights AS capped FROM s3),
level AS (SELECT arg_min(rest / weights, struct_pack(r := r, n := source IS NULL, s := source)) AS level FROM s4 WHERE NOT capped),
s5 AS (SELECT source, source_size, total, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (SELECT level FROM level) END AS target FROM s4),
q AS (SELECT d.*, source_size, target, total, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
timed AS (SELECT *, (p * source_size + c) / target AS v FROM q, range({PASSES}) t(p) WHERE size > 0 AND target > 0),
run AS (SELECT v, total, CAST(sum(size) OVER (ORDER BY v, source NULLS LAST, u, doc_id NULLS FIRST, size, p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM timed),
cut AS (SELECT min(v) AS cut FROM run WHERE upto > total * {SHARE} // 100)
SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 AND target > 0 THEN size * ({" + ".join(f"CASE WHEN cut IS NULL OR ({p} * source_size + c) / target < cut THEN 1 ELSE 0 END" for p in range(PASSES))}) ELSE 0 END AS taken
FROM q, cut
"""
