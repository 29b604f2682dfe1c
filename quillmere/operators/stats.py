"""Descriptive statistics: lengths, nearest-rank percentiles, counts by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import effective_group_key, is_blank, strip
from ..scratch import written


def length_summary(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """min_len, mean_len (two decimals), max_len, n; zeros where there is nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.groupBy(*by).agg(
        zero(F.min(value)).alias("min_len"),
        F.coalesce(F.round(F.avg(value), 2), F.lit(0.0)).alias("mean_len"),
        zero(F.max(value)).alias("max_len"),
        F.count(value).alias("n"),
    )


def _ranked(df: DataFrame, value: str, percents: list[int], by: tuple[str, ...]) -> DataFrame:
    """Rows to be aggregated by the columns of by: __n, __lo, __hi, __sum of a part of a group's values, and p50-like columns,
    each of which one row of a group holds.

    A selection in three steps. Equal values become one row with their number. These rows are sorted by ranges, written once,
    and their numbers summed for each range and group, which tells in what range the wanted rank lies. Only the ranges that
    hold a wanted rank are then counted through. A group may lie over any number of ranges, so neither a group of all rows nor
    a column without repeats is held by one task."""
    keys = [f"__b{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{value}`").alias("__v"))
    # a group without values keeps a row, which counts for nothing
    rows = rows.groupBy(*keys, "__v").agg(F.count("__v").alias("__k"))
    rows = written(rows.repartitionByRange(*keys, "__v").sortWithinPartitions(*keys, "__v").withColumn("__part", F.spark_partition_id()), "ranked")
    sums = rows.groupBy(*keys, "__part").agg(
        F.sum("__k").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum(F.col("__v") * F.col("__k")).alias("__sum"),
    )
    group = Window.partitionBy(*keys)
    upto, whole = F.sum("__n").over(group.orderBy("__part")), F.sum("__n").over(group)
    places = sums.select(*keys, "__part", (upto - F.col("__n")).alias("__before"), upto.alias("__upto"), whole.alias("__whole"))
    names = [f"p{p}" for p in percents]
    at = {n: F.expr(f"greatest(1, (__whole * {p} + 99) div 100)") for n, p in zip(names, percents, strict=True)}
    here = {n: F.when((F.col("__before") < r) & (r <= F.col("__upto")), r - F.col("__before")) for n, r in at.items()}
    wanted = places.select(*[F.col(k).alias(f"{k}w") for k in keys], F.col("__part").alias("__partw"), *[c.alias(n) for n, c in here.items()])
    wanted = wanted.filter(F.coalesce(*names).isNotNull())
    match = rows["__part"] == F.col("__partw")
    for k in keys:
        match &= rows[k].eqNullSafe(F.col(f"{k}w"))
    run = F.sum("__k").over(Window.partitionBy("__part", *keys).orderBy("__v"))
    hits = rows.join(wanted, match).withColumn("__run", run)
    found = {n: F.when((F.col("__run") - F.col("__k") < F.col(n)) & (F.col(n) <= F.col("__run")), F.col("__v")) for n in names}
    hits = hits.select(*keys, *[c.alias(n) for n, c in found.items()]).filter(F.coalesce(*names).isNotNull())
    out = sums.drop("__part").unionByName(hits, allowMissingColumns=True)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "__n", "__lo", "__hi", "__sum", *names)


def nearest_rank(df: DataFrame, value: str, percents: list[int], *by: str) -> DataFrame:
    """p50-like columns by the nearest-rank rule: the smallest value with at least p percent of rows at or below it. Null
    values do not count; a group without values gets nulls. The values must be numbers."""
    return _ranked(df, value, percents, by).groupBy(*by).agg(*[F.max(f"p{p}").alias(f"p{p}") for p in percents])


def token_length_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, min_len, mean_len (two decimals), p50 and p95 by the nearest-rank rule, max_len and total of whole numbers."""
    return _ranked(df, value, [50, 95], by).groupBy(*by).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.min("__lo").alias("min_len"), F.round(F.try_divide(F.sum("__sum"), F.sum("__n")), 2).alias("mean_len"),
        F.max("p50").alias("p50"), F.max("p95").alias("p95"), F.max("__hi").alias("max_len"), F.sum("__sum").alias("total"),
    )


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Summaries of splits as one; its percentiles are the largest of the splits', not pooled ones."""
    return parts.agg(
        F.sum("n").alias("n"), F.min("min_len").alias("min_len"), F.round(F.sum("total") / F.sum("n"), 2).alias("mean_len"),
        F.max("p50").alias("p50"), F.max("p95").alias("p95"), F.max("max_len").alias("max_len"), F.sum("total").alias("total"),
    )


def ranked_counts(df: DataFrame, key: str, most: int, *by: str) -> DataFrame:
    """The most frequent keys: by falling count, then key; within groups if by is given."""
    counts = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    if not by:
        return counts.orderBy(F.desc("n"), key).limit(most)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), key))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most)


def padded_tokens(df: DataFrame, length: str, order: list[str], batch: int) -> DataFrame:
    """One row: real_tokens, padded_tokens (each batch padded to its longest) and n_batches."""
    rows = numbered(df.select(*order, F.col(length).alias("__v")), order)
    per = rows.groupBy(F.floor(F.col("__n") / batch).alias("b")).agg(F.max("__v").alias("m"), F.count("*").alias("c"), F.sum("__v").alias("s"))
    return per.agg(F.sum("s").alias("real_tokens"), F.sum(F.col("m") * F.col("c")).alias("padded_tokens"), F.count("*").alias("n_batches"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __n, its place from 0 in the order of the columns, whatever their types.

    Sorted by ranges and written once; a row's id then names its range and its place there, and the sizes of the ranges (a
    row for each partition) give where each begins."""
    rows = written(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__k"))
    sizes = sizes.select("__part", (F.sum("__k").over(Window.orderBy("__part")) - F.col("__k")).alias("__from"))
    return rows.join(F.broadcast(sizes), part == F.col("__part")).withColumn("__n", F.col("__from") + place).drop("__id", "__part", "__from")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """dimension, value, n for each key column, in one pass (grouping sets)."""
    # beside themselves the keys stand under other names, which tell what a set groups by even where a value is null
    rows = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("n"), *[F.grouping(k).alias(f"__g_{k}") for k in keys])
    name = F.coalesce(*[F.when(F.col(f"__g_{k}") == 0, F.lit(k)) for k in keys])
    value = F.coalesce(*[F.when(F.col(f"__g_{k}") == 0, F.col(k).cast("string")) for k in keys])
    return rows.select(name.alias("dimension"), value.alias("value"), "n")


def corpus_statistics(examples: DataFrame, topics: int = 20) -> tuple[DataFrame, DataFrame]:
    """Canonical examples -> one row of totals and length summaries, and (dimension, value, n): examples by source and by
    the most frequent topics, targets by question type and difficulty. Examples and targets are different units."""
    topic = F.when(~is_blank(F.col("topic")), strip(F.col("topic")))
    e = examples.select("source", topic.alias("topic"), F.length("context").alias("context_chars"), F.size("targets").alias("targets_per_example"),
                        F.col("grounding").isNotNull().alias("grounded"), effective_group_key(F.col("group_key"), F.col("context")).alias("key"), "targets")
    t = e.select(F.explode("targets").alias("t")).select("t.*")
    t = t.withColumns({"question_chars": F.length("question"), "answer_chars": F.length("answer"), "n_options": F.when(F.size("options") > 0, F.size("options"))})

    def summary(c: str) -> list[Column]:
        return [F.coalesce(F.min(c), F.lit(0)).alias(f"{c}_min"), F.coalesce(F.round(F.avg(c), 2), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.max(c), F.lit(0)).alias(f"{c}_max")]

    whole = e.agg(
        F.count("*").alias("total_examples"), F.count_distinct("topic").alias("distinct_topics"), F.count_if(F.col("topic").isNull()).alias("examples_without_topic"),
        F.count_if("grounded").alias("grounded_examples"), F.count_distinct("key").alias("distinct_group_keys"), *summary("context_chars"), *summary("targets_per_example"),
    )
    of_targets = t.agg(F.count("*").alias("total_targets"), F.coalesce(F.sum("marks"), F.lit(0)).alias("marks_total"), *summary("question_chars"), *summary("answer_chars"), *summary("n_options"))
    ranked = ranked_counts(e.filter("topic is not null"), "topic", topics).select(F.lit("topic").alias("dimension"), F.col("topic").alias("value"), "n")
    counts = counts_by(e, "source").union(counts_by(t, "question_type", "difficulty")).union(ranked)
    return whole.crossJoin(F.broadcast(of_targets)), counts  # one row each


def split_summary(df: DataFrame) -> DataFrame:
    """One row about question rows: examples, titles, and least, mean (two decimals) and greatest of the lengths of contexts,
    questions and first answers and of the number of answers."""
    first = F.get("answers.text", F.lit(0))
    lengths = {"context_chars": F.length("context"), "question_chars": F.length("question"), "answer_chars": F.coalesce(F.length(first), F.lit(0)), "answers": F.size("answers.text")}
    cols = [c for k, v in lengths.items() for c in (F.min(v).cast("long").alias(f"{k}_min"), F.round(F.avg(v), 2).alias(f"{k}_mean"), F.max(v).cast("long").alias(f"{k}_max"))]
    return df.agg(F.count("*").alias("num_examples"), F.count_distinct("title").alias("num_titles"), *cols)


def gold_answers(df: DataFrame) -> DataFrame:
    """id, golds of question rows."""
    return df.select("id", F.col("answers.text").alias("golds"))


def record_lengths(df: DataFrame, prompt: Column, total: Column, limit: int) -> DataFrame:
    """df with prompt_tokens, completion_tokens (never negative), total_tokens and truncated."""
    return df.withColumns({"prompt_tokens": prompt.cast("long"), "completion_tokens": F.greatest(F.lit(0), total - prompt).cast("long"), "total_tokens": total.cast("long"), "truncated": total > limit})


def source_breakdown(df: DataFrame, split: str = "split", source: str = "source") -> DataFrame:
    """Rows by split and source."""
    return df.groupBy(split, source).agg(F.count("*").alias("n"))


def missing_sources(df: DataFrame, split: str = "split", source: str = "source", of: str = "train") -> DataFrame:
    """split, source: sources of one split that another one lacks."""
    has = df.groupBy(source).agg(F.collect_set(split).alias("__has"))  # as many values as there are splits
    every = df.filter(F.col(split) != of).agg(F.collect_set(split).alias("__every"))
    rows = has.filter(F.array_contains("__has", of)).crossJoin(F.broadcast(every))  # one row
    return rows.select(source, F.explode(F.array_except("__every", "__has")).alias(split)).select(split, source)


def pool(parts: dict[str, DataFrame]) -> DataFrame:
    """The sources in order of their names, one after the other; columns that one lacks are null there."""
    frames = [parts[k] for k in sorted(parts)]
    if not frames:
        raise ValueError("there are no sources to pool")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_topics(chunks: DataFrame, topics: str = "topics") -> DataFrame:
    """The topic labels of chunks, each once, in order."""
    return chunks.select(F.explode(topics).alias("topic")).distinct().orderBy("topic")


def top_indices(df: DataFrame, values: str, most: int, *keys: str) -> DataFrame:
    """keys, pos, rank: places of the largest values of an array, ties to the lower place; sorted inside the row."""
    marked = F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("pos")))
    best = F.slice(F.array_sort(F.filter(marked, lambda x: x["v"].isNotNull())), 1, most)
    return df.select(*keys, F.posexplode(best).alias("r", "x")).select(*keys, F.col("x.pos").alias("pos"), (F.col("r") + 1).alias("rank"))
