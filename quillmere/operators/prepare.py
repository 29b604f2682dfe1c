"""The whole preparation of a dataset: unique ids, rules, repeats, caps, a split by groups, an order inside each split."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import example_fingerprint
from ..scratch import written
from .quality import config_filters, drop_invalid, validate_dataset
from .selection import cap_per_source, dataset_fingerprint, dedup, duplicates, grouping_key, order_hash, select_hash, split_groups
from .stats import pool

STAGES = ("adapted", "unique_ids", "valid", "deduplicated", "capped_per_source", "capped_total")
#: So many dropped ids are reported.
SAMPLES = 20


@dataclass(frozen=True)
class Plan:
    """What preparation is to do; None for a cap is no cap."""

    seed: int = 42
    shuffle_seed: int = 42
    ratios: tuple[float, ...] = (0.9, 0.05, 0.05)
    group_by: str = "context"
    least_chars: int = 64
    most_chars: int = 8000
    drop_duplicates: bool = True
    per_source: int | None = None
    total: int | None = None
    sources: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    grounded: bool = False


@dataclass(frozen=True)
class Prepared:
    """examples with split and position; stage, n, place; id, reason, of at most SAMPLES dropped examples; issues."""

    examples: DataFrame
    stages: DataFrame
    dropped: DataFrame
    issues: DataFrame


def _fingerprint() -> Column:
    return example_fingerprint(F.col("context"), F.col("targets"))


def issues_of(df: DataFrame, plan: Plan, fingerprint: Column | None = None) -> DataFrame:
    """Issues of a dataset under a plan; allow-lists that are empty allow everything."""
    found = validate_dataset(df, plan.least_chars, plan.most_chars, fingerprint)
    if plan.sources or plan.kinds or plan.levels or plan.grounded:
        given = lambda xs, code, rows: rows if xs else rows.filter(F.col("code") != code)
        more = config_filters(df, plan.sources, plan.kinds, plan.levels, plan.grounded)
        more = given(plan.sources, "unknown_source", given(plan.kinds, "type_not_allowed", given(plan.levels, "difficulty_not_allowed", more)))
        found = found.unionByName(more)
    return found


def _repeats(valid: DataFrame) -> DataFrame:
    """The ids (unique, one of them may be null) of rows (id, __fp) that dedup() by __fp with least id leaves out. A null id is
    least, so none of those left out is null."""
    first = valid.groupBy("__fp").agg(F.min(F.struct("id")).alias("__one"), F.count("*").alias("__n")).filter("__n > 1").withColumnRenamed("__fp", "__key")
    rows = valid.join(first, F.col("__fp").eqNullSafe(F.col("__key")))
    return rows.filter(~F.col("id").eqNullSafe(F.col("__one.id"))).select("id")


def _capped(kept: DataFrame, most: int, seed: int) -> DataFrame:
    """cap_per_source() of examples with unique ids, told from sources and ids."""
    chosen = cap_per_source(kept.select("source", "id"), most, seed).select(F.col("id").alias("__id"))
    return kept.join(chosen, F.col("id").eqNullSafe(F.col("__id")), "left_semi")


def prepare(adapted: dict[str, DataFrame], plan: Plan | None = None) -> Prepared:
    """Adapted examples by source -> the prepared set. Each stage that others read twice is written once. Dropped ids are
    reported with the reason of the first stage that dropped them. Nothing left is an error.

    Fingerprints are made once and written. Which examples repeat or are over a cap is told from ids, fingerprints and sources
    alone; texts are only looked up by id then, and stay where they are as long as the ids to be left out are few."""
    plan = plan or Plan()
    pooled = written(pool(adapted), "prepare-pooled")
    unique = written(dedup(pooled, ["id"], ["source", "context"]).withColumn("__fp", _fingerprint()), "prepare-unique")
    issues = written(issues_of(unique, plan, F.col("__fp")), "prepare-issues")
    valid = written(drop_invalid(unique.select("id", "__fp"), issues), "prepare-valid")
    bad = issues.filter("severity = 'error' and example_id is not null").select(F.col("example_id").alias("id")).distinct()
    out = bad.union(_repeats(valid)) if plan.drop_duplicates else bad
    kept = written(unique.drop("__fp").join(out, "id", "left_anti"), "prepare-kept")
    capped = kept if plan.per_source is None else written(_capped(kept, plan.per_source, plan.seed), "prepare-capped")
    last = capped if plan.total is None else written(select_hash(capped, plan.total, plan.seed), "prepare-last")
    frames = dict(zip(STAGES, (pooled, unique, valid, kept, capped, last), strict=True))
    count = lambda k, name: frames[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), F.lit(k).alias("place"), "n")
    stages = written(reduce(DataFrame.union, [count(k, name) for k, name in enumerate(STAGES)]), "prepare-stages")
    if last.isEmpty():
        said = ", ".join(f"{r['stage']} {r['n']}" for r in stages.orderBy("place").collect())  # six rows
        raise ValueError(f"nothing is left to prepare: {said}")
    gone = lambda k, ids, reason: ids.select(F.col("id").cast("string").alias("id"), F.lit(reason).alias("reason"), F.lit(k).alias("k"))
    reasons = [
        gone(0, pooled.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_id"), gone(1, bad, "validation_error"),
        gone(2, duplicates(valid, "__fp"), "duplicate_content") if plan.drop_duplicates else None,
        gone(3, kept.join(capped.select("id"), "id", "left_anti"), "per_source_cap") if plan.per_source is not None else None,
        gone(4, capped.join(last.select("id"), "id", "left_anti"), "total_cap") if plan.total is not None else None,
    ]
    first = reduce(DataFrame.union, [r for r in reasons if r is not None]).groupBy("id").agg(F.min(F.struct("k", "reason")).alias("r"))
    dropped = first.orderBy("r.k", "id").limit(SAMPLES).select("id", "r.reason")
    keyed = last.withColumn("__group", grouping_key(plan.group_by))
    split = split_groups(keyed, "__group", plan.seed, plan.ratios).drop("__group")
    return Prepared(order_hash(split, plan.shuffle_seed, ["split"]), stages, dropped, issues)


def preflight(prepared: DataFrame, expect_fingerprint: str | None = None, expect_sources: dict[str, int] | None = None, expect_train: int | None = None) -> DataFrame:
    """Prepared examples (with split) -> name, passed (null where nothing was asked for), detail: checks of the data before a
    run. Sums and one digest, so that no row but these reaches the driver."""
    spark = prepared.sparkSession
    train = prepared.filter("split = 'train'")
    found = dataset_fingerprint(prepared, _fingerprint())
    rows = found.select(F.lit("fingerprint").alias("name"), F.lit(expect_fingerprint).cast("string").alias("want"), F.col("fingerprint").alias("got"))
    n = train.agg(F.count("*").cast("string").alias("got"))
    rows = rows.union(n.select(F.lit("train_examples"), F.lit(None if expect_train is None else str(expect_train)).cast("string"), "got"))
    counts = train.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    want = spark.createDataFrame(sorted((expect_sources or {}).items()), "w string, m long")
    both = counts.join(want, F.col("s") == F.col("w"), "full").select(F.concat(F.lit("source "), F.coalesce("s", "w")).alias("name"), (F.coalesce("m", F.lit(0)) if expect_sources is not None else F.lit(None)).cast("string").alias("want"), F.coalesce("n", F.lit(0)).cast("string").alias("got"))
    rows = rows.union(both)
    return rows.select("name", F.when(F.col("want").isNotNull(), F.col("want") == F.col("got")).alias("passed"), F.concat(F.lit("found "), "got", F.coalesce(F.concat(F.lit(", expected "), "want"), F.lit(""))).alias("detail"))
