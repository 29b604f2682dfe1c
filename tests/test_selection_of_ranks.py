"""Percentiles by selection against sorted lists."""

import math
import random

import pytest

from quillmere.operators import stats as S


def rank(values: list, p: int):
    values = sorted(v for v in values if v is not None)
    return values[max(1, math.ceil(len(values) * p / 100)) - 1] if values else None


@pytest.mark.parametrize("kind", ["long", "double"])
def test_nearest_rank(spark, kind):
    rng = random.Random(3)
    draw = (lambda: rng.randrange(40)) if kind == "long" else (lambda: rng.uniform(-5, 5))
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice(["x", None]), draw() if rng.random() < 0.9 else None) for i in range(3000)]
    rows += [("none", "x", None), ("one", None, draw())]
    df = spark.createDataFrame(rows, f"a string, p50 string, v {kind}")  # a grouping column may have the name of a result's neighbour
    df = df.withColumnRenamed("p50", "b")
    groups: dict = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).append(v)
    percents = [0, 1, 50, 95, 100]
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in S.nearest_rank(df, "v", percents, "a", "b").collect()}
    assert got == {k: tuple(rank(v, p) for p in percents) for k, v in groups.items()}


def test_whole_table_and_nothing(spark):
    df = spark.range(1001).selectExpr("id * 0.5D as v")
    assert tuple(S.nearest_rank(df, "v", [50, 95]).first()) == (250.0, 475.0)
    assert tuple(S.nearest_rank(df.filter("false"), "v", [50]).first()) == (None,)
    r = S.token_length_summary(spark.range(0).selectExpr("cast(id as int) v"), "v").first()
    assert (r["n"], r["min_len"], r["p50"], r["total"]) == (0, None, None, None)


def test_a_group_of_all_rows_lies_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = S._ranked(spark.range(20_000).selectExpr("'g' as g", "rand(5) as v"), "v", [50, 95], ("g",))
        parts = [r["__n"] for r in ranked.filter("__n is not null").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 20_000 and max(parts) < 10_000  # no task holds the group
