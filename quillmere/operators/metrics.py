"""Exact match and token F1, for pairs, questions with several gold answers, and corpora."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, normalize_answer, numbered_runs
from ..session import ship
from .paper import FIELDS, TARGET_ENUMS, TARGET_REQUIRED, TARGET_SCHEMA, strict_decode


def exact_match(prediction: Column, golds: Column) -> Column:
    """1.0 if any gold answer is equal after normalization; no gold answers give 0.0."""
    p = normalize_answer(prediction)
    return F.exists(golds, lambda g: normalize_answer(g) == p).cast("double")


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets, given as numbered_tokens(): both empty give 1.0, one empty 0.0."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2.0 * shared / (F.size(a) + F.size(b)))


def with_tokens(df: DataFrame, **columns: str) -> DataFrame:
    """df with, for each name given, the normalized text of a column (name_norm) and its tokens numbered by how often they
    came before (name_tokens): as sets of these, texts intersect as multisets of tokens, in linear time."""
    df = df.withColumns({f"{n}_norm": normalize_answer(F.col(c)) for n, c in columns.items()})
    df = df.withColumns({f"{n}_sorted": F.array_sort(F.filter(F.split(f"{n}_norm", " "), lambda x: x != "")) for n in columns})
    for n in columns:
        df = numbered_runs(df, f"{n}_sorted", f"{n}_tokens")
    return df.drop(*[f"{n}_sorted" for n in columns])


def pair_scores(pairs: DataFrame) -> DataFrame:
    """id, prediction, gold (a row for each gold answer) with em and f1."""
    df = with_tokens(pairs, __p="prediction", __g="gold")
    em = (F.col("__p_norm") == F.col("__g_norm")).cast("double")
    return df.withColumn("em", em).withColumn("f1", overlap_f1(F.col("__p_tokens"), F.col("__g_tokens"))).select(*pairs.columns, "em", "f1")


def example_scores(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """id, em, f1: the best over gold answers. References drive: one without a prediction is an error at run time, one
    without gold answers scores 0.0."""
    p = predictions.select("id", "prediction", F.lit(True).alias("__there"))
    df = references.join(p, "id", "left")
    df = df.withColumn("prediction", F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("prediction")))
    rows = df.select("id", "prediction", F.explode_outer("golds").alias("gold"))
    scored = pair_scores(rows)
    return scored.groupBy("id").agg(F.coalesce(F.max("em"), F.lit(0.0)).alias("em"), F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1"))


def corpus_scores(scores: DataFrame) -> DataFrame:
    """One row: exact_match and f1 in percent, total_examples."""
    mean = lambda c: F.coalesce(F.avg(c) * 100, F.lit(0.0))
    return scores.agg(mean("em").alias("exact_match"), mean("f1").alias("f1"), F.count("*").alias("total_examples"))


def generation_rows(rows: DataFrame) -> DataFrame:
    """id, source, prediction (JSON) and reference (a target struct) -> indicators of one row each: json_valid, schema_valid,
    and for valid ones question_type, difficulty and marks matches, answer_em, answer_f1, question_f1 and option_count
    matches (only where the reference has options). Any JSON is valid; the schema asks for an object with known keys,
    those required, and known enum values."""
    text = F.col("prediction")
    decoded = strict_decode(rows.withColumn("__json", F.try_parse_json(text)), "prediction", TARGET_SCHEMA, list(FIELDS), list(TARGET_REQUIRED), TARGET_ENUMS)
    r = F.col("reference")
    df = decoded.withColumn("__ok", F.col("__json").isNotNull() & F.col("problem").isNull())
    df = with_tokens(df.withColumns({"__pa": F.col("value.answer"), "__ra": r["answer"], "__pq": F.col("value.question"), "__rq": r["question"]}), __a="__pa", __b="__ra", __c="__pq", __d="__rq")
    one = lambda c: F.when(F.col("__ok"), F.coalesce(c, F.lit(False)).cast("double")).otherwise(0.0)
    score = lambda c: F.when(F.col("__ok"), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    options = F.when(F.size(r["options"]) > 0, F.coalesce(F.size("value.options"), F.lit(0)) == F.size(r["options"]))
    return df.select(
        "id", "source", r["question_type"].alias("question_type"), F.col("__json").isNotNull().cast("double").alias("json_valid"), F.col("__ok").cast("double").alias("schema_valid"),
        one(F.col("value.question_type") == r["question_type"]).alias("question_type_matches"), one(F.col("value.difficulty") == r["difficulty"]).alias("difficulty_matches"),
        one(F.col("value.marks") == r["marks"]).alias("marks_matches"), one(F.col("__a_norm") == F.col("__b_norm")).alias("answer_em"),
        score(overlap_f1(F.col("__a_tokens"), F.col("__b_tokens"))).alias("answer_f1"), score(overlap_f1(F.col("__c_tokens"), F.col("__d_tokens"))).alias("question_f1"),
        one(options).alias("option_count_matches"),
    )


def generation_scores(rows: DataFrame) -> DataFrame:
    """generation_rows() -> scope (all, source, type), value, n and the mean of each indicator (six decimals), in one pass."""
    names = [c for c in rows.columns if c not in ("id", "source", "question_type")]
    rates = [F.round(F.sum(c) / F.count("*"), 6).alias(c) for c in names]
    by = rows.groupingSets([[], [F.col("source")], [F.col("question_type")]], "source", "question_type")
    out = by.agg(F.grouping("source").alias("__s"), F.grouping("question_type").alias("__t"), F.count("*").alias("n"), *rates)
    scope = F.when(F.col("__s") == 0, "source").when(F.col("__t") == 0, "type").otherwise("all")
    return out.select(scope.alias("scope"), F.when(F.col("__s") == 0, F.col("source")).otherwise(F.col("question_type")).alias("value"), "n", *names)


def cross_check(ours: DataFrame, other: DataFrame, limit: float = 0.01) -> DataFrame:
    """Two rows of corpus scores -> their differences, and whether both are below the limit."""
    o = other.select(F.col("exact_match").alias("__em"), F.col("f1").alias("__f1"))
    df = ours.crossJoin(F.broadcast(o))  # one row each
    df = df.withColumns({"exact_match_delta": F.round(F.abs(F.col("exact_match") - F.col("__em")), 6), "f1_delta": F.round(F.abs(F.col("f1") - F.col("__f1")), 6)})
    return df.withColumn("agrees", (F.col("exact_match_delta") < limit) & (F.col("f1_delta") < limit)).drop("__em", "__f1")


def plain_scores(df: DataFrame) -> DataFrame:
    """prediction, golds -> one row: exact_match and f1 in percent, by a loop over tokens in Python. A second scorer, which
    shares no code with the first, to hold that against; a row without golds scores 0."""
    ship(df.sparkSession)

    def tokens(text: str | None) -> list[str]:
        bare = "".join(c for c in (text or "").lower() if c not in PUNCTUATION)
        return re.sub(r"\b(a|an|the)\b", " ", bare).split()

    def f1(p: list[str], g: list[str]) -> float:
        shared = (Counter(p) & Counter(g)).total()
        if not p or not g:
            return float(p == g)
        return 2 * shared / (len(p) + len(g))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(tokens(p), [tokens(g) for g in golds or []]) for p, golds in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            em, f = [max([float(p == g) for g in gs], default=0.0) for p, gs in rows], [max([f1(p, g) for g in gs], default=0.0) for p, gs in rows]
            yield pa.RecordBatch.from_arrays([pa.array(em, pa.float64()), pa.array(f, pa.float64())], names=["em", "f1"])

    each = df.select("prediction", "golds").mapInArrow(work, "em double, f1 double")
    return each.agg((F.avg("em") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1"))


def zip_align(predictions: DataFrame, references: DataFrame, sources: DataFrame | None = None, pos: str = "pos") -> DataFrame:
    """Rows put side by side by position. A position that one side lacks is an error at run time."""
    out = predictions.withColumn("__p", F.lit(True))
    for k, other in enumerate([references, *([sources] if sources is not None else [])]):
        out = out.join(other.withColumn(f"__o{k}", F.lit(True)), pos, "full")
    marks = [c for c in out.columns if c.startswith("__")]
    whole = F.col(marks[0]).isNotNull()
    for m in marks[1:]:
        whole = whole & F.col(m).isNotNull()
    wrong = F.raise_error(F.concat(F.lit("one side has no row at "), F.col(pos).cast("string"))).cast("boolean")
    return out.filter(F.when(whole, F.lit(True)).otherwise(wrong)).drop(*marks)
