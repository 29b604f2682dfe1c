"""Overlapping context windows, answer alignment and n-best span decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tighten_span
from ..session import ship
from .metrics import corpus_scores, cross_check, example_scores

WORD = re.compile(r"\S+")
OFFSETS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def offsets_of(texts: list[str | None]) -> pa.Array:
    """White-space tokens of texts as lists of structs (s, e), built from flat numbers."""
    found = [[m.span() for m in WORD.finditer(t)] if t is not None else [] for t in texts]
    flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["s", "e"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=pa.array([t is None for t in texts]))


@F.arrow_udf(OFFSETS)
def token_offsets(text: pa.Array) -> pa.Array:
    """White-space tokens of a text as structs (s, e). Columns can only build these by appending to a growing array."""
    return offsets_of(text.to_pylist())


PIECES = T.ArrayType(T.StructType([*OFFSETS.elementType.fields, T.StructField("t", T.StringType())]))


@F.arrow_udf(PIECES)
def token_pieces(text: pa.Array) -> pa.Array:
    """White-space tokens of a text as structs (s, e, t), t the token itself: cutting it out by its place would walk through
    the text from its start, for each token anew."""
    texts = text.to_pylist()
    pairs = offsets_of(texts)
    words = pa.array([w for t in texts if t is not None for w in WORD.findall(t)], pa.string())
    flat = pa.StructArray.from_arrays([*pairs.values.flatten(), words], ["s", "e", "t"])
    return pa.ListArray.from_arrays(pairs.offsets, flat, mask=pairs.is_null())


def context_budget(max_length: int, specials: int, question_tokens: Column) -> Column:
    """Tokens left for the context; none left is an error at run time."""
    left = F.lit(max_length - specials) - question_tokens
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("the question leaves no room for context")).cast("int"))


def tiles(n: Column, budget: Column, doc_stride: int) -> tuple[Column, Column]:
    """How many windows n tokens have, and how many tokens lie between the starts of two."""
    step = budget - F.least(F.lit(doc_stride), budget - 1)
    return F.when(n <= budget, 1).otherwise(F.ceil((n - budget) / step) + 1), step


def tile_windows(df: DataFrame, n: str, budget: str, doc_stride: int) -> DataFrame:
    """A row for each window of a context of n tokens: window, first, last (exclusive). Neighbours share
    min(doc_stride, budget - 1) tokens; an empty context has one empty window."""
    count, step = tiles(F.col(n), F.col(budget), doc_stride)
    df = df.withColumn("window", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    first = F.col("window") * step
    return df.withColumn("first", first.cast("int")).withColumn("last", F.least(F.col("first") + F.col(budget), F.col(n)).cast("int"))


def align(df: DataFrame) -> DataFrame:
    """Rows with window, first, last, offsets (array of s, e for all tokens), answer_start, answer_end -> status, and
    start_token, end_token inside aligned windows: the window must hold the whole answer; the first token is the last
    one that starts at or before it, the last token the first that ends at or after it."""
    mine = F.slice("offsets", F.col("first") + 1, F.col("last") - F.col("first"))
    df = df.withColumn("__o", mine)
    low, high = F.get("__o", F.lit(0))["s"], F.get("__o", F.size("__o") - 1)["e"]
    start = F.size(F.filter("__o", lambda o: o["s"] <= F.col("answer_start"))) - 1
    end = F.size("__o") - F.size(F.filter("__o", lambda o: o["e"] >= F.col("answer_end")))
    status = (
        F.when(F.col("answer_start").isNull(), "no_answer")
        .when(F.size("__o") == 0, "empty_window")
        .when((low > F.col("answer_start")) | (high < F.col("answer_end")), "outside")
        .otherwise("aligned")
    )
    ok = F.col("status") == "aligned"
    return df.withColumn("status", status).withColumn("start_token", F.when(ok, start)).withColumn("end_token", F.when(ok, end)).drop("__o")


def alignment_report(df: DataFrame, id_: str = "id") -> DataFrame:
    """One row: windows by status, examples without an aligned window, aligned part of examples."""
    per = df.groupBy(id_).agg(F.bool_or(F.col("status") == "aligned").alias("ok"), F.count("*").alias("n"), F.count_if(F.col("status") == "aligned").alias("a"))
    return per.agg(
        F.sum("n").alias("n_windows"), F.sum("a").alias("n_aligned"), F.count_if(~F.col("ok")).alias("n_unaligned_examples"),
        F.round(F.count_if("ok") / F.count("*"), 6).alias("aligned_fraction"),
    )


def _shortlist(values: str, n_best: int) -> Column:
    """The n_best largest of an array as structs (pos, score, rank), best first, ties to the earlier place; null has none."""
    every = F.filter(F.transform(values, lambda v, i: F.struct((-v).alias("k"), i.alias("pos"))), lambda x: x["k"].isNotNull())
    best = F.slice(F.sort_array(every), 1, n_best)
    return F.transform(best, lambda x, r: F.struct(x["pos"].alias("pos"), (-x["k"]).alias("score"), (r + 1).alias("rank")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_candidates(n_best: int = 20, max_length: int = 30) -> Column:
    """Of a row with start_logits, end_logits and context_mask, the candidate spans as an array of structs (start, end,
    start_rank, end_rank, score). The n_best starts and ends are listed first; only then pairs that end before they start, or
    are longer than max_length, or lie outside the context (mask other than 1) fall away. All in the row. Arrays of unequal
    length are an error at run time."""
    if n_best <= 0 or max_length <= 0:
        raise ValueError("n_best and max_length must be positive")
    n = F.size("start_logits")
    same = (F.size("end_logits") == n) & (F.size("context_mask") == n)
    inside = lambda listed: F.filter(listed, lambda x: F.get("context_mask", x["pos"]) == 1)
    both = F.struct(inside(_shortlist("start_logits", n_best)).alias("s"), inside(_shortlist("end_logits", n_best)).alias("e"))

    def pairs(b: Column) -> Column:
        def of(s: Column) -> Column:
            ends = F.filter(b["e"], lambda e: (e["pos"] >= s["pos"]) & (e["pos"] - s["pos"] < max_length))
            return F.transform(ends, lambda e: F.struct(s["pos"].alias("start"), e["pos"].alias("end"), s["rank"].alias("start_rank"), e["rank"].alias("end_rank"), (s["score"] + e["score"]).alias("score")))

        return F.flatten(F.transform(b["s"], of))

    checked = F.when(same, both).otherwise(F.raise_error(F.lit("logits and mask differ in length")).cast(_BOTH))
    return F.when(n > 0, let(checked, pairs))


_ONE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
_BOTH = T.StructType([T.StructField("s", _ONE), T.StructField("e", _ONE)])


def candidates(windows: DataFrame, n_best: int = 20, max_length: int = 30) -> DataFrame:
    """(id, window, start_logits, end_logits, context_mask) -> (id, window, start, end, start_rank, end_rank, score), see
    window_candidates()."""
    return windows.select("id", "window", F.inline(window_candidates(n_best, max_length)))


def softmax(df: DataFrame, score: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def decode(windows: DataFrame, n_best: int = 20, max_length: int = 30, most: int = 10) -> DataFrame:
    """(id, window, start_logits, end_logits, context_mask) -> id, rank, window, start, end, probability: the best spans of each
    example over all its windows: one softmax, then by score, window, start and rank of the end.

    A window leaves its greatest score, the sum of its exponentials and its best spans; only these are pooled by example. An
    example without a candidate has no row."""
    own = windows.select("id", "window", window_candidates(n_best, max_length).alias("c")).filter("size(c) > 0")
    # the array is made before it is looked at three times
    one = let(F.col("c"), lambda c: let(F.array_max(F.transform(c, lambda x: x["score"])), lambda m: F.struct(m.alias("m"), c.alias("c"))))
    best = lambda c: F.slice(F.sort_array(F.transform(c, lambda x: F.struct((-x["score"]).alias("k"), x["start"].alias("start"), x["end_rank"].alias("end_rank"), x["end"].alias("end")))), 1, most)
    summary = let(one, lambda w: F.struct(F.col("window").alias("window"), w["m"].alias("m"), F.aggregate(w["c"], F.lit(0.0), lambda a, x: a + F.exp(x["score"] - w["m"])).alias("z"), best(w["c"]).alias("best")))
    pooled = own.select("id", summary.alias("w")).groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    top = F.array_max(F.transform("w", lambda x: x["m"]))
    pooled = pooled.withColumn("__m", top).withColumn("__z", F.aggregate("w", F.lit(0.0), lambda a, x: a + x["z"] * F.exp(x["m"] - F.col("__m"))))
    spans = F.flatten(F.transform("w", lambda x: F.transform(x["best"], lambda b: F.struct(b["k"].alias("k"), x["window"].alias("window"), b["start"].alias("start"), b["end_rank"].alias("end_rank"), b["end"].alias("end")))))
    rows = pooled.select("id", "__m", "__z", F.posexplode(F.slice(F.sort_array(spans), 1, most)).alias("r", "x"))
    return rows.select("id", (F.col("r") + 1).alias("rank"), "x.window", "x.start", "x.end", (F.exp(-F.col("x.k") - F.col("__m")) / F.col("__z")).alias("probability"))


def answers(examples: DataFrame, features: DataFrame, ranked: DataFrame) -> DataFrame:
    """examples (id, context), features (id, window, offsets with a struct or null a position) and decode() -> a row for each
    example: has_answer, answer, char_start, char_end, score, n_windows, and n_best, structs by rank. Texts are cut from
    the context and tightened. An example without a span has has_answer false, an empty answer and score 0."""
    spans = ranked.join(features.select("id", "window", "offsets"), ["id", "window"])
    spans = spans.select("id", "rank", "window", "start", "end", "probability", F.get("offsets", F.col("start"))["s"].alias("cs"), F.get("offsets", F.col("end"))["e"].alias("ce"))
    spans = spans.join(examples.select("id", "context"), "id")
    tight = tighten_span(F.col("context"), F.col("cs"), F.col("ce"))
    spans = spans.withColumn("__t", tight).withColumns({"char_start": F.col("__t.start"), "char_end": F.col("__t.end")})
    text = F.substring("context", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    one = F.struct("rank", text.alias("text"), "char_start", "char_end", F.col("probability").alias("score"), F.col("start").alias("token_start"), F.col("end").alias("token_end"), "window")
    best = spans.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("n_best"))  # as many as decode() leaves
    n = features.groupBy("id").agg(F.count("*").alias("n_windows"))
    rows = examples.select("id").join(best, "id", "left").join(n, "id", "left")
    first = F.get("n_best", F.lit(0))
    return rows.select(
        "id", F.col("n_best").isNotNull().alias("has_answer"), F.coalesce(first["text"], F.lit("")).alias("answer"), F.coalesce(first["char_start"], F.lit(0)).alias("char_start"),
        F.coalesce(first["char_end"], F.lit(0)).alias("char_end"), F.coalesce(first["score"], F.lit(0.0)).alias("score"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("n_best", F.array().cast(best.schema["n_best"].dataType)).alias("n_best"),
    )


def unaligned(windows: DataFrame, id_: str = "id") -> DataFrame:
    """Ids without an aligned window."""
    return windows.groupBy(id_).agg(F.bool_or(F.col("status") == "aligned").alias("ok")).filter("not ok").select(id_)


def evaluate(examples: DataFrame, features: DataFrame, windows: DataFrame, n_best: int = 20, max_length: int = 30, other: DataFrame | None = None) -> DataFrame:
    """examples (id, context, golds), features (id, window, offsets), windows with logits (see decode()) -> one row: exact_match,
    f1, total_examples, total_features, examples_without_answer; with other, a second scorer's row, also cross_check()."""
    found = answers(examples, features, decode(windows, n_best, max_length))
    scores = corpus_scores(example_scores(found.select("id", F.col("answer").alias("prediction")), examples.select("id", "golds")))
    facts = found.agg(F.count_if(~F.col("has_answer")).alias("examples_without_answer"), F.coalesce(F.sum("n_windows"), F.lit(0)).alias("total_features"))
    out = scores.crossJoin(F.broadcast(facts))  # one row each
    return out if other is None else cross_check(out, other)


def collect_logits(features: DataFrame, forward: Callable[[dict[str, list]], tuple[list, list]], columns: list[str], batch: int = 32) -> DataFrame:
    """features (id, window and the model's columns) -> id, window, start_logits, end_logits: forward is a model's pass over a
    batch (lists by column), made once for each task's batches; no model is part of this library."""
    ship(features.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                starts, ends = forward({c: part.column(i + 2).to_pylist() for i, c in enumerate(columns)})
                lists = [pa.array(x, pa.list_(pa.float64())) for x in (starts, ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["id", "window", "start_logits", "end_logits"])

    kind = features.schema["id"].dataType.simpleString()
    rows = features.select("id", F.col("window").cast("int").alias("window"), *columns)
    return rows.mapInArrow(work, f"id {kind}, window int, start_logits array<double>, end_logits array<double>")
