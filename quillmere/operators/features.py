"""Features of question and context: prepared questions, windows with offsets and masks, labels, bundles, mask checks.

Tokens are runs without white space, here as in the rest of the library; a feature is laid out as a mark, the question,
a mark, a window of the context, a mark, so that masks and offsets mean what they mean for a model's tokenizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import align, context_budget, tiles, token_offsets, token_pieces

#: Marks in a feature: before the question, after it, at the end; as input tokens.
FIRST, BETWEEN = "[CLS]", "[SEP]"
SPECIALS = 3


def prepare_question(question: Column, offsets: Column, most: int) -> Column:
    """question without leading white space, cut after its first most tokens (offsets: those of question as it is)."""
    first = F.get(offsets, F.lit(0))["s"]
    last = F.get(offsets, F.least(F.size(offsets), F.lit(most)) - 1)["e"]
    whole = F.regexp_replace(question, r"(?U)^\s+", "")
    return F.when(F.size(offsets) > most, F.substring(question, first + 1, last - first)).otherwise(whole)


def encode_windows(df: DataFrame, max_length: int = 384, doc_stride: int = 128, max_question: int = 64) -> DataFrame:
    """Rows (id, question, context, ...) -> a row for each window: window, tokens, offsets (structs s, e into the context; null
    outside it), context_mask, sequence_ids (0 question, 1 context, null marks), char_start, char_end; other columns stay. A
    question that leaves no room for context is an error at run time; an empty context has one window without it."""
    given = df.columns
    df = df.withColumns({"__q": token_offsets(F.col("question")), "__c": token_pieces(F.col("context"))})
    df = df.withColumn("question", prepare_question(F.col("question"), F.col("__q"), max_question))
    df = df.withColumns({"__qt": F.filter(F.split("question", r"(?U)\s+"), lambda t: t != ""), "__n": F.size("__c")})
    df = df.withColumn("__budget", context_budget(max_length, SPECIALS, F.size("__qt")))
    count, step = tiles(F.col("__n"), F.col("__budget"), doc_stride)
    # windows are cut in the row and leave with their own tokens only, so a long context is not copied for each of them
    mine = lambda w: F.slice("__c", (w * F.col("__step") + 1).cast("int"), F.col("__budget"))
    df = df.withColumns({"__step": step, "__count": count.cast("int")})
    each = F.transform(F.sequence(F.lit(0), F.col("__count") - 1), lambda w: F.struct(w.alias("window"), mine(w).alias("o")))
    df = df.select(*given, "__qt", F.explode(each).alias("__w"))
    df = df.withColumns({"window": F.col("__w.window"), "__o": F.col("__w.o")})
    nq, nc = F.size("__qt"), F.size("__o")
    repeat = lambda v, n, kind: F.array_repeat(F.lit(v).cast(kind), n)
    pair = "struct<s:int,e:int>"
    mark = F.array(F.lit(BETWEEN))
    df = df.withColumns(
        {
            "tokens": F.concat(F.array(F.lit(FIRST)), F.col("__qt"), mark, F.transform("__o", lambda o: o["t"]), mark),
            "offsets": F.concat(F.array_repeat(F.lit(None).cast(pair), nq + 2), F.transform("__o", lambda o: F.struct(o["s"].cast("int").alias("s"), o["e"].cast("int").alias("e"))), F.array(F.lit(None).cast(pair))),
            "sequence_ids": F.concat(repeat(None, F.lit(1), "int"), repeat(0, nq, "int"), repeat(None, F.lit(1), "int"), repeat(1, nc, "int"), repeat(None, F.lit(1), "int")),
            "char_start": F.coalesce(F.get("__o", F.lit(0))["s"], F.lit(0)),
            "char_end": F.coalesce(F.get("__o", nc - 1)["e"], F.lit(0)),
        }
    )
    df = df.withColumn("context_mask", F.transform("sequence_ids", lambda s: F.when(s == 1, 1).otherwise(0)))
    return df.drop("__qt", "__w", "__o")


def context_range(sequence_ids: Column) -> Column:
    """Struct first, last: positions of the context's tokens; null without any."""
    first = F.array_position(sequence_ids, F.lit(1))
    last = F.size(sequence_ids) + 1 - F.array_position(F.reverse(sequence_ids), F.lit(1))
    return F.when(first > 0, F.struct((first - 1).cast("int").alias("first"), (last - 1).cast("int").alias("last")))


def mask_offsets(offsets: Column, sequence_ids: Column) -> Column:
    """offsets with null where a token is not of the context; arrays of unequal length are an error at run time."""
    masked = F.zip_with(offsets, sequence_ids, lambda o, s: F.when(s == 1, o))
    wrong = F.raise_error(F.lit("offsets and sequence ids differ in length")).cast("array<struct<s:int,e:int>>")
    return F.when(F.size(offsets) == F.size(sequence_ids), masked).otherwise(wrong)


def build_features(df: DataFrame, labels: bool = False, offsets: bool = False, **lengths: int) -> DataFrame:
    """Question rows -> features: id, window, tokens; with labels start_position, end_position and status (an answer that is
    not whole in the window is labelled 0, 0), with offsets the offsets ([0, 0] outside the context) and context_mask."""
    rows = encode_windows(df, **lengths)
    cols = [F.col("id"), F.col("window"), F.col("tokens")]
    if labels:
        start, text = F.get("answers.answer_start", F.lit(0)), F.get("answers.text", F.lit(0))
        rows = rows.withColumns({"answer_start": start, "answer_end": start + F.length(text), "__all": F.col("offsets")})
        # the window's own tokens are aligned; positions then move behind the question
        inside = F.filter("__all", lambda o: o.isNotNull())
        rows = rows.withColumns({"first": F.lit(0), "last": F.size(inside), "offsets": inside})
        rows = align(rows).withColumns({"offsets": F.col("__all"), "__front": context_range(F.col("sequence_ids"))["first"]})
        place = lambda c: F.when(F.col("status") == "aligned", F.col(c) + F.col("__front")).otherwise(0).cast("int")
        cols += [place("start_token").alias("start_position"), place("end_token").alias("end_position"), F.col("status")]
    if offsets:
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))
        cols += [F.transform("offsets", lambda o: F.coalesce(o, zero)).alias("offset_mapping"), F.col("context_mask")]
    return rows.select(*cols)


def train_features(df: DataFrame, **lengths: int) -> DataFrame:
    return build_features(df, labels=True, **lengths)


def eval_features(df: DataFrame, **lengths: int) -> DataFrame:
    return build_features(df, offsets=True, **lengths)


def validation_features(df: DataFrame, **lengths: int) -> DataFrame:
    return build_features(df, labels=True, offsets=True, **lengths)


def inference_features(df: DataFrame, **lengths: int) -> DataFrame:
    """Features without labels whose offsets are null outside the context, as decoding reads them."""
    rows = encode_windows(df, **lengths)
    return rows.select("id", "window", "tokens", mask_offsets(F.col("offsets"), F.col("sequence_ids")).alias("offsets"), "context_mask")


def feature_bundle(df: DataFrame, kind: str, **lengths: int) -> tuple[DataFrame, DataFrame]:
    """The columns a model reads, and beside them what scoring needs, by id and window: status for training, offsets and masks
    for evaluation, both for validation."""
    both = {"train": train_features, "eval": eval_features, "validation": validation_features}[kind](df, **lengths)
    model = ["tokens"] + [c for c in ("start_position", "end_position") if c in both.columns]
    rest = [c for c in both.columns if c not in model and c not in ("id", "window")]
    return both.select("id", "window", *model), both.select("id", "window", *rest)


def with_examples(features: DataFrame, examples: DataFrame) -> DataFrame:
    """features with context and golds of their examples."""
    return features.join(examples.select("id", "context", "golds"), "id")


def inspect_masks(df: DataFrame, max_length: int) -> DataFrame:
    """Rows (id, input_ids, completion_mask, which may be null) -> checks, each true, false, or null where it cannot be told."""
    n, mask = F.size("input_ids"), F.col("completion_mask")
    aligned = mask.isNotNull() & (F.size(mask) == n)
    marked = F.when(aligned, F.filter(F.transform(mask, lambda m, i: F.when(m != 0, i)), lambda i: i.isNotNull()))
    df = df.withColumn("__m", marked)
    some = F.size("__m") > 0
    first, last = F.get("__m", F.lit(0)), F.get("__m", F.size("__m") - 1)
    return df.select(
        "id", mask.isNotNull().alias("mask_present"), aligned.alias("mask_aligned"), F.when(aligned, some).alias("mask_not_empty"), F.when(some, last - first + 1 == F.size("__m")).alias("mask_contiguous"),
        F.when(some, first > 0).alias("mask_excludes_first"), F.when(some, last == n - 1).alias("mask_reaches_end"), (n < max_length).alias("within_max_length"),
        F.when(aligned, F.size("__m")).alias("completion_tokens"), F.when(aligned, n - F.size("__m")).alias("prompt_tokens"),
    )
