"""Source records -> canonical examples, with a reason where a record is refused.

An adapter takes a DataFrame of raw records and gives the canonical columns, and rejection_reason, which is null for
adapted records. A registry names them; adapt() keeps the good ones or raises at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import derive_id, is_blank

CANONICAL = ["id", "context", "targets", "source", "topic", "grounding", "group_key", "rejection_reason"]

_blank = is_blank


def target(kind: str, question: Column, answer: Column, difficulty: str, marks: int, options: Column | None = None, index: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("question_type"), question.alias("question"), answer.alias("answer"),
        (options if options is not None else F.array().cast("array<string>")).alias("options"),
        (index if index is not None else F.lit(None)).cast("int").alias("correct_option_index"),
        F.lit(difficulty).alias("difficulty"), F.lit(marks).alias("marks"), F.lit(None).cast("string").alias("explanation"),
    )


def ground_span(context: Column, start: Column, answer: Column) -> Column:
    """The span of an answer, kept only where the context holds the answer there."""
    there = F.substring(context, start + 1, F.length(answer)) == answer
    return F.when(there, F.struct(start.cast("int").alias("char_start"), (start + F.length(answer)).cast("int").alias("char_end"), answer.alias("excerpt")))


def _finish(df: DataFrame) -> DataFrame:
    return df.select(*CANONICAL)


def adapt_squad(df: DataFrame) -> DataFrame:
    answer, start = F.get("answers.text", F.lit(0)), F.get("answers.answer_start", F.lit(0))
    reason = F.when(_blank(F.col("context")), "no context").when(_blank(F.col("question")), "no question").when(_blank(answer), "no answer")
    return _finish(
        df.withColumns(
            {
                "rejection_reason": reason,
                "targets": F.array(target("short_answer", F.col("question"), answer, "easy", 1)),
                "grounding": ground_span(F.col("context"), start, answer),
                "group_key": F.concat(F.lit("title:"), F.col("title")),
                "topic": F.col("title"),
                "source": F.lit("squad"),
                "id": F.coalesce(F.col("id").cast("string"), derive_id(F.lit("squad"), F.col("context"), F.col("question"))),
            }
        )
    )


def adapt_qag(df: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a"))
    kept = F.filter(pairs, lambda p: ~_blank(p["q"]) & ~_blank(p["a"]))
    reason = (
        F.when(_blank(F.col("paragraph")), "no context")
        .when(F.size("questions") != F.size("answers"), "questions and answers differ in number")
        .when(F.size(kept) == 0, "no pairs")
    )
    key = F.coalesce(F.col("paragraph_id"), derive_id(F.lit("qag"), F.col("paragraph")))
    return _finish(
        df.withColumns(
            {
                "rejection_reason": reason,
                "targets": F.transform(kept, lambda p: target("short_answer", p["q"], p["a"], "easy", 1)),
                "context": F.col("paragraph"),
                "id": key,
                "source": F.lit("qag"),
                "topic": F.lit(None).cast("string"),
                "grounding": F.lit(None).cast("struct<char_start:int,char_end:int,excerpt:string>"),
                "group_key": F.concat(F.lit("paragraph:"), key),
            }
        )
    )


def adapt_learningq(df: DataFrame) -> DataFrame:
    reason = F.when(_blank(F.col("context")), "no context").when(_blank(F.col("question")), "no question").when(_blank(F.col("answer")), "no written answer")
    return _finish(
        df.withColumns(
            {
                "rejection_reason": reason,
                "targets": F.array(target("long_answer", F.col("question"), F.col("answer"), "medium", 5)),
                "id": derive_id(F.lit("learningq"), F.col("context"), F.col("question")),
                "source": F.lit("learningq"),
                "topic": F.col("topic") if "topic" in df.columns else F.lit(None).cast("string"),
                "grounding": F.lit(None).cast("struct<char_start:int,char_end:int,excerpt:string>"),
                "group_key": F.when(~_blank(F.col("doc_id")), F.concat(F.lit("doc:"), F.col("doc_id"))),
            }
        )
    )


def mcq_index(options: Column, answer: Column, index: Column | None = None) -> Column:
    """An explicit index; else the one option equal to the answer but for case and outer blanks; else a letter in
    range. Null if none of them decides."""
    plain = lambda c: F.lower(F.trim(c))
    same = F.filter(F.transform(options, lambda o, i: F.when(plain(o) == plain(answer), i)), lambda i: i.isNotNull())
    letter = F.ascii(F.upper(F.trim(answer))) - 65
    by_letter = F.when(F.trim(answer).rlike("^[A-Za-z]$") & (letter < F.size(options)), letter)
    found = F.when(F.size(same) == 1, F.get(same, F.lit(0))).otherwise(by_letter)
    if index is None:
        return found.cast("int")
    return F.when(index.isNotNull(), F.when((index >= 0) & (index < F.size(options)), index)).otherwise(found).cast("int")


def adapt_mcq(df: DataFrame, fields: dict[str, str] | None = None, source: str = "mcq") -> DataFrame:
    """fields maps canonical names (context, question, options, answer, correct_index, topic, id) to those of df."""
    names = {n: n for n in ("context", "question", "options", "answer", "correct_index", "topic", "id")} | (fields or {})
    get = lambda n, kind="string": F.col(names[n]) if names[n] in df.columns else F.lit(None).cast(kind)
    context, question, options = get("context"), get("question"), get("options", "array<string>")
    index = mcq_index(options, get("answer"), get("correct_index", "int"))
    reason = (
        F.when(_blank(context), "no context").when(_blank(question), "no question")
        .when(options.isNull() | (F.size(options) < 3), "fewer than three options")
        .when(F.exists(options, _blank), "blank option").when(index.isNull(), "no correct option")
    )
    return _finish(
        df.select(
            F.coalesce(get("id").cast("string"), derive_id(F.lit(source), context, question)).alias("id"),
            context.alias("context"),
            F.array(target("mcq", question, F.get(options, index), "medium", 1, options, index)).alias("targets"),
            F.lit(source).alias("source"),
            get("topic").alias("topic"),
            F.lit(None).cast("struct<char_start:int,char_end:int,excerpt:string>").alias("grounding"),
            F.lit(None).cast("string").alias("group_key"),
            reason.alias("rejection_reason"),
        )
    )


def adapt_race(df: DataFrame) -> DataFrame:
    """Articles with letter answers. Their id stands for several questions, so it is not taken."""
    return adapt_mcq(df.drop("id"), {"context": "article"}, "race")


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "squad": adapt_squad, "qag": adapt_qag, "learningq": adapt_learningq, "mcq": adapt_mcq, "race": adapt_race,
}


def adapter_for(source: str) -> Callable[[DataFrame], DataFrame]:
    if source not in ADAPTERS:
        raise KeyError(f"no adapter for {source!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[source]


def adapt(source: str, records: DataFrame, skip_invalid: bool = True) -> DataFrame:
    """Adapted records; refused ones are left out, or are an error at run time."""
    rows = adapter_for(source)(records)
    if skip_invalid:
        return rows.filter("rejection_reason is null").drop("rejection_reason")
    why = F.raise_error(F.concat(F.lit(f"{source}: "), "rejection_reason")).cast("boolean")
    return rows.filter(F.when(F.col("rejection_reason").isNotNull(), why).otherwise(F.lit(True))).drop("rejection_reason")


def ingest_counts(adapted: DataFrame) -> DataFrame:
    """source, records_seen, adapted, rejected, rejection_rate (four decimals)."""
    bad = F.count_if(F.col("rejection_reason").isNotNull())
    return adapted.groupBy("source").agg(
        F.count("*").alias("records_seen"),
        F.count_if(F.col("rejection_reason").isNull()).alias("adapted"),
        bad.alias("rejected"),
        F.round(bad / F.count("*"), 4).alias("rejection_rate"),
    )


def rejection_samples(adapted: DataFrame, most: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    return adapted.filter("rejection_reason is not null").withColumn("rank", rank).filter(F.col("rank") <= most).select("source", "id", "rejection_reason")


def primary(field: str, targets: str = "targets") -> Column:
    """A field of an example's first target; null without targets."""
    return F.get(targets, F.lit(0))[field]


def blank_pairs(df: DataFrame) -> DataFrame:
    """One row: n_pairs of question and answer in records with parallel lists, and n_blank, those adapt_qag leaves out."""
    pairs = F.arrays_zip(F.col("questions").alias("q"), F.col("answers").alias("a"))
    blank = F.size(F.filter(pairs, lambda p: _blank(p["q"]) | _blank(p["a"])))
    fair = df.filter(F.size("questions") == F.size("answers"))
    return fair.agg(F.coalesce(F.sum(F.size(pairs)), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum(blank), F.lit(0)).alias("n_blank"))
