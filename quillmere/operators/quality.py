"""Validation of canonical examples: rules report issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import example_fingerprint, fold, is_blank, strip

KINDS = ("mcq", "true_false", "fill_blank", "short_answer", "long_answer", "match", "case")
LEVELS = ("easy", "medium", "hard")
SQUAD_COLUMNS = ("id", "title", "context", "question", "answers")
NO_TARGET = "cast(null as int)"


def issue(when: Column, code: str, severity: str = "error") -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def found(rules: list[Column]) -> Column:
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def _rows(df: DataFrame, rules: list[Column], *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(found(rules)).alias("i")).select(*keys, "i.code", "i.severity")


def check_schema(df: DataFrame, split: str = "unknown") -> DataFrame:
    """df, if it has the columns of question rows, answers with arrays text and answer_start, and a row; else an error."""
    missing = [c for c in SQUAD_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"split {split}: no columns {', '.join(missing)}; there are {', '.join(df.columns)}")
    kind = df.schema["answers"].dataType
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    wrong = [n for n in ("text", "answer_start") if not isinstance(fields.get(n), T.ArrayType)]
    if wrong:
        raise ValueError(f"split {split}: answers must hold arrays, and lacks {', '.join(wrong)}")
    if df.isEmpty():
        raise ValueError(f"split {split} has no rows")
    return df


def example_rules(least: int, most: int) -> list[Column]:
    c = F.col("context")
    return [
        issue(is_blank(c), "empty_context"),
        issue(~is_blank(c) & (F.length(c) < least), "context_too_short"),
        issue(~is_blank(c) & (F.length(c) > most), "context_too_long"),
        issue(F.coalesce(F.size("targets"), F.lit(0)) <= 0, "no_targets"),
    ]


def mcq_rules(options: Column, at: Column, answer: Column, when: Column | None = None) -> list[Column]:
    """Options are compared stripped and in lower case; blank ones neither repeat nor answer anything."""
    when = F.lit(True) if when is None else when
    filled = F.filter(options, lambda o: ~is_blank(o))
    plain = F.transform(filled, fold)
    inside = at.isNotNull() & (at >= 0) & (at < F.size(options))
    return [
        issue(when & (F.size(options) < 3), "too_few_options"),
        issue(when & F.exists(options, is_blank), "blank_option"),
        issue(when & (F.size(F.array_distinct(plain)) < F.size(plain)), "repeated_option"),
        issue(when & ~inside, "index_out_of_range"),
        issue(when & inside & ~is_blank(answer) & (fold(F.get(options, at)) != fold(answer)), "answer_not_option"),
    ]


def marks_rule(marks: Column) -> Column:
    """Marks are positive whole numbers; the column's type rules out others."""
    return issue(marks.isNull() | (marks <= 0), "invalid_marks")


def target_rules(t: Column, context: Column) -> list[Column]:
    """Rules for a target (a struct) of an example with this context."""
    mcq, opts, answer = t["question_type"] == "mcq", t["options"], t["answer"]
    return [
        issue(is_blank(t["question"]), "empty_question"),
        issue(is_blank(answer), "empty_answer"),
        issue(t["question_type"].isNull() | ~t["question_type"].isin(*KINDS), "unknown_type"),
        issue(t["difficulty"].isNull() | ~t["difficulty"].isin(*LEVELS), "unknown_difficulty"),
        marks_rule(t["marks"]),
        issue(~mcq & (F.size(opts) > 0), "unexpected_options", "warning"),
        *mcq_rules(opts, t["correct_option_index"], answer, mcq),
        issue(
            t["question_type"].isin("short_answer", "fill_blank") & ~is_blank(answer) & ~F.contains(F.lower(context), F.lower(strip(answer))),
            "answer_not_in_context", "warning",
        ),
    ]


def validate_examples(df: DataFrame, least: int = 64, most: int = 8000) -> DataFrame:
    """example_id, target_index (null), code, severity for context and targets."""
    rows = df.withColumn("example_id", F.col("id")).withColumn("target_index", F.expr(NO_TARGET))
    return _rows(rows, example_rules(least, most), "example_id", "target_index")


def _targets(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("example_id"), "context", F.posexplode("targets").alias("target_index", "t"))


def validate_targets(df: DataFrame) -> DataFrame:
    return _rows(_targets(df), target_rules(F.col("t"), F.col("context")), "example_id", "target_index")


def config_filters(df: DataFrame, sources: list[str], kinds: list[str], levels: list[str], grounded: bool = False) -> DataFrame:
    """Values outside allow-lists are warnings: reported, never dropped. Missing grounding is an error if asked for."""
    t = _targets(df).select("example_id", "target_index", "t.*")
    one = _rows(df.select(F.col("id").alias("example_id"), F.lit(None).cast("int").alias("target_index"), "source", "grounding"), [
        issue(~F.col("source").isin(*sources), "unknown_source", "warning"), *([issue(F.col("grounding").isNull(), "ungrounded")] if grounded else [])
    ], "example_id", "target_index")
    two = _rows(t, [issue(~F.col("question_type").isin(*kinds), "type_not_allowed", "warning"), issue(~F.col("difficulty").isin(*levels), "difficulty_not_allowed", "warning")], "example_id", "target_index")
    return one.unionByName(two)


def duplicate_issues(df: DataFrame, fingerprint: Column | None = None) -> DataFrame:
    """Repeated ids (errors) and repeated contents (warnings), each reported once, on the least id. One pass and one
    shuffle: an example is counted under its id and under its fingerprint (a column of df, where that was made before)."""
    fingerprint = example_fingerprint(F.col("context"), F.col("targets")) if fingerprint is None else fingerprint
    as_key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key"))
    keys = F.array(as_key("duplicate_id", F.col("id")), as_key("duplicate_content", fingerprint))
    rows = df.select("id", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.min("id").alias("example_id"), F.count("*").alias("n")).filter("n > 1")
    severity = F.when(F.col("kind") == "duplicate_id", "error").otherwise("warning")
    return rows.select("example_id", F.expr(NO_TARGET).alias("target_index"), F.col("kind").alias("code"), severity.alias("severity"))


def validate_dataset(df: DataFrame, least: int = 64, most: int = 8000, fingerprint: Column | None = None) -> DataFrame:
    """example_id, target_index, code, severity: the rules for examples and for targets, read off in one pass, and repeats. A
    dataset without examples has one issue, empty_dataset, on no example."""
    none = F.expr(NO_TARGET)
    of_example = F.transform(found(example_rules(least, most)), lambda i: F.struct(none.alias("target_index"), i["code"].alias("code"), i["severity"].alias("severity")))
    each = lambda t, k: F.transform(found(target_rules(t, F.col("context"))), lambda i: F.struct(k.alias("target_index"), i["code"].alias("code"), i["severity"].alias("severity")))
    of_targets = F.flatten(F.transform(F.coalesce("targets", F.expr("slice(targets, 1, 0)")), each))
    rows = df.select(F.col("id").alias("example_id"), F.explode(F.concat(of_example, F.coalesce(of_targets, F.slice(of_example, 1, 0)))).alias("i")).select("example_id", "i.*")
    empty = df.agg(F.count("*").alias("n")).filter("n = 0")
    empty = empty.select(F.lit(None).cast(df.schema["id"].dataType).alias("example_id"), none.alias("target_index"), F.lit("empty_dataset").alias("code"), F.lit("error").alias("severity"))
    return rows.unionByName(duplicate_issues(df, fingerprint)).unionByName(empty)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


def code_rollup(issues: DataFrame) -> DataFrame:
    """severity, code, n: by both, by severity alone and in all (null stands for every value)."""
    return issues.rollup("severity", "code").agg(F.count("*").alias("n")).select("severity", "code", "n")


def drop_invalid(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Examples without an error; warnings stay."""
    bad = issues.filter("severity = 'error'").select(F.col("example_id").alias("id")).distinct()
    return df.join(bad, "id", "left_anti")


def offset_class(context: Column, start: Column, answer: Column) -> Column:
    """exact, whitespace_only, mismatch or no_answer."""
    cut = F.substring(context, start + 1, F.length(answer))
    return F.when(answer.isNull() | (answer == "") | start.isNull(), "no_answer").when(cut == answer, "exact").when(strip(cut) == strip(answer), "whitespace_only").otherwise("mismatch")


def verify_offsets(df: DataFrame) -> DataFrame:
    """context, start, answer -> class, n."""
    return df.groupBy(offset_class(F.col("context"), F.col("start"), F.col("answer")).alias("class")).agg(F.count("*").alias("n"))


def offset_report(df: DataFrame, samples: int = 5) -> DataFrame:
    """id, context, start, answer -> one row: checked, a count of each class, the part that is exact among rows with an
    answer (six decimals) and the least ids that do not match."""
    rows = df.select("id", offset_class(F.col("context"), F.col("start"), F.col("answer")).alias("c"))
    n = {c: F.count_if(F.col("c") == c) for c in ("exact", "whitespace_only", "mismatch", "no_answer")}
    counts = rows.agg(F.count("*").alias("checked"), *[v.alias(k) for k, v in n.items()])
    ids = rows.filter("c = 'mismatch'").orderBy("id").limit(samples).agg(F.sort_array(F.collect_list("id")).alias("samples"))
    rate = F.round(F.col("exact") / F.nullif(F.col("checked") - F.col("no_answer"), F.lit(0)), 6)
    return counts.withColumn("exact_rate", rate).crossJoin(F.broadcast(ids))  # one row each


def require_answers(df: DataFrame, answers: str = "answers.text", sample_size: int | None = None, order: str = "id") -> DataFrame:
    """df; a row without an answer, among the first sample_size by order if that is given, is an error at run time."""
    wrong = F.raise_error(F.lit("a row has no answer")).cast("boolean")
    bare = F.coalesce(F.size(answers), F.lit(0)) <= 0
    if sample_size is not None:
        first = df.orderBy(order).limit(sample_size)
        if not first.filter(bare).isEmpty():
            raise ValueError(f"one of the first {sample_size} rows has no answer")
        return df
    return df.filter(F.when(bare, wrong).otherwise(F.lit(True)))


def audit_dataset(df: DataFrame, key: str, limit: float = 0.01) -> DataFrame:
    """Findings about a split dataset (split, source, key, n_tokens, truncated): finding, detail. Splits without a row are
    findings, too."""
    leaks = df.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(F.lit("leakage").alias("finding"), F.col(key).cast("string").alias("detail"))
    # the splits are three at most, so each source's set and the list of all are small
    every = df.filter("split <> 'train'").agg(F.collect_set("split").alias("every"))
    stands = df.groupBy("source").agg(F.collect_set("split").alias("has")).filter(F.array_contains("has", "train"))
    missing = stands.crossJoin(F.broadcast(every)).select("source", F.explode(F.array_except("every", "has")).alias("split"))  # one row
    missing = missing.select(F.lit("source_missing").alias("finding"), F.concat_ws("/", "split", "source").alias("detail"))
    present = df.agg(F.collect_set("split").alias("has"))
    bare = present.select(F.lit("empty_split").alias("finding"), F.explode(F.array_except(F.array(*map(F.lit, ("train", "validation", "test"))), "has")).alias("detail"))
    empty = df.filter("n_tokens = 0").groupBy().agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("zero_tokens").alias("finding"), F.col("n").cast("string").alias("detail"))
    cut = df.groupBy("split").agg(F.avg(F.col("truncated").cast("double")).alias("r")).filter(F.col("r") > limit)
    return leaks.union(missing).union(bare).union(empty).union(cut.select(F.lit("truncation").alias("finding"), F.col("split").alias("detail")))
