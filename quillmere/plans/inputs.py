"""Canonical inputs derived from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as question rows: the answer is the first word of five letters A-Z or more, the question the first
    eight words, the title the source."""
    d = table(spark, sf_dir, "documents")
    answer = F.regexp_extract("text", "[A-Za-z]{5,}", 0)
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("title"),
        F.col("text").alias("context"),
        F.array_join(F.slice(F.split("text", r"\s+", 9), 1, 8), " ").alias("question"),
        F.struct(
            F.when(answer != "", F.array(answer)).otherwise(F.array().cast("array<string>")).alias("text"),
            F.when(answer != "", F.array((F.instr(F.col("text"), answer) - 1).cast("int"))).otherwise(F.array().cast("array<int>")).alias("answer_start"),
        ).alias("answers"),
    )


SQUAD = """
squad AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, text AS context,
  array_to_string(list_slice(string_split_regex(text, '[\\t\\n\\v\\f\\r ]+'), 1, 8), ' ') AS question,
  regexp_extract(text, '[A-Za-z]{5,}', 0) AS answer,
  CASE WHEN regexp_extract(text, '[A-Za-z]{5,}', 0) <> '' THEN instr(text, regexp_extract(text, '[A-Za-z]{5,}', 0)) - 1 END AS answer_start
  FROM documents)"""


def replies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions (assistant turns) and references (the other assistant texts of the conversation)."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "text")
    every = rows.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("all"))
    refs = rows.join(every, "conv_id").select("id", F.transform(F.filter("all", lambda x: x["turn"] != F.col("turn")), lambda x: x["text"]).alias("golds"))
    return rows.select("id", F.col("text").alias("prediction")), refs


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = replies(spark, sf_dir)
    return p.join(r, "id").select("id", "prediction", F.explode("golds").alias("gold"))


PAIRS = """
turns AS (SELECT concat_ws('-', conv_id, turn) AS id, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT a.id, a.text AS prediction, b.text AS gold FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn <> b.turn)"""


def mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as multiple-choice records: the options are the regions, the answer a letter."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    options = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("options"))
    rows = n.join(F.broadcast(options))  # one row
    return rows.select(
        F.col("n_nationkey").cast("string").alias("id"),
        F.concat(F.lit("Nation "), "n_name").alias("context"),
        F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"),
        "options",
        F.char(F.col("n_regionkey") + 65).alias("answer"),
        F.lit(None).cast("int").alias("correct_index"),
        F.lit("geography").alias("topic"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a question bank."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.element_at(F.array(F.lit("mcq"), F.lit("short_answer"), F.lit("long_answer")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int")).alias("question_type"),
        F.col("p_name").alias("text"),
        F.col("p_type").alias("answer"),
        F.col("p_brand").alias("topic"),
        F.when(F.col("p_size") <= 15, "easy").when(F.col("p_size") <= 35, "medium").otherwise("hard").alias("difficulty"),
        (F.pmod("p_size", F.lit(5)) + 1).cast("int").alias("marks"),
        F.col("p_partkey").alias("pos"),
    )


BANK = """
bank AS (SELECT p_partkey AS id, ['mcq', 'short_answer', 'long_answer'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS question_type, p_name AS text, p_type AS answer,
  p_brand AS topic, CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 35 THEN 'medium' ELSE 'hard' END AS difficulty,
  CAST(p_size % 5 + 1 AS INTEGER) AS marks, p_partkey AS pos FROM part)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits of two windows of 16 positions: halves are starts and ends, values rounded to one decimal so
    that ties occur. The first two positions of a window lie outside the context."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    df = e.select(F.col("vec_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("window"), v.alias("v"))
    part = lambda at: F.slice("v", F.col("window") * 16 + at, 16)
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: (p >= 2).cast("int"))
    return df.select("id", "window", part(1).alias("start_logits"), part(33).alias("end_logits"), mask.alias("context_mask"))


LOGITS = """
lg AS (SELECT vec_id AS id, CAST(k // 16 AS INTEGER) AS "window", CAST(k % 16 AS INTEGER) AS pos, round(CAST(embedding[k + 1] AS DOUBLE), 1) AS s,
  round(CAST(embedding[k + 33] AS DOUBLE), 1) AS e, k % 16 >= 2 AS inside FROM embeddings, range(32) t(k))"""
