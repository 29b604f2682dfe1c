"""A corpus pipeline: documents in, token ids of a clean weighted mix out.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import mixing, ngram_join, secrets, spm, toxicity
from quillmere.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labels, scores below the toxic limit."""
    labels = table(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels)
    return toxicity.score(docs.select(*COLUMNS), machine).filter(F.col("score") < toxicity.TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the least doc_id, rows without a doc_id last. Texts without words
    all stay; of rows with one doc_id and one text, one stays."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret that the scan finds replaced by a mark, and n_chars of the new text."""
    model = secrets.train(docs.select("doc_id", "text"))
    return secrets.redact(docs.select(*COLUMNS), model).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weighted mix takes them: not, once or twice. Rows that are alike in doc_id, source and text
    share their passes; what is left over is given to one of them, so the mix takes as many words as it says."""
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumns({"__size": mixing.n_words(F.col("text")), "__text": F.xxhash64("text")})
    sized = keyed.select("doc_id", "source", F.col("__size").alias("size"), F.col("__text").alias("text_key"))
    taken = mixing.mix(materialize(sized, "mix-sizes"), ties=("text_key",)).groupBy("doc_id", "source", "size", "text_key")
    taken = taken.agg(F.sum("passes_taken").alias("passes"), F.count("*").alias("rows")).filter("passes > 0")
    taken = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("text_key").alias("k"), "passes", "rows")
    taken = materialize(taken, "mix-taken")
    match = lambda t: keyed.doc_id.eqNullSafe(t.d) & keyed.source.eqNullSafe(t.s) & (F.col("__text") == t.k)
    times = F.floor(F.col("passes") / F.col("rows")).cast("int")
    each = taken.filter(times > 0)
    out = keyed.join(each, match(each)).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)
    over = taken.filter(F.col("passes") % F.col("rows") > 0)
    if over.head(1):
        # by the thousand, as a row that stands a million times leaves many over
        one = keyed.join(over, match(over)).dropDuplicates(["d", "s", "k"]).withColumn("left", F.col("passes") % F.col("rows"))
        part = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("left") - 1) / 1000)))).repartition("d", "s", "k", "part")
        part = part.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("left") - 1000 * F.col("part")))))
        out = out.unionByName(part.select(*COLUMNS))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; fewer texts at once than alone, as executors hold the other stages' heap."""
    return spm.encode_documents(docs, spm.default_path(), chars=600_000, cached=250_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The first stage trains a model, which SQL cannot express; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again but for the last."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
