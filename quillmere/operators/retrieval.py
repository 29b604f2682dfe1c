"""An inverted index for BM25: written once, then searched without reading a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, counted
from ..scratch import drop, short_shuffles, written
from .content import BROADCAST_TERMS
from .stats import numbered

#: Documents of one block; an entry of the index holds the postings of one term in one block.
BLOCK = 1024
#: Up to so many different terms of all queries are named in the filter of the scan; more of them are joined.
NAMED_TERMS = 1000
#: Blocks of each query that are scored before bounds are compared.
PROBE = 2


def _weight(f: Column, dl: Column, avg: Column, k1: float, b: float) -> Column:
    return f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avg))


def build_index(docs: DataFrame, path: str, id_: str = "id", block: int = BLOCK, k1: float = 1.5, b: float = 0.75) -> None:
    """Writes the index of docs (id, text) into the folder path: `postings` (term, block, n, most, docs: places in the block
    and counts, see _posting()), sorted by term and block; `documents` (block, docs: structs of at, id, dl in the order of
    places); and `whole`, one row of nd, avg, k1, b.

    Documents are numbered by length, so that those of a block are alike and `most`, the greatest weight of a term in a
    block, lies close to the others. Texts are read and tokenized once. Documents move to the task of their block as counted
    terms; there the postings of a term are put together without another shuffle, at most `block` of them in a list, and
    only these entries are sorted by range of term and block, so that a term of all documents fills many tasks. Documents
    with a null text are not part of the index; empty ones count for the number and mean length; rows with one id, or a null
    one, are documents of their own.

    What is shuffled is packed: the terms of a document as one string and its counts as numbers, a posting as one number, ids
    and lengths once a document. Tables and shuffle files of a step go as soon as the next one is written."""
    with short_shuffles(docs.sparkSession):
        rows = docs.filter(F.col("text").isNotNull()).select(F.col(id_).alias("id"), F.sort_array(answer_tokens(F.col("text"))).alias("__t"))
        rows = counted(rows.withColumn("dl", F.size("__t")), "__t", "terms")
        # no token has a blank in it
        rows = rows.select("id", "dl", F.array_join(F.col("terms.term"), " ").alias("words"), F.col("terms.n").alias("counts"))
        # places are given by length, id and what the text counts, hence the same at every run. Sorting by range looks at its rows
        # twice, so what took work is written before; the numbered rows serve both passes
        counts = written(rows.withColumn("__h", F.xxhash64("words", "counts")), "index-rows")
        rows = numbered(counts, ["dl", "id", "__h"])
        drop(counts)
        whole = written(rows.agg(F.count("*").alias("nd"), F.avg("dl").alias("avg")), "index-whole").withColumns({"k1": F.lit(float(k1)), "b": F.lit(float(b))})
        whole.write.mode("overwrite").parquet(f"{path}/whole")
        placed = rows.select(F.floor(F.col("__n") / block).alias("block"), (F.col("__n") % block).cast("int").alias("at"), "id", "dl", "words", "counts")
        own = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "id", "dl"))).alias("docs"))
        own.write.mode("overwrite").parquet(f"{path}/documents")
        each = placed.filter("dl > 0").select("block", "at", "dl", "words", F.col("counts").alias("f")).repartition("block").withColumn("term", F.split("words", " "))
        # an outer explosion, as for another one Spark makes the array again in a filter below; no array here is empty
        each = each.select("block", "at", "dl", F.explode_outer(F.arrays_zip("term", "f")).alias("c")).crossJoin(F.broadcast(whole.select("avg")))  # one row
        each = each.select(F.col("c.term").alias("term"), "block", _posting(F.col("at"), F.col("c.f")).alias("p"), _weight(F.col("c.f"), F.col("dl"), F.col("avg"), k1, b).alias("w"))
        entries = written(each.groupBy("term", "block").agg(F.count("*").alias("n"), F.max("w").alias("most"), F.collect_list("p").alias("docs")), "index-entries")
        drop(rows)
        entries.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
        drop(entries)


def _posting(at: Column, f: Column) -> Column:
    """The place of a document in its block and how often a term stands there, as one number."""
    return F.shiftleft(at.cast("long"), 32) + f


def _asked(queries: DataFrame, query: str) -> DataFrame:
    return written(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(answer_tokens(F.col("text")))).alias("term")).distinct(), "index-asked")


def _entries(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """The index's entries of the terms. A few terms are named in the scan, which then reads only row groups that hold one of
    them; more are joined."""
    postings = spark.read.parquet(f"{path}/postings")
    some = [r["term"] for r in terms.limit(NAMED_TERMS + 1).collect()]
    if len(some) <= NAMED_TERMS:
        return postings.filter(F.col("term").isin(some))
    return postings.join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term", "left_semi")


def _scores(entries: DataFrame, documents: DataFrame, blocks: DataFrame, asked: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """query, block, at, id, score of the documents in the blocks (query, block). Scores are rounded to six decimals.

    Entries move once, to the task of their block. There they meet the block's documents, whose weights are made once for all
    queries, and then the queries; a document's terms are summed up where they are, so of queries times documents nothing is
    shuffled."""
    wanted = blocks.groupBy("block").agg(F.collect_list("query").alias("queries"))
    if (few := wanted.select("block")).count() <= BROADCAST_TERMS:
        entries = entries.join(F.broadcast(few), "block", "left_semi")
    here = documents.join(wanted, "block").crossJoin(F.broadcast(whole))  # one row
    part = F.transform("docs", lambda d: F.col("k1") * (1 - F.col("b") + F.col("b") * d["dl"] / F.col("avg")))
    here = here.select("block", "queries", F.col("docs.id").alias("ids"), part.alias("parts"), "k1")

    def weighted(p: Column) -> Column:
        at, f = F.shiftright(p, 32).cast("int"), p.bitwiseAND((1 << 32) - 1)
        return F.struct(at.alias("at"), F.get("ids", at).alias("id"), (f * (F.col("k1") + 1) / (f + F.get("parts", at))).alias("w"))

    # hashed on the side of the blocks: with the entries broadcast, scores would have to be shuffled
    hits = entries.select("term", "block", "docs").repartition("block").join(here.hint("shuffle_hash"), "block").select("term", "block", "queries", F.transform("docs", weighted).alias("docs"))
    hits = hits.join(F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked, "term").filter(F.array_contains("queries", F.col("query")))
    hits = hits.select("block", "query", "idf", F.explode_outer("docs").alias("d"))  # none is empty, see build_index()
    scored = hits.groupBy("block", "query", F.col("d.at").alias("at"), F.col("d.id").alias("id")).agg(F.round(F.sum(F.col("idf") * F.col("d.w")), 6).alias("score"))
    return scored.filter(F.col("score") > least)


def _best(scored: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "block", "at"))
    return scored.withColumn("__r", place).filter(F.col("__r") <= most)


def search_index(spark: SparkSession, path: str, queries: DataFrame, most: int, query: str = "query", id_: str = "id", least: float = 0.0, probe: int = PROBE) -> DataFrame:
    """queries (query, text) against the index at path -> query, id, score, rank (from 0), as bm25_many gives them: the best
    documents of each query for its distinct tokens, ties to the lesser id (null first), then to the shorter text.

    A block's bound is the sum of its terms' greatest weights. The `probe` blocks with the greatest bounds of each query are
    scored; their `most`th score, if there are as many, is what others have to reach: of all further blocks only those
    whose bound does are scored. So nothing is lost, and queries for rare words read few entries."""
    if most <= 0:
        return spark.createDataFrame([], queries.select(query).schema).select(query, F.lit(None).cast(_id_type(spark, path)).alias(id_), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    with short_shuffles(spark):
        first, rest, scored, more = _searched(spark, path, queries, most, query, least, probe)
    found = _best(scored.unionByName(more), most)
    return found.select(F.col("query").alias(query), F.col("id").alias(id_), "score", (F.col("__r") - 1).alias("rank"))


def _id_type(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/documents").selectExpr("docs[0].id as id").schema["id"].dataType


def _searched(spark: SparkSession, path: str, queries: DataFrame, most: int, query: str, least: float, probe: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks (query, block) that are probed, those scored after them, and the scores of both."""
    asked = _asked(queries, query)
    entries = _entries(spark, path, asked.select("term").distinct())
    whole, documents = spark.read.parquet(f"{path}/whole"), spark.read.parquet(f"{path}/documents")
    heads = written(entries.select("term", "block", "n", "most"), "index-heads")
    rare = heads.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(whole.select("nd")))  # one row
    idf = rare.select("term", F.log1p((F.col("nd") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = written(asked.join(idf, "term"), "index-weights")
    # a bound is compared with rounded scores and may itself be a little off
    bounds = heads.join(asked, "term").groupBy("query", "block").agg((F.sum(F.col("idf") * F.col("most")) + 1e-6).alias("bound")).filter(F.col("bound") > least)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    bounds = written(bounds.withColumn("k", order), "index-bounds")
    first = bounds.filter(F.col("k") <= probe).select("query", "block")
    scored = written(_best(_scores(entries, documents, first, asked, whole, least), most), "index-first")
    reach = scored.filter(F.col("__r") == most).select("query", F.col("score").alias("reach"))
    rest = bounds.filter(F.col("k") > probe).join(reach, "query", "left").filter(F.col("reach").isNull() | (F.col("bound") >= F.col("reach")))
    rest = written(rest.select("query", "block"), "index-rest")
    return first, rest, scored.drop("__r"), _scores(entries, documents, rest, asked, whole, least)
