"""Documents: checks and labels of chunks, BM25 ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, counted, is_blank
from ..scratch import written
from .chunking import LEAST, MOST, TARGET, chunk_documents

#: So many pairs of query and term at most are broadcast.
BROADCAST_TERMS = 200_000

#: Words without topical weight.
STOPWORDS = (
    "about above after again against all also am and any are as at be because been before being below between both but by "
    "can cannot could did do does doing done down during each either else enough etc even every few for from further had has "
    "have having he her here hers herself him himself his how however if in into is it its itself just less like made make "
    "many may me more most much must my myself no nor not now of off on once one only or other others ought our ours "
    "ourselves out over own per same shall she should so some such than that their theirs them themselves then there these "
    "they this those though through thus to too under until up upon use used using very was we were what when where which "
    "while who whom whose why will with within without would you your yours yourself yourselves"
).split()


def verify_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose text is not the slice of their document."""
    d = docs.select(F.col("document_id").cast("string"), F.col("text").alias("whole"))
    same = F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")
    return chunks.join(d, "document_id").filter(~same).select("id")


def content_tokens(text: Column) -> Column:
    return F.filter(answer_tokens(text), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))


def _ranked(least: int, most: int) -> Column:
    """Of the counts __c (see counted()), structs (n, term) of the most frequent terms, n negative."""
    often = F.transform(F.filter("__c", lambda c: c["n"] >= least), lambda c: F.struct((-c["n"]).alias("n"), c["term"].alias("term")))
    return F.slice(F.sort_array(often), 1, most)


def _top(df: DataFrame, id_: str, terms: str, most: int, least: int) -> DataFrame:
    """id, term, n, rank of the most frequent terms of an array; counted and ranked inside the row, without a shuffle. The
    array that is exploded must not be a column of its own: a filter on it would be pushed below all it is made of."""
    df = counted(df.withColumn("__s", F.sort_array(terms)), "__s", "__c")
    best = df.select(id_, F.posexplode(_ranked(least, most)).alias("r", "x"))
    return best.select(id_, F.col("x.term").alias("term"), (-F.col("x.n")).cast("long").alias("n"), (F.col("r") + 1).alias("rank"))


def topics(docs: DataFrame, id_: str = "id", most: int = 5) -> DataFrame:
    """id, term, n, rank: the most frequent content words of each row."""
    return _top(docs.select(id_, content_tokens(F.col("text")).alias("__t")), id_, "__t", most, 1)


def _neighbours(tokens: str) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _pairs(docs: DataFrame, id_: str) -> DataFrame:
    df = docs.select(id_, content_tokens(F.col("text")).alias("__t"))
    return df.select(id_, _neighbours("__t").alias("__t"))


def bigrams(docs: DataFrame, id_: str = "id") -> DataFrame:
    """id, term: every two neighbouring content words. What is exploded is no column, see _top()."""
    df = docs.select(id_, content_tokens(F.col("text")).alias("__t"))
    return df.select(id_, F.explode(_neighbours("__t")).alias("term"))


def concepts(docs: DataFrame, id_: str = "id", most: int = 3, least: int = 2) -> DataFrame:
    """id, term, n, rank: the most frequent pairs of neighbouring content words that stand twice or more."""
    return _top(_pairs(docs, id_), id_, "__t", most, least)


def label_chunks(chunks: DataFrame, id_: str = "id") -> DataFrame:
    """chunks with topics and concepts filled where both are empty, from their own text. All in the row: rows with one id do
    not mix, and nothing is joined."""
    none = F.array().cast("array<string>")
    empty = F.coalesce((F.size("topics") == 0) & (F.size("concepts") == 0), F.lit(False))
    df = chunks.withColumn("__e", empty).withColumn("__t", F.when(F.col("__e"), content_tokens(F.col("text"))))
    df = counted(df.withColumn("__s", F.sort_array("__t")), "__s", "__c").withColumn("__topics", _ranked(1, 5))
    df = counted(df.withColumn("__s", F.sort_array(_neighbours("__t"))), "__s", "__c").withColumn("__concepts", _ranked(2, 3))
    words = lambda c: F.coalesce(F.transform(c, lambda x: x["term"]), none)
    labels = {"topics": F.when(F.col("__e"), words("__topics")).otherwise(F.col("topics")), "concepts": F.when(F.col("__e"), words("__concepts")).otherwise(F.col("concepts"))}
    return df.withColumns(labels).select(*chunks.columns)


def bm25_many(docs: DataFrame, queries: DataFrame, most: int, id_: str = "id", query: str = "query", k1: float = 1.5, b: float = 0.75, least: float = 0.0) -> DataFrame:
    """docs (id, text) and queries (query, text) -> query, id, score, rank (from 0): for each query the best documents by
    BM25 for its distinct tokens. Scores are rounded to six decimals before ranking, ties go to the lesser id.

    One pass over the texts leaves, of each document, its length and the counts of terms that some query has; that table
    is written, and its sums give the number of documents, their mean length and the terms' document counts. Query terms
    are broadcast up to BROADCAST_TERMS, beyond that they are joined by shuffle."""
    asked = queries.select(query, F.explode(F.array_distinct(answer_tokens(F.col("text")))).alias("term")).distinct()
    asked = written(asked, "bm25-terms")
    small = asked.count() <= BROADCAST_TERMS
    hint = F.broadcast if small else (lambda x: x)
    rows = docs.select(id_, F.sort_array(answer_tokens(F.col("text"))).alias("__t"))
    rows = counted(rows.withColumn("dl", F.size("__t")), "__t", "__c").select(id_, "dl", "__c")
    # every document also keeps a row of the empty term, which is no token, for their number and mean length
    every = F.concat("__c", F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("term"))))
    terms = rows.select(id_, "dl", F.explode(every).alias("c")).select(id_, "dl", F.col("c.term").alias("term"), F.col("c.n").alias("f"))
    wanted = asked.select("term").distinct().union(docs.sparkSession.createDataFrame([("",)], "term string"))
    hits = written(terms.join(hint(wanted), "term", "left_semi"), "bm25-hits")
    whole = hits.filter("term = ''").agg(F.count("*").alias("nd"), F.avg("dl").alias("avg"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    pairs = hits.join(hint(asked.join(frequency, "term")), "term").crossJoin(F.broadcast(whole))  # one row
    idf = F.log1p((F.col("nd") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    scored = pairs.groupBy(query, id_).agg(F.round(F.sum(idf * weight), 6).alias("score")).filter(F.col("score") > least)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), id_))
    # compared as it is, so that each task keeps its own best only
    return scored.withColumn("__r", place).filter(F.col("__r") <= most).select(query, id_, "score", (F.col("__r") - 1).alias("rank"))


def bm25(docs: DataFrame, query: str, most: int, id_: str = "id", **options) -> DataFrame:
    """id, score, rank (from 0) for one query text."""
    one = docs.sparkSession.createDataFrame([(0, query)], "query int, text string")
    return bm25_many(docs, one, most, id_, **options).drop("query")


def fetch_passages(ranked: DataFrame, chunks: DataFrame, id_: str = "id") -> DataFrame:
    """The chunks of a ranking as passages, in its order: rank, id, document_id, text, char_start, char_end, score."""
    kept = [c for c in ("document_id", "text", "char_start", "char_end", "topics") if c in chunks.columns]
    return ranked.join(chunks.select(id_, *kept), id_).select("rank", id_, *kept, "score").orderBy("rank")


def direct_passages(chunks: DataFrame, id_: str = "id") -> DataFrame:
    """Chunks as passages without a retrieval: no score, no rank."""
    return chunks.select(id_, *[c for c in ("document_id", "text", "char_start", "char_end", "topics") if c in chunks.columns])


def build_corpus(docs: DataFrame, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Documents (document_id, text) -> labelled chunks: cut, then given topics and concepts."""
    chunks = chunk_documents(docs, target, least, most)
    none = F.array().cast("array<string>")
    return label_chunks(chunks.withColumns({"topics": none, "concepts": none}))


def traceable(grounding: Column) -> Column:
    """A non-blank source and a span that is there."""
    return ~is_blank(grounding["source_id"]) & grounding["span"].isNotNull()


def reference_text(grounding: Column) -> Column:
    """A grounding in words: source, chapter, section and span, what is missing left out."""
    span = grounding["span"]
    place = F.when(span.isNotNull(), F.concat(F.lit("chars "), span["char_start"].cast("string"), F.lit("-"), span["char_end"].cast("string")))
    named = F.coalesce(F.when(~is_blank(grounding["source_title"]), grounding["source_title"]), grounding["source_id"])
    parts = [named, grounding["chapter"], grounding["section"], place]
    return F.concat_ws(", ", *[F.when(~is_blank(p), p) for p in parts])
