"""Exact top-k by integer inner product, with block-at-a-time pruning.

Vectors are dealt into segments. In a segment documents are numbered by their strongest component, so that vectors that
point alike stand together, and cut into blocks: ranges of that numbering. A block keeps the greatest and least value of
each component (term); for a query, the sum over components of the better product bounds every score in the block. A
cell holds one segment and one group of queries: each query takes its blocks by falling bound, scores through the block's
forward index (its vectors) and stops when the next bound is below its kth score. Every query starts with a kth score from
a probe, a bounded sample of the vectors themselves, so weak segments are left at once and give no rows.

The probe only sets the starting bound, which is a true one: results do not depend on it. Segments and groups are large
(SEGMENT, QUERIES), so a vector is copied once for each QUERIES queries and a query once for each SEGMENT vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import table

SEGMENT, BLOCK, QUERIES, PROBE = 16_384, 128, 4_096, 4_096
#: No score yet.
NONE = np.iinfo(np.int64).min


def _search(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int, floors: np.ndarray):
    """For each query its k best rows of the segment with scores of at least its floor: query, vec_id and score, best
    first, and the number of scores computed."""
    strong = np.argmax(np.abs(docs), 1) if docs.shape[1] else np.zeros(len(ids), int)
    sign = np.take_along_axis(docs, strong[:, None], 1)[:, 0] >= 0 if docs.shape[1] else strong
    order = np.lexsort((ids, sign, strong))
    ids, docs = ids[order], docs[order]
    starts = np.arange(0, len(ids), block)
    highs = np.array([docs[s : s + block].max(0) for s in starts])
    lows = np.array([docs[s : s + block].min(0) for s in starts])
    # a score and, at equal scores, the rank of the vec_id in one number: the higher, the better
    n = len(ids)
    largest = float(np.abs(docs).max(initial=0)) * float(np.abs(queries).max(initial=0)) * docs.shape[1]
    if (largest + 1) * n >= 2**62:
        raise OverflowError("scores of this size do not fit 64 bits")
    tie = np.empty(n, np.int64)
    tie[np.lexsort((np.arange(n), ids))] = n - 1 - np.arange(n)
    d, q = (docs.astype(np.float64), queries.astype(np.float64)) if largest < 2**53 else (docs, queries)
    bounds = np.maximum(queries, 0) @ highs.T + np.minimum(queries, 0) @ lows.T
    turn = np.argsort(-bounds, 1, kind="stable")
    best = np.full((len(query_ids), k), NONE, np.int64)
    least = np.where(floors == NONE, NONE, floors * n)  # a row's number must reach this
    active, scored = np.arange(len(query_ids)), 0
    for r in range(len(starts)):
        # each active query takes its next block, as long as that can hold anything better
        active = active[bounds[active, turn[active, r]] * n + n - 1 >= least[active]]
        if not len(active):
            break
        now = turn[active, r]
        for b in np.unique(now):
            who = active[now == b]
            some = slice(starts[b], starts[b] + block)
            rows = (q[who] @ d[some].T).astype(np.int64) * n + tie[some]
            scored += rows.size
            rows[(ids[some] == query_ids[who][:, None]) | (rows < least[who][:, None])] = NONE
            every = np.concatenate([best[who], rows], 1)
            best[who] = np.partition(every, every.shape[1] - k, 1)[:, -k:]
            least[who] = np.maximum(least[who], best[who].min(1))
    best = -np.sort(-best, 1)
    at, rank = np.nonzero(best != NONE)
    value = best[at, rank]
    place = np.empty(n, np.int64)
    place[n - 1 - tie] = np.arange(n)
    return query_ids[at], ids[place[n - 1 - value % n]], value // n, scored


def search_segment(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK):
    """(query, vec_id, score) rows: the k best of the segment for each query, and the number of scores computed."""
    *rows, scored = _search(ids, docs, query_ids, queries, k, block, np.full(len(query_ids), NONE))
    return list(zip(*(r.tolist() for r in rows), strict=True)), scored


def _wide(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Lists of numbers as rows, shorter ones ending in zeros."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vec_id, v array<long> -> query_id, rank, vec_id, score: for each query the k best other vectors, ties to the
    smaller vec_id.

    Rows with a null vec_id, a null vector or null components take no part. Shorter vectors count as ending in zeros. A
    repeated vec_id is found as often as it stands there and never by its own query; a repeated query is answered once, by
    the least of its vectors. Other columns are left out; an empty table gives an empty one."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select("vec_id", "v").filter("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.sum(is_query.cast("int")).alias("q")).first()
    n, dim, n_queries = stats["n"], stats["dim"] or 0, stats["q"] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = max(1, -(-n // SEGMENT), min(tasks, n // 1024))  # more and smaller ones where there are tasks for them
    groups = max(1, -(-n_queries // QUERIES))
    spread = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id"), F.col("v")), F.lit(m)).cast("int")
    probe = vectors.filter(spread("probe", max(1, n // PROBE)) == 0).limit(2 * PROBE).collect()
    probe_ids = np.array([r["vec_id"] for r in probe], np.int64)
    probe_vectors = np.zeros((len(probe), dim), np.int64)
    for i, r in enumerate(probe):
        probe_vectors[i, : len(r["v"])] = r["v"]

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            out = np.full(len(own), NONE, np.int64)
            if len(probe_ids) > k and len(own):
                scores = _wide(batch.column(1), dim) @ probe_vectors.T
                scores[own[:, None] == probe_ids] = NONE
                out = np.partition(scores, len(probe_ids) - k, 1)[:, len(probe_ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["vec_id", "v", "floor"])

    quers = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(floor, "vec_id long, v array<long>, floor long")
    quers = quers.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"))
    quers = quers.agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("queries"))
    # by row, so that a row that stands a million times fills no segment
    dealt = vectors.withColumn("segment", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(segments)).cast("int"))
    segs = dealt.groupBy("segment").agg(F.collect_list(F.struct("vec_id", "v")).alias("docs"))
    # each segment meets each group of queries: the stated query set against all rows, in blocks
    cells = segs.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(quers, "g").select("docs", "queries")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, queries = (c.slice(i, 1).flatten() for c in batch.columns)
                ids, wide = docs.field("vec_id").to_numpy(), _wide(docs.field("v"), dim)
                found = _search(ids, wide, queries.field("vec_id").to_numpy(), _wide(queries.field("v"), dim), k, BLOCK, queries.field("floor").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[:3]], names=["query_id", "vec_id", "score"])

    found = cells.repartition(max(1, min(segments * groups, 8 * tasks))).mapInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    """The contract's columns; vectors with null or non-finite components take no part, the rest as top_k() states."""
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    v = e.filter(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * 64).cast("long")).alias("v"))
    return top_k(v, F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
