"""Approximate nearest neighbours by cosine over learned partitions.

A bounded sample of the vectors (`sample` rows, by hash) gives a graph of nearest neighbours. The graph is cut into parts of
equal size: halves of halves along the widest direction first, then vertices move to the part that holds most of their
neighbours as long as sizes stay within a tenth of each other. A softmax classifier learns from each sampled vector the parts
of itself and its neighbours; it names the part of every row (the most probable one) and the parts that a query looks at:
by falling probability, until those before hold `mass` of the probability, two at least, and until they hold enough rows.

`mass` is set by measurement: `trial` queries are compared with all rows, and it is the least that finds the wished share of
their neighbours. Rows of a part are dealt into segments of bounded size, so that neither a large part nor a hot group of
near copies makes a large task; equal vectors are listed before that with their k + 1 least ids only, the others of them can
be nobody's neighbours. Scores are computed on the original vectors, alike wherever a row lies, so equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize, table

PARTS, SAMPLE, TRIAL, RECALL = 64, 8_192, 512, 0.95
#: Neighbours of a vertex, sampled vectors a part, rows of a segment, queries that meet it at once.
DEGREE, LEAST_PART, SEGMENT, QUERIES = 16, 64, 8_192, 4_096
#: Scores of matrix products may differ from exact ones by less than this.
SLACK = 1e-9


def wide(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, shorter ones ending in zeros."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    out = np.zeros((len(lists), dim))
    out[np.arange(dim) < np.diff(ends)[:, None]] = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """The nearest other rows of each row of unit vectors, by blocks."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    for s in range(0, len(x), 1024):
        near = x[s : s + 1024] @ x.T
        near[np.arange(len(near)), np.arange(s, s + len(near))] = -2
        out[s : s + 1024] = np.argpartition(-near, degree - 1, 1)[:, :degree] if degree else 0
    return out


def halves(x: np.ndarray, parts: int) -> np.ndarray:
    """Parts (a power of two) of equal size: cut at the median along the widest direction, again and again."""
    out = np.zeros(len(x), np.int64)
    if parts > 1:
        centred = x - x.mean(0)
        along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
        upper = np.zeros(len(x), bool)
        upper[np.argsort(along, kind="stable")[len(x) // 2 :]] = True
        for side, at in ((~upper, 0), (upper, parts // 2)):
            out[side] = at + halves(x[side], parts // 2)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """A part for each vertex of a neighbour graph: few edges between parts, sizes within a tenth of the mean."""
    own, rng, n = halves(x, parts), np.random.default_rng(seed), len(x)
    ends = np.concatenate([np.repeat(np.arange(n), near.shape[1]), near.ravel()])
    others = np.concatenate([near.ravel(), np.repeat(np.arange(n), near.shape[1])])
    most, least = int(np.ceil(1.1 * n / parts)), int(0.9 * n / parts)
    sizes = np.bincount(own, minlength=parts)
    for _ in range(rounds):
        held = np.bincount(ends * parts + own[others], minlength=n * parts).reshape(n, parts)
        to = held.argmax(1)
        gain = held[np.arange(n), to] - held[np.arange(n), own]
        gain[rng.random(n) < 0.5] = 0  # neighbours do not swap places again and again
        movers = np.flatnonzero(gain > 0)
        if not len(movers):
            continue
        for v in movers[np.argsort(-gain[movers], kind="stable")].tolist():
            if sizes[to[v]] < most and sizes[own[v]] > least:
                sizes[own[v]] -= 1
                own[v] = to[v]
                sizes[own[v]] += 1
    return own


class Router:
    """A softmax classifier from unit vectors to parts."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(vectors: np.ndarray, parts: int = PARTS, epochs: int = 40, seed: int = 1) -> Router:
    """Parts of a sample's neighbour graph, and the classifier that learns them. A sample of few vectors has fewer parts."""
    x = unit(vectors)
    parts = 1 << max(0, min(parts, len(x) // LEAST_PART).bit_length() - 1)
    if parts == 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1))
    near = graph(x)
    own = balanced_parts(x, near, parts)
    aim = 0.5 * np.eye(parts)[own]
    for j in range(near.shape[1]):
        aim[np.arange(len(x)), own[near[:, j]]] += 0.5 / near.shape[1]
    centres = np.stack([x[own == p].mean(0) for p in range(parts)]).T
    router, rng = Router(8 * centres, np.zeros(parts)), np.random.default_rng(seed)
    moments = [np.zeros_like(a) for a in (router.weights, router.weights, router.bias, router.bias)]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 256):
            rows, step = order[s : s + 256], step + 1
            wrong = (router.probabilities(x[rows]) - aim[rows]) / len(rows)
            for i, (value, slope) in enumerate(((router.weights, x[rows].T @ wrong + 1e-5 * router.weights), (router.bias, wrong.sum(0)))):
                m, v = moments[2 * i], moments[2 * i + 1]
                m += 0.1 * (slope - m)
                v += 0.01 * (slope**2 - v)
                value -= 0.05 * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return router


def probes(probability: np.ndarray, sizes: np.ndarray, mass: float, k: int) -> np.ndarray:
    """Which parts each query looks at (a mask): by falling probability while those before hold less than mass, two at least,
    and as long as those before hold no more than k rows."""
    order = np.argsort(-probability, 1, kind="stable")
    p, rows = np.take_along_axis(probability, order, 1), sizes[order]
    take = (np.cumsum(p, 1) - p < mass) | (np.cumsum(rows, 1) - rows <= k)
    take[:, :2] = True
    out = np.zeros_like(take)
    np.put_along_axis(out, order, take, 1)
    return out


def best_of(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries that may be among the k largest of their row; -2 stands for no entry."""
    kth = np.partition(near, near.shape[1] - k, 1)[:, near.shape[1] - k] if near.shape[1] > k else np.full(len(near), -2.0)
    return np.nonzero((near > -1.5) & (near >= kth[:, None] - SLACK))


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of pairs of original vectors, each by itself."""
    length = lambda x: np.sqrt((x * x).sum(1))
    return (queries * rows).sum(1) / (length(queries) * length(rows))


FOUND = "query_uid long, query_id {0}, uid long, vec_id {0}, score double"


def _compare(ids: pa.Array, uids: np.ndarray, rows: np.ndarray, q_ids: pa.Array, q_uids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest of some rows for each query, and what ties with the last one."""
    near = unit(queries) @ unit(rows).T
    near[q_uids[:, None] == uids] = -2
    at, col = best_of(near, k)
    columns = [pa.array(q_uids[at]), q_ids.take(pa.array(at)), pa.array(uids[col]), ids.take(pa.array(col)), pa.array(scores(queries[at], rows[col]))]
    return pa.RecordBatch.from_arrays(columns, names=["query_uid", "query_id", "uid", "vec_id", "score"])


def _nearest(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Index:
    """Every row's part, and what it takes to answer queries."""

    def __init__(self, vectors: DataFrame, k: int = 5, parts: int = PARTS, sample: int = SAMPLE):
        """vectors: vec_id, v array<double>. Rows that cannot be compared (v null or empty, zero, or holding null or
        non-finite components) are left out; so are other columns."""
        spark = vectors.sparkSession
        ship(spark)
        fine = "v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x != 0)"
        rows = vectors.select("vec_id", F.expr("transform(v, x -> double(x))").alias("v")).filter(fine)
        self.k, self.kind = k, vectors.schema["vec_id"].dataType.simpleString()
        self.all = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "ann-rows")
        # of equal vectors k + 1 are enough: each query's own row is one of them at most
        place = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id"), "uid"))
        self.rows = materialize(self.all.withColumn("__p", place).filter(F.col("__p") <= k + 1).drop("__p"), "ann-index")
        stats = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        self.n, self.dim = stats["n"], stats["dim"] or 0
        chance = F.pmod(F.xxhash64(F.lit("sample"), "uid"), F.lit(max(1, self.n // (2 * sample)))) == 0
        picked = self.rows.filter(chance).orderBy(F.xxhash64(F.lit("order"), "uid")).limit(sample).select("v").toArrow()
        self.router = fit(wide(picked["v"].combine_chunks(), self.dim), parts) if self.n else None
        self.mass = 1.0

    def placed(self) -> DataFrame:
        """The rows with their part."""
        router, dim = self.router, self.dim

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = wide(b.column("v"), dim)
                part = router.probabilities(unit(x)).argmax(1) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=[*b.schema.names, "part"])

        return self.rows.select("uid", "vec_id", "v").mapInArrow(work, f"uid long, vec_id {self.kind}, v array<double>, part int")

    def brute_force(self, queries: DataFrame, most: int = TRIAL) -> DataFrame:
        """The true neighbours of at most so many queries, compared with every row: a task keeps its own best."""
        picked = queries.orderBy(F.xxhash64(F.lit("trial"), "uid")).limit(most).select("uid", "vec_id", "v").toArrow().combine_chunks()
        ids, uids = picked["vec_id"].combine_chunks(), picked["uid"].to_numpy()
        x, dim, k = wide(picked["v"].combine_chunks(), self.dim), self.dim, self.k

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(uids):
                    yield _compare(b.column("vec_id"), b.column("uid").to_numpy(), wide(b.column("v"), dim), ids, uids, x, k)

        return _nearest(self.rows.select("uid", "vec_id", "v").mapInArrow(work, FOUND.format(self.kind)), k)

    def calibrate(self, queries: DataFrame, wished: float = RECALL, trial: int = TRIAL) -> tuple[float, float]:
        """Sets mass to the least that finds the wished share of the true neighbours of some queries; the recall on them,
        and the share of rows that these queries look at."""
        true = self.brute_force(queries, trial).select("query_uid", "uid").join(self.placed().select("uid", "part"), "uid")
        true = true.join(queries.select(F.col("uid").alias("query_uid"), F.col("v").alias("q")), "query_uid").toArrow()
        if not true.num_rows:
            return 1.0, 1.0
        part, p = true["part"].to_numpy(), self.router.probabilities(unit(wide(true["q"].combine_chunks(), self.dim)))
        own = p[np.arange(len(p)), part][:, None]
        needed = np.where(p > own, p, 0).sum(1)
        self.mass = float(np.nextafter(np.quantile(needed, wished, method="higher"), 2))
        mask = probes(p, self.sizes(), self.mass, self.k)
        return float(mask[np.arange(len(p)), part].mean()), float((mask * self.sizes()).sum() / (len(p) * self.n))

    def sizes(self) -> np.ndarray:
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(self.router.bias.size, np.int64)
            for r in self.placed().groupBy("part").count().collect():
                self._sizes[r["part"]] = r["count"]
        return self._sizes

    def search(self, queries: DataFrame) -> DataFrame:
        """queries: rows of self.all -> query_uid, query_id, rank, uid, vec_id, score."""
        spark, router, dim, k, mass, sizes = queries.sparkSession, self.router, self.dim, self.k, self.mass, self.sizes()
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        segment = max(256, min(SEGMENT, self.n // tasks))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mask = probes(router.probabilities(unit(wide(b.column("v"), dim))), sizes, mass, k) if b.num_rows else np.zeros((0, len(sizes)), bool)
                at, part = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(part.astype(np.int32))], names=[*b.schema.names, "part"])

        shape = f"uid long, vec_id {self.kind}, v array<double>, part int"
        asked = materialize(queries.select("uid", "vec_id", "v").mapInArrow(route, shape), "ann-routed")
        counts = {r["part"]: r["count"] for r in asked.groupBy("part").count().collect()}
        plan = [(p, -(-int(n) // segment), -(-counts.get(p, 0) // QUERIES)) for p, n in enumerate(sizes.tolist()) if n and counts.get(p)]
        plan = F.broadcast(spark.createDataFrame(plan, "part int, segments int, groups int"))  # a row a part
        deal = lambda df, own, other: (
            df.join(plan, "part").withColumn(own[0], F.pmod(F.xxhash64(F.lit("deal"), "uid"), F.col(own[1])).cast("int"))
            .withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1))).drop("segments", "groups")
        )
        docs = deal(self.placed(), ("s", "segments"), ("g", "groups")).groupBy("part", "s", "g")
        asks = deal(asked, ("g", "groups"), ("s", "segments")).groupBy("part", "s", "g")

        def work(one: pa.Table, other: pa.Table) -> pa.Table:
            if not one.num_rows or not other.num_rows:
                return pa.Table.from_batches([], schema=names)
            one, other = one.combine_chunks(), other.combine_chunks()
            rows = wide(one["v"].chunk(0), dim)
            parts = []
            for s in range(0, other.num_rows, 1024):  # bounded products
                q = other.slice(s, 1024).combine_chunks()
                parts.append(_compare(one["vec_id"].chunk(0), one["uid"].to_numpy(), rows, q["vec_id"].chunk(0), q["uid"].to_numpy(), wide(q["v"].chunk(0), dim), k))
            return pa.Table.from_batches(parts)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        names = to_arrow_schema(StructType.fromDDL(FOUND.format(self.kind)))
        return _nearest(docs.cogroup(asks).applyInArrow(work, FOUND.format(self.kind)), k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, parts: int = PARTS, sample: int = SAMPLE, recall: float = RECALL, trial: int = TRIAL) -> DataFrame:
    """vec_id, v -> query_id, rank, vec_id, score: the k nearest other rows that are found for each query row, ties to the
    smaller vec_id (null last).

    Rows are told apart by place: a query hides its own row only, so another row with its vec_id is a candidate, and a
    repeated query id is answered once for each of its rows. Rows with a null, empty or zero vector, or one with null or
    non-finite components, take no part; a row with a null vec_id is a candidate. Shorter vectors count as ending in zeros. Other columns
    are left out; an empty table gives an empty one."""
    index = Index(vectors, k, parts, sample)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], f"query_id {index.kind}, rank int, vec_id {index.kind}, score double")
    queries = index.all.filter(is_query)
    index.calibrate(queries, recall, trial)
    return index.search(queries).select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), F.col("vec_id") % 50 == 0)
