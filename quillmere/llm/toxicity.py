"""Toxicity: a factorization machine over hashed terms.

The machine's score adds a weight for each term of a text and, for each pair of its terms, the product of their vectors:
an insult together with a mention of a group can count for more than both alone. It is trained on a bounded sample of
labelled documents, on all their terms at once; penalties bring terms that explain nothing, alone or in pairs, to zero.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import table, tidy

TERM = re.compile(r"\w+")
BITS = 20
#: The contract's limit.
TOXIC = 0.3


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-cased word: itself and its beginnings of 4 to 8 characters, so that inflected forms share
    terms."""
    return tuple(zlib.crc32(t.encode()) & ((1 << BITS) - 1) for t in (word, *("^" + word[:n] for n in range(4, min(8, len(word)) + 1))))


def again(term: int, times: int) -> int:
    """The hashed term for a term that stands in a text so many times or more (2 and 3 are told apart)."""
    return (term * 2654435761 + times * 40503) & ((1 << BITS) - 1)


def with_counts(counts: dict[int, int]) -> list[int]:
    return sorted({t for t in counts} | {again(t, k) for t, n in counts.items() for k in (2, 3) if n >= k})


def terms(text: str | None) -> list[int]:
    """Hashed terms of a whole text: of its lower-cased runs of word characters."""
    counts: Counter = Counter()
    for w, n in Counter(TERM.findall((text or "").lower())).items():
        for t in word_terms(w):
            counts[t] += n
    return with_counts(counts)


class Machine:
    """A second-order factorization machine: of hashed terms that carry anything, weights and vectors."""

    def __init__(self, chosen: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.row = np.full(1 << BITS, -1, np.int32)
        self.row[chosen] = np.arange(len(chosen))
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def score(self, found: np.ndarray) -> float:
        rows = self.row[found]
        rows = rows[rows >= 0]
        v = self.vectors[rows]
        z = self.bias + self.weights[rows].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array, and where each begins."""
    at = np.flatnonzero(x[1:] != x[:-1]) + 1
    at = np.concatenate([[0], at]) if len(x) else at
    return x[at], at


class Table:
    """Which texts hold which terms, in both directions, for sums over the terms of a text and over the texts of a term."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, n_terms: int):
        """flat: the terms (int32) of the texts, one text after the other."""
        self.flat, self.n_texts, self.n_terms = flat, len(lengths), n_terms
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self._index()

    def _index(self) -> None:
        self.texts, self.text_at = _heads(self.row)
        # sorted in place, as one number a term and text: an order of indexes would take as much memory again
        both = self.flat.astype(np.int64)
        both *= self.n_texts + 1
        both += self.row
        both.sort()
        self.by_term = np.empty(len(both), np.int32)
        np.remainder(both, self.n_texts + 1, out=self.by_term, casting="unsafe")
        both //= self.n_texts + 1
        self.terms, self.term_at = _heads(both)

    def keep(self, terms: np.ndarray) -> None:
        """Leaves out other terms (a mask)."""
        some = terms[self.flat]
        self.flat, self.row = self.flat[some], self.row[some]
        self._index()

    @staticmethod
    def _sums(x: np.ndarray, which: np.ndarray, heads: np.ndarray) -> np.ndarray:
        # a column at a time: the numbers gathered at once are as many as there are terms in all texts
        cols = [np.add.reduceat(np.ascontiguousarray(c)[which], heads) for c in x.reshape(len(x), -1).T]
        return np.stack(cols, 1).reshape(len(heads), *x.shape[1:])

    def over_terms(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_texts, *x.shape[1:]), x.dtype)
        if len(self.flat):
            out[self.texts] = self._sums(x, self.flat, self.text_at)
        return out

    def over_texts(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_terms, *x.shape[1:]), x.dtype)
        if len(self.flat):
            out[self.terms] = self._sums(x, self.by_term, self.term_at)
        return out


class Adam:
    """Steps along a gradient, then towards zero by limit: rows as wholes, numbers of a vector one by one."""

    def __init__(self, like: np.ndarray, rate: float, limit: float):
        self.first, self.second, self.t = np.zeros_like(like), np.zeros(len(like), like.dtype), 0
        self.rate, self.limit = rate, limit

    def step(self, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        size = grad**2 if grad.ndim == 1 else (grad**2).mean(1)
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * size
        step = self.rate / (np.sqrt(self.second / (1 - 0.999**self.t)) + 1e-4)
        if x.ndim == 1:
            x = x - step * self.first / (1 - 0.9**self.t)
            return np.sign(x) * np.maximum(np.abs(x) - step * self.limit, 0)
        x = x - step[:, None] * self.first / (1 - 0.9**self.t)
        return x * np.maximum(1 - step * self.limit / np.maximum(np.sqrt((x * x).sum(1)), 1e-12), 0)[:, None]


def fit(rows: list[tuple[np.ndarray, int]], **options) -> Machine:
    """fit_flat() for a list of terms and label of each text."""
    flat = np.concatenate([*(found for found, _ in rows), np.zeros(0, np.int32)]).astype(np.int32)
    return fit_flat(flat, np.array([len(found) for found, _ in rows], np.int64), np.array([label for _, label in rows], np.float32), **options)


def fit_flat(
    flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, rank: int = 6, steps: int = 150, rate: float = 0.05, limit: float = 5e-4, pull: float = 3e-4, least_rows: int = 3, start: float = 0.1
) -> Machine:
    """Log loss over all texts at once. First the weights of all hashed terms are fitted, then weights and vectors together.

    No term is chosen by its own relation to the label, as two terms can matter together that do not matter alone: all
    take part in both fits, but for those in fewer than least_rows texts. Weights are held small by an absolute penalty
    (limit), vectors by one on their lengths (pull), so that terms that explain nothing end at zero and are left out."""
    rng = np.random.default_rng(7)
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.0
        return Machine(np.array([], int), -30.0 if mean < 0.5 else 30.0, np.zeros(0), np.zeros((0, rank)))
    every = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= least_rows)
    at = np.full(1 << BITS, -1, np.int32)
    at[every] = np.arange(len(every))
    flat = at[flat]
    there = flat >= 0
    ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(lengths)])]
    flat = flat[there]
    del there
    data = Table(flat, np.diff(ends), len(every))
    del flat
    bias, w = math.log(y.mean() / (1 - y.mean())), np.zeros(len(every), np.float32)

    def error(z: np.ndarray) -> np.ndarray:
        return ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)

    adam = Adam(w, rate, limit)
    for _ in range(steps):
        g = error(bias + data.over_terms(w))
        w = adam.step(w, data.over_texts(g))
        bias -= 5 * float(g.sum())
    # so that the pairs of a usual text's terms add about start to its score before anything is learnt
    spread = math.sqrt(start * math.sqrt(2 / rank) / max(1.0, len(data.flat) / len(y)))
    v = rng.normal(0, spread, (len(every), rank)).astype(np.float32)
    adams = Adam(w, rate, limit), Adam(v, rate, pull)
    for _ in range(steps):
        sums = data.over_terms(v)
        linear = data.over_terms(np.stack([w, (v * v).sum(1)], 1))
        g = error(bias + linear[:, 0] + 0.5 * ((sums * sums).sum(1) - linear[:, 1]))
        grad = data.over_texts(np.concatenate([g[:, None], g[:, None] * sums], 1))
        w, v = adams[0].step(w, grad[:, 0]), adams[1].step(v, grad[:, 1:] - grad[:, :1] * v)
        bias -= 5 * float(g.sum())
        live = (w != 0) | v.any(1)
        if 2 * live.sum() < len(data.terms):  # a term at zero seldom comes back: the work shrinks with those left
            data.keep(live)
    kept = np.flatnonzero((w != 0) | v.any(1))
    return Machine(every[kept], float(bias), w[kept].astype(np.float64), v[kept].astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000) -> Machine:
    """A machine from about most_rows labelled documents outside the held-out part, chosen by hash of doc_id; the bound
    is a parameter, and so is what is broadcast. A repeated label counts as toxic if any is; of rows with one doc_id the least
    text is taken, so a repeated doc_id is one document; null labels and labels of absent documents are left out."""
    ship(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = max(1, math.ceil(labels.count() * 0.75 / most_rows))
    known = known.filter(F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(share)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id")
    rows = rows.agg(F.min("text").alias("text"), F.max(F.col("toxic").cast("int")).alias("toxic"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([np.array(terms(t), np.int32).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], names=["doc_id", "found", "toxic"])

    # terms come as packed 32-bit numbers: some 5 KB a row, and most_rows rows. Put in order here: a sort before
    # collecting would run the terms twice
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(work, f"doc_id {kind}, found binary, toxic int").toArrow().combine_chunks()
    digest = [zlib.crc32(f) for f in got.column("found").to_pylist()]
    order = np.lexsort((got.column("toxic").to_numpy(), digest, got.column("doc_id").to_numpy()))
    got = got.take(pa.array(order))
    packed = [np.frombuffer(f, np.int32) for f in got.column("found").to_pylist()]
    y = (got.column("toxic").to_numpy() > 0).astype(np.float32)
    del got
    lengths = np.array([len(f) for f in packed], np.int64)
    flat = np.concatenate([*packed, np.zeros(0, np.int32)])
    del packed
    return fit_flat(flat, lengths, y)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with score, in their order of columns; a column score of docs is replaced. An empty or null text gets the score
    of no terms. Whole texts of any length are read; repeated rows get the same score; an empty table gives an empty one.
    The other columns pass through unread."""
    ship(docs.sparkSession)
    cached_most = 150_000
    base = docs.drop("score")
    text_at = base.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        row = machine.row
        # terms that matter: chosen themselves, or with a chosen term for several times
        useful = row >= 0
        every = np.arange(1 << BITS, dtype=np.int64)
        for k in (2, 3):
            useful |= row[(every * 2654435761 + k * 40503) & ((1 << BITS) - 1)] >= 0

        def find(text: str | None) -> float:
            counts: dict[int, int] = {}
            for w, n in Counter(TERM.findall((text or "").lower())).items():
                ids = memo.get(w)
                if ids is None:
                    if len(memo) > cached_most:
                        memo.clear()
                    ids = memo[w] = tuple(t for t in word_terms(w) if useful[t])
                for t in ids:
                    counts[t] = counts.get(t, 0) + n
            return machine.score(np.array([t for t in with_counts(counts) if row[t] >= 0], np.int64))

        for batch in batches:
            scores = pa.array([find(t) for t in batch.column(text_at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])
        memo.clear()
        tidy()

    return base.mapInArrow(work, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents. Trained outside the held-out quarter; a null doc_id is not held
    out and has no label. Nulls, ties and empty tables as train() and score() state."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
