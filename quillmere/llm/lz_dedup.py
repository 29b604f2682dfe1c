"""Removal of repeated 35-word windows by relative Lempel-Ziv parsing of the corpus against itself.

1. Reference. Every text is cut at triggers into phrases: runs of window starts (a window is 35 words) that share their
   first inner trigger. The reference index holds each phrase context that stands twice or more, with one place of it, its
   canonical one (the least by text, so that what texts share is found in one and the same text), and another for the
   canonical place itself. It is dealt by the phrase's core into blocks, so each document meets every block, and only at
   phrases whose core the block holds.
2. Factors. A document is parsed greedily from left to right: at the first place that no factor covers, its phrase is
   looked up, and the factor grows phrase by phrase while the document and the reference go on in step. A phrase without an
   entry is a literal. A factor reaches at least one whole window, 35 words, so all of them are long enough.
3. Factor boundaries. A window across the end of a factor may still stand elsewhere, split otherwise. Such windows lie in
   phrases whose core stands in the reference but whose context does not; they are looked up one by one, among the windows
   of one place of each other context of those cores.

Words under a factor or a repeated window are removed. Cores, contexts, windows and texts are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import drop, materialize, table
from .repeats import Rolling, phrases, pieces, word_codes

#: Fixed value of the contract; neighbours of a trigger and words of its gram (3 * WIDTH + GRAM <= LENGTH + 2).
LENGTH, WIDTH, GRAM = 35, 11, 4


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _phrases(rows: DataFrame, length: int, width: int, gram: int) -> DataFrame:
    """key, text -> core, context, key, at (first * 256 + last - first); copies in one task give their phrases once."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for key, data in zip(batch.column(0).to_pylist(), texts_of(batch, 1), strict=True):
                if key not in seen:
                    if len(seen) < 200_000:  # more copies would be found again, which changes nothing
                        seen.add(key)
                    core, context, first, last = phrases(word_codes(data), length, width, gram)
                    found.append((core.view(np.int64), context.view(np.int64), np.full(len(core), key, np.int64), first * 256 + (last - first)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["core", "context", "key", "at"])

    return rows.select("key", "text").mapInArrow(parse, "core long, context long, key long, at long")


def reference(rows: DataFrame, length: int = LENGTH, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """key, text -> the phrases whose core stands twice (core, context, key, at), and the index: core, context, n, and
    the two places lo (the canonical one) and hi."""
    cut = _phrases(rows, length, width, gram)
    cores = materialize(cut.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "lz-cores")
    again = materialize(cut.join(cores, "core"), "lz-again")
    drop(cores)
    here = F.struct("key", "at")
    index = again.groupBy("core", "context").agg(F.count("*").alias("n"), F.min(here).alias("lo"), F.max(here).alias("hi"))
    return again, materialize(index, "lz-index")


def boundary_windows(rows: DataFrame, index: DataFrame, length: int) -> DataFrame:
    """(key, start) of windows that repeat though their phrase's context is not in the index."""
    split = materialize(index.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "lz-split")
    ends = index.join(split, "core").select("lo.key", F.struct(F.col("lo.at").alias("at"), (F.col("n") > 1).alias("sure")).alias("end"))
    ends = materialize(ends, "lz-ends").groupBy("key").agg(F.collect_list("end").alias("ends"))
    texts = rows.select("key", "text").join(ends, "key").groupBy("key").agg(F.first("ends").alias("ends"), F.first("text").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, some, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch, 2), strict=True):
                at = np.array([e["at"] for e in some], np.int64)
                n = at % 256 + 1
                starts = pieces(at // 256, n)
                h = Rolling(word_codes(data)).hash(starts, starts + length)
                found.append((h.view(np.int64), np.full(len(h), key, np.int64), starts, np.repeat(np.array([e["sure"] for e in some], bool), n)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["window", "key", "start", "sure"])

    single = materialize(texts.mapInArrow(listed, "window long, key long, start long, sure boolean"), "lz-windows")
    twice = materialize(single.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window"), "lz-twice")
    loose = materialize(single.filter("not sure").join(twice, "window").select("key", "start"), "lz-loose")
    for t in (split, single, twice):
        drop(t)
    return loose


def factors(first: np.ndarray, last: np.ndarray, ref: np.ndarray, ref_first: np.ndarray, length: int) -> np.ndarray:
    """Greedy factors of one text from its matched phrases (window starts first to last, and where they stand in the
    reference): rows of start, words, text of the reference, start there."""
    order = np.argsort(first, kind="stable")
    first, last, ref, ref_first = first[order], last[order], ref[order], ref_first[order]
    step = (first[1:] == last[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_first[1:] - first[1:] == ref_first[:-1] - first[:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~step])[: len(first)])
    ends = np.append(heads[1:], len(first)) - 1 if len(heads) else heads
    return np.stack([first[heads], last[ends] + length - first[heads], ref[heads], ref_first[heads]], 1) if len(heads) else np.zeros((0, 4), np.int64)


_FACTOR = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("reference", pa.int64()), ("reference_start", pa.int64())]))


def lz_dedup(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_removed, n_factors, kept_sha256, kept (the words left, joined by blanks) and factors
    (start, n_words, reference: xxhash64 of the text that they are read from, reference_start); a row for each row.

    A null text has no words; texts with fewer than 35 words keep all; copies of a text with more, repeated rows among
    them, lose all of it (one factor: the text itself). Texts of any length are taken whole, one at a time in memory. An
    empty table gives an empty one; other columns are left out. doc_id passes through unread, null or not."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    again, index = reference(rows, length, width, gram)
    loose = boundary_windows(rows, index, length)
    known = index.filter("n > 1").select("core", "context", "lo", "hi")
    self_ = (F.col("key") == F.col("lo.key")) & (F.col("at") == F.col("lo.at"))
    matched = again.join(known, ["core", "context"]).select("key", "at", F.when(self_, F.col("hi")).otherwise(F.col("lo")).alias("ref"))
    matched = materialize(matched.select("key", F.struct("at", F.col("ref.key").alias("k"), F.col("ref.at").alias("r")).alias("m")), "lz-matched")
    drop(again)
    drop(index)
    found = materialize(matched.groupBy("key").agg(F.collect_set("m").alias("matches")), "lz-factors")
    drop(matched)
    single = loose.groupBy("key").agg(F.collect_set("start").alias("starts"))
    copies = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("copied"))
    facts = materialize(copies.join(found, "key", "full").join(single, "key", "full"), "lz-facts")
    drop(found)
    drop(loose)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            keys, matches, starts, copied = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            for data, key, m, s, c in zip(texts_of(batch, 1), keys, matches, starts, copied, strict=True):
                words = data.split()
                n = len(words)
                if c and n >= length:
                    parts = np.array([[0, n, key, 0]], np.int64)
                else:
                    at, k, r = (np.array([x[name] for x in m or ()], np.int64) for name in ("at", "k", "r"))
                    parts = factors(at // 256, at // 256 + at % 256, k, r // 256, length)
                change = np.zeros(n + 1, np.int32)
                begins = np.concatenate([parts[:, 0], np.array(s or (), np.int64)])
                np.add.at(change, begins, 1)
                np.add.at(change, begins + np.concatenate([parts[:, 1], np.full(len(s or ()), length)]), -1)
                gone = (np.cumsum(change[:-1]) > 0).tolist()
                kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
                out.append((n, sum(gone), len(parts), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), [dict(zip(("start", "n_words", "reference", "reference_start"), p, strict=True)) for p in parts.tolist()]))
            names = ["doc_id", "n_words", "n_removed", "n_factors", "kept_sha256", "kept", "factors"]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _FACTOR)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=names)

    done = rows.join(facts, "key", "left").select("doc_id", "text", "key", "matches", "starts", "copied")
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = "array<struct<start:bigint,n_words:bigint,reference:bigint,reference_start:bigint>>"
    return done.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, n_factors long, kept_sha256 string, kept string, factors {listed}")


def op10_lz_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, ties and empty tables as lz_dedup() states."""
    return lz_dedup(table(spark, sf_dir, "documents")).drop("kept", "factors", "n_factors")


OP10_SQL = """
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) u(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM again, unnest(range(i, i + 35)) v(p)),
word AS (SELECT doc_id, p, ws[p] AS x FROM w, unnest(range(1, len(ws) + 1)) v(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
