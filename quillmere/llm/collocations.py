"""Phrase collocations by hierarchical pair naming.

Words that stand often enough get ids, and texts become sequences of ids. Level by level every two neighbouring ids of frequent
(k - 1)-word phrases name a k-word phrase: the pair is counted over the whole corpus, a frequent pair gets an id of its own, and
the sequences are rewritten in these ids. The row of a phrase is (id, left, right, f): its parents are the phrases without its
last and without its first word. So all else is looked up along the parents: the first j words of a phrase are reached by going
left, the last j by going right (cuts), and a phrase lies inside exactly those one word longer that name it as a parent
(subsumption: longer ones still are no more frequent than these).

The corpus is cut into blocks of about BLOCK words. A block sends each of its different words and pairs once, with its count, and
gets back the ids of those that are frequent; words that stand everywhere are therefore as many rows as there are blocks, and no
task sees all places of anything. The rows of a phrase meet once: summed up over their group, and only those of frequent phrases
go on. Only pairs of frequent phrases are ever counted: no phrase is more frequent than its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import drop, materialize, table, tidy

#: Words of a block; it is full when it holds as many, texts are not divided.
BLOCK = 1_000_000
LEAST, LONGEST, SUBSUMED, BEST = 10, 3, 50, 2_000
#: Where texts are cut into pieces, and a sign for that between words.
MARKS, CUT = r"[.,;:!?\n\x0b\x0c\r]", "\n"
NO_LANG = "und"
#: The score in exact numbers: up to 15 digits of a, 17 of l and of r.
SCORE = "cast((cast(1000000 as decimal(7,0)) * cast(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) as decimal(30,0))) div cast(cast(l as decimal(17,0)) * cast(r as decimal(17,0)) as decimal(34,0)) as long)"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, codes): the different words of some texts, and the texts as one sequence of their numbers, -1 where a piece or
    a text ends. A-Z are lower-cased; pieces end at MARKS, words at blanks and tabs."""
    ended = pc.binary_join_element_wise(pc.ascii_lower(texts.cast(pa.large_string())), pa.scalar(CUT, pa.large_string()), pa.scalar("", pa.large_string()))
    marked = pc.replace_substring_regex(ended, pattern=MARKS, replacement=f" {CUT} ")
    every = pc.split_pattern(pc.replace_substring(marked, pattern="\t", replacement=" "), pattern=" ").flatten()
    every = every.filter(pc.not_equal(every, pa.scalar("", pa.large_string()))).dictionary_encode()
    codes, words = every.indices.to_numpy().astype(np.int32), every.dictionary
    cut = pc.index(words, pa.scalar(CUT, pa.large_string())).as_py()
    if cut < 0:
        return words.cast(pa.string()), codes
    shifted = np.arange(len(words), dtype=np.int32)
    shifted[cut:] -= 1
    shifted[cut] = -1
    return pa.concat_arrays([words[:cut], words[cut + 1 :]]).cast(pa.string()), shifted[codes]


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """text, lang -> a row for each block with codes (32-bit numbers of its words), and rows (block, code, lang, word, n) of
    its different words. All texts of a block have one lang."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal number
            whole = pa.concat_tables(held).combine_chunks()
            for lang in pc.unique(whole["lang"]).to_pylist():
                words, codes = words_of(whole.filter(pc.equal(whole["lang"], lang))["text"].combine_chunks())
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                for s in range(0, len(words), 50_000):
                    w = words[s : s + 50_000]
                    yield batch(block=pa.array(np.full(len(w), number)), code=pa.array(np.arange(s, s + len(w), dtype=np.int32)), lang=pa.array([lang] * len(w)), word=w, n=pa.array(counts[s : s + len(w)]))
                yield batch(block=pa.array([number]), codes=pa.array([codes.tobytes()], pa.binary()))
                number += 1

        for b in batches:
            for s in range(0, b.num_rows, 100):
                some = pa.Table.from_batches([b.slice(s, 100)])
                held.append(some)
                size += some["text"].nbytes // 6
                if size >= block:
                    yield from full()
                    held, size = [], 0
                    tidy()
        if held:
            yield from full()
            tidy()

    shape = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("codes", pa.binary())])

    def batch(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    return rows.mapInArrow(work, "block long, code int, lang string, word string, n long, codes binary")


#: A block as the sequence of its phrases of one length: 32-bit numbers, -1 where none starts, and the ids (64 bits) of the numbers.
SEQUENCE = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])


def pairs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in a sequence, neither of them -1: where they start, the different pairs as 64-bit keys, the number of the
    pair at each place, and how often each stands."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    keys, which, n = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True, return_counts=True)
    return at, keys, which, n


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pairs of neighbours of each block by their ids, numbered by code, with their counts."""
    for batch in batches:
        for row in batch.to_pylist():
            _, keys, _, n = pairs_of(np.frombuffer(row["codes"], np.int32))
            ids = np.frombuffer(row["ids"], np.int64)
            for s in range(0, len(keys), 100_000):
                k = keys[s : s + 100_000]
                columns = [np.full(len(k), row["block"]), np.arange(s, s + len(k), dtype=np.int32), ids[k >> 32], ids[k & 0xFFFFFFFF], n[s : s + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "code", "left", "right", "n"])


def _renamed(paired: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One block, and the ids of its frequent words or (paired) pairs (code, id) -> the block as the sequence of these."""
    return lambda blocks, names: _sequence(blocks, names, paired)


def _sequence(blocks: pa.Table, names: pa.Table, paired: bool) -> pa.Table:
    if not blocks.num_rows or not names.num_rows:
        return SEQUENCE.empty_table()
    codes = np.frombuffer(blocks["codes"][0].as_py(), np.int32)
    if paired:
        at, keys, which, _ = pairs_of(codes)
        codes, before = np.full(len(codes), -1, np.int32), len(keys)
        codes[at] = which
    else:
        before = int(codes.max(initial=-1)) + 1
    known = np.full(before + 1, -1, np.int32)  # the last place stands for code -1
    known[names["code"].to_numpy()] = np.arange(names.num_rows, dtype=np.int32)
    values = [[blocks["block"][0].as_py()], [known[codes].tobytes()], [names["id"].to_numpy().astype(np.int64).tobytes()]]
    return pa.table([pa.array(v, f.type) for v, f in zip(values, SEQUENCE, strict=True)], schema=SEQUENCE)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """text, lang -> (phrases, sizes). phrases: lang, k (words), phrase, f, id, left, right, firsts and lasts (how often the
    first and the last 1 .. k - 1 words stand), all phrases of 1 to longest words that stand least times or more, as
    tables written by level; sizes: lang, n (all words)."""
    ship(docs.sparkSession)
    blocks = materialize(_blocks(docs, block), "phrase-blocks")
    words = blocks.filter("n is not null")
    sizes = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-sizes")
    rows, keys, levels, sequences = words.select("block", "code", "lang", "word", "n"), ["lang", "word"], [], blocks.filter("codes is not null").select("block", "codes")
    for k in range(1, longest + 1):
        # a row a block and phrase, hot ones included; what is rare ends here
        often = rows.withColumn("f", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("f") >= least).drop("n")
        often = materialize(often, f"phrase-often-{k}")
        named = materialize(often.groupBy(*keys).agg(F.max("f").alias("f")).withColumn("id", F.monotonically_increasing_id()), f"phrase-names-{k}")
        if k == 1:
            none, nothing = F.array().cast("array<long>"), F.lit(None).cast("long")
            level = named.select("id", "lang", F.col("word").alias("phrase"), "f", nothing.alias("left"), nothing.alias("right"), none.alias("firsts"), none.alias("lasts"))
        else:
            parent = levels[-1]
            one = parent.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("__l"), F.concat("firsts", F.array("f")).alias("firsts"))
            two = parent.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("__r"), F.concat("lasts", F.array("f")).alias("lasts"))
            level = named.join(one, "left").join(two, "right").withColumn("phrase", F.concat_ws(" ", "__l", "__r")).select("id", "lang", "phrase", "f", "left", "right", "firsts", "lasts")
        levels.append(materialize(level, f"phrases-{k}"))
        if k < longest:
            ids = often.join(named.drop("f"), keys).select(F.col("block").alias("of"), "code", "id")
            step = sequences.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(_renamed(paired=k > 1), "block long, codes binary, ids binary")
            before, sequences = (sequences if k > 1 else blocks), materialize(step, f"phrase-sequences-{k}")
            drop(before)
            rows, keys = sequences.mapInArrow(_pairs, "block long, code int, left long, right long, n long"), ["left", "right"]
        drop(often)
        drop(named)
    return reduce(DataFrame.unionByName, [level.withColumn("k", F.lit(i + 1)) for i, level in enumerate(levels)]), sizes


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, best: int = BEST, block: int = BLOCK) -> DataFrame:
    """text, lang -> lang, rank, phrase, a, l, r, n, score: phrases of 2 to longest words that stand least times or more, by
    the score floor(1000000 * a * a / (l * r)) of their weakest cut (ties: the shortest first part). A phrase goes if a longer
    one that holds it stands subsumed percent as often or more. Of each lang the best first, then the more frequent, then by
    bytes.

    Null texts are empty, a null lang is `und`. Rows are told apart by nothing: a repeated text counts again. A text without
    words adds nothing, an empty table gives an empty one. Other columns are left out, whatever they are called. Products are exact up to
    10**15 words of a lang."""
    every, sizes = phrases(docs, least, longest, block)
    longer = every.filter("k > 1")
    # parents of a phrase are the phrases one word shorter that lie in it; ids are told apart by level
    inside = longer.select(F.explode(F.array("left", "right")).alias("id"), (F.col("k") - 1).alias("k"), "f").groupBy("id", "k").agg(F.max("f").alias("__most"))
    kept = longer.join(inside, ["id", "k"], "left").filter(~F.coalesce(100 * F.col("__most") >= subsumed * F.col("f"), F.lit(False)))
    cuts = kept.select("lang", "phrase", "f", F.posexplode(F.arrays_zip("firsts", F.reverse("lasts").alias("lasts"))).alias("j", "x"))
    cuts = cuts.select("lang", "phrase", "j", F.col("f").alias("a"), F.col("x.firsts").alias("l"), F.col("x.lasts").alias("r"))
    part = cuts.withColumn("score", F.expr(SCORE))
    weakest = F.min(F.struct("score", "j", "l", "r")).alias("m")
    scored = part.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= best)
    # the best of each 64th of a lang, then of the lang: no task sorts all phrases of one
    top = first(first(scored.withColumn("__s", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "__s"), "lang")
    return top.join(F.broadcast(sizes.select("lang", "n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


_OP11_COUNTS = " UNION ALL ".join(f"SELECT lang, {k} AS k, w[i:i + {k - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in (1, 2, 3))

OP11_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, k, p, count(*) AS f FROM ({_OP11_COUNTS}) GROUP BY lang, k, p HAVING count(*) >= 10),
longer AS (SELECT lang, inner_, max(f) AS most FROM (
  SELECT lang, p[1:2] AS inner_, f FROM f WHERE k = 3 UNION ALL SELECT lang, p[2:3], f FROM f WHERE k = 3) GROUP BY lang, inner_),
kept AS (SELECT f.* FROM f LEFT JOIN longer ON f.lang = longer.lang AND f.p = longer.inner_ WHERE k > 1 AND coalesce(100 * most >= 50 * f, false) = false),
cuts AS (SELECT c.lang, c.p, c.j, c.f AS a, x.f AS l, y.f AS r FROM (SELECT lang, p, k, f, unnest(range(1, k)) AS j FROM kept) c
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.j] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.j + 1:c.k]),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM weakest JOIN sizes USING (lang)) WHERE rank <= 2000
"""
