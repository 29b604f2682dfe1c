"""Dedup, hash-ordered selection and caps, and grouped splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import effective_group_key, order_digest
from ..scratch import written
from ..session import ship

SPLITS = ("train", "validation", "test")
#: Groups that are worth a part of their own in the order of a split.
GROUPS_A_PART = 1_000


def dedup(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each key: the first in the given order. Aggregated partially, so a hot key is no larger than others."""
    rest = [c for c in df.columns if c not in keys]
    one = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    out = df.groupBy(*keys).agg(one.alias("__one"))
    return out.select(*[F.col(c) if c in keys else F.col("__one")[c].alias(c) for c in df.columns])


def duplicates(df: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """Rows that dedup() by key with least id_ leaves out: key, id_."""
    least = df.groupBy(key).agg(F.min(id_).alias("__least"), F.count("*").alias("__n")).filter("__n > 1").withColumnRenamed(key, "__key")
    rows = df.join(least, F.col(key).eqNullSafe(F.col("__key")))
    return rows.filter(F.col(id_) != F.col("__least")).select(key, id_)


def duplicate_groups(df: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """key, ids (sorted), n for keys that stand more than once."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_list(id_)).alias("ids"), F.count("*").alias("n"))
    return g.filter("n > 1")


def select_hash(df: DataFrame, most: int, seed: int, id_: str = "id") -> DataFrame:
    """At most so many rows, those whose seeded digests come first; most must be positive."""
    if most <= 0:
        raise ValueError("the limit must be positive")
    return df.withColumn("__d", order_digest(seed, F.col(id_).cast("string"))).orderBy("__d", id_).limit(most).drop("__d")


def cap_per_source(df: DataFrame, most: int, seed: int, source: str = "source", id_: str = "id") -> DataFrame:
    df = df.withColumn("__d", order_digest(seed, F.col(id_).cast("string")))
    rank = F.row_number().over(Window.partitionBy(source).orderBy("__d", id_))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank", "__d")


def order_hash(df: DataFrame, seed: int, by: list[str], id_: str = "id") -> DataFrame:
    """df with position: the place of a row, from 0, in its group's seeded order.

    Numbered in two levels: how many rows stand in each of 4,096 digest ranges of a group, then places inside a range. So
    no task sorts a whole group, however large."""
    df = df.withColumn("__d", order_digest(seed, F.col(id_).cast("string"))).withColumn("__r", F.substring("__d", 1, 3))
    sizes = df.groupBy(*by, "__r").agg(F.count("*").alias("__n"))
    before = (F.sum("__n").over(Window.partitionBy(*by).orderBy("__r")) - F.col("__n")).alias("__before")
    sizes = sizes.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__r").alias("__q"), before)
    match = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)] + [F.col("__r") == F.col("__q")]
    place = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__d", id_)) - 1
    out = df.withColumn("__p", place).join(sizes, match)
    return out.withColumn("position", (F.col("__before") + F.col("__p")).cast("int")).select(*[c for c in df.columns if c not in ("__d", "__r")], "position")


def split_targets(n: int, ratios: tuple[float, ...] = (0.9, 0.05, 0.05)) -> list[int]:
    """How many examples each split is to hold: floors, and the rest to the largest fractions (of equal ones the
    later)."""
    exact = [r * n for r in ratios]
    out = [int(x) for x in exact]
    fractions = sorted(range(len(ratios)), key=lambda i: (exact[i] - out[i], i))
    for i in fractions[len(fractions) - (n - sum(out)) :] if n > sum(out) else []:
        out[i] += 1
    return out


def grouping_key(by: str) -> Column:
    """The key by which examples (id, context, group_key) stay together: example, topic or context. A key of their own goes
    first; by topic, examples without one stay with their context, so that they do not become one huge group."""
    if by == "example":
        return F.concat(F.lit("id:"), F.col("id").cast("string"))
    if by == "topic":
        return F.coalesce(F.when(F.col("group_key") != "", F.col("group_key")), effective_group_key(F.col("group_key"), F.col("context")))
    if by == "context":
        return effective_group_key(F.col("group_key"), F.col("context"))
    raise ValueError(f"groups are made by example, topic or context, not by {by!r}")


def fold_split(counts: Iterable[int], aims: list[int], have: list[int]) -> tuple[list[int], list[int]]:
    """The split of each group in turn, by its number, and what the splits hold then: a group goes to the split that lacks
    the largest part of its target (ties: the earlier split), to the first where none lacks anything."""
    have, out = list(have), []
    lack = [(a - h) / a if a else 0.0 for a, h in zip(aims, have, strict=True)]
    for n in counts:
        best = lack.index(most) if (most := max(lack)) > 0 else 0
        have[best] += n
        lack[best] = (aims[best] - have[best]) / aims[best] if aims[best] else 0.0
        out.append(best)
    return out, have


def split_groups(df: DataFrame, key: str, seed: int, ratios: tuple[float, ...] = (0.9, 0.05, 0.05)) -> DataFrame:
    """df with split: whole groups, in the order of their seeded digests, go to the split that lacks the largest part of
    its target (ties in order of the splits; none lacking: train). A null key is a group of its own.

    The rule looks at all choices before, so it is a fold over the order. It runs in parallel all the same: digests are sorted by
    range, every part folds from a guess of what the splits hold before it (their shares of the rows so far), and the end of
    each part is the next one's start in another round, in which only parts whose start was wrong run again. Choices that
    lack or have a little more soon are the same, so the second round or the third changes nothing; then every start is the
    true end before it, and the places are those of the fold in one piece. A part keeps three numbers."""
    spark = df.sparkSession
    ship(spark)
    groups = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n"))
    digest = order_digest(seed, F.coalesce(F.col("__key").cast("string"), F.lit("")))
    groups = written(groups.withColumn("__d", digest), "split-groups")
    n_groups, total = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    aims = split_targets(total, ratios)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_groups // GROUPS_A_PART))
    order = ["__d", F.asc_nulls_first("__key")]
    ranged = written(groups.repartitionByRange(parts, *order).sortWithinPartitions(*order), "split-order")
    placed = ranged.select("*", F.regexp_extract("_metadata.file_path", r"/part-(\d+)[^/]*$", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("row"))
    in_turn = lambda rows: rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "row")

    def ends_of(starts: dict[int, list[int]]) -> dict[int, list[int]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have: dict[int, list[int]] = {}
            for batch in batches:
                for part, counts in _by_part(batch):
                    have[part] = fold_split(counts, aims, have.get(part) or starts[part])[1]
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(have), pa.int32()), "have": pa.array(list(have.values()), pa.list_(pa.int64()))})

        rows = placed.select("part", "row", "n").filter(F.col("part").isin(list(starts)))
        return {r["part"]: r["have"] for r in in_turn(rows).mapInArrow(work, "part int, have array<long>").collect()}  # a row a part

    before, starts = 0, {}
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):  # a row a part
        guess = [a * before // max(1, total) for a in aims]
        starts[r["part"]] = [guess[0] + before - sum(guess), *guess[1:]]
        before += r["n"]
    ends, stale = {}, dict(starts)
    while stale:
        ends |= ends_of(stale)
        numbers = sorted(starts)
        true = dict(zip(numbers[1:], [ends[p] for p in numbers], strict=False))
        stale = {p: have for p, have in true.items() if starts[p] != have}
        starts |= stale

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[int]] = {}
        for batch in batches:
            out = []
            for part, counts in _by_part(batch):
                places, have[part] = fold_split(counts, aims, have.get(part) or starts[part])
                out += places
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["__key", "place"])

    kind = groups.schema["__key"].dataType.simpleString()
    chosen = in_turn(placed.select("__key", "part", "row", "n")).select("__key", "part", "n").mapInArrow(choose, f"__key {kind}, place int")
    named = F.element_at(F.array(*map(F.lit, SPLITS)), F.col("place") + 1)
    chosen = chosen.select("__key", named.alias("split"))
    return df.join(chosen, F.col(key).eqNullSafe(F.col("__key"))).select(*df.columns, "split")


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int]]]:
    """The counts of a batch, cut where the part changes."""
    parts, counts = batch.column("part").to_numpy(), batch.column("n").to_pylist()
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if s < e:
            yield int(parts[s]), counts[s:e]


def leaked_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in two splits or more."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def shared_keys(df: DataFrame, key: str, split: str, one: str, other: str) -> DataFrame:
    """Keys that stand in both of two splits."""
    of = lambda name: df.filter(F.col(split) == name).select(key)
    return of(one).intersect(of(other))


def require_unique(df: DataFrame, id_: str = "id") -> DataFrame:
    """df; a repeated id is an error at run time."""
    n = F.count("*").over(Window.partitionBy(id_))
    wrong = F.raise_error(F.concat(F.lit("repeated id "), F.col(id_).cast("string"))).cast("bigint")
    return df.withColumn("__n", n).filter(F.when(F.col("__n") > 1, wrong).otherwise(F.lit(1)) == 1).drop("__n")


#: Lanes of a fingerprint's sums, each of 64 bits.
LANES = [f"s{i}" for i in range(4)]


def fingerprint_state(df: DataFrame, fp: Column) -> DataFrame:
    """One row: n, and the sums s0 .. s3 (decimal, modulo 2**64) of the four parts of the SHA-256 digests of fingerprints.

    Sums do not know an order and know how often a fingerprint stands. They are made in every task and added up; states of
    parts are merged by merge_fingerprints(), so a new file needs to be read only itself. A null fingerprint counts as a
    value of its own; without rows all is 0."""
    d = F.coalesce(F.sha2(fp, 256), F.lit("0" * 63 + "1"))
    lane = lambda i: F.conv(F.substring("__d", 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")
    sums = [F.coalesce(F.sum(lane(i)), F.lit(0)).alias(s) for i, s in enumerate(LANES)]
    return _wrapped(df.select(d.alias("__d")).agg(F.count("*").alias("n"), *sums))


def _wrapped(df: DataFrame) -> DataFrame:
    return df.withColumns({s: (F.col(s).cast("decimal(38,0)") % F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)") for s in LANES})


def merge_fingerprints(states: DataFrame) -> DataFrame:
    """The state of all rows of parts, from the parts' states."""
    sums = [F.coalesce(F.sum(F.col(s).cast("decimal(28,0)")), F.lit(0)).alias(s) for s in LANES]
    return _wrapped(states.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *sums))


def named_fingerprint(state: DataFrame, length: int = 16) -> DataFrame:
    """A state's fingerprint: the first hexadecimal digits of SHA-256 of its numbers."""
    numbers = F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", *LANES)])
    return state.select(F.substring(F.sha2(numbers, 256), 1, length).alias("fingerprint"))


def dataset_fingerprint(df: DataFrame, fp: Column, length: int = 16, ordered: bool = False) -> DataFrame:
    """One row, one digest whatever the order of rows, see fingerprint_state(); ordered: see ordered_fingerprint()."""
    return ordered_fingerprint(df, fp, length) if ordered else named_fingerprint(fingerprint_state(df, fp), length)


def ordered_fingerprint(df: DataFrame, fp: Column, length: int = 16) -> DataFrame:
    """One row, one digest whatever the order of rows: SHA-256 over the sorted digests of fingerprints, each followed by NUL.
    Digests of 4,096 ranges, told by their first three digits, are made first, and the whole one of these.

    A null fingerprint stands as the empty digest, in a range of its own. Equal digests travel as one with their number, and a
    range is hashed as it is read, so no task holds a range, however large or often repeated."""
    ship(df.sparkSession)
    counts = df.select(F.coalesce(F.sha2(fp, 256), F.lit("")).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    rows = counts.withColumn("k", F.substring("d", 1, 3)).repartition("k").sortWithinPartitions("d")
    parts = rows.select("k", "d", "n").mapInArrow(_range_digests, "k string, p string")
    every = parts.agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("all"))  # 4,097 at most
    text = F.array_join(F.transform("all", lambda x: F.concat(x["p"], F.lit("\u0000"))), "")
    return every.select(F.substring(F.sha2(text, 256), 1, length).alias("fingerprint"))


#: So many equal digests are hashed at once.
AT_ONCE = 10_000


def _range_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (k, d, n) -> k and SHA-256 of its digests, each as often as n says and followed by NUL."""
    key, state, done = None, hashlib.sha256(), []
    for batch in batches:
        for k, d, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                done += [(key, state.hexdigest())] if key is not None else []
                key, state = k, hashlib.sha256()
            one = d.encode() + b"\0"
            for _ in range(n // AT_ONCE):
                state.update(one * AT_ONCE)
            state.update(one * (n % AT_ONCE))
    done += [(key, state.hexdigest())] if key is not None else []
    yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in done], pa.string()), "p": pa.array([p for _, p in done], pa.string())})
