"""Removal of repeated 200-byte strings by prefix-free parsing and suffix arrays.

1. Parse. A place is a trigger if the rolling hash of the GRAM bytes there falls below a limit: this depends on those bytes
   alone. Phrases run from trigger to trigger, the second one included, so no phrase is a proper beginning of another.
   The text from a place to the end of its phrase is a dictionary suffix, and what follows is a suffix of the parse.
2. Prune. Windows (200-byte strings) are taken together that have their first trigger in common and lie within SPAN places
   of each other. What all of them share (their core) repeats if any of them does, and where their whole surroundings (the
   context) stand twice, all of them do. Contexts left are cut into FINE places and pruned once more in the same way. What is
   then left are windows at the very ends of repeats, from one place of each context.
3. Suffix arrays. The distinct phrases behind those windows are sorted: the dictionary's order. Each parse suffix, as far as
   200 bytes reach, becomes its phrases' places in that order, and these lists are sorted: the parse's order. Windows are
   then sorted by dictionary suffix and, where that is equal, by place of the parse suffix. As the phrases are prefix-free
   this is the order of the corpus itself, in which equal windows are neighbours: a window that has 200 bytes in common
   with a neighbour repeats. Neighbours at the ends of two partitions are compared on the driver (two rows a partition).

Hashes of 64 bits stand for cores, contexts, texts and the comparison of neighbours. Pruning, too, compares neighbours of a
sorted order cut into ranges, so a core or context that holds a third of all rows goes over many partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import U64, drop, materialize, mix64, table
from .repeats import Rolling, pieces, runs

#: Fixed value of the contract.
LENGTH = 200
#: Bytes of a trigger, mean distance of triggers, places of a segment before and after the second pruning.
GRAM, MEAN, SPAN, FINE = 16, 28, 64, 8
#: Texts and segments, at most, by which the sizes of partitions are chosen; no result depends on them.
SAMPLED_TEXTS, SAMPLE = 2_000, 20_000
#: A phrase of the dictionary is cut here: no window reaches further.
MOST = LENGTH + GRAM
_CODES = mix64(np.arange(1, 257, dtype=U64))
#: A segment's place: first window, distance to the trigger (ALONE: none), last window less first.
ALONE = 255


def place(first: np.ndarray, distance: np.ndarray | int, width: np.ndarray | int) -> np.ndarray:
    return (first << 16) + (distance << 8) + width


class Text:
    """A text's bytes, hashes of its parts and its triggers."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        self.roll = Rolling(_CODES[self.bytes])
        self.n = len(self.bytes)

    def triggers(self) -> np.ndarray:
        return np.flatnonzero((self.roll.raw(GRAM) >> U64(32)) < U64(2**32 // MEAN)) if self.n >= GRAM else np.zeros(0, np.int64)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Core, context and place of every segment of windows; windows without a trigger stand alone."""
        cores, contexts, places = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        end = self.n - LENGTH
        if end >= 0:
            t = self.triggers()
            before = np.concatenate([[-1], t[:-1]]) if len(t) else t
            for low in range(0, LENGTH - GRAM, SPAN):
                high = min(low + SPAN - 1, LENGTH - GRAM)
                first, last = np.maximum(np.maximum(before + 1, t - high), 0), np.minimum(t - low, end)
                some = first <= last
                self._segment(cores, contexts, places, t[some], first[some], last[some], low, SPAN)
            begins, ends = np.concatenate([[0], t + 1]), np.minimum(np.concatenate([t - (LENGTH - GRAM) - 1, [end]]), end)
            alone = pieces(begins, np.maximum(ends - begins + 1, 0))
            h = self.roll.hash(alone, alone + LENGTH)
            cores.append(h)
            contexts.append(h)
            places.append(place(alone, ALONE, 0))
        return np.concatenate(cores), np.concatenate(contexts), np.concatenate(places)

    def _segment(self, cores: list, contexts: list, places: list, t, first, last, low, span: int) -> None:
        # every window of a segment begins at t - low or up to span - 1 places before
        cores.append(mix64(self.roll.hash(t - low, t - low - (span - 1) + LENGTH) + np.asarray(low * 1000 + span, U64)))
        contexts.append(mix64(self.roll.hash(first, last + LENGTH) + (t - first).astype(U64)))
        places.append(place(first, t - first, last - first))

    def finer(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the parts, of FINE places at most, of segments."""
        x, t = windows(at)
        part = (t - x) // FINE
        change = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(t, prepend=-1) != 0))
        last = x[np.append(change[1:], len(x)) - 1] if len(x) else x
        out: tuple[list, list, list] = ([], [], [])
        self._segment(*out, t[change], x[change], last, part[change] * FINE, FINE)
        return out[0][0], out[1][0], out[2][0]


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of segments, and their triggers."""
    first, n = at >> 16, (at & 255) + 1
    return pieces(first, n), np.repeat(first + ((at >> 8) & 255), n)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


_SEGMENT = "core long, context long, key long, place long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> core, context, key, place; copies of a text in one task give their segments once."""
    seen: set[int] = set()
    for batch in batches:
        found: list[tuple] = []
        for key, data in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
            if key not in seen:
                if len(seen) < 200_000:  # more copies would be found again, which changes nothing
                    seen.add(key)
                found.append((*Text(data).segments(), key))
        if found:
            yield _joined(found)


def _joined(found: list[tuple]) -> pa.RecordBatch:
    core, context, at = (np.concatenate([f[i] for f in found]) for i in range(3))
    key = np.repeat(np.array([f[3] for f in found], np.int64), [len(f[0]) for f in found])
    arrays = [pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(key), pa.array(at)]
    return pa.RecordBatch.from_arrays(arrays, names=["core", "context", "key", "place"])


def _between(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds (columns core, context, key) each row is behind, compared column by column."""
    lo, hi = (np.searchsorted(bounds[:, 0], rows[:, 0], side) for side in ("left", "right"))
    if bounds.shape[1] == 1:
        return hi
    out = lo.copy()
    on = np.flatnonzero(hi > lo)  # rows with the value of a bound: few, or many of one value
    for value in np.unique(rows[on, 0]).tolist():
        some = on[rows[on, 0] == value]
        first, last = lo[some[0]], hi[some[0]]
        out[some] = first + _between(bounds[first:last, 1:], rows[some, 1:])
    return out


def _sample(rows: DataFrame, tasks: int) -> np.ndarray:
    """core, context, key of rows drawn by hash: all of them, or about SAMPLE to 2 * SAMPLE, and eight to sixteen a task where
    that is more."""
    share = max(1, rows.count() // max(SAMPLE, 8 * tasks))
    drawn = rows.filter(F.pmod(F.xxhash64("core", "context", "key", "place"), F.lit(share)) == 0).select("core", "context", "key").toArrow()
    return np.stack([c.to_numpy().astype(np.int64) for c in drawn.columns], 1) if drawn.num_rows else np.zeros((0, 3), np.int64)


def _bounds(drawn: np.ndarray, tasks: int) -> np.ndarray:
    """Different rows of the sample that cut it into as many even parts as there are tasks, or, where it has fewer rows, into
    as many parts as it allows."""
    drawn = np.unique(drawn, axis=0)
    at = np.unique(np.linspace(0, len(drawn), tasks + 1).astype(int)[1:-1])
    return drawn[at[at < len(drawn)]]


def _prune(rows: DataFrame, parse: Callable, sample: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The segments that parse makes of rows -> (key, place) of those whose context stands twice, and (key, place) of one or two places of each context
    that shares its core with another: windows there may repeat though not all do.

    The rows are sorted by core, context, key and place, so that all of this shows between neighbours. Partitions are
    ranges of that order, cut by a sample of the rows of sample, which decides nothing but their sizes: a core or context
    with many rows goes over several. Where two partitions meet, the driver looks at two rows."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(_sample(sample, n), n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parse(batches):
            values = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_between(bounds, values).astype(np.int32))], names=[*batch.schema.names, "part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with what is known of them: 1, context stands twice; 2, beside another context of its core; first and
        last rows of the partition also for the driver, with the partition's number."""
        part, last, names = TaskContext.get().partitionId(), None, ["core", "context", "key", "place", "kind", "part"]

        def tell(cols: list, which: np.ndarray, kind: int, side: int) -> pa.RecordBatch:
            more = (pa.array(np.full(len(which), x, np.int64)) for x in (kind, side))
            return pa.RecordBatch.from_arrays([*(pa.array(c[which]) for c in cols), *more], names=names)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            if last is None:
                yield tell(cols, np.zeros(1, int), 0, 2 * part)
            else:  # the last row may be told twice, here and with its own batch
                cols = [np.concatenate([a, b]) for a, b in zip(last, cols, strict=True)]
            core = cols[0][1:] == cols[0][:-1]
            same = core & (cols[1][1:] == cols[1][:-1])
            for kind, pairs in ((1, same), (2, core & ~same)):
                hit = np.flatnonzero(pairs)
                yield tell(cols, np.union1d(hit, hit + 1), kind, -1)
            last = [c[-1:] for c in cols]
        if last is not None:
            yield tell(last, np.zeros(1, int), 0, 2 * part + 1)

    by = ["core", "context", "key", "place"]
    dealt = rows.mapInArrow(deal, f"{_SEGMENT}, part int").repartitionById(n, "part").select(*by).sortWithinPartitions(*by)
    found = materialize(dealt.mapInArrow(compare, f"{_SEGMENT}, kind long, part long"), name)
    borders = [tuple(r) for r in found.filter("kind = 0").orderBy("part").collect()]
    more = []
    for a, b in zip(borders[1::2], borders[2::2], strict=False):
        if a[0] == b[0]:
            more += [(*x[:4], 1 if a[1] == b[1] else 2) for x in (a, b)]
    known = found.filter("kind > 0").select(*by, "kind")
    if more:
        known = known.union(spark.createDataFrame(more, f"{_SEGMENT}, kind long"))
    return known.filter("kind = 1").select("key", "place"), known.filter("kind = 2").select("key", "place")


def _with_texts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """key, places and text, one text of each key."""
    places = ends.groupBy("key").agg(F.collect_set("place").alias("places"))
    return docs.groupBy("key").agg(F.first("text").alias("text")).join(places, "key").select("key", "places", "text")


def _finer(docs: DataFrame, ends: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield _joined([(*Text(data).finer(np.sort(np.array(p, np.int64))), k) for k, p, data in zip(keys, at, _texts(batch, 2), strict=True)])

    return _with_texts(docs, ends).mapInArrow(cut, _SEGMENT)


_KINDS = {"kind": pa.int32(), "data": pa.binary(), "rest": pa.int64(), "window": pa.int64(), "key": pa.int64(), "start": pa.int64(), "phrases": pa.list_(pa.int64())}


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(n, t) for k, t in _KINDS.items()], names=list(_KINDS))


def _slices(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values, the bytes from begins to ends."""
    n = ends - begins
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data[pieces(begins, n)].tobytes())])


def _listed(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of three kinds: 0, a window with its dictionary suffix and the hash of what follows its trigger; 1, a phrase by
    hash; 2, the phrases of a parse suffix, by the hash of its first 200 bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found: list[list] = [[] for _ in range(9)]
            for key, p, data in zip(keys, at, _texts(batch, 2), strict=True):
                text = Text(data)
                x, t = windows(np.sort(np.array(p, np.int64)))
                rest = lambda t, text=text: text.roll.hash(t, np.minimum(t + LENGTH, text.n)).view(np.int64)
                every, heads = text.triggers(), np.unique(t)
                ends_ = np.minimum(np.minimum(np.append(every[1:] + GRAM, text.n), every + MOST), text.n)
                name = text.roll.hash(every, ends_).view(np.int64)
                i = np.searchsorted(every, heads)
                n = np.maximum(np.searchsorted(every, heads + LENGTH - GRAM) - i, 1)
                flat = pieces(i, n)
                fresh = np.array([k for k in np.unique(flat).tolist() if name[k] not in known], np.int64)
                if len(known) < 500_000:  # more phrases would be told again, which changes nothing
                    known.update(name[fresh].tolist())
                parts = (
                    _slices(text.bytes, x, t + GRAM), rest(t), text.roll.hash(x, x + LENGTH).view(np.int64), np.full(len(x), key, np.int64), x,
                    rest(heads), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(name[flat])),
                    name[fresh], _slices(text.bytes, every[fresh], ends_[fresh]),
                )
                for so_far, part in zip(found, parts, strict=True):
                    so_far.append(part)
            if not keys:
                continue
            cols = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else pa.array(np.concatenate(c)) for c in found]
            kind = lambda k, like: pa.array(np.full(len(like), k, np.int32))
            yield _rows({"kind": kind(0, cols[0]), "data": cols[0], "rest": cols[1], "window": cols[2], "key": cols[3], "start": cols[4]})
            yield _rows({"kind": kind(2, cols[5]), "rest": cols[5], "phrases": cols[6]})
            yield _rows({"kind": kind(1, cols[7]), "rest": cols[7], "data": cols[8]})

    ddl = "kind int, data binary, rest long, window long, key long, start long, phrases array<long>"
    return _with_texts(docs, ends).mapInArrow(work, ddl)


def _order(listed: DataFrame) -> DataFrame:
    """The windows with the place of their parse suffix: data, place, window, key, start."""
    book = listed.filter("kind = 1").groupBy(F.col("rest").alias("phrase")).agg(F.min("data").alias("data"))
    book = materialize(book, "suffix-phrases")
    # ranks that follow the order: partitions of a global sort are in order, and so are the ids inside them
    ranks = materialize(book.orderBy("data").select("phrase", F.monotonically_increasing_id().alias("rank")), "suffix-dictionary")
    drop(book)
    parse = listed.filter("kind = 2").groupBy("rest").agg(F.min("phrases").alias("phrases"))
    parse = parse.select("rest", F.posexplode("phrases").alias("i", "phrase"))
    ranked = materialize(parse.join(ranks, "phrase").select("rest", "i", "rank"), "suffix-parse")
    drop(ranks)
    lists = ranked.groupBy("rest").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ranks"))
    lists = materialize(lists, "suffix-lists")
    drop(ranked)
    order = materialize(lists.orderBy("ranks").select("rest", F.monotonically_increasing_id().alias("place")), "suffix-order")
    drop(lists)
    out = listed.filter("kind = 0").join(order, "rest").select("data", "place", "window", "key", "start")
    out = materialize(out, "suffix-windows")
    drop(order)
    return out


def _neighbours(ordered: DataFrame) -> DataFrame:
    """(key, start) of windows that equal the one before or after them in corpus order."""
    by = ["data", "place", "window", "key", "start"]
    n = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, *by).sortWithinPartitions(*by).select("window", "key", "start")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["part", "window", "key", "start"]
        rows = lambda p, w, k, s: pa.RecordBatch.from_arrays([pa.array(np.full(len(w), p, np.int64)), pa.array(w), pa.array(k), pa.array(s)], names=names)
        last = None
        for batch in batches:
            w, k, s = (batch.column(i).to_numpy() for i in range(3))
            if not len(w):
                continue
            if last is None:
                yield rows(2 * part, w[:1], k[:1], s[:1])  # the first of the partition
            else:
                w, k, s = (np.concatenate([a, b]) for a, b in zip(last, (w, k, s), strict=True))
            same = np.flatnonzero(w[1:] == w[:-1])
            both = np.union1d(same, same + 1)
            yield rows(-1, w[both], k[both], s[both])
            last = (w[-1:], k[-1:], s[-1:])
        if last is not None:
            yield rows(2 * part + 1, *last)

    found = materialize(ordered.mapInArrow(work, "part long, window long, key long, start long"), "suffix-neighbours")
    borders = [tuple(r) for r in found.filter("part >= 0").orderBy("part").collect()]
    more = [x[2:] for a, b in zip(borders[1::2], borders[2::2], strict=False) if a[1] == b[1] for x in (a, b)]
    marks = found.filter("part < 0").select("key", "start")
    return marks.union(found.sparkSession.createDataFrame(more, "key long, start long")) if more else marks


def covered(n: int, marks: list[int] | None, copied: bool) -> np.ndarray:
    """Which of n bytes lie in a repeated window."""
    if n < LENGTH:
        return np.zeros(n, bool)
    if copied:
        return np.ones(n, bool)
    change = np.zeros(n + 1, np.int32)
    if marks:
        at = np.array(marks, np.int64)
        np.add.at(change, at >> 8, 1)
        np.add.at(change, (at >> 8) + (at & 255) + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left); a row for each row.

    A null text is empty; texts shorter than 200 bytes keep everything; copies of a text of 200 bytes or more lose all of
    it, and repeated rows are copies. Texts of any length are taken whole, one at a time in memory. An empty table gives an
    empty one; other columns of docs are left out. doc_id passes through unread, null or not."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    texts = rows.select("key", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = max(1, rows.count() // max(SAMPLED_TEXTS, tasks))
    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(drawn)) == 0).mapInArrow(_parsed, _SEGMENT)
    whole, ends = _prune(texts, _parsed, some, "suffix-1")
    finer = materialize(_finer(rows, ends), "suffix-finer")
    fine, rest = _prune(finer, iter, finer, "suffix-2")
    drop(finer)
    listed = materialize(_listed(rows, rest), "suffix-listed")
    ordered = _order(listed)
    drop(listed)
    loose = _neighbours(ordered)
    drop(ordered)
    mark = (F.shiftleft(F.shiftright("place", 16), 8) + F.col("place").bitwiseAND(255)).alias("mark")
    marks = whole.select("key", mark).union(fine.select("key", mark)).union(loose.select("key", F.shiftleft("start", 8)))
    marks = materialize(marks.groupBy("key").agg(F.collect_set("mark").alias("marks")), "suffix-marks")
    copies = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("copied"))
    facts = materialize(copies.join(marks, "key", "full").select("key", F.when(F.col("copied").isNull(), F.col("marks")).alias("marks"), "copied"), "suffix-facts")
    for t in (whole, fine, marks):
        drop(t)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, found, copied in zip(_texts(batch, 1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                gone = covered(len(data), found, bool(copied))
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((len(data), int(gone.sum()), runs(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rows.join(facts, "key", "left").select("doc_id", "text", "marks", "copied")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return done.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, ties and empty tables as suffix_dedup() states."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")
