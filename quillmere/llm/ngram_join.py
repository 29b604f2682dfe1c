"""N-gram Jaccard join by rare-first prefix filtering.

1. Every text becomes its set of 64-bit shingle hashes. Texts with equal sets are one node, so exact copies never meet.
2. Shingles are ordered rare first. Frequencies come from counts over a fixed number of hash slots, summed over all
   documents: their size does not grow with the corpus, and any order shared by all sets keeps the filter exact.
3. Two sets that link share a shingle in their prefixes. Postings of prefix shingles are joined on the shingle; length
   and positional filters drop pairs, and what is left is verified once, after a suffix filter, on the whole sets.
4. Pairs are asked for in two rounds. First each shingle's nodes meet one leader; nodes that are then known to be connected
   need no more pairs between them. At last every pair of nodes of different components that shares a prefix shingle
   and passes the filters is verified, asked for at the first of neighbouring shingles that both have. No group is expanded into all its pairs, and no link between components is lost.
5. Components come from alternating large-star and small-star steps over tables in the shared folder.

64-bit hashes stand for shingles and sets: for n different shingles the chance of any collision is about n**2 / 2**65.
Two sets are verified by 48 of the bits: a pair of n and m shingles has a false match with a chance of n * m / 2**48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import U64, drop, materialize, mix64, table
from .repeats import word_codes

WORDS, PERCENT = 5, 75
SLOTS_BITS, SLICES = 20, 64
#: So many ids at most are broadcast (16 bytes each).
BROADCAST_ROWS = 250_000

_MULTIPLIERS = mix64(np.arange(1, 65, dtype=U64)) | U64(1)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles of a text, A-Z lower-cased. Fewer words are one shingle, none are
    none; null is none."""
    h = word_codes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return np.zeros(0, U64)
    k = min(n, len(h))
    m = len(h) - k + 1
    total = np.zeros(m, U64)
    for i in range(k):
        total += h[i : i + m] * _MULTIPLIERS[i]
    return np.unique(mix64(total + U64(k)))


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = (s * U64(0x9FB21C651E98DF25)).sum(dtype=U64) ^ np.bitwise_xor.reduce(mix64(s + U64(0x632BE59BD9B4E019)))
    return int(mix64(np.array([x + U64(len(s))], U64)).view(np.int64)[0]) if len(s) else 0


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """Rows (ref, named, text_key, node, size) for documents, and (slice, counts) for the slots of each partition, whose
    number stands in ref."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SLOTS_BITS, np.uint32)
        for batch in batches:
            nodes, sizes, slots = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, n)
                nodes.append(node_of(s))
                sizes.append(len(s))
                slots.append((s >> U64(64 - SLOTS_BITS)).astype(np.int32))
            if slots:
                counts += np.bincount(np.concatenate(slots), minlength=1 << SLOTS_BITS).astype(np.uint32)
            yield pd.DataFrame({"ref": batch["ref"], "named": batch["named"], "text_key": batch["text_key"], "node": nodes, "size": sizes, "slice": -1, "counts": None})
        parts = [p.tobytes() for p in np.split(counts, SLICES)]
        yield pd.DataFrame({"ref": TaskContext.get().partitionId(), "named": False, "text_key": 0, "node": 0, "size": 0, "slice": range(SLICES), "counts": parts})

    return docs.mapInPandas(work, "ref long, named boolean, text_key long, node long, size int, slice int, counts binary")


def _frequencies(profile: DataFrame, fan: int = 64) -> np.ndarray:
    """Counts of all slots: 4 MB whatever the corpus. They are summed in a tree, so that a task holds fan parts at most,
    however many partitions the corpus has."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SLOTS_BITS) // SLICES, np.uint64)
        for c in rows["counts"]:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"ref": rows["ref"].iloc[:1], "slice": rows["slice"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    rows = profile.filter("slice >= 0").select("ref", "slice", "counts")
    last = rows.agg(F.max("ref")).first()[0] or 0
    while True:
        rows = rows.withColumn("ref", F.floor(F.col("ref") / fan)).groupBy("ref", "slice").applyInPandas(add, "ref long, slice int, counts binary")
        last //= fan
        if not last:
            break
        rows = materialize(rows, "slot-sums")
    out = np.zeros(1 << SLOTS_BITS, np.uint32)
    for r in rows.collect():
        out.reshape(SLICES, -1)[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out


def prefix_length(size, percent: int):
    """How many of the rarest shingles must be looked at: links need percent / 100 of the larger set to be shared."""
    return size - (percent * size + 99) // 100 + 1


def _prefixes(docs: DataFrame, frequencies, n: int, percent: int) -> DataFrame:
    """(ref, named, node, size, tokens): each document's prefix in rare-first order."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq = frequencies.value
        for batch in batches:
            rows = []
            for ref, named, text in zip(batch["ref"], batch["named"], batch["text"], strict=True):
                s = shingle_set(text, n)
                if not len(s):
                    continue
                f = freq[(s >> U64(64 - SLOTS_BITS)).astype(np.int64)]
                k = prefix_length(len(s), percent)
                if len(s) > 4 * k + 64:
                    some = np.flatnonzero(f <= np.partition(f, k - 1)[k - 1])
                    s2, f = s[some], f[some]
                else:
                    s2 = s
                rows.append((ref, named, node_of(s), len(s), s2[np.argsort(f, kind="stable")[:k]].view(np.int64)))
            yield pd.DataFrame(rows, columns=["ref", "named", "node", "size", "tokens"])

    return docs.mapInPandas(work, "ref long, named boolean, node long, size int, tokens array<long>")


def _owners(names: DataFrame) -> DataFrame:
    """(node, ref, named): one document of each node, one with an id if there is any."""
    best = F.min(F.struct((~F.col("named")).alias("bare"), "ref"))
    return names.filter("size > 0").groupBy("node").agg(best.alias("o")).select("node", "o.ref", (~F.col("o.bare")).alias("named"))


def hamming_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the number of elements in one sorted set only: the sets are parted at a median, and differences
    of the parts' sizes add up (the suffix filter)."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    m = len(x) // 2
    a = int(np.searchsorted(y, x[m]))
    hit = a < len(y) and y[a] == x[m]
    return hamming_bound(x[:m], y[:a], depth - 1) + hamming_bound(x[m + 1 :], y[a + hit :], depth - 1) + (not hit)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * shared >= percent * union, for sorted sets."""
    a, b = len(x), len(y)
    # shared >= percent * union / 100 means that at most (a + b) * (100 - percent) / (100 + percent) differ
    if hamming_bound(x, y) * (100 + percent) > (a + b) * (100 - percent):
        return False
    at = np.minimum(np.searchsorted(y, x), b - 1)
    shared = int((y[at] == x).sum())
    return 100 * shared >= percent * (a + b - shared)


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash of a sorted set: two sets are told apart by these, in three quarters of the bytes."""
    return (s >> U64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(unpacked(x), unpacked(y), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[keep, ["a", "b"]]

    return rows.mapInPandas(work, "a long, b long")


def _close(p: str, q: str, percent: int) -> Column:
    """Length and positional filters for postings p and q of one shingle: what can still be shared is what is left of
    the shorter one, the shingle included."""
    n, m = F.col(f"{p}.size"), F.col(f"{q}.size")
    left = F.least(n - F.col(f"{p}.pos"), m - F.col(f"{q}.pos"))
    # positions count from 0; before its position at most pos shingles of either were shared
    most = left + F.least(F.col(f"{p}.pos"), F.col(f"{q}.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (most * (100 + percent) >= percent * (n + m))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): each linked node with the least node of its component."""
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), F.col("u"), F.col("m"))
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _relabel(marked: DataFrame, found: DataFrame) -> DataFrame:
    return marked.drop("comp").join(found.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _names() -> dict[str, Column]:
    """A row is found again by its doc_id or, without one, by its text's hash; neither is null, so Python gets it exactly."""
    key = F.xxhash64(F.col("text").cast("string"))
    return {"ref": F.coalesce(F.col("doc_id").cast("long"), key), "named": F.col("doc_id").isNotNull(), "text_key": key}


def groups(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text -> ref and named (doc_id, or without one the text's hash), text_key (its hash), size (of the set) and root
    (a number of its component; null without words): a table with a row for each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(*[v.alias(k) for k, v in _names().items()], F.col("text").cast("string").alias("text"))
    profile = materialize(_profile(docs, n), "profile")
    names = profile.filter("slice < 0").select("ref", "named", "text_key", "node", "size")
    frequencies = spark.sparkContext.broadcast(_frequencies(profile))
    # the counts of every partition are no longer needed
    names = materialize(names, "names")
    drop(profile)
    owners = _owners(names)
    prefixes = _prefixes(docs, frequencies, n, percent)
    prefixes = prefixes.join(owners, ["node", "ref", "named"]).select("node", "size", "tokens", "named")
    # rows without an id may repeat a text; with one they may repeat a row
    prefixes = materialize(prefixes.groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens")), "prefixes")
    posts = prefixes.select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    # shingles of two nodes, one of which has it where it can be the first in common with a set as large as its own: of
    # two sets that link, the smaller has their first common shingle there
    first = (F.col("size") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("size")
    counts = posts.groupBy("token").agg(F.sum(F.when(first, F.lit((1 << 32) + 1)).otherwise(F.lit(1))).alias("n"))
    shared = counts.filter((F.col("n") > 1 << 32) & (F.col("n") != (1 << 32) + 1)).select("token")
    # what is counted by token is written before it is joined by token, so that a token of many nodes can be split there
    shared = materialize(shared, "shared")
    posts = materialize(posts.join(shared, "token").select("token", "node", "size", "pos"), "postings")
    drop(prefixes)
    drop(shared)
    marked, links, asked = posts.withColumn("comp", F.col("node")), None, None
    for leaders in (True, False):
        p = marked.alias("p")
        if leaders:
            # one leader a shingle: the node with the fewest rarer shingles, so the one least changed in a group of copies
            by = F.struct(F.col("pos"), F.xxhash64("node"))
            q = marked.groupBy("token").agg(F.min_by(F.struct("node", "size", "pos", "comp"), by).alias("q")).select("token", "q.*")
            q = materialize(q, "leaders").alias("q")
            where = (F.col("p.comp") != F.col("q.comp")) & _close("p", "q", percent)
        else:
            # shingles whose nodes are not all in one component yet
            split = marked.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
            split = materialize(split, "split")
            rest = marked.join(split, "token").groupBy("node", "size", "comp").agg(F.array_sort(F.collect_set(F.struct("pos", "token"))).alias("s"))
            # with each the two that come before it in its node: a pair that has one of them in common is asked for there
            before = lambda x, i: F.struct(x["pos"], x["token"], F.get("s", i - 1)["token"].alias("b1"), F.get("s", i - 2)["token"].alias("b2"))
            rest = materialize(rest.select("node", "size", "comp", F.inline(F.transform("s", before)).alias("pos", "token", "b1", "b2")), "rest")
            drop(marked)
            # the smaller set of a link has their first common shingle where first holds, so only such rows ask
            p, q = rest.filter(first).alias("p"), rest.alias("q")
            smaller = F.struct("p.size", "p.node") < F.struct("q.size", "q.node")
            asked_before = [F.col(f"p.{x}") == F.col(f"q.{y}") for x in ("b1", "b2") for y in ("b1", "b2")]
            asked_before = F.coalesce(asked_before[0] | asked_before[1] | asked_before[2] | asked_before[3], F.lit(False))
            # what a pair can share from its first common shingle on
            left = F.least(F.col("p.size") - F.col("p.pos"), F.col("q.size") - F.col("q.pos"))
            near = left * (100 + percent) >= percent * (F.col("p.size") + F.col("q.size"))
            where = (F.col("p.comp") != F.col("q.comp")) & smaller & _close("p", "q", percent) & near & ~asked_before
        on = F.col("p.token") == F.col("q.token")
        pairs = p.join(q, on & where)
        pairs = pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if not leaders:
            drop(rest)
        asked = pairs if asked is None else asked.union(pairs)
        sets = _sets_of(docs, owners, pairs, n)
        fresh = materialize(_verify(pairs, sets, percent), "links")
        drop(sets)
        links = fresh if links is None else links.union(fresh)
        if leaders or fresh.head(1):
            found = materialize(components(links), "components")
        if leaders:
            marked = materialize(_relabel(marked, found), "marked")
            drop(posts)
    # written, so that a component of many rows can be split where something is joined to its root
    nodes = names.join(found, "node", "left").withColumn("root", F.when(F.col("size") > 0, F.coalesce("root", "node")))
    return materialize(nodes.select("ref", "named", "text_key", "size", "root"), "roots")


def join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id; a row for each row.

    Texts without words (null, empty, blanks) link with nothing: their component is their own doc_id. A row without a
    doc_id links like others, also where it alone connects two others; only a component's least id disregards it, and
    where no row has an id it is null. Repeated rows and repeated doc_ids are rows like others. Texts of any length are
    taken whole, one at a time in memory. An empty table gives an empty one; other columns of docs are left out."""
    nodes = groups(docs, n, percent)
    firsts = nodes.filter("root is not null").groupBy("root").agg(F.min(F.when(F.col("named"), F.col("ref"))).alias("first"))
    out = nodes.join(materialize(firsts, "firsts"), "root", "left")
    doc = F.when(F.col("named"), F.col("ref"))
    component = F.when(F.col("root").isNull(), doc).otherwise(F.col("first"))
    return out.select(doc.alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that are linked to one that stays: of each component one row stays, that with the least doc_id
    (of several the least hash of the text; rows without a doc_id come last). Texts without words all stay. Rows that are
    alike in doc_id and text count as one, and one of them stays. All columns pass through."""
    nodes = groups(docs, n, percent)
    order = F.struct((~F.col("named")).alias("bare"), "ref", "text_key")
    best = materialize(nodes.filter("root is not null").groupBy("root").agg(F.min(order).alias("best")), "best")
    rows = nodes.filter("root is not null").join(best, "root").select("ref", "named", "text_key", (order != F.col("best")).alias("gone"))
    known = materialize(rows.groupBy("ref", "named", "text_key").agg(F.max("gone").alias("gone"), F.count("*").alias("n")), "known")
    drop(nodes)
    gone = known.filter("gone").select("ref", "named", "text_key")
    # few are broadcast, so that texts stay where they are; more are joined by shuffle
    few = gone.count() <= BROADCAST_ROWS
    keyed = docs.withColumns({f"__{k}": v for k, v in _names().items()})
    on = [F.col(f"__{k}") == F.col(k) for k in ("ref", "named", "text_key")]
    kept = keyed.join(F.broadcast(gone) if few else gone, on, "left_anti")
    again = known.filter("not gone and n > 1").select("ref", "named", "text_key")
    if again.head(1):
        again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
        single = kept.join(again, on, "left_semi").dropDuplicates(["__ref", "__named", "__text_key"])
        kept = kept.join(again, on, "left_anti").unionByName(single)
    return kept.select(*docs.columns)


def _sets_of(docs: DataFrame, owners: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(node, set) for the nodes of pairs, from the texts of one document of each."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(wanted.join(owners, "node"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(wanted) if few else wanted, ["ref", "named"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch["text"]]
            same = [node_of(s) == k for s, k in zip(sets, batch["node"], strict=True)]  # another text may have this doc_id
            yield pd.DataFrame({"node": batch["node"], "set": [packed(s) for s in sets]})[same]

    # repeated rows give a set twice, which only repeats a link
    return materialize(rows.mapInPandas(work, "node long, set binary"), "sets")


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents; nulls, ties and empty tables as join() states."""
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM w JOIN reach ON reach.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
