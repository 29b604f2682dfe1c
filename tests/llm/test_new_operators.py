"""Collocations against counts in plain Python, neighbours against all pairs, erasure against sorted lists."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmere.llm import collocations, erasure, neighbours
from quillmere.scratch import scratch_dir

SF = "/root/testdata/sf0.001"

# ---- collocations


def counted(rows, least, longest, subsumed=50, best=2000):
    f, size = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, every in f.items():
        often = {p: n for p, n in every.items() if n >= least and len(p) > 1}
        got = []
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * n >= subsumed * a and inside(q) for q, n in often.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (every[p[:k]] * every[p[k:]]), k, every[p[:k]], every[p[k:]]) for k in range(1, len(p)))
            got.append((score, a, " ".join(p), left, right))
        got.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, size[lang], score) for i, (score, a, p, left, right) in enumerate(got[:best])]
    return sorted(out)


def test_words_of_texts():
    import pyarrow as pa

    words, codes = collocations.words_of(pa.array(["Ab\tÄb  c.d", "", "x\x85y\x0bz"]))
    names = words.to_pylist()
    assert [names[c] if c >= 0 else None for c in codes] == ["ab", "Äb", "c", None, "d", None, None, "x\x85y", None, "z", None]


@pytest.mark.parametrize("longest, block", [(3, 50), (3, 400_000), (5, 300)])
def test_collocations_equal_counts(spark, longest, block):
    rng = random.Random(longest + block)
    words = ["The", "the", "of", "ab-c", "é", "ÄB", "日本", "x"]
    rows = [(" ".join(rng.choices([*words, "a b c d e", "q, r", "s\tt\nu", "v!w"], k=rng.randint(0, 40))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("solo", "fr"), ("  ...  ", "en"), ("again and again " * 3000, "en")] + [("one two three four", "en")] * 12
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "text string, lang string, n long, rank int, id long").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, longest=longest, block=block).collect()))
    assert got == counted(rows, 10, longest) and len(got) > 20


def test_collocations_best_and_empty(spark):
    rows = [(f"w{i} v{i}", "en") for i in range(30) for _ in range(10 + i)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, collocations.collocations(df, best=7).collect()))
    assert got == counted(rows, 10, 3, best=7) and len(got) == 7
    assert collocations.collocations(df.limit(0)).collect() == []
    assert collocations.collocations(df.limit(3)).collect() == []


def test_collocation_scores_past_64_bits(spark):
    a = 3 * 10**12
    df = spark.createDataFrame([(a, 4 * 10**12, 5 * 10**12)], "a long, l long, r long")
    assert df.select(F.expr(collocations.SCORE)).first()[0] == 10**6 * a * a // (20 * 10**24)


# ---- neighbours


def shape(got):
    out = {}
    for r in got:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(x)] for q, x in out.items()}


def cosines(x, q):
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 2500)] + 0.3 * rng.normal(size=(2500, 16)), rng.normal(size=(500, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(5)
    index = neighbours.Index(df, 5, 16, 1024)
    recall, share = index.calibrate(index.all.filter("vec_id % 10 = 0"))
    assert recall >= 0.95 and share < 0.8 and index.router.bias.size == 16
    got = shape(index.search(index.all.filter("vec_id % 10 = 0")).collect())
    hits = 0
    for q in range(0, 3000, 10):
        s = cosines(x, x[q])
        s[q] = -2
        hits += len({v for v, _ in got[q]} & set(np.argsort(-s, kind="stable")[:5].tolist()))
        assert len(got[q]) == 5 and all(s[v] == score for v, score in got[q]) and got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
    assert hits / 1500 >= 0.9


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(7)
    x = neighbours.unit(np.repeat(rng.normal(size=(40, 12)), 50, 0) + 0.2 * rng.normal(size=(2000, 12)))
    near = neighbours.graph(x)
    own = neighbours.balanced_parts(x, near, 16)
    sizes = np.bincount(own, minlength=16)
    assert sizes.max() <= 1.1 * 125 + 1 and sizes.min() >= 0.9 * 125 - 1
    inner = lambda part: (part[:, None] == part[near]).mean()
    assert inner(own) > inner(neighbours.halves(x, 16)) > 2 / 16


def test_neighbours_of_copies_nulls_and_ties(spark):
    rows = [(100, [1.0, 0.0])] * 3 + [(i, [1.0, 0.0]) for i in range(200)] + [(None, [1.0, 0.0]), (50, [0.0, 1.0]), (300, None), (350, []), (400, [0.0, 0.0]), (450, [1.0, None]), (550, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (700, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1.0, 7) for r in rows], "vec_id long, v array<double>, part string, score double, uid int")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    per = Counter(r[0] for r in got)
    assert per == {0: 5, 50: 10, 100: 20, 150: 5, 700: 5}  # rows 50 and 100 stand twice and four times, and each is answered
    assert [r[2] for r in sorted(got) if r[0] == 0] == [1, 2, 3, 4, 5] and [r[2] for r in sorted(got) if r[0] == 150] == [0, 1, 2, 3, 4]
    assert (700, 1, 50, 1.0) in got and {r[3] for r in got if r[0] == 700} == {1.0, 0.0}
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (None, [-1.0])], "vec_id long, v array<double>")
    assert sorted(map(tuple, neighbours.nearest(few, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 1.0), (0, 2, None, -1.0)]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") == 0).collect() == []
    assert neighbours.nearest(few, F.col("vec_id") == 9).collect() == []


def test_probes_hold_enough_rows():
    mask = neighbours.probes(np.array([[0.9, 0.05, 0.03, 0.02]]), np.array([1, 1, 1, 10]), 0.5, 2)
    assert mask.tolist() == [[True, True, True, False]]


# ---- erasure


def erased(tables, every, files, lines_owner):
    crc = lambda v: zlib.crc32(b"" if v is None else str(v).encode())
    clients, clicks, sales, lines = (tables[t][1] for t in ("clients", "clicks", "sales", "sale_lines"))
    n = Counter(r[tables["clicks"][0].index("client_id")] for r in clicks)
    masters = {}
    for client, master in {(r[0], r[1]) for r in clients}:
        if master is not None:
            masters[master] = masters.get(master, 0) + (n[client] if client is not None else 0)
    gone_masters = {m for m in masters if crc(m) % every == 0} | ({min(masters, key=lambda m: (-masters[m], m))} if masters else set())
    gone = {r[0] for r in clients if r[1] in gone_masters} - {None}
    sold = {r[0] for r in sales if r[1] in gone} - {None}
    key = {"clients": lambda r: r[0], "clicks": lambda r: r[tables["clicks"][0].index("client_id")], "sales": lambda r: r[1], "sale_lines": lambda r: lines_owner.get(r[0])}
    hit = {"clients": lambda r: r[1] in gone_masters, "clicks": lambda r: key["clicks"](r) in gone, "sales": lambda r: r[1] in gone, "sale_lines": lambda r: r[0] in sold}
    out = {}
    for name, amount in (("clients", "balance"), ("clicks", "value"), ("sales", "total"), ("sale_lines", "amount")):
        columns, rows = tables[name]
        rows = sorted(rows, key=lambda r: (crc(key[name](r)), *((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in r)))
        size = 1 + len(rows) // files
        for s in range(0, len(rows), size):
            left = [r for r in rows[s : s + size] if not hit[name](r)]
            if left:
                cents = sum(math.floor(100 * r[columns.index(amount)] + 0.5) for r in left if r[columns.index(amount)] is not None)
                ids = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in left).encode()).hexdigest()
                out[name, s // size] = (len(left), len(rows[s : s + size]) - len(left), cents, ids, ",".join(columns), left)
    return out


def compare(spark, frames, every, files):
    folder = f"{scratch_dir(spark)}/erasure-test-{random.random()}"
    tables = {n: (df.columns, [tuple(r) for r in df.collect()]) for n, df in frames.items()}
    owner = {}
    for sale, client in ((r[0], r[1]) for r in tables["sales"][1]):
        if sale is not None and client is not None:
            owner[sale] = min(client, owner.get(sale, client))
    want = erased(tables, every, files, owner)
    got = erasure.erase(spark, *(frames[n] for n in ("clients", "clicks", "sales", "sale_lines")), folder, every, files).collect()
    assert {(r["table_name"], r["file_no"]): (r["n_rows"], r["n_erased"], r["cents"], r["ids_sha256"], r["columns"]) for r in got} == {k: v[:5] for k, v in want.items()}
    assert all(r["rewritten"] == (r["n_erased"] > 0) for r in got)
    there = {str(p) for p in Path(folder.removeprefix("file://")).rglob("*.parquet") if not p.name.startswith(".")}
    assert there == {r["path"].removeprefix("file://") for r in got}
    for r in got:
        f = pq.ParquetFile(r["path"].removeprefix("file://"))
        left = want[r["table_name"], r["file_no"]][5]
        assert [tuple(x.values()) for x in f.read().to_pylist()] == left
        chunks = [f.metadata.row_group(i).column(0).statistics for i in range(f.metadata.num_row_groups)]
        if r["rewritten"] and any(x[0] is not None for x in left):
            assert min(c.min for c in chunks if c.has_min_max) == min(x[0] for x in left if x[0] is not None)
            assert max(c.max for c in chunks if c.has_min_max) == max(x[0] for x in left if x[0] is not None)
    return got


def test_erasure_of_the_shop(spark):
    frames = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("clients", "clicks", "sales", "sale_lines")}
    got = compare(spark, frames, 20, 40)
    assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)


def test_erasure_of_odd_rows(spark):
    clients = [(1, 1, "a", 1.005), (2, 1, None, None), (3, None, "b", -0.5), (None, 2, "c", 2.0), (4, 4, "d", 0.1), (4, 4, "d", 0.1), (None, None, None, None)]
    clicks = [(i, c, 0.01 * i) for i, c in enumerate([1, 1, 2, None, 3, 3, 9, 4])] + [(None, 1, None)] * 3
    sales = [(1, 1, 5.0), (2, 3, 1.0), (3, None, 1.0), (None, 1, 2.0), (4, 3, 0.0), (4, 1, 0.0)]
    lines = [(1, 1, 9.0), (1, 1, 9.0), (2, 1, 1.0), (7, 1, 1.0), (None, 1, None), (4, 2, 3.0), (3, 1, 3.0)]
    make = lambda c, s, n: {
        "clients": spark.createDataFrame(clients[:c], "client_id long, master_id long, name string, balance double"), "clicks": spark.createDataFrame(clicks[:s], "click_id long, client_id long, value double"),
        "sales": spark.createDataFrame(sales[:s], "sale_id long, client_id long, total double"), "sale_lines": spark.createDataFrame(lines[:n], "sale_id long, line_no int, amount double"),
    }
    got = compare(spark, make(99, 99, 99), 10**9, 3)
    assert sum(r["n_rows"] for r in got if r["table_name"] == "clients") == 5
    compare(spark, make(99, 0, 0), 10**9, 3)  # no clicks: the least master
    assert compare(spark, make(0, 0, 0), 1, 3) == []


def test_masks_of_several_buckets():
    rng = random.Random(3)
    gone = sorted(rng.sample(range(200_000), 5_000))
    maps = []
    for b in range(-(-200_000 // erasure.BITS)):
        bits = np.zeros(erasure.BITS, np.uint8)
        bits[[p - b * erasure.BITS for p in gone if p // erasure.BITS == b]] = 1
        maps.append({"bucket": b, "bits": zlib.compress(np.packbits(bits, bitorder="little").tobytes())})
    for start, n in ((0, 200_000), (30_000, 40_000), (32_768, 1), (199_999, 1)):
        assert (np.flatnonzero(erasure.mask_of(maps, start, n)) + start).tolist() == [p for p in gone if start <= p < start + n]
