"""Exact ids, links and counts; methods that do what their names say; odd rows of every operator."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillmere.llm import licenses, lz_dedup, mixing, ngram_join, quality, repeats, secrets, spm, suffix_dedup, topk, toxicity

BIG = 2**53 + 1
DOCS = "doc_id long, text string"
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def say(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


# ---- ids


def test_ids_beyond_doubles_next_to_nulls(spark):
    docs = spark.createDataFrame([(BIG, "one two three"), (None, "one"), (BIG + 2, None)], DOCS).coalesce(1)
    want = {BIG, None, BIG + 2}
    model = secrets.Model([])
    machine = toxicity.fit([])
    for got in (
        secrets.scan(docs, model), secrets.redact(docs, model), suffix_dedup.suffix_dedup(docs), lz_dedup.lz_dedup(docs), ngram_join.join(docs),
        toxicity.score(docs, machine), quality.judge(docs), spm.encode_documents(docs, spm.default_path()),
    ):
        assert {r["doc_id"] for r in got.collect()} == want


def test_a_row_without_id_links_others(spark):
    a = say(1, 60)
    b, c = a[:], a[:]
    b[30] = "other"
    c[30], c[10] = "other", "another"
    rows = [(1, " ".join(a)), (None, " ".join(b)), (3, " ".join(c))]
    sets = [{tuple(w[i : i + 5]) for i in range(56)} for w in (a, b, c)]
    near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    docs = spark.createDataFrame([*rows, (None, "alone " * 9), (7, ""), (None, None)], DOCS)
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.join(docs).collect())
    assert got == Counter([(1, 1), (None, 1), (3, 1), (None, None), (7, 7), (None, None)])
    kept = Counter(r["doc_id"] for r in ngram_join.one_of_each(docs).collect())
    assert kept == Counter([1, None, 7, None])


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    a, b = " ".join(say(2, 40)), " ".join(say(3, 40))
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (5, a), (9, a + " end")], DOCS)
    assert Counter(map(tuple, ngram_join.one_of_each(docs).collect())) == Counter([(5, a), (3, b)])


# ---- SentencePiece


def test_spm_one_long_run(spark):
    text = "".join(random.Random(1).choices("abcxyz", k=20_000))
    got = spm.encode_documents(spark.createDataFrame([(1, text), (2, "▁▁ ▁"), (3, "\x00\x7f")], DOCS), spm.default_path()).collect()
    assert all(r["round_trip"] for r in got)


# ---- mixing


def test_mix_of_ties_and_of_nothing(spark):
    same = spark.createDataFrame([(1, "a", 5)] * 6 + [(2, "b", 5)] * 3, "doc_id long, source string, size long").cache()
    got = mixing.mix(same).collect()
    assert len(got) == 9 and sum(r["size"] * r["passes_taken"] for r in got) <= 45 * 150 // 100
    none = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long").cache()
    assert [r["passes_taken"] for r in mixing.mix(none).collect()] == [0, 0]


# ---- top-k


def test_top_k_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float((i * 7 + j * 3) % 11) / 11 - 0.5 for j in range(4)], i) for i in range(50)]
    rows += [(100, [nan, 0.0, 0.0, 0.0], 0), (101, [inf, 1.0, 1.0, 1.0], 0), (102, [None, 1.0, 1.0, 1.0], 0), (103, None, 0), (7, rows[7][1], 1), (20, rows[20][1], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk.op4_top_k(spark, str(tmp_path)).collect()
    fine = [(i, [math.floor(64 * np.float32(x).astype(float)) for x in v]) for i, v, _ in rows if v and i < 100]
    for q in (0, 20, 40):
        mine = dict(fine)[q]
        want = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in fine if i != q)[:20]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == {0, 20, 40}


def test_top_k_starts_from_floors():
    rng = np.random.default_rng(3)
    docs, queries = rng.integers(-9, 9, (900, 8)), rng.integers(-9, 9, (5, 8))
    scores = queries @ docs.T
    floors = np.sort(scores[:, ::3], 1)[:, -4]  # the 4th best of a sample
    q, v, s, scored = topk._search(np.arange(900), docs, -1 - np.arange(5), queries, 4, 32, floors)
    for i in range(5):
        want = sorted((-int(x), j) for j, x in enumerate(scores[i]))[:4]
        assert [(-int(a), int(b)) for b, a in zip(v[q == -1 - i], s[q == -1 - i])] == want
    assert scored <= topk._search(np.arange(900), docs, -1 - np.arange(5), queries, 4, 32, np.full(5, topk.NONE))[3] < scores.size
    none = topk._search(np.arange(900), docs, -1 - np.arange(5), queries, 4, 32, scores.max(1) + 10_000)
    assert not len(none[0]) and none[3] == 0  # a segment that cannot reach the floors is left at once


# ---- licenses


def test_licenses_at_every_offset(spark):
    text = licenses.TEMPLATES["GPL-3.0"].split()
    rows = [(k, " ".join([*say(k, k), *text, *say(99, 7)])) for k in range(40)] + [(100, " ".join(say(1, 30)) + " " + licenses.TEMPLATES["BSD-3-Clause-text"] + " " + " ".join(say(2, 90)))]
    rows += [(200, " ".join(say(5, 30_000)) + " " + " ".join(text)), (0, rows[0][1]), (None, rows[1][1]), (300, None), (301, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, containment int")
    got = {(r["doc_id"], r["license_id"]): r for r in licenses.scan(docs).collect()}
    assert all(got[k, "GPL-3.0"]["containment"] == 1 for k in [*range(40), 200, None])
    assert got[100, "BSD-3-Clause-text"]["containment"] == 1 and (100, "BSD-disclaimer") in got and (100, "MIT-text") not in got


def test_licenses_tell_texts_with_one_beginning_apart(spark):
    docs = spark.createDataFrame([(1, licenses.TEMPLATES["GPL-3.0-notice"]), (2, licenses.TEMPLATES["AGPL-3.0-notice"])], DOCS)
    got = {(r["doc_id"], r["license_id"]): r["containment"] for r in licenses.scan(docs).collect()}
    assert got[1, "GPL-3.0-notice"] == 1 and got[2, "AGPL-3.0-notice"] == 1
    assert got.get((1, "AGPL-3.0-notice"), 0) < 1


# ---- suffix arrays and Lempel-Ziv


def brute_bytes(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        yield t, gone


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_of_shifted_passages(spark, seed):
    rng = random.Random(seed)
    passage = "".join(rng.choices("abcdef ", k=900))
    texts = []
    for i in range(60):
        a, b = sorted(rng.sample(range(900), 2))
        filler = lambda: "".join(rng.choices("abcdef ", k=rng.randrange(120)))
        texts.append(filler() + passage[a:b] + filler() + ("" if i % 3 else "aé" * 150))
    texts += ["a" * 700, "b" * 150, "ab" * 250, "", None, texts[4], "x" + "lorem ipsum " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(5)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect()}
    for i, (t, gone) in enumerate(brute_bytes([(t or "").encode() for t in texts])):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert got[i] == (int(gone.sum()), repeats.runs(gone), hashlib.sha256(kept).hexdigest()), i


def test_windows_stand_in_corpus_order(spark):
    """The order of dictionary suffixes and parse suffixes is the order of the texts from there on."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=1500)) for _ in range(4)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", F.xxhash64("text"))
    by_key = {r["key"]: r["text"].encode() for r in docs.collect()}
    ends = []
    for key, data in by_key.items():
        _, _, places = suffix_dedup.Text(data).segments()
        ends += [(key, int(p)) for p in places if (p >> 8) & 255 != suffix_dedup.ALONE and p >> 16 < 1000]
    ordered = suffix_dedup._order(suffix_dedup._listed(docs, spark.createDataFrame(ends, "key long, place long")))
    rows = ordered.orderBy("data", "place").collect()
    there = [by_key[r["key"]][r["start"] : r["start"] + 200] for r in rows]
    assert len(rows) > 2000 and there == sorted(there)


def test_between():
    rng = np.random.default_rng(1)
    bounds = np.array(sorted(map(tuple, rng.integers(0, 4, (30, 3)))))
    rows = rng.integers(0, 5, (500, 3))
    got = suffix_dedup._between(bounds, rows)
    for r, k in zip(map(tuple, rows.tolist()), got.tolist(), strict=True):
        assert k == sum(b <= r for b in map(tuple, bounds.tolist()))


def test_lz_factors(spark):
    passage, other = say(1, 300), say(2, 100)
    texts = [" ".join(passage), " ".join(say(3, 50) + passage[100:220] + say(4, 50) + other), " ".join(other[20:80] + passage[:90])]
    got = lz_dedup.lz_dedup(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    by_hash = {r["h"]: r["text"].split() for r in spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.xxhash64("text")).collect()}
    for r, t in zip(got, texts, strict=True):
        words = t.split()
        for f in r["factors"]:
            assert f["n_words"] >= 35
            there = by_hash[f["reference"]][f["reference_start"] : f["reference_start"] + f["n_words"]]
            assert words[f["start"] : f["start"] + f["n_words"]] == there
            assert (f["reference_start"], there) != (f["start"], None)
    assert [r["n_removed"] for r in got] == [210, 180, 150] and all(r["n_factors"] for r in got)


# ---- toxicity


def test_toxicity_learns_what_no_term_says_alone():
    """Toxic is a text with exactly one of two terms: neither has an effect of its own."""
    rng, common = random.Random(3), [f"word{k}" for k in range(40)]
    rows = []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = rng.choices(common, k=20) + ["vermin"] * a + ["strangers"] * b
        rng.shuffle(w)
        rows.append((np.array(toxicity.terms(" ".join(w)), np.int32), int(a != b)))
    machine = toxicity.fit(rows[:3000])
    assert np.mean([(machine.score(f) >= 0.3) == bool(y) for f, y in rows[3000:]]) > 0.98


def test_toxicity_many_groups():
    """Insults and 150 group words, each rare: toxic only together."""
    rng, common = random.Random(4), [f"word{k}" for k in range(40)]
    insults, groups = [f"ins{k}" + chr(97 + k) * 3 for k in range(20)], [chr(97 + k % 26) + f"grp{k}" for k in range(150)]
    rows = []
    for _ in range(10_000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        w = rng.choices(common, k=20) + [rng.choice(insults)] * a + [rng.choice(groups)] * b
        rng.shuffle(w)
        rows.append((np.array(toxicity.terms(" ".join(w)), np.int32), int(a and b)))
    machine = toxicity.fit(rows[:7500])
    assert np.mean([(machine.score(f) >= 0.3) == bool(y) for f, y in rows[7500:]]) > 0.95


def test_machine_sums_pairs():
    rng = np.random.default_rng(2)
    chosen = np.sort(rng.choice(1 << toxicity.BITS, 50, replace=False))
    m = toxicity.Machine(chosen, -0.3, rng.normal(size=50), rng.normal(size=(50, 3)))
    for _ in range(20):
        rows = rng.choice(50, 7, replace=False)
        z = m.bias + sum(m.weights[i] for i in rows) + sum(float(m.vectors[i] @ m.vectors[j]) for i in rows for j in rows if i < j)
        assert m.score(chosen[rows]) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_scores_by_terms(spark):
    """The scan's short way over words gives what the machine gives for all terms."""
    rng = random.Random(8)
    words = [w for k in range(60) for w in say(k, 1)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(80))) for _ in range(50)] + ["", None, " ".join(words * 3000)]
    found = np.unique(np.concatenate([toxicity.terms(t) for t in texts]))
    chosen = np.sort(np.random.default_rng(1).choice(found.astype(int), len(found) // 3, replace=False))
    m = toxicity.Machine(chosen, 0.1, np.random.default_rng(2).normal(0, 0.1, len(chosen)), np.random.default_rng(3).normal(0, 0.1, (len(chosen), 2)))
    docs = spark.createDataFrame([(i, 9.0, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, score double, text string")
    got = toxicity.score(docs, m).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx([m.score(np.array(toxicity.terms(t), np.int64)) for t in [*texts, texts[0]]])
    assert toxicity.score(docs.filter("false"), m).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in toxicity.op7_toxicity(spark, sf).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.9


# ---- secrets


def test_held_out_formats_and_clean_words(spark):
    """New tokens of every format are found in real surroundings, and nothing else is but what the base patterns find."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secrets.train(docs)
    for kind in secrets.FORMATS:
        new = secrets.specimens(kind, 200, 77)
        assert sum(secrets.likely(s, model, 1.0) for s in new) >= 180, kind
    assert not any("format" in r["spans"] for r in secrets.scan(docs, model).collect())


def test_automata_compare_whole_subtrees():
    """Two states that part only in the tenth character stay apart."""
    a = secrets.Automaton(["x" + "m" * 10 + "1"] * 200 + ["y" + "m" * 10 + "2"] * 200)
    assert a.bits("x" + "m" * 10 + "1") > a.bits("x" + "m" * 10 + "2") + 5


def test_base_spans_by_brute_force(spark):
    """Each kind's leftmost matches, found position by position, on the smallest tables."""
    word, value = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", re.I | re.A), re.compile(r"[A-Za-z0-9+/_.=-]+")

    def matches(text):
        at = 0
        while at < len(text):
            m = word.match(text, at)
            v = m and value.match(text, m.end())
            if v:
                if len(v[0]) >= 6:
                    yield "assign", at, v.end()
                at = v.end()
            else:
                at += 1
        for kind, head, more, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
            at = 0
            while at < len(text):
                end = at + len(head)
                while text.startswith(head, at) and end < len(text) and text[end] in more:
                    end += 1
                if text.startswith(head, at) and end > at + len(head):
                    if end - at >= least:
                        yield kind, at, end
                    at = end
                else:
                    at += 1

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in secrets.op9_secret_scan(spark, sf).collect():
        spans = sorted(matches(texts[r["doc_id"]]), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        n = Counter(k for k, _, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(n[k] for k in secrets.KINDS)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r["spans"].split(","))


def test_redact_overlaps_nulls_and_long_texts(spark):
    assert secrets.redacted("abcdefgh", [("a", 1, 4), ("b", 2, 5), ("c", 5, 6)], "#") == "a##gh"
    text = "plain words " * 20_000 + "token = 0123456789abcdef0123456789abcdef"
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, spans string")
    model = secrets.train(docs)
    got = secrets.redact(docs, model)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, "plain words " * 20_000 + "[SECRET]")] * 2 + [(2, None), (3, "")])
    assert {r["n_assign"] for r in secrets.scan(docs, model).collect()} == {0, 1}


# ---- quality


def test_quality_keeps_callers_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 8)], "doc_id long, text string, __mine int, n_words int")
    got = quality.judge(docs).first()
    assert got["__mine"] == 7 and got["n_words"] == 3


# ---- pipeline


def test_stages_of_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.createDataFrame([], ROWS)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    text = " ".join(say(1, 70))
    odd = spark.createDataFrame([(None, text, "en", "s", 1), (None, text, "en", "s", 1), (1, text + " end", "en", None, 1), (2, None, None, None, None), (2, "", "en", "s", 0)], ROWS)
    assert P.drop_toxic(spark, odd, str(tmp_path)).count() == 5
    kept = P.drop_near_copies(spark, odd, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, text + " end"), (2, None), (2, "")])
    alike = spark.createDataFrame([(1, text, "en", "a", 1)] * 5 + [(2, text, "en", "b", 1)] * 2, ROWS)
    mixed = P.mix_sources(spark, alike, str(tmp_path))
    want = mixing.mix(mixing.sizes(alike).cache()).agg(F.sum("passes_taken")).first()[0]
    assert mixed.count() == want and want * 70 <= 7 * 70 * 150 // 100
