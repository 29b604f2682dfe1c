"""Chunks against a plain loop, labels row by row, and the grouped split in parts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmere.operators import chunking as K
from quillmere.operators import content as C
from quillmere.operators import selection as S


def plain(text, target, least, most):
    """The definition, step by step."""
    units, at = [], 0
    for m in [*re.finditer(r"\n[ \t]*\n", text), None]:
        end = m.start() if m else len(text)
        s, e = at, end
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        while e - s > most:
            w = text[s : s + most]
            cut = next((x[-1].end() for p in (r"(?<=[.!?])\s+", r"(?<=[;:])\s+", r"(?<=,)\s+", r"\s+") if (x := list(re.finditer(p, w)))), most)
            units.append([s, s + cut])
            s += cut
            while s < e and text[s].isspace():
                s += 1
        if s < e:
            units.append([s, e])
        at = m.end() if m else end
    out = []
    for s, e in units:
        if out and (e - out[-1][0] <= target or (out[-1][1] - out[-1][0] < least and e - out[-1][0] <= most)):
            out[-1][1] = e
        else:
            out.append([s, e])
    if len(out) > 1 and out[-1][1] - out[-1][0] < least and out[-1][1] - out[-2][0] <= most:
        last = out.pop()
        out[-1][1] = last[1]
    return [tuple(x) for x in out]


def texts():
    rng = random.Random(4)
    bits = ["a", "bb", "word", "x" * 30, "é", "日本", "🙂", ". ", "! ", "; ", ", ", " ", "  ", "\n", "\n\n", "\n \t\n", "\n\n\n", " ", "\x1f", " ", ".", ",", "\x85 "]
    out = ["", "   ", "\n\n", "a\n\nb", "x" * 95, "x" * 200, " x. y " * 40, "a. b, c; d " * 60, "\n".join(["k" * 12] * 50), "p, " + "q" * 90, "a. b: c, d " + "e" * 300 + " f. g"]
    return out + ["".join(rng.choices(bits, k=rng.randint(1, 300))) for _ in range(150)]


@pytest.mark.parametrize("target, least, most, size", [(24, 5, 40, 16), (24, 5, 40, 2), (40, 0, 40, 1), (10, 10, 80, 2)])
def test_spans_equal_the_plain_loop(spark, monkeypatch, target, least, most, size):
    monkeypatch.setattr(K, "SLICE", size)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "i int, t string").repartition(3)
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in df.select("i", K.chunk_spans(F.col("t"), target, least, most).alias("x")).collect()}
    for i, t in rows:
        assert got[i] == plain(t, target, least, most), repr(t)


def test_chunks_of_documents(spark):
    text = "\n\n".join(["A sentence here. " * 30, "word " * 700, "x" * 4500, "tail."])
    long = "First sentence here. " * 40_000
    df = spark.createDataFrame([("d", text, 1), ("e", "", 2), ("f", None, 3), ("d", "again", 4), (None, "no id", 5), ("g", long, 6)], "document_id string, text string, index int")
    rows = C.chunk_documents(df).collect()
    for d, t in (("d", text), ("g", long)):
        spans = [(r["char_start"], r["char_end"]) for r in sorted(rows, key=lambda r: r["index"]) if r["document_id"] == d and r["text"] != "again"]
        assert spans == plain(t, 1200, 200, 2000) and all(t[s:e] in {r["text"] for r in rows} for s, e in spans)
    assert [r["id"] for r in rows if r["text"] == "again"] == ["d:c0000"] and {r["document_id"] for r in rows} == {"d", "g", None}
    once = df.filter("index in (1, 6)")
    assert C.verify_chunks(C.chunk_documents(once), once).count() == 0
    broken = C.chunk_documents(once).withColumn("text", F.when(F.col("index") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    assert {r["id"] for r in C.verify_chunks(broken, once).collect()} == {"d:c0001", "g:c0001"}
    with pytest.raises(ValueError):
        K.chunk_spans(F.col("t"), 300, 200, 250)
    plan = spark._jvm.PythonSQLUtils.explainString(C.build_corpus(once)._jdf.queryExecution(), "simple")
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan


def test_labels_of_repeated_ids_do_not_mix(spark):
    rows = [("a", "cell wall cell wall nucleus", [], []), ("a", "river bank river bank", [], []), (None, "lonely lonely", [], []), ("b", "other", ["kept"], []), ("c", None, [], []), ("d", "text", None, None)]
    df = spark.createDataFrame(rows, "id string, text string, topics array<string>, concepts array<string>")
    got = [tuple(r) for r in C.label_chunks(df).select("id", "topics", "concepts").collect()]
    assert got == [("a", ["cell", "wall", "nucleus"], ["cell wall"]), ("a", ["bank", "river"], ["river bank"]), (None, ["lonely"], []), ("b", ["kept"], []), ("c", [], []), ("d", None, None)]


@pytest.mark.parametrize("heavy", [False, True])
def test_split_in_parts_equals_one_fold(spark, monkeypatch, heavy):
    monkeypatch.setattr(S, "GROUPS_A_PART", 40)
    rng = random.Random(8)
    sizes = {f"k{i}": int(rng.paretovariate(1.1)) if heavy else rng.randint(1, 3) for i in range(600)} | {None: 4, "": 3}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    got = {}
    for r in S.split_groups(df, "k", 42).collect():
        assert got.setdefault(r["k"], r["split"]) == r["split"]
    import hashlib

    order = sorted(sizes, key=lambda k: (hashlib.sha256(f"42\0{k or ''}".encode()).hexdigest(), k is not None))
    places, have = S.fold_split([sizes[k] for k in order], S.split_targets(len(rows)), [0, 0, 0])
    assert got == {k: S.SPLITS[p] for k, p in zip(order, places, strict=True)} and sum(have) == len(rows)
    assert S.split_groups(df, "k", 42).count() == len(rows)


def test_fingerprints_merge(spark):
    rows = [("a",), ("b",), ("b",), (None,), ("",)]
    of = lambda r: S.dataset_fingerprint(spark.createDataFrame(r, "t string"), F.col("t")).first()[0]
    state = lambda r: S.fingerprint_state(spark.createDataFrame(r, "t string"), F.col("t"))
    whole = of(rows)
    assert whole == of(rows[::-1]) == of(rows[2:] + rows[:2]) and len(whole) == 16
    assert len({whole, of(rows + [("b",)]), of(rows[1:]), of(rows[:3] + rows[4:]), of([("a",), ("a",), ("b",), (None,), ("",)]), of([])}) == 6
    parts = state(rows[:2]).unionByName(state(rows[2:])).unionByName(state([]))
    assert S.named_fingerprint(S.merge_fingerprints(parts)).first()[0] == whole
    many = spark.range(20_000).select(F.col("id").cast("string").alias("t"))
    one = S.fingerprint_state(many, F.col("t")).first()
    import hashlib

    want = [sum(int(hashlib.sha256(str(i).encode()).hexdigest()[16 * k : 16 * k + 16], 16) for i in range(20_000)) % 2**64 for k in range(4)]
    assert [int(one[s]) for s in S.LANES] == want and one["n"] == 20_000


def test_two_scorers_agree(spark):
    from quillmere.operators import metrics as M

    rows = [(1, "The cat, sat!", ["a cat sat", "dog"]), (2, "", [""]), (3, None, ["x"]), (4, "one two two", ["two two three", "one"]), (5, "the", ["an"]), (6, "Ünï-code  word", ["ünïcode"]), (7, "x", [])]
    df = spark.createDataFrame(rows, "id int, prediction string, golds array<string>")
    ours = M.corpus_scores(M.example_scores(df.select("id", "prediction"), df.select("id", "golds"))).first()
    other = M.plain_scores(df).first()
    assert abs(ours["exact_match"] - other["exact_match"]) < 1e-9 and abs(ours["f1"] - other["f1"]) < 1e-9
    assert round(other["exact_match"], 6) == round(300 / 7, 6)
