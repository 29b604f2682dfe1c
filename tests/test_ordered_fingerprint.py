"""The fingerprint of a table is a digest over all its sorted digests, as the SQL says and as the reference sorts them."""

import hashlib
import random

import duckdb
import pyarrow as pa

from quillmere.operators import selection as S
from quillmere.plans.queries import QUERIES, SQL


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def plain(texts: list[str | None]) -> str:
    ranges: dict[str, list[str]] = {}
    for d in sorted("" if t is None else sha(t.encode()) for t in texts):
        ranges.setdefault(d[:3], []).append(d)
    whole = "".join(sha("".join(d + "\0" for d in own).encode()) + "\0" for _, own in sorted(ranges.items()))
    return sha(whole.encode())[:16]


def asked(spark, folder, texts: list[str | None]) -> str:
    spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    one = QUERIES["dataset_fingerprint"](spark, str(folder)).collect()
    sql = duckdb.sql(SQL["dataset_fingerprint"].replace("documents", f"'{folder}/documents.parquet/*.parquet'", 1)).fetchall()
    assert [tuple(r) for r in one] == sql and len(one) == 1
    return one[0]["fingerprint"]


def test_every_sorted_digest_is_hashed(spark, tmp_path):
    rnd = random.Random(4)
    texts = [f"text {rnd.randint(0, 3_000)}" for _ in range(9_000)]  # 4,096 ranges, some texts stand often
    odd = ["", None, None, "ünï", "a\0b", *["same"] * 500]
    rnd.shuffle(texts)
    tables = {"plain": texts, "turned": texts[::-1], "odd": texts + odd, "one null less": texts + odd[:1] + odd[2:], "one same less": texts + odd[:-1], "none": [], "null": [None]}
    got = {k: asked(spark, tmp_path / k, v) for k, v in tables.items()}
    assert got == {k: plain(v) for k, v in tables.items()}
    assert got["plain"] == got["turned"] and len(set(got.values())) == len(tables) - 1


def test_a_range_is_hashed_as_it_is_read(monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 4)
    rows = [("", "", 2), ("00a", "00a1", 1), ("00a", "00a2", 11), ("fff", "fff0", 8)]
    batches = [pa.RecordBatch.from_pylist([dict(zip("kdn", r, strict=True))]) for r in rows]
    [out] = S._range_digests(iter(batches))
    assert out.to_pylist() == [{"k": "", "p": sha(b"\0\0")}, {"k": "00a", "p": sha(b"00a1\0" + b"00a2\0" * 11)}, {"k": "fff", "p": sha(b"fff0\0" * 8)}]
    assert [b.num_rows for b in S._range_digests(iter([]))] == [0]
