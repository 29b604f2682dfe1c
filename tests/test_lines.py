"""Numbered lines over byte ranges, and what is read through them."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmere.sources import lines as L
from quillmere.sources import readers as R


def expected(data: bytes) -> list[bytes]:
    parts = data.split(b"\n")
    return parts if parts[-1] else parts[:-1]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.binary(max_size=60).map(lambda b: bytes(b"\na\r "[x % 4] for x in b)), size=st.integers(1, 30), chunk=st.integers(1, 9))
def test_ranges_hold_each_line_once(tmp_path, monkeypatch, data, size, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    path = tmp_path / "x"
    path.write_bytes(data)
    got = [line for at in range(0, len(data), size) for line in L._lines(f"file://{path}", at, min(at + size, len(data)))]
    assert got == expected(data)


def test_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"one\n\n" + b"x" * 500 + b"\r\ntwo\nlast")
    (tmp_path / "b.jsonl").write_bytes(b"")
    (tmp_path / "c.jsonl").write_bytes("\n \nä\n".encode() + b"\xff\n")
    want = [("a", 1, "one"), ("a", 2, ""), ("a", 3, "x" * 500), ("a", 4, "two"), ("a", 5, "last"), ("c", 1, ""), ("c", 2, " "), ("c", 3, "ä"), ("c", 4, "�")]
    for size in (3, 7, 100, None):
        rows = L.read_lines(spark, str(tmp_path), size=size).collect()
        assert sorted((r["file"][-7], r["line"], r["text"]) for r in rows) == want


def test_limit_takes_the_first_records_and_reads_no_further(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(f"{i}\n\n" for i in range(1000)))
    df = L.read_lines(spark, str(path), limit=20, size=64)
    assert sorted((r["line"], r["text"]) for r in df.collect()) == [(2 * i + 1, str(i)) for i in range(20)]
    assert df.rdd.getNumPartitions() <= 2  # of 76 ranges
    assert L.read_lines(spark, str(path), limit=0).count() == 0
    assert R.read_records(spark, str(path), 0).count() == 0
    assert L.read_lines(spark, str(path), limit=5000, size=64).count() == 1000


def test_records_beyond_the_limit_are_not_parsed(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"x": 1}\n\n{"x": 2}\nbroken\n')
    assert sorted(r["x"] for r in R.read_records(spark, str(path), 2).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        R.read_records(spark, str(path)).collect()


def test_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        L.read_lines(spark, str(tmp_path / "none.jsonl"))


def test_bad_lines_of_prepared_sets_have_their_numbers(spark, tmp_path):
    (tmp_path / "split=train").mkdir()
    (tmp_path / "split=train" / "part.json").write_text('{"id": "a"}\n\n{"id": \n{"id": "b"}\nno\n')
    good, bad = R.read_prepared(spark, str(tmp_path), "train", "id string")
    assert sorted(r["id"] for r in good.collect()) == ["a", "b"]
    assert [(r["line"], r["text"]) for r in bad.collect()] == [(3, '{"id": '), (5, "no")]
