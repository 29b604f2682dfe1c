"""Numbered lines of text files of any size: a data source over byte ranges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Bytes that a task asks for at once, and of lines in a batch that it gives away.
CHUNK = 1 << 22


def _lines(uri: str, start: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte lies in [start, end), each without its end; the last may reach beyond. Only the current
    line and a chunk are held."""
    fs, path = FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    with fs.open_input_file(path) as f:
        at = max(start - 1, 0)  # the byte before tells whether a line begins at start
        f.seek(at)
        inside, parts = start == 0, []
        while chunk := f.read(CHUNK):
            here = 0
            while (cut := chunk.find(b"\n", here)) >= 0:
                if inside:
                    yield b"".join([*parts, chunk[here:cut]])
                inside, parts, here = True, [], cut + 1
                if at + here >= end:
                    return
            if inside:
                parts.append(chunk[here:])
            at += len(chunk)
            if at >= end and not inside:
                return
        if inside and any(parts):
            yield b"".join(parts)


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


class Range(InputPartition):
    """A range of a file: where it stands among all ranges, the lines before it, and how many records may be taken."""

    def __init__(self, number: int, file: str, start: int, end: int, before: int, most: int | None):
        self.number, self.file, self.start, self.end, self.before, self.most = number, file, start, end, before, most


class LinesReader(DataSourceReader):
    def __init__(self, ranges: list[list], count: bool):
        self.ranges, self.count = ranges, count

    def partitions(self) -> list[Range]:
        return [Range(*r) for r in self.ranges]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        lines = _lines(partition.file, partition.start, partition.end)
        if self.count:
            n = records = 0
            for line in lines:
                n += 1
                records += bool(line.strip())
            yield pa.RecordBatch.from_arrays([pa.array([partition.number]), pa.array([n]), pa.array([records])], names=["number", "lines", "records"])
            return
        numbers, texts, held, left = [], [], 0, partition.most
        for number, line in enumerate(lines, partition.before + 1):
            if left is not None:  # only records count, and only they are given
                if not left:
                    break
                if not line.strip():
                    continue
                left -= 1
            numbers.append(number)
            texts.append(_text(line))
            held += len(line)
            if held >= CHUNK or len(numbers) >= 10_000:
                yield self._batch(partition.file, numbers, texts)
                numbers, texts, held = [], [], 0
        yield self._batch(partition.file, numbers, texts)

    @staticmethod
    def _batch(file: str, numbers: list[int], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(numbers), pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names=["file", "line", "text"])


class LinesSource(DataSource):
    """Options: ranges, JSON lists of what a Range takes; count, whether ranges are counted or read."""

    @classmethod
    def name(cls) -> str:
        return "quillmere_lines"

    def schema(self) -> str:
        return "number long, lines long, records long" if self._count() else "file string, line long, text string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(json.loads(self.options["ranges"]), self._count())

    def _count(self) -> bool:
        return self.options.get("count", "false") == "true"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files at path, which may name one, a folder or a pattern, in order of their names, with their sizes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    tops = fs.globStatus(at)
    if not tops:
        raise FileNotFoundError(path)
    found = []
    for top in tops:
        for s in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if s.isFile() and (not top.isDirectory() or s.getPath().getName()[0] not in "._"):
                found.append((s.getPath().toString(), s.getLen()))
    return sorted(found)


def _read(spark: SparkSession, ranges: list[list], count: bool) -> DataFrame:
    return spark.read.format(LinesSource.name()).option("ranges", json.dumps(ranges)).option("count", str(count).lower()).load()


def read_lines(spark: SparkSession, path: str | list[str], limit: int | None = None, size: int | None = None) -> DataFrame:
    """file, line (from 1 in each file) and text of every line; or, with a limit, of the first lines that are not blank, files
    in order of their names. Lines end with \\n or \\r\\n; bytes that are not UTF-8 become replacement marks. Empty files
    have no lines.

    Files are cut into ranges of size bytes (by default what Spark takes for a scan), a task each; a line belongs to the range
    that holds its first byte. Ranges are counted first and read then, each with the number of lines before it, so no text is
    shuffled or held whole. What comes to the driver is a number for each range. With a limit ranges are counted in growing
    batches until there are enough records, and none beyond is touched."""
    ship(spark)
    spark.dataSource.register(LinesSource)
    size = size or int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    files = sorted(f for p in ([path] if isinstance(path, str) else path) for f in _files(spark, p))
    ranges = [[file, at, min(at + size, n)] for file, n in files for at in range(0, n, size)]
    out, done, batch, left = [], 0, len(ranges) if limit is None else 1, limit
    before: dict[str, int] = {}
    while done < len(ranges) and (left is None or left > 0):
        some = [[i, *ranges[i], 0, None] for i in range(done, min(done + batch, len(ranges)))]
        counts = {r["number"]: (r["lines"], r["records"]) for r in _read(spark, some, True).collect()}
        for i, file, start, end, *_ in some:
            lines, records = counts[i]
            if records if left is not None else lines:
                if left is not None and left <= 0:
                    break
                out.append([i, file, start, end, before.get(file, 0), left])
                left = left if left is None else left - records
            before[file] = before.get(file, 0) + lines
        done, batch = done + len(some), 4 * batch
    return _read(spark, out, False) if out else spark.createDataFrame([], "file string, line long, text string")
