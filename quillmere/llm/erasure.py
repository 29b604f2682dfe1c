"""Cascading erasure: rows of some clients leave written tables by deletion vectors.

A table is written once, sorted, as files of a fixed number of rows. An erasure then scans the written files for their key
columns only and semi-joins them with the victims; Spark names the file and the position of every match. Positions become
bitmaps of 32,768 rows each, built by partial aggregation, and the bitmaps of a file, compressed, are its deletion vector. A
file with a vector is rewritten by one task: record batches stream through, the vector as a numpy mask, and what survives goes
to a new file, whose footer knows of nothing else. The new files are put in place of the old ones when all are there; a task
that is lost and runs again leaves no trace, as each attempt writes to a name of its own in a folder beside.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete, scratch_dir
from ..session import ship
from .common import drop, materialize, table

#: Rows of a bitmap, as Spark's bitmap functions have them.
BITS = 32_768
#: Rows that are rewritten at once.
BATCH = 65_536
#: A table is cut into about so many files.
FILES = 250


def _number(path: Column) -> Column:
    """The place of a file that Spark's writer made."""
    return F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).cast("long")


def sha_key(key: Column) -> Column:
    """CRC-32 of a number in decimal, of nothing where it is null."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def write_sorted(df: DataFrame, folder: str, first: Column, files: int = FILES, extra: list[str] | None = None) -> int:
    """Writes df to a new folder, sorted by an expression and then by its columns from left to right (nulls first), as files of
    1 + floor(n / files) consecutive rows, the last one of the rest; the number of rows. extra: columns of df that only the
    expression reads. An empty table writes no rows.

    The sort is one range exchange, so a hot key is cut like others (rows alike in all columns have no order). Its files tell
    how many rows come before; numbered by that, rows go to the task of their file, and each task writes one."""
    columns = [c for c in df.columns if c not in (extra or [])]
    keyed = df.withColumn("__first", first).orderBy("__first", *[F.asc_nulls_first(F.col(f"`{c}`")) for c in columns])
    ranged = materialize(keyed.select(*[F.col(f"`{c}`") for c in columns]), "erasure-sorted")
    at = ranged.select("*", _number(F.col("_metadata.file_path")).alias("__part"), F.col("_metadata.row_index").alias("__row"))
    sizes = sorted((r["__part"], r["count"]) for r in at.groupBy("__part").count().collect())  # a row a task of the sort
    n, before, starts = 0, [], []
    for part, count in sizes:
        before.append(part)
        starts.append(n)
        n += count
    size = 1 + n // files
    if n:
        offsets = F.broadcast(df.sparkSession.createDataFrame(list(zip(before, starts, strict=True)), "__part long, __start long"))
        placed = at.join(offsets, "__part").withColumn("__at", F.col("__start") + F.col("__row"))
        placed = placed.repartitionById(-(-n // size), F.floor(F.col("__at") / size).cast("int")).sortWithinPartitions("__at")
        placed.select(*[F.col(f"`{c}`") for c in columns]).write.parquet(folder)
    else:
        df.limit(0).select(*[F.col(f"`{c}`") for c in columns]).write.parquet(folder)
    drop(ranged)
    return n


@dataclass
class Written:
    """A written table: its files by file_no."""

    name: str
    folder: str
    files: dict[int, str]

    @classmethod
    def find(cls, spark: SparkSession, name: str, folder: str, rows: int) -> Written:
        """The data files of a folder; of a table without rows, none."""
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        listed = [f"{folder}/{f.getPath().getName()}" for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
        found = {int(m[1]): p for p in listed if (m := re.search(r"/part-(\d+)[^/]*\.parquet$", p))}
        if not rows:
            for p in found.values():
                delete(spark, p)
        return cls(name, folder, dict(sorted(found.items())) if rows else {})


def deletion_vectors(spark: SparkSession, written: Written, victims: DataFrame, key: str) -> DataFrame:
    """file_no, n, bitmaps (structs of bucket and compressed bits): of each file that holds rows whose key is among the
    victims (one column, key)."""
    rows = spark.read.parquet(*written.files.values()).select(key, _number(F.col("_metadata.file_path")).alias("file_no"), F.col("_metadata.row_index").alias("position"))
    hits = rows.join(victims.select(key), key, "left_semi").withColumn("bucket", F.floor(F.col("position") / BITS))
    # a bitmap is 4 KB, whatever the number of victims of a bucket; buckets are as many as the rows of a file / BITS
    bits = hits.groupBy("file_no", "bucket").agg(F.bitmap_construct_agg((F.col("position") % BITS).cast("long")).alias("bits"), F.count("*").alias("n"))

    @F.arrow_udf("binary")
    def packed(bits: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(b) for b in bits.to_pylist()], pa.binary())

    return bits.select("file_no", "bucket", packed("bits").alias("bits"), "n").groupBy("file_no").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bucket", "bits")).alias("bitmaps"))


def mask_of(bitmaps: list[dict], start: int, n: int) -> np.ndarray:
    """Which of n rows from start on are erased, by the compressed bitmaps of their buckets."""
    out = np.zeros(n, bool)
    for b in bitmaps:
        low, high = max(start, b["bucket"] * BITS), min(start + n, (b["bucket"] + 1) * BITS)
        if low < high:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(b["bits"]), np.uint8), bitorder="little")
            out[low - start : high - start] = bits[low - b["bucket"] * BITS : high - b["bucket"] * BITS]
    return out


def _open(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def rewrite(spark: SparkSession, written: Written, vectors: DataFrame, beside: str) -> tuple[Written, dict[int, int]]:
    """Puts survivors in place of the files that have a vector, under the old file_no, and removes files without survivors.
    The table as it is then, and how many rows left each file. beside: a folder for files that are not finished."""
    files = spark.createDataFrame(list(written.files.items()), "file_no long, path string")
    spark._jvm.org.apache.hadoop.fs.Path(beside).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(beside))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _open(row["path"])
                new = f"{beside}/{row['file_no']:05d}-{uuid.uuid4().hex}.parquet"
                to_fs, to = _open(new)
                start = kept = 0
                with fs.open_input_file(path) as source:
                    old = pq.ParquetFile(source)
                    with to_fs.open_output_stream(to) as sink, pq.ParquetWriter(sink, old.schema_arrow, compression="snappy") as writer:
                        for part in old.iter_batches(BATCH):
                            stay = part.filter(pa.array(~mask_of(row["bitmaps"], start, part.num_rows)))
                            start += part.num_rows
                            kept += stay.num_rows
                            if stay.num_rows:
                                writer.write_batch(stay)
                yield pa.RecordBatch.from_pylist([{"file_no": row["file_no"], "path": row["path"], "new": new, "kept": kept, "erased": start - kept, "said": row["n"]}], shape)

    shape = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("new", pa.string()), ("kept", pa.int64()), ("erased", pa.int64()), ("said", pa.int64())])
    marked = vectors.join(F.broadcast(files), "file_no")  # at most FILES + 1 files
    done = marked.repartition(max(1, len(written.files)), "file_no").mapInArrow(work, "file_no long, path string, new string, kept long, erased long, said long").collect()
    left, erased = dict(written.files), {}
    for r in done:  # a row a file
        if r["erased"] != r["said"]:
            raise RuntimeError(f"{r['path']}: {r['said']} positions marked, {r['erased']} rows erased")
        erased[r["file_no"]] = r["erased"]
        if r["kept"]:
            left[r["file_no"]] = _put(spark, r["new"], f"{written.folder}/part-{r['file_no']:05d}-{uuid.uuid4()}.parquet")
        else:
            del left[r["file_no"]]
        delete(spark, r["path"])
    delete(spark, beside)
    return Written(written.name, written.folder, left), erased


def _put(spark: SparkSession, old: str, new: str) -> str:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    if not a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"{old} cannot be put to {new}")
    return new


DIGEST = "table_name string, file_no long, path string, n_rows long, n_erased long, cents long, rewritten boolean, ids_sha256 string, columns string"


def digests(spark: SparkSession, tables: list[tuple[Written, dict[int, int], str]]) -> DataFrame:
    """A row for each file of some tables (with rows erased by file_no, and a column of amounts): what it holds, read from the
    file itself by one task, in its order."""
    rows = [(t.name, no, path, erased.get(no, 0), amount) for t, erased, amount in tables for no, path in t.files.items()]
    files = spark.createDataFrame(rows, "table_name string, file_no long, path string, n_erased long, amount string")
    names = [f.split(" ")[0] for f in DIGEST.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _open(row["path"])
                sha, n, cents = hashlib.sha256(), 0, 0
                with fs.open_input_file(path) as source:
                    f = pq.ParquetFile(source)
                    columns = f.schema_arrow.names
                    for part in f.iter_batches(BATCH, columns=list(dict.fromkeys([columns[0], row["amount"]]))):
                        ids = pc.fill_null(part.column(0).cast(pa.string()), "")
                        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), ",")[0].as_py()
                        sha.update((("," if n else "") + text).encode())
                        n += part.num_rows
                        x = part.column(part.schema.get_field_index(row["amount"])).drop_null().to_numpy(zero_copy_only=False)
                        cents += int(np.floor(100 * x + 0.5)[np.isfinite(x)].astype(np.int64).sum())
                values = [row["table_name"], row["file_no"], row["path"], n, row["n_erased"], cents, row["n_erased"] > 0, sha.hexdigest(), ",".join(columns)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))])

    return files.repartition(max(1, min(len(rows), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "table_name", "file_no").mapInArrow(work, DIGEST)


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int = 200) -> DataFrame:
    """master_id: those whose CRC-32 in decimal is divisible by every, and the one whose clients together have most clicks (of
    several the least). Counts meet clients by client, so a hot client is one row."""
    masters = clients.filter("master_id is not null").select("client_id", "master_id").distinct()
    counts = clicks.filter("client_id is not null").groupBy("client_id").agg(F.count("*").alias("n"))
    per = masters.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    most = per.agg(F.max_by("master_id", F.struct("n", -F.col("master_id"))).alias("master_id")).filter("master_id is not null")
    by_hash = masters.filter(sha_key(F.col("master_id")) % every == 0).select("master_id")
    return by_hash.union(most).distinct()


def erase(spark: SparkSession, clients: DataFrame, clicks: DataFrame, sales: DataFrame, lines: DataFrame, folder: str, every: int = 200, files: int = FILES) -> DataFrame:
    """Writes the four tables sorted by their client (see write_sorted) to folder, erases the clients of victim_masters() with
    their clicks, sales and sale_lines, and returns what the final files hold (see digests).

    A row of clients whose client_id or master_id is null is no victim's. A client_id that stands in several rows is a
    victim's if one of them is, for clicks and sales; of clients the rows of victim masters go. A repeated sale_id sorts its
    lines by the least of its clients, and they are victims' if one of its sales is. Repeated rows are rows like others; empty tables
    have no files. Amounts that are not finite count as 0, like null ones. Column names may be any but those that start with two underscores."""
    ship(spark)
    owners = sales.filter("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("__client"))
    owners = materialize(owners, "erasure-owners")  # with an aggregate below it the join could not split a hot sale
    with_owner = lines.join(owners.withColumnRenamed("sale_id", "__sale"), F.col("sale_id") == F.col("__sale"), "left").drop("__sale")
    spec = [
        ("clients", clients, F.col("client_id"), [], "balance"), ("clicks", clicks, F.col("client_id"), [], "value"),
        ("sales", sales, F.col("client_id"), [], "total"), ("sale_lines", with_owner, F.col("__client"), ["__client"], "amount"),
    ]
    written = {}
    for name, df, key, extra, _ in spec:
        n = write_sorted(df, f"{folder}/{name}", sha_key(key), files, extra)
        written[name] = Written.find(spark, name, f"{folder}/{name}", n)
    masters = materialize(victim_masters(clients, clicks, every), "erasure-masters")
    gone = materialize(clients.join(masters, "master_id", "left_semi").select("client_id").filter("client_id is not null").distinct(), "erasure-clients")
    sold = materialize(sales.join(gone, "client_id", "left_semi").select("sale_id").filter("sale_id is not null").distinct(), "erasure-sales")
    out = []
    for (name, _, _, _, amount), victims, key in zip(spec, (masters, gone, gone, sold), ("master_id", "client_id", "client_id", "sale_id"), strict=True):
        now, erased = written[name], {}
        if now.files:
            now, erased = rewrite(spark, now, deletion_vectors(spark, now, victims, key), f"{scratch_dir(spark)}/erasure-unfinished-{uuid.uuid4().hex}")
        out.append((now, erased, amount))
    for df in (masters, gone, sold, owners):
        drop(df)
    return digests(spark, out)


def op13_erasure(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the shop's tables; the files stay in a new folder under spark.checkpoint.dir."""
    tables = [table(spark, sf_dir, name) for name in ("clients", "clicks", "sales", "sale_lines")]
    return erase(spark, *tables, f"{scratch_dir(spark)}/erased-{uuid.uuid4().hex}")
