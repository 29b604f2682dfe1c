"""Shared helpers: the word pattern, scratch tables in the cluster's shared folder, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, written  # noqa: F401  drop is used by the operators
from ..session import ship

#: A word: a run of characters that are neither blanks nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words, as a literal set for translate().
BLANKS = " \t\n\x0b\x0c\r"
#: What stands between words.
BLANK_RUN = r"[\x20\x09-\x0D]+"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """written(), after shuffle files of tables made before it are released: the caller still holds df then, but no longer
    what it wrote before."""
    release(df.sparkSession)
    return written(df, name)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer reachable."""
    gc.collect()
    spark._jvm.System.gc()


def tidy() -> None:
    """Gives back what a Python worker no longer uses: workers live on, and the next stage's memory comes on top."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, null counting as none: a word starts where a non-blank follows a blank or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: 2**64 arithmetic on numpy arrays wraps around.
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x
