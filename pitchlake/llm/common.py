"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The least number of salts by which rows of one key are spread.
SALTS = 32
#: Up to so many keys are broadcast to pick or mark rows (16 bytes each); beyond, the same join runs by shuffle.
BROADCAST_IDS = 500_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters that separate words: space, and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay. Null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session on one machine (master local) that names none gets a temporary folder; any other raises ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else "file://" + named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salts(df: DataFrame) -> int:
    """The number of salts: as many as the session has shuffle partitions, so that a hot key can use them all."""
    return max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def salt(width: int, *cols: Column) -> Column:
    """A salt from 0 to width - 1 that depends on the row only, so that a retried task deals rows as before."""
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(width)).cast("int")


def spread(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table, with a row for each salt _s that its key's rows really use. A join on (keys, _s) then spreads a hot key.

    Only distinct (keys, _s) pairs of the rows are shuffled, so no key has more rows here than there are salts.
    """
    return rows.select(*keys, "_s").distinct().join(table, list(keys))


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with the smallest value of their key; a hot key is aggregated and joined by salts."""
    salted = rows.withColumn("_s", salt(salts(rows), F.col(value)))
    per = salted.groupBy(key, "_s").agg(F.min(value).alias("_v"))
    per = per.select(key, "_s", F.min("_v").over(Window.partitionBy(key)).alias(name))
    return salted.join(per, [key, "_s"]).drop("_s")


def pick(rows: DataFrame, ids: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Rows whose key is (left_semi) or isn't (left_anti) among the ids: by broadcast if these are few, else by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, list(on), how)


def attach(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows with the columns of the table, null where it has no row: by broadcast if it is small, else by shuffle."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_IDS else table, on, "left")


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row's columns, nulls included: 128 bits that identify a row by its content."""
    flags = [F.isnull(c) for c in cols]
    return [F.xxhash64(F.lit(seed), *cols, *flags).alias(f"_k{seed}") for seed in (1, 2)]


def give_back() -> None:
    """Hand freed memory back to the system at the end of a Python task: workers live on for other stages. Nothing where the C library can't."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hidden(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns; extra columns of the input, whatever they are called, go."""
    return df.select(*[F.col(f"`{n}`") for n in names])
