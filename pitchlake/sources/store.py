"""Tables in folders: a cache keyed by match, Parquet, CSV and array sinks, JSON summaries, text reports, ingestion of data sets."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.errors import EngineError, SourceError
from pitchlake.sources.provider import DataAdapter, supports_360

#: The most numbers that ``write_npy`` brings to the driver.
NPY_LIMIT = 1 << 24


def materialised(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the session's checkpoint folder, so that several branches read them and a lost executor costs none.

    On one machine a session that names no folder gets a temporary one; any other raises SourceError.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise SourceError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tables-"))
    return df.checkpoint(eager=True)


class TableStore:
    """A folder of Parquet tables partitioned by a key; writing replaces the partitions that the rows have."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "match_id") -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def put(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(self.path(name))

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def get_or_put(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.exists(name):
            self.put(name, make())
        return self.get(name)

    def keys(self, name: str) -> DataFrame:
        """The keys that are there, from the partitions alone, sorted as text."""
        return self.get(name).select(F.col(self.key).cast("string").alias(self.key)).distinct().orderBy(self.key)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def summary_json(df: DataFrame, digits: int = 4) -> str:
    """A one-row report as pretty JSON with rounded numbers."""
    row = df.first()
    return json.dumps({k: round(v, digits) if isinstance(v, float) else v for k, v in row.asDict(recursive=True).items()}, indent=2, sort_keys=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def slug_path(base: str, slug: str) -> str:
    return f"{base.rstrip('/')}/{slug}"


def read_point(spark: SparkSession, path: str, field: str) -> object:
    """One value of a JSON document; SourceError if the document or the field is absent."""
    try:
        row = spark.read.option("multiLine", True).json(path).select(field).first()
    except AnalysisException as e:
        raise SourceError(f"{path} has no {field}") from e
    if row is None or row[0] is None:
        raise SourceError(f"{path} has no {field}")
    return row[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document as one file, by the file system that the path names; an older one is replaced."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small document as text; SourceError if there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise SourceError(f"no document at {path}") from e
    return "" if row is None else row[0]


def write_npy(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], limit: int = NPY_LIMIT) -> int:
    """The columns as one matrix file (rows in order); more numbers than ``limit`` raise ValueError: use Parquet for these. Returns the rows."""
    import io

    n = df.count()
    if n * len(columns) > limit:
        raise ValueError(f"{n} rows are too many for one matrix file")
    x = np.array([tuple(r) for r in df.orderBy(*order).select(*columns).collect()], dtype=float).reshape(n, len(columns))
    buffer = io.BytesIO()
    np.save(buffer, x)
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(buffer.getvalue()))
    finally:
        out.close()
    return n


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """i, v: the rows of matrix files as arrays, read by executors; a vector gives arrays of one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.load(io.BytesIO(data), allow_pickle=False).astype(float)
                x = x.reshape(len(x), -1)
                for a in range(0, len(x), 10_000):
                    part = x[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["i", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "i bigint, v array<double>")


def hconcat(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The columns of all tables side by side, rows matched by keys and not by place. Columns other than keys must differ."""
    out = tables[0]
    for t in tables[1:]:
        if clash := (set(out.columns) & set(t.columns)) - set(keys):
            raise ValueError(f"columns in two tables: {sorted(clash)}")
        out = out.join(t, list(keys))
    return out


def text_table(df: DataFrame, formats: Mapping[str, str] | None = None, title: str | None = None) -> str:
    """A small report as aligned text: numbers to the right, by their format, nulls as a dash."""
    formats = formats or {}
    rows = [["-" if v is None else format(v, formats.get(c, "")) for c, v in zip(df.columns, r, strict=True)] for r in df.collect()]
    numeric = [t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") for _, t in df.dtypes]
    wide = [max(map(len, [c, *[r[i] for r in rows]])) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(x.rjust(w) if right else x.ljust(w) for x, w, right in zip(cells, wide, numeric, strict=True)).rstrip()
    return "\n".join([*([title] if title else []), line(df.columns), "  ".join("-" * w for w in wide), *map(line, rows)])


def match_summary(events: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Per data set and for all (TOTAL): matches, events, events with a freeze frame, matches with any."""
    seen = events.groupBy(dataset, "match_id").agg(F.count(F.lit(1)).alias("n"), F.count("freeze_frame").alias("f"))
    out = seen.rollup(dataset).agg(F.count(F.lit(1)).alias("matches"), F.sum("n").alias("events"), F.sum("f").alias("with_360"), F.count_if(F.col("f") > 0).alias("matches_360"))
    return out.withColumn(dataset, F.coalesce(dataset, F.lit("TOTAL")))


def ingest(store: TableStore, adapters: Mapping[str, DataAdapter]) -> tuple[DataFrame, dict[str, str]]:
    """Load every data set's events and line-ups into the store; the summary and the data sets that failed, with their reasons.

    A data set that can't be read is left out; the others are stored.
    """
    failed: dict[str, str] = {}
    tables = []
    for slug, adapter in adapters.items():
        try:
            events, lineups = adapter.load_events(), adapter.load_lineups()
            store.put(slug_path("events", slug), events)
            store.put(slug_path("lineups", slug), lineups)
            tables.append(store.get(slug_path("events", slug)).withColumn("dataset", F.lit(slug)))
        except (EngineError, AnalysisException) as e:
            failed[slug] = str(e).splitlines()[0]
    if not tables:
        raise SourceError("no data set could be read")
    return match_summary(union_tables(*tables)), failed


def has_frames(events: DataFrame, match_id: str) -> bool:
    """Whether a match has any freeze frame."""
    row = supports_360(events.where(F.col("match_id") == match_id)).first()
    return bool(row and row.has_360)
