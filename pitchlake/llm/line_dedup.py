"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over the threshold, reassemble.

Two 64-bit hashes name a line, and two name a text. Counting is pre-aggregated on the map side. The table of dropped lines is
never broadcast: it can grow with the corpus. It meets the lines on (hash, salt) and the positions that a text loses meet the
texts on (hash, salt); a salt depends on the whole row, so neither the most common line nor the most common text is in one task.
Whole texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import BLANKS, ascii_lower, row_key, salt, salts, spread


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_hash(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(3), key).alias("_h1"), F.xxhash64(F.lit(4), key).alias("_h2")]


def line_dedup(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The input's rows and columns, with ``text_col`` replaced by the lines that stay, and n_lines, n_dropped added.

    A line's key is the line without blanks at either end, A-Z lower-cased. Keys of at least ``min_chars`` code points
    that occur in at least ``min_docs`` documents lose all their lines everywhere. Every row is a document of its own,
    repeated rows and rows with a null id included. Null and empty texts have one empty line, which stays (its key has
    no code points) and gives an empty text. An empty table gives an empty table. Extra columns are kept; columns
    called n_lines and n_dropped are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name in kept and f.dataType.typeName() not in ("map", "variant", "void")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(kept)]
    docs = docs.select(*own, text.alias("_text"), *row_key(F.col(f"`{text_col}`")), salt(salts(docs), *hashed).alias("_s"))
    norm = F.transform(_lines(ascii_lower(F.col("_text"))), lambda x: F.btrim(x, F.lit(BLANKS)))
    once = docs.select("_s", F.explode(F.array_distinct(norm)).alias("_key")).where(F.length("_key") >= min_chars)
    counted = once.select("_s", *_line_hash(F.col("_key"))).groupBy("_h1", "_h2", "_s").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_n", F.sum("_n").over(Window.partitionBy("_h1", "_h2")))
    frequent = counted.where(F.col("_n") >= min_docs).select("_h1", "_h2", "_s")
    at = docs.select("_k1", "_k2", "_s", F.posexplode(norm).alias("_pos", "_key")).where(F.length("_key") >= min_chars)
    at = at.select("_k1", "_k2", "_s", "_pos", *_line_hash(F.col("_key")))
    gone = at.join(frequent, ["_h1", "_h2", "_s"]).groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_gone"))
    out = docs.join(spread(docs, gone, ["_k1", "_k2"]), ["_k1", "_k2", "_s"], "left")
    lines = _lines(F.col("_text"))
    n_lines = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_gone"))
    rebuilt = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    columns = [rebuilt.alias(c) if c == text_col else F.col(f"_own{i}").alias(c) for i, c in enumerate(kept)]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
