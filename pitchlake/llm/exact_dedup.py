"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each group.

Everything on the path is a built-in DataFrame expression.

* The grouping key is (hash, text): rows meet by hash, and the aggregation's own key comparison of the text's bytes
  keeps texts apart that collide. Partial aggregation sends one row per distinct text and map task, so a text that
  makes up a third of the table costs no more than any other.
* What each row needs from its group (the id that stays, the group's size) comes back by a join on (hash, SHA-256, salt).
  A group is repeated for the salts that its rows really use, and there are as many salts as shuffle partitions, so a hot
  group is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import ascii_lower, cut, hidden, salt, salts, spread


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = F.md5,
    keep: str = "min",
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" (the smallest stable id stays) or "max". ``normalise`` maps the text before it is compared.

    Null text counts as empty, so null and empty texts are equal. Rows whose id is null are members of their group, and
    such a row stays only where no row of the group has an id. Repeated rows (same id, same text) each count in
    group_size and share one verdict. An empty table gives an empty result. Extra columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    base = hidden(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("_id"), normalise(F.col(f"`{text_col}`")).alias("_norm"))
    base = base.withColumn("_h", content_hash(F.col("_norm")))
    best = F.min("_id") if keep == "min" else F.max("_id")
    groups = base.groupBy("_h", "_norm").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("_h", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")
    rows = cut(base.select("_id", "_h", F.sha2("_norm", 256).alias("text_sha256"), salt(salts(docs), F.col("_id")).alias("_s")))
    out = rows.join(spread(rows, groups, ["_h", "text_sha256"]), ["_h", "text_sha256", "_s"])
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
