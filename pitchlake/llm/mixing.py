"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words by water-filling. A source's rate r = target / size says how often each of its
documents is expected: floor(r) whole copies are certain, and the fraction p = r - floor(r) is the inclusion probability
of one copy more. Documents are ranked by Q = [u / (1 - u)] / [p / (1 - p)], the random odds divided by the inclusion
odds, and the first of them are taken until the source's remaining target of words is filled.

The ranking needs no sort of a whole source: the words of each of BUCKETS ranges of u are summed (partial aggregation),
running sums over these few rows tell the range in which the cut falls, and only the documents of that zone are sorted.
Beyond the cut each document of the zone that still fits is taken in order, and one more if that brings the source nearer to its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, row_key, salt, salts

#: Ranges of the random number, at most so many rows per source in the running sums.
BUCKETS = 16384
#: Documents among which the cut is looked for, beyond those of the range in which it falls.
ZONE = 256
#: Up to so many sources their table is broadcast (about 100 bytes each); beyond, it is joined by salted keys.
BROADCAST_SOURCES = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """From (source, size): target per source. Sources in code point order, null last, get the weights in turn.

    Targets share ``share`` of all sizes by weight, stop at ``max_repeat`` times the source's size, and the excess is
    shared again by weight among the rest until none is above. This closed form needs one sort of the sources by
    size / weight: the sources that reach their bound are the first of that order.
    """
    turn = Window.orderBy(F.isnull("source"), F.col("source"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("_rank", F.row_number().over(turn))
    t = t.withColumn("_w", F.element_at(w, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size").cast("double") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every).cast("double") * F.lit(float(share))
    t = t.withColumn("_level", (total - before) / rest).withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    return t.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level)).select("source", "source_size", "target")


def _fill(zone: DataFrame) -> DataFrame:
    """_whose (the source) and _picked: the places of documents behind the cut that are taken.

    Going down the order, each document that still fits is taken; then the one that brings the source nearest to its target, if any
    does. A source's list has the documents of its zone only.
    """
    gap = F.first("_rest") - F.coalesce(F.max(F.when(F.col("_in"), F.col("_sum"))), F.first("_filled"))
    later = F.sort_array(F.collect_list(F.when(~F.col("_in") & (F.col("size") > 0), F.struct(F.col("_i").alias("i"), F.col("size").alias("n")))))
    rows = zone.groupBy(F.col("_source").alias("_whose")).agg(gap.alias("_gap"), later.alias("_later"))
    start = F.struct(F.col("_gap").alias("gap"), F.array().cast("array<int>").alias("got"))

    def take(s: Column, x: Column) -> Column:
        return F.when(x["n"] <= s["gap"], F.struct((s["gap"] - x["n"]).alias("gap"), F.concat(s["got"], F.array(x["i"])).alias("got"))).otherwise(s)

    rows = rows.withColumn("_s", F.aggregate("_later", start, take))
    near = F.filter("_later", lambda x: ~F.array_contains(F.col("_s.got"), x["i"]) & (x["n"] < 2 * F.col("_s.gap")))
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x["n"] - F.col("_s.gap")).alias("d"), x["i"].alias("i"))))["i"]
    return rows.select("_whose", F.when(best.isNull(), F.col("_s.got")).otherwise(F.concat(F.col("_s.got"), F.array(best))).alias("_picked"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_columns: bool = True,
) -> DataFrame:
    """The input's rows with size, source_size, target, copies and taken = copies * size added.

    With ``keep_columns`` false only id_col and the added columns are returned, and texts are read once.

    Size is the number of words, 0 for null and empty texts; such documents fill no target, and their copies, if any,
    are 0 words. Rows with a null source form a source of their own, the last. Null ids are allowed. Equal rows have the
    same random number; ties are broken by the row's content, and among equal rows it doesn't matter which is taken.
    An empty table gives an empty one. Columns of the input with the names that are added are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in added] if keep_columns else [id_col]
    doc_id, text, source = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(own)],
        source.alias("_source"),
        doc_id.alias("_id"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)).alias("_u"),
        *row_key(doc_id, text),
    )
    rows = rows.withColumn("_b", F.floor(F.col("_u") * BUCKETS).cast("int")).withColumn("_s", salt(salts(docs), F.col("_k1")))
    slim = ["_source", "_id", "size", "_u", "_k1", "_k2", "_b", "_s"]
    if keep_columns:
        counted = rows.select(*slim)
    else:
        rows = counted = cut(rows)
    ranges = cut(counted.groupBy("_source", "_b").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n")))
    sizes = ranges.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size"))
    goal = targets(sizes, weights, share, max_repeat)
    goal = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    order = Window.partitionBy("_source").orderBy("_b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = ranges.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    run = run.join(goal, F.col("_source").eqNullSafe(F.col("source"))).drop("source")
    first = F.min(F.when(F.col("_before") + F.col("_words") > F.col("_rest"), F.struct("_b", "_before", "_at"))).over(Window.partitionBy("_source"))
    run = run.withColumn("_first", first)
    facts = ["source_size", "target", "_whole", "_rest"]
    plan = run.groupBy(F.col("_source").alias("_of")).agg(
        *[F.first(c).alias(c) for c in facts],
        F.first("_first._b").alias("_from"),
        F.first("_first._before").alias("_filled"),
        F.max(F.when((F.col("_b") >= F.col("_first._b")) & (F.col("_at") < F.col("_first._at") + ZONE), F.col("_b"))).alias("_to"),
    )
    plan = cut(plan)
    many = plan.count() > BROADCAST_SOURCES
    if not many:
        joined = rows.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_of")), "left")
    else:
        used = rows.select(F.col("_source").alias("_src"), F.col("_s").alias("_t")).distinct()
        plan = used.join(plan, F.col("_src").eqNullSafe(F.col("_of"))).drop("_src")
        joined = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_s") == F.col("_t")), "left").drop("_t")
    p = F.col("_rest") / F.col("source_size")
    odds = F.when(F.col("_rest") > 0, (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p))).otherwise(F.col("_u"))
    joined = joined.withColumn("_zone", F.coalesce(F.col("_b").between(F.col("_from"), F.col("_to")), F.lit(False)))
    clear = joined.where(~F.col("_zone")).withColumn("_more", F.coalesce(F.col("_b") < F.col("_from"), F.lit(False)))
    rank = Window.partitionBy("_source").orderBy("_q", "_id", "_k1", "_k2")
    zone = joined.where(F.col("_zone")).withColumn("_q", odds).withColumn("_sum", F.col("_filled") + F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_i", F.row_number().over(rank))
    zone = zone.withColumn("_in", F.col("_sum") <= F.col("_rest"))
    picked = _fill(zone)
    if many:
        zone = zone.join(picked, F.col("_source").eqNullSafe(F.col("_whose")), "left")
    else:
        zone = zone.join(F.broadcast(picked), F.col("_source").eqNullSafe(F.col("_whose")), "left")
    zone = zone.withColumn("_more", F.col("_in") | F.coalesce(F.array_contains("_picked", F.col("_i")), F.lit(False)))
    out = clear.unionByName(zone.drop("_q", "_sum", "_i", "_in", "_whose", "_picked"))
    copies = F.least(F.col("_whole").cast("int") + F.col("_more").cast("int"), F.lit(max_repeat))
    out = out.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(own)], "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies").cast("long") * F.col("size"))
