"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times.  Within a source the documents stand
in a fixed order (size, then id); the prefix sum of the expected copies, shifted by one random offset, crosses
some integers at each document, and the document is emitted once per integer crossed.

The prefix sum is computed in two levels, so that a source, or a size within it, of any weight is spread over tasks:
the table is dealt out in ranges of that order, whatever the ids are, and rows are counted by size and range; then rows
are numbered within a range.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null ids come first
within their size; rows that repeat in all of source, size and id are interchangeable; an empty table gives no
rows; a source whose texts are all empty has target 0 and is not taken; texts may be of any length; columns of ``docs``
pass through ``mix`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SIZE_PATTERN, materialize

RANGE_ROWS = 50_000  # rows that are numbered together
BROADCAST_ROWS = 500_000  # documents whose numbers of copies are broadcast; those of more are joined by a shuffle


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """One uniform number in [0, 1) per source and seed."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(
    by_size: DataFrame, weights: Sequence[int] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0, seed: int = 7
) -> DataFrame:
    """(source, source_size, target, copies, shift) from counts by (source, size).

    A source's target is the smaller of its cap and ``level * weight``; ``level`` is what is left for the
    uncapped sources per unit of weight once the sources with the smallest cap per weight are at their cap.
    The table has a row per source, so its windows are small.
    """
    named = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", pick.alias("weight"))
    ranked = named.select(
        "*",
        (F.col("source_size") * F.lit(float(cap)) / F.col("weight")).alias("per"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(ratio))).alias("wanted"),
    )
    order = Window.orderBy(F.col("per"), F.col("source").asc_nulls_last())
    before = F.coalesce(
        F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ) * F.lit(float(cap))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.select("*", ((F.col("wanted") - before) / left).alias("level"))
    level = ranked.where("level <= per").agg(F.min_by("level", "per").alias("level"))
    # where several sources have the same cap per weight, the first of them has the lowest level that fits
    target = F.least(
        F.col("source_size") * F.lit(float(cap)),
        F.coalesce(F.col("found.level"), F.lit(0.0)) * F.col("weight"),
    )
    return (
        named.alias("n")
        .crossJoin(F.broadcast(level).alias("found"))  # one row
        .select("source", "source_size", target.alias("target"))
        .select(
            "*",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies"),
            offset(F.col("source"), seed).alias("shift"),
        )
    )


def mix_counts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    ratio: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """A row per document: id, source, size, source_size, target and ``n_copies``, the times it is emitted."""
    slim = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size")
    )
    slim = materialize(slim, "sizes")  # texts are read once
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("id").asc_nulls_first()]
    n_ranges = max(docs.sparkSession.sparkContext.defaultParallelism, -(-slim.count() // RANGE_ROWS))
    ranged = materialize(slim.repartitionByRange(n_ranges, *order).withColumn("piece", F.spark_partition_id()), "ranges")
    by_piece = materialize(ranged.groupBy("source", "size", "piece").agg(F.count(F.lit(1)).alias("rows")), "pieces")
    targets = source_targets(by_piece, weights, ratio, cap, seed)
    # rows by size, and a few more where a size spans ranges
    earlier = Window.partitionBy("source").orderBy("size", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = by_piece.select("source", "size", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    counts = materialize(_null_safe(counts, targets, ["source"]), "counts")
    rows = _null_safe(ranged, F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, ["source", "size", "piece"])
    within = Window.partitionBy("source", "size", "piece").orderBy(F.col("id").asc_nulls_first())
    place = F.col("before") + F.row_number().over(within) - 1
    rows = rows.select("id", "source", "size", "source_size", "target", "copies", "shift", place.alias("place"))
    crossed = F.floor((F.col("place") + 1) * F.col("copies") + F.col("shift")) - F.floor(
        F.col("place") * F.col("copies") + F.col("shift")
    )
    return rows.select("id", "source", "size", "source_size", "target", crossed.cast("long").alias("n_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each repeated as often as it is taken; columns are kept as they are."""
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    text_col = options.get("text_col", "text")
    plan = mix_counts(docs, **options).groupBy("id", "source", "size").agg(F.sort_array(F.collect_list("n_copies")).alias("n"))
    plan = materialize(plan, "plan")
    known = plan.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("n") > 1).alias("shared")).first()
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    at = lambda c: F.col(names[docs.columns.index(c)])
    held = held.select(
        F.struct(*names).alias("row"), at(id_col).alias("id"), at(source_col).alias("source"), text_size(at(text_col)).alias("size")
    )
    keys = ["id", "source", "size"]
    single = plan.where((F.size("n") == 1) & (F.col("n")[0] > 0)).select(*keys, F.col("n")[0].alias("times"))
    joined = _null_safe(held, F.broadcast(single) if known.rows <= BROADCAST_ROWS else single, keys).select("row", "times")
    if known.shared:
        # rows that repeat in id, source and size share the copies that these rows were given
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
        shared = _null_safe(held, plan.where(F.size("n") > 1), keys)
        joined = joined.unionByName(shared.select("row", F.element_at("n", nth).alias("times")))
    copies = joined.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return copies.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the keys are kept once."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return left.join(renamed, cond).drop(*[f"_{k}" for k in keys])
