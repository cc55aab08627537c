"""Order over whole tables without one task that sees all rows.

Rows are dealt by ranges of their order and sorted there; what a row has before it is
what its range has before the row, plus what earlier ranges hold.  Only one figure per range (and
group) is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.shared import stored


def placed(rows: DataFrame, order: list[Column], name: str = "place", by: tuple[str, ...] = (), sums: Column | None = None, before: str = "before") -> DataFrame:
    """``rows`` with ``name``, their place from 1 in order, per group ``by`` if given.

    With ``sums``, a number per row, also with ``before``: the sum over all earlier rows of the group.
    Rows that tie in the order are placed in an arbitrary order of theirs, which is fixed
    once the result is computed.  An empty table gives an empty one.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    numbered = rows.withColumn("_sum", F.lit(0).cast("long") if sums is None else sums.cast("long"))
    dealt = numbered.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    # In a sorted range rows have consecutive numbers, the range's own in the high bits.
    kept = stored(dealt.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_row", 33)
    ends = kept.groupBy(*[F.col(c).alias(f"_{c}") for c in by], part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"), F.sum("_sum").alias("_sums"))
    if by:
        earlier = Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ends.select(*[f"_{c}" for c in by], "_part", "_first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_sums")])
    else:
        # A row per range: as many as there are tasks.
        done, table = [0, 0], []
        for row in sorted(ends.collect(), key=lambda r: r["_part"]):
            table.append((row["_part"], row["_first"], *done))
            done = [done[0] + row["_rows"], done[1] + row["_sums"]]
        offsets = F.broadcast(rows.sparkSession.createDataFrame(table, "_part long, _first long, _rows_before long, _sums_before long"))
    same = part == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = kept.join(offsets, same).withColumn(name, F.col("_row") - F.col("_first") + F.col("_rows_before") + 1)
    if sums is not None:
        within = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn(before, F.coalesce(F.sum("_sum").over(within), F.lit(0)) + F.col("_sums_before"))
    return found.select(*rows.columns, name, *([before] if sums is not None else []))
