"""First failure and joined failures of ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.ranges import placed


def first_failure(*rules: tuple[Column, Column | str]) -> Column:
    """The message of the first rule whose condition holds, else null.

    A condition that is null counts as not met: write rules so that null means fine.
    """
    return F.coalesce(*[F.when(bad, message if isinstance(message, Column) else F.lit(message)) for bad, message in rules])


def earliest(failures: DataFrame, keys: list[str], rank: Column, message: str = "message") -> DataFrame:
    """Each key's message with the smallest rank; ranks are structs, compared field by field."""
    return failures.groupBy(*keys).agg(F.min_by(message, rank).alias(message))


def joined(failures: DataFrame, order: str, message: str = "message", by: tuple[str, ...] = ()) -> DataFrame:
    """All messages joined with ``; `` in order, empty if there are none."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(message).isNotNull(), F.struct(order, message))))
    return failures.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p[message]), "; ").alias("errors"))


def joined_chunks(failures: DataFrame, order: str, message: str = "message", by: tuple[str, ...] = (), rows: int = 1000) -> DataFrame:
    """The joined text as rows ``by, chunk, offset, text``: concatenated in order they are all messages with ``; `` between.

    A chunk holds ``rows`` messages, the last one fewer, and all but a group's first begin with ``; ``;
    ``offset`` is how many characters are before it.  A group without messages has no row.
    Messages are placed in ranges, so no task and no value holds them all.
    """
    found = placed(failures.where(F.col(message).isNotNull()).select(*by, F.col(order).alias("_order"), F.col(message).alias("_message")), [F.col("_order").asc(), F.col("_message").asc()], "_place", by)
    chunk = F.expr(f"(_place - 1) div {rows}").alias("chunk")
    texts = found.groupBy(*by, chunk).agg(F.array_sort(F.collect_list(F.struct("_place", "_message"))).alias("parts"))
    texts = texts.select(*by, "chunk", F.concat(F.when(F.col("chunk") > 0, F.lit("; ")).otherwise(F.lit("")), F.array_join(F.transform("parts", lambda p: p["_message"]), "; ")).alias("text"))
    return placed(texts, [F.col("chunk").asc()], "_nth", by, F.length("text"), "offset").select(*by, "chunk", "offset", "text")


def repeated(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that are not the first of their key; the window holds one key's rows."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("copy", place.cast("long")).where(F.col("copy") > 1)


def same_json(left: Column, right: Column) -> Column:
    """Deep equality of two JSON texts, whatever the order of their keys."""
    text = lambda c: F.to_json(F.try_parse_json(c))
    return text(left).eqNullSafe(text(right))
