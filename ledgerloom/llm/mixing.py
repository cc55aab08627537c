"""Mixing sources to target weights by subset-sum budget fitting.

Targets
    Sources, by code point with null last, weigh ``WEIGHTS`` in turn and share a
    budget of ``SHARE`` of all sizes.  A source is given at most ``MOST`` times its
    size; what is above is shared again by weight until no target is above.  Places
    are numbered by ranges of the names, the sharing is a few sums over the sources:
    no task has to hold them all.

Fitting
    Documents are counted by source and exact length.  A source takes every
    document as often as its target holds the whole source; of each length it then
    takes the remaining share of the documents, rounded down.  What the rounding
    leaves of the budget is filled by single documents, longest first, and at last
    by a bounded-knapsack program over the lengths still left.  Should that miss the
    budget, shares of ``WIDE`` less are taken and the program fills all of that: at a
    budget up to ``WIDE`` its sum is the nearest of all, above it the nearest that
    keeps those shares.  The steps are the same for every size.

Selection
    The planned number of documents of a length are those first by a seeded hash of
    their id, so reruns agree.  Hash ranges of each (source, length) are counted
    first, so that a hot length is ranked in 64 parts and never in one.

Edge cases
    * null text: size 0; null source: a source of its own, the last; null ids: as
      any other value;
    * repeated rows are documents of their own; which of equal rows is taken does
      not matter;
    * a source of size 0 has target 0; no source at all: an empty result;
    * a hot length is one row of the counts, a hot source one histogram of its lengths;
    * extra columns are kept: :func:`mixed` returns all columns as they came, :func:`mix`
      replaces one named like its results (``times, size, source_size, target``),
      :func:`mixture` drops them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import WORD, fresh, quoted, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
#: Budget that is left to the knapsack program, at first and should that miss; it bounds the program's
#: memory, a bit and four bytes for each sum up to twice the budget.
EXACT, WIDE = 1 << 16, 1 << 18
_BUCKETS = 64


def fill(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that the sum comes nearest ``budget``."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if total <= budget or not total:
        return list(counts)
    taken, gap = _fitted(sizes, counts, budget, budget, EXACT)
    if gap:
        other, less = _fitted(sizes, counts, budget, max(0, budget - WIDE), WIDE)
        if less < gap:
            return other
    return taken


def _fitted(sizes: list[int], counts: list[int], budget: int, shared: int, program: int) -> tuple[list[int], int]:
    """What to take with a share of ``shared`` of each length and about ``program`` left to the program, and the distance."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    taken = [c * shared // total for c in counts]
    rest = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    while True:  # one more of each length, longest first, down to what the program takes
        before = rest
        for i in order:
            if rest <= program:
                break
            if 0 < sizes[i] <= rest - program // 2 and taken[i] < counts[i]:
                taken[i] += 1
                rest -= sizes[i]
        if rest <= program or rest == before:
            break
    free = [c - t for c, t in zip(counts, taken, strict=True)]
    chosen, reached = _nearest(sizes, free, rest, rest)
    if reached < rest:  # a sum above the budget may be nearer
        chosen, reached = _nearest(sizes, free, rest, 2 * rest - reached - 1)
    return [t + n for t, n in zip(taken, chosen, strict=True)], abs(reached - rest)


def _nearest(sizes: list[int], counts: list[int], wanted: int, most: int) -> tuple[list[int], int]:
    """Bounded knapsack: how many of each size make the sum nearest ``wanted`` among those up to ``most``, and the sum.

    Of two sums as near the smaller one is chosen.  For each sum the item that first
    reached it is kept, so the memory does not grow with the number of items.
    """
    mask, row, items = (1 << most + 1) - 1, 1, []  # bit b of the row: the items so far can sum to b
    via = np.zeros(most + 1, np.int32)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if not 0 < sizes[i] <= most:
            continue
        free, step = min(counts[i], most // sizes[i]), 1
        while free and not row >> wanted & 1:
            step = min(step, free)
            grown = (row | row << sizes[i] * step) & mask
            if grown != row:
                items.append((i, step))
                new = np.frombuffer((grown ^ row).to_bytes((most >> 3) + 1, "little"), np.uint8)
                via[np.flatnonzero(np.unpackbits(new, bitorder="little"))] = len(items)
                row = grown
            free -= step
            step *= 2
        if row >> wanted & 1:
            break
    below = (row & (1 << wanted + 1) - 1).bit_length() - 1
    above = row >> wanted
    above = wanted + (above & -above).bit_length() - 1 if above else 2 * wanted + 1
    total = at = below if wanted - below <= above - wanted else above
    taken = [0] * len(sizes)
    while at:
        i, step = items[via[at] - 1]
        at -= sizes[i] * step
        taken[i] += step
    return taken, total


def _plan_source(group: pa.Table) -> pa.Table:
    group = group.sort_by("_size")
    sizes, counts = group.column("_size").to_pylist(), group.column("_count").to_pylist()
    target, whole = group.column("target")[0].as_py(), group.column("source_size")[0].as_py()
    times = min(MOST, int(target // whole)) if whole else 0
    extra = fill(sizes, counts, round(target - times * whole)) if whole and times < MOST else [0] * len(sizes)
    return pa.table({"_source": group.column("_source"), "_size": group.column("_size"), "source_size": group.column("source_size"),
                     "target": group.column("target"), "_times": pa.array([times] * len(sizes), pa.int32()), "_extra": pa.array(extra, pa.int64())})


def _weighted(sources: DataFrame) -> DataFrame:
    """``sources`` with ``weight``, by place; places are counted within ranges of the names."""
    parts = written(sources.select("_source", "source_size").repartitionByRange("_source").withColumn("part", F.spark_partition_id()), "sources")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", ahead.alias("ahead"))  # a row per range
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("_source")) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = parts.join(starts, "part").select("_source", "source_size", F.get(weights, F.pmod(place, F.lit(len(WEIGHTS))).cast("int")).alias("weight"))
    return written(ranked, "sources")


def targets(sources: DataFrame) -> DataFrame:
    """``_source, source_size, target`` from ``sources (_source, source_size)``, one row per source."""
    ranked, level, before = _weighted(sources), 0.0, -1
    while True:
        full = F.col("source_size") * float(MOST) < F.col("weight") * level
        now = ranked.agg(F.sum("source_size").alias("every"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if not now["weight"] or now["n"] == before:
            break
        level, before = (now["every"] * SHARE - now["full"] * float(MOST)) / now["weight"], now["n"]
    return ranked.select("_source", "source_size", F.least(F.col("source_size") * float(MOST), F.col("weight") * level).alias("target"))


def _mixed(docs: DataFrame, kept: list[str], results: list[str], id_col: str, text_col: str, source_col: str, narrow: bool) -> DataFrame:
    """The columns ``kept`` of ``docs`` and the results times, size, source size and target under the given names."""
    key, size, hashed, other, bucket, place, once, more = fresh([*docs.columns, *results], "_from", "_words", "_hash", "_texthash", "_bucket", "_place", "_once", "_more")
    text = quoted(text_col).cast("string")
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    # A prefix orders null last and keeps the code-point order of the rest.
    name = F.coalesce(F.concat(F.lit("0"), quoted(source_col).cast("string")), F.lit("1"))
    number = F.xxhash64(quoted(id_col).cast("string"), F.lit(SEED))
    # Rows of one id are told apart by their text, so that reruns take the same.
    rows = docs.select(*map(quoted, kept), name.alias(key), words.alias(size), number.alias(hashed), F.xxhash64(text).alias(other), F.shiftrightunsigned(number, 58).cast("int").alias(bucket))
    if narrow:
        rows = written(rows, "sizes")
    counted = rows.groupBy(F.col(key).alias("_source"), F.col(size).alias("_size"), F.col(bucket).alias("_bucket")).agg(F.count("*").alias("_count"))
    buckets = written(counted, "buckets")
    lengths = buckets.groupBy("_source", "_size").agg(F.sum("_count").alias("_count"))
    sources = lengths.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_count")).alias("source_size"))
    histogram = lengths.join(targets(sources), "_source").select("_source", "_size", "_count", "source_size", "target")
    planned = histogram.groupBy("_source").applyInArrow(
        _plan_source, "_source string, _size long, source_size long, target double, _times int, _extra long")
    # At most 64 rows per (source, length): how many each hash range gives.
    before = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = buckets.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    ranges = ranges.join(planned, ["_source", "_size"]).withColumn("_take", F.col("_extra") - F.col("_before"))
    times, said, whole, target = results
    ranges = ranges.select(F.col("_source").alias(key), F.col("_size").alias(size), F.col("_bucket").alias(bucket), F.col("source_size").alias(whole), F.col("target").alias(target), F.col("_times").alias(once), F.col("_take").alias(more))
    nth = F.row_number().over(Window.partitionBy(key, size, bucket).orderBy(hashed, quoted(id_col), other))
    chosen = rows.join(ranges, [key, size, bucket]).withColumn(place, nth)
    taken = F.col(once) + F.when(F.col(place) <= F.col(more), 1).otherwise(0)
    return chosen.select(*map(quoted, kept), F.col(size).alias(said), whole, target, taken.alias(times))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", narrow: bool = False) -> DataFrame:
    """``docs`` with ``times``, how often the mix takes each row, and its size, source size and target.

    ``narrow`` keeps the id alone of the columns of ``docs``.
    """
    results = ["times", "size", "source_size", "target"]
    return _mixed(docs, [id_col] if narrow else [c for c in docs.columns if c not in results], results, id_col, text_col, source_col, narrow)


def mixture(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``."""
    return mix(docs, narrow=True).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    results = fresh(docs.columns, "_times", "_said", "_whole", "_target")
    rows = _mixed(docs, docs.columns, results, "doc_id", "text", "source", False)
    return rows.select(F.explode(F.array_repeat(F.lit(0), F.col(results[0]))).alias(results[1]), *map(quoted, docs.columns)).select(*map(quoted, docs.columns))
