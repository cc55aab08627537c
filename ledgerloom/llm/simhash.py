"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Fingerprint
    64 bits over the XXH64 hashes (seed 42) of a text's 4-word shingles, repeats
    included; words are runs of non-white-space of the text with A-Z lower-cased.
    A bit is 1 if it is set in over half the hashes.

Links
    Two fingerprints at distance <= 4 have a common variant at distance <= 2 from
    both.  So every distinct fingerprint emits its 2,081 variants within half the
    radius, variants are shuffled, and equal variants collide.  To keep the
    shuffle small, what travels is one copy of the fingerprint per *prefix* that
    any of its variants has (all prefixes within two flips of its own); the
    variants with that prefix are made where they are sorted.  That is the same
    multiset of variants, dealt by the variant's leading bits.  All members of a
    collision lie in one ball of radius 2, so neighbours in sorted order are
    linked instead of all pairs; each such pair is verified by its bit count.

Components
    Each prefix yields a spanning forest of its verified links; the forests'
    union goes through :mod:`components`.  Copies share a fingerprint and are
    joined back by it, so groups of copies are never expanded.

Edge cases
    * null or empty text, or white space only: fingerprint zero, linked like any
      other; fewer than four words: the whole sequence is the one shingle;
    * null ids: such rows get their group's id; a group of null ids only has none;
    * repeated rows are kept, each with its group; extra columns are dropped by
      :func:`near_duplicates` and kept by :func:`representatives`;
    * an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerloom.llm.common import fresh, quoted, renumbered, written
from ledgerloom.llm.components import components

SHINGLE = 4
SEED = 42
HALF = 2
#: Fingerprints near one prefix that one task takes, and variants that it sorts at once.
PREFIX_ROWS, SORTED = 2_000_000, 1 << 20


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)]
        parts = iter(words)
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    totals = np.zeros(64, np.int64)
    for at in range(0, n, 8160):  # sums of 255 bits at most fit a byte
        bits = np.unpackbits(hashes[at : at + 8160].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        totals += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        totals += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) for every row."""
    narrow = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(text_col).cast("string").alias("_text"))
    return narrow.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _marked_batches(text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, "_fp"])

    return run


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``most`` set, as uint64."""
    every = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]
    return np.array(every, np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        while not np.array_equal(after, jumped := after[after]):
            after = jumped
        if np.array_equal(after, label):
            return label
        label = after


def _collisions(prints: np.ndarray, left: np.ndarray, fixed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of neighbours in each collision of the variants that keep the first ``fixed`` bits
    and flip at most ``left`` of the others; more bits are fixed until a sort is small."""
    open_parts = [(np.arange(len(prints)), left, np.zeros(len(prints), np.uint64), fixed)]
    while open_parts:
        here, left, flips, fixed = open_parts.pop()
        rest = 64 - fixed
        wide = int(len(here) - 1).bit_length()
        balls = sum(int(np.count_nonzero(left == k)) * sum(math.comb(rest, j) for j in range(k + 1)) for k in range(HALF + 1))
        if wide > fixed or (balls > SORTED and rest > 4):
            # Deal by the variants' next four bits.
            nibble = (prints[here] ^ flips) >> np.uint64(rest - 4) & np.uint64(15)
            for value in range(16):
                after = left - np.bitwise_count(nibble ^ np.uint64(value))
                kept = np.flatnonzero(after >= 0)
                if len(kept) > 1:
                    flip = (nibble[kept] ^ np.uint64(value)) << np.uint64(rest - 4)
                    open_parts.append((here[kept], after[kept], flips[kept] ^ flip, fixed + 4))
            continue
        tails = prints[here] & np.uint64((1 << rest) - 1)
        packed = []
        for k in range(HALF + 1):
            at = np.flatnonzero(left == k)
            packed.append(((tails[at, None] ^ _ball(rest, k)[None, :]) << np.uint64(wide) | at[:, None].astype(np.uint64)).ravel())
        packed = np.sort(np.concatenate(packed))
        same = packed[1:] >> np.uint64(wide) == packed[:-1] >> np.uint64(wide)
        low = np.uint64((1 << wide) - 1)
        yield here[(packed[:-1][same] & low).astype(np.int64)], here[(packed[1:][same] & low).astype(np.int64)]


@cache
def _ball(bits: int, most: int) -> np.ndarray:
    return _flips(bits, most)


def prefix_links(prints: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among distinct fingerprints that share a variant whose first
    ``bits`` bits are ``prefix``; each collision is linked in a chain."""
    left = HALF - np.bitwise_count((prints >> np.uint64(64 - bits)) ^ np.uint64(prefix)).astype(np.int64)
    keep = np.flatnonzero(left >= 0)
    found = [np.zeros(0, np.int64)]
    if len(keep) > 1:
        for a, b in _collisions(prints[keep], left[keep], bits):
            a, b = keep[a], keep[b]
            found.append(np.unique(np.minimum(a, b) << 32 | np.maximum(a, b)))
    pairs = np.unique(np.concatenate(found))
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.bitwise_count(prints[a] ^ prints[b]) <= 2 * HALF
    return a[near], b[near]


def _prefix_forest(bits: int):
    def run(group: pa.Table) -> pa.Table:
        prefix = group.column("prefix")[0].as_py()
        prints = np.unique(group.column("fp").to_numpy().view(np.uint64))
        a, b = prefix_links(prints, prefix, bits)
        root = _roots(len(prints), a, b)
        hung = np.flatnonzero(root != np.arange(len(prints)))
        return pa.table({"u": prints[hung].view(np.int64), "v": prints[root[hung]].view(np.int64)})

    return run


def _dealt(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """``rows (fp, prefix, left)``, by the first ``bits`` bits, dealt by ``more`` further bits."""
    masks = [(int(m), int(m).bit_count()) for m in _flips(more, HALF)]
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("cost")) for m, n in masks])
    own = F.shiftrightunsigned("fp", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
    rows = rows.select("fp", "prefix", "left", F.explode(flips).alias("flip")).where("flip.cost <= left")
    return rows.select("fp", (F.shiftleft("prefix", more).bitwiseOR(own.bitwiseXOR(F.col("flip.mask")))).alias("prefix"), (F.col("left") - F.col("flip.cost")).alias("left"))


def links(prints: DataFrame, count: int) -> DataFrame:
    """Spanning links ``u, v`` of the near-fingerprint graph over distinct ``prints (fp)``.

    A prefix that more than ``PREFIX_ROWS`` fingerprints are near, as in a large family of
    similar texts, is dealt by eight more bits, and again, until none is; that ends, for
    no more than 2,081 fingerprints are near one whole variant.
    """
    # 37 copies of a fingerprint up to 2**23 of them; then one bit more for each doubling.
    bits = min(24, max(8, math.ceil(math.log2(max(count, 1))) - 15))
    rows = _dealt(prints.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(HALF).alias("left")), 0, bits)
    found = None
    while True:
        dense = written(rows.groupBy("prefix").count().where(F.col("count") > PREFIX_ROWS).select("prefix"), "dense")
        last = bits + 8 > 60 or dense.isEmpty()
        fine = rows if last else rows.join(dense, "prefix", "left_anti")
        forest = fine.select("fp", "prefix").groupBy("prefix").applyInArrow(_prefix_forest(bits), "u long, v long")
        found = forest if found is None else found.unionByName(forest)
        if last:
            return found
        rows = written(_dealt(rows.join(dense, "prefix", "left_semi"), bits, 8), "dealt")
        bits += 8


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows (doc_id, fp)`` with ``root``, the component's name, and ``component_id``, its smallest id."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    hung = written(components(links(nodes.select("fp"), nodes.count())), "roots")
    linked = hung.join(nodes, hung.node == nodes.fp).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    # Written, so that the join by a hot fingerprint has two plain sides and can be split.
    labels = written(nodes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id")), "labels")
    return rows.join(labels, "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    return _grouped(written(fingerprints(docs, id_col, text_col), "fingerprints")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group, with its smallest id; rows with a null id are kept.

    Rows of an id with texts of different groups are chosen apart; of one group's rows
    with that id, one with the smallest fingerprint stays, and of these the one with the
    smallest hash of all its columns, so reruns agree.
    """
    mark, whole, kept = fresh(docs.columns, "_fp", "_row", "_kept")
    plain = renumbered(docs)
    batches = _marked_batches(docs.columns.index("text"))
    marked = plain.mapInArrow(batches, StructType([*plain.schema.fields, StructField("_fp", LongType())])).toDF(*docs.columns, mark)
    marked = written(marked.withColumn(whole, F.xxhash64(F.to_json(F.struct(*map(quoted, docs.columns)), {"ignoreNullFields": "false"}))), "marked")
    groups = _grouped(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("fp"), F.col(whole).alias("row")))
    first = groups.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "fp", "row")).alias("first"))
    first = first.select(F.col("first.doc_id").alias(kept), F.col("first.fp").alias(mark), F.col("first.row").alias(whole))
    known = marked.where("doc_id is not null").withColumn(kept, F.col("doc_id").cast("long")).join(first, [kept, mark, whole], "left_semi")
    return known.dropDuplicates([kept, mark, whole]).unionByName(marked.where("doc_id is null").withColumn(kept, F.lit(None).cast("long"))).select(*map(quoted, docs.columns))
