"""Jaccard join of word n-grams by T-occurrence search (DivideSkip).

Sets
    A document's set is its distinct 4-word shingles (with fewer words, the whole
    sequence is the one shingle), each named by 64 bits that mix its words' XXH64.
    Documents of one set are one *class*, named by 64 bits of the set's SHA-256, and
    are searched once.  Names are not compared beyond these bits: of a billion
    different sets two share a name with a chance of some hundredths, and two
    documents' shingles with one below a billionth.

Search
    Sets of n and m shingles link when their overlap is at least
    T = ceil(r (n + m) / (1 + r)), r being the least similarity, so at least ceil(r n).
    Within a block, inverted lists hold the sets of each shingle in order of size.
    A query sets aside its L longest lists (DivideSkip's rule), merges the short ones
    with a heap that skips what cannot be in T - L of them, probes the long ones for
    what is left by binary search, and keeps what reaches T.

Blocks
    If each set's shingles are put in one order, two linked sets share k of their first
    n - ceil(r n) + k.  The order is by name, but shingles that very many documents have come
    last (Misra-Gries summaries of all documents find them; the order never changes what
    is found), and k is one in twenty.  Of the sets that have a shingle among
    their first ones, those of near sizes make a block named by its smallest set, so that the shingles of one
    family of near copies make few blocks.  Sets that share less than k with all others together
    have no partner.  Each set also leaves the blocks that it shares least with, for less than half of
    its k in all: a pair keeps a block, and chance meetings end here.  A block
    of over ``BLOCK_TOKENS`` shingles is cut into parts that meet two by two.  A pair is
    counted in the smallest block that both its sets are in.  What leaves a block is a count of links per
    set and a spanning forest, never pairs.

Edge cases
    * null or empty text, or white space only: an empty set, linked with nothing; its
      component is its own id;
    * null ids: rows get their component's id; a component of null ids only has none;
    * repeated rows, and rows of one id with several texts, are documents of their own;
    * very long texts: sets are compared whole; extra columns are ignored, whatever their names;
    * an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.common import bitmap, in_bitmap, removed, written
from ledgerloom.llm.components import components

SHINGLE = 4
#: Least similarity in hundredths.
LEAST = 85
#: Of every so many shingles of a set, one is what it must share among its first ones.
EXTRA = 20
#: Shingles that one task holds as a block; more are cut into parts.
BLOCK_TOKENS = 2_000_000
#: Shingles counted per task, and held to be common: those of one in ``COMMON_SHARE`` documents.
COUNTED, COMMON_SHARE = 65_536, 200
#: Ids up to which short lists are merged by a heap in Python; more are merged by one sort of the runs.
HEAPED = 4_096
#: Texts in one batch to Python.
TEXTS = 500
#: DivideSkip's constant: L = T / (MU log2(longest) + 1).
MU = 0.0085

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted names of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    wide = min(shingle, len(words))
    if not wide:
        return hashes
    out = np.full(len(words) - wide + 1, wide, np.uint64)
    for k in range(wide):
        out = _mixed(out * _ODD + hashes[k : k + len(out)])
    return np.unique(out)


def least_overlap(n: int, least: int = LEAST) -> int:
    """What a set of n shingles shares with any partner."""
    return -(-least * n // 100)


def least_pair_overlap(n: np.ndarray | int, m: np.ndarray | int, least: int = LEAST) -> np.ndarray | int:
    """What sets of n and m shingles share if they link."""
    return -(-least * (n + m) // (100 + least))


def least_shared(n: int, least: int = LEAST) -> int:
    """k: what linked sets of n or more shingles share among their first n - ceil(r n) + k."""
    return max(1, min(least_overlap(n, least), n // EXTRA))


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are in at least ``least`` of the sorted lists, and in how many."""
    if sum(map(len, lists)) > HEAPED:
        run = np.sort(np.concatenate(lists), kind="stable")  # merges the sorted runs
        at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        counts = np.diff(np.append(at, len(run)))
        return run[at[counts >= least]], counts[counts >= least]
    plain = [x.tolist() for x in lists]
    heap = [(x[0], k, 0) for k, x in enumerate(plain) if x]
    heapq.heapify(heap)
    ids, counts = [], []
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            ids.append(top)
            counts.append(len(popped))
            wanted = top + 1
        else:
            # Ids below the one that `least` lists can still reach are skipped.
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            wanted = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(plain[k], wanted, at)
            if at < len(plain[k]):
                heapq.heappush(heap, (plain[k][at], k, at))
    return np.array(ids, np.int64), np.array(counts, np.int64)


def reaching(lists: list[np.ndarray], needed: Callable[[np.ndarray], np.ndarray], least: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip: ids whose number of lists is at least ``needed(ids)``, which is at least ``least``; and that number."""
    lists = sorted(lists, key=len)
    longest = max(map(len, lists), default=0)
    none = np.zeros(0, np.int64)
    if len(lists) < least or not longest:
        return none, none
    aside = min(least - 1, int(least / (MU * math.log2(longest) + 1)))
    ids, counts = merged(lists[: len(lists) - aside], least - aside)
    if allowed is not None:
        ids, counts = ids[allowed[ids]], counts[allowed[ids]]
    wanted = needed(ids)
    for left, long in zip(range(aside, 0, -1), lists[len(lists) - aside :], strict=True):
        open_ = counts + left >= wanted
        if not open_.all():
            ids, counts, wanted = ids[open_], counts[open_], wanted[open_]
        if not len(ids):
            return none, none
        at = np.minimum(np.searchsorted(long, ids), len(long) - 1)
        counts = counts + (long[at] == ids)
    found = counts >= wanted
    return ids[found], counts[found]


def links(sets: list[np.ndarray], least: int = LEAST, allowed: Callable[[int], np.ndarray | None] = lambda _: None) -> Iterator[tuple[int, np.ndarray]]:
    """``(query, its smaller partners)`` for sets in order of size; ``allowed(query)`` masks the others, if it masks any."""
    sizes = np.array([len(s) for s in sets], np.int64)
    offsets = np.append(0, np.cumsum(sizes))
    flat = np.concatenate(sets)
    by = np.argsort(flat, kind="stable")
    posts = np.repeat(np.arange(len(sets)), sizes)[by]
    ordered = flat[by]
    first = np.append(True, ordered[1:] != ordered[:-1])
    begins = np.flatnonzero(first)[np.cumsum(first) - 1]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    for q in range(1, len(sets)):
        n = int(sizes[q])
        need, low = least_overlap(n, least), int(np.searchsorted(sizes, least_overlap(n, least)))
        at = place[offsets[q] : offsets[q + 1]]  # where the query stands in its lists; smaller sets are before it
        at = at[(begins[at] < at) & (posts[at - 1] >= low)]
        if len(at) < need:
            continue
        mask = allowed(q)
        if mask is not None and not mask[low:q].any():
            continue
        lists = [posts[b:e] for b, e in zip(begins[at].tolist(), at.tolist(), strict=True)]
        ids, _ = reaching(lists, lambda ids, n=n: np.where(ids >= low, least_pair_overlap(n, sizes[ids], least), len(sets) + n), need, mask)
        if len(ids):
            yield q, ids


@contextmanager
def _few_texts(spark: SparkSession) -> Iterator[None]:
    """Within, a batch that goes to Python holds ``TEXTS`` rows: it is held several times, here and there, and texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(TEXTS, int(before)) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _common_counts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Misra-Gries: of all but a share of 1 in ``COUNTED`` the counts are short by that share at most."""
        keys, counts, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            every, where = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([counts, np.ones(size, np.int64)])).astype(np.int64)
            if len(every) > COUNTED:
                sums = sums - np.partition(sums, -COUNTED - 1)[-COUNTED - 1]
            return every[sums > 0], sums[sums > 0]

        for batch in batches:
            for text in batch.column("text"):
                tokens = token_set(text.as_py(), shingle)
                held.append(tokens)
                size += len(tokens)
                if size > 1 << 20:
                    keys, counts = folded()
                    held, size = [], 0
        keys, counts = folded()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["token", "count"])

    return run


def common_tokens(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """The shingles that come last in every set's order, at most ``COUNTED`` of them, sorted."""
    counted = texts.select("text").mapInArrow(_common_counts(shingle), "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    often = max(16, texts.count() // COMMON_SHARE)
    rows = counted.where(F.col("count") >= often).orderBy(F.desc("count"), "token").limit(COUNTED).collect()
    return np.sort(np.array([r["token"] for r in rows], np.int64).view(np.uint64))


def _name(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.sha256(tokens.tobytes()).digest()[:8], "little", signed=True)


def _sets(shingle: int, least: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, needs, names, rare, often = [], [], [], [], []
            for text in batch.column("text"):
                tokens = token_set(text.as_py(), shingle)
                n = len(tokens)
                sizes.append(n)
                names.append(_name(tokens) if n else None)
                # A partner may be smaller, and its first ones are fewer.
                needs.append(least_shared(least_overlap(n, least), least))
                first = n - least_overlap(n, least) + least_shared(n, least) if n else 0
                last = np.isin(tokens, common, assume_unique=True)
                kept = tokens[~last][:first]
                rare.append(kept.view(np.int64))
                often.append(tokens[last][: first - len(kept)].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(needs, pa.int64()), pa.array(names, pa.int64()),
                                              pa.array(rare, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))], ["doc_id", "row", "n", "need", "class", "rare", "common"])

    return run


def _members(sets: DataFrame, least: int) -> DataFrame:
    """``class, block, shared``: in which blocks a class is, and by how many of its first shingles."""
    single = sets.where("class is not null").select("class", "n", "rare", "common").dropDuplicates(["class"])
    rare = single.select("class", "n", F.explode("rare").alias("token"))
    by_size = Window.partitionBy("token").orderBy("n", "class")
    # Sets of a shingle make chains in which each is near its neighbour's size; a block is a chain.
    near = F.coalesce(100 * F.lag("n").over(by_size) >= least * F.col("n"), F.lit(False))
    followed = F.coalesce(100 * F.col("n") >= least * F.lead("n").over(by_size), F.lit(False))
    chained = rare.select("class", "token", "n", near.alias("near"), followed.alias("followed"))
    first = F.last(F.when(~F.col("near"), F.col("class")), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rare = chained.withColumn("block", first).where("near or followed").select("class", "block")
    # Of the few common shingles, sets of the same class of size, or the next, make a block; a set is in two.
    size = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / least)))
    common = single.select("class", F.array(size, size + 1).alias("sizes"), F.explode("common").alias("token")).select("class", "token", F.explode("sizes").alias("size"))
    ends = common.groupBy("token", "size").agg(F.min("class").alias("block"), F.max("class").alias("most")).where("block < most").select("token", "size", "block")
    common = common.join(ends, ["token", "size"]).select("class", "block")
    return rare.unionByName(common).groupBy("class", "block").agg(F.count("*").alias("shared"))


def _in_blocks(sets: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``classes`` that may have partners, with their ``blocks``."""
    own = Window.partitionBy("class")  # no more than the class has first shingles
    members = _members(sets, least).withColumn("all", F.sum("shared").over(own)).withColumn("left", F.sum("shared").over(own.orderBy("shared", "block")))
    members = members.join(classes.select("class", "need"), "class").where("all >= need and left > (need - 1) div 2").select("class", "block")
    members = written(members, "members")
    several = members.groupBy("block").count().where("count > 1").select("block")
    blocks = members.join(several, "block").groupBy("class").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    alive = written(blocks.join(classes.select("class", "row", "n", "copies"), "class"), "alive")
    removed(members)
    return alive


def _picked(shingle: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.flatnonzero(in_bitmap(batch.column("row").to_numpy(), wanted))
            sets = [token_set(t.as_py(), shingle) for t in batch.column("text").take(pa.array(keep))]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "tokens"])

    return run


def _block_links(least: int):
    def run(group: pa.Table) -> pa.Table:
        block, one, other = (group.column(c)[0].as_py() for c in ("block", "one", "other"))
        names, copies, parts = (group.column(c).to_numpy() for c in ("class", "copies", "part"))
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in group.column("tokens").combine_chunks()]
        order = np.lexsort((names, [len(s) for s in sets]))
        names, copies, parts, sets = names[order], copies[order], parts[order], [sets[k] for k in order]
        # Members of each smaller block: pairs of them are counted there.
        elsewhere: dict[int, list[int]] = {}
        smaller = []
        for at, blocks in enumerate(group.column("blocks").take(pa.array(order)).to_pylist()):
            smaller.append([b for b in blocks if b < block])
            for b in smaller[-1]:
                elsewhere.setdefault(b, []).append(at)
        met = {b: np.array(members) for b, members in elsewhere.items()}

        def allowed(q: int) -> np.ndarray | None:
            if not smaller[q] and one == other:
                return None
            mask = np.ones(len(sets), bool) if one == other else parts != parts[q]
            for b in smaller[q]:
                mask[met[b]] = False
            return mask

        found, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
        for q, ids in links(sets, least, allowed):
            found[q] += copies[ids].sum()
            found[ids] += copies[q]
            roots = np.unique(label[np.append(ids, q)])
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
        kept = np.flatnonzero(found)
        return pa.table({"class": names[kept], "links": found[kept], "up": names[label[kept]]})

    return run


def _dealt(alive: DataFrame) -> DataFrame:
    """``alive`` classes once per block, and per pair of parts where a block is large."""
    each = alive.select("*", F.explode("blocks").alias("block"))
    large = each.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts")).where("parts > 1")
    each = each.join(large, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    each = each.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return each.select("block", F.least("part", "to").alias("one"), F.greatest("part", "to").alias("other"), "part", "class", "copies", "blocks")


def class_links(docs: DataFrame, sets: DataFrame, classes: DataFrame, shingle: int, least: int) -> DataFrame:
    """``class, links, up``: links found in a block per class, and the class it hangs on there."""
    alive = _in_blocks(sets, classes, least)
    wanted = bitmap(alive.select(F.col("row").alias("number")), alive.count())
    whole = docs.select("row", "text").mapInArrow(_picked(shingle, wanted), "class long, tokens binary").groupBy("class").agg(F.first("tokens").alias("tokens"))
    found = written(_dealt(alive).join(whole, "class").groupBy("block", "one", "other").applyInArrow(_block_links(least), "class long, links long, up long"), "links")
    removed(alive)
    return found


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row: the set's size, the smallest id that links lead to, the rows linked with."""
    texts = docs.select(_quoted(id_col).cast("long").alias("doc_id"), _quoted(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    schema = "doc_id long, row long, n long, need long, class long, rare array<long>, common array<long>"
    with _few_texts(docs.sparkSession):
        common = common_tokens(texts, shingle)
        sets = written(texts.select("doc_id", "row", "text").mapInArrow(_sets(shingle, least, common), schema), "sets")
    classes = written(sets.where("class is not null").groupBy("class").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("need").alias("need")), "classes")
    with _few_texts(docs.sparkSession):
        found = class_links(texts, sets, classes, shingle, least)
    hung = written(components(found.select(F.col("class").alias("u"), F.col("up").alias("v"))), "roots")
    rooted = classes.select("class", "first", "copies").join(hung, F.col("class") == F.col("node"), "left").select("class", "first", "copies", F.coalesce("root", "class").alias("root"))
    rooted = rooted.join(found.groupBy("class").agg(F.sum("links").alias("links")), "class", "left")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Written, so that the join by a hot class has two plain sides and can be split.
    named = written(rooted.join(ids, "root").select("class", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    removed(classes, found, hung)
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.select("doc_id", "n", "class").join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
