"""Merkle manifest of a table: leaves per row, a tree per language, a tree of languages, proofs.

Tree
    A leaf is the SHA-256 of a row's fields, a field being ``-`` if it is null, else its
    UTF-8 length, a colon and its value.  A language's leaves ascend by id.  While more
    than one node remains, each run of eight neighbours (the last may be shorter) becomes
    the SHA-256 of their hex digests.  The languages' roots, ordered by language, are
    the leaves of the outer tree.

Blocks
    A leaf's place among its language's comes from one range-partitioned sort and the
    partitions' counts.  Places are cut into aligned blocks of ``8**DEPTH``, so a block
    is a whole subtree.  Each block is an Arrow table that DuckDB folds inside its
    executor: one ordered ``string_agg`` and ``sha256`` query per level.  Spark combines
    the block roots level by level, in tables of an eighth each, then hands proofs down the
    same tables: every node has one parent and at most eight children, so no join has
    a hot key.  At last the blocks run once more with their outer proof, and each row's
    leaf is folded up to the root; siblings are never stored per row.

Edge cases
    * null ids come first and are not tampered with; a null language is a language of
      its own, before the empty one;
    * rows of one id ascend by leaf; repeated rows are leaves each;
    * a language of one row has that leaf as its root; one language has its root as the
      root, and a table of one row an empty proof, whose hash is that of the empty text;
    * null or empty text: ``-`` or ``0:``; very long texts are hashed where they are read;
    * extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import removed, written

FAN_OUT = 8
#: Levels of the tree that one block folds: 4,096 leaves.
DEPTH = 4
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, changed``: each row's leaf, and the leaf of the row as it is after tampering.

    Tampered rows, whose id's CRC-32 is divisible by three, have the text's A-Z in lower case.
    """
    rows = docs.select(*[_column(c).alias(c) for c in FIELDS]).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = [F.col(c) for c in FIELDS]
    touched = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", CAPITALS, CAPITALS.lower())).otherwise(F.col("text"))
    return rows.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(own).alias("leaf"), leaf([*own[:-1], touched]).alias("changed"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place``, the place from 0 in the row's group, and ``n``, the group's rows; and the table to remove.

    Rows are dealt by ranges of group and order, so a large group spans many tasks; a window
    sees a row per task and group.  ``rows`` must be a stored table; rows equal in ``order`` are
    told apart by where they lie, which lets them be split and cannot change what equal rows yield.
    """
    marked = rows.withColumn("_lies", F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_lies")]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_lies")
    # A sorted partition's rows have consecutive numbers, the partition's own in the high bits.
    kept = written(dealt.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = kept.groupBy(F.col(group).alias("_group"), F.shiftright("_row", 33).alias("_part")).agg(F.min("_row").alias("_least"), F.count("*").alias("_rows"))
    window = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_group", "_part", "_least", before.alias("_before"), F.sum("_rows").over(window).alias("n"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.shiftright("_row", 33) == F.col("_part"))
    placed = kept.join(parts, same).withColumn("place", F.col("_row") - F.col("_least") + F.col("_before"))
    return placed.drop("_row", "_group", "_part", "_least", "_before"), kept


_FOLD = f"select place // {FAN_OUT} as place, sha256(string_agg(h, '' order by place)) as h, string_agg(h, '' order by place) as run from level{{}} group by 1"
_SIDES = f"left(run, {_HEX} * (d.place % {FAN_OUT})::int)", f"substr(run, {_HEX} * (d.place % {FAN_OUT} + 1)::int + 1)"
_CLIMB = f"""select doc, d.place // {FAN_OUT} as place, sha256({_SIDES[0]} || cur || {_SIDES[1]}) as cur, sib || {_SIDES[0]} || {_SIDES[1]} as sib
from climb{{0}} d join level{{1}} r on r.place = d.place // {FAN_OUT}"""


def _levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def _folded(db: duckdb.DuckDBPyConnection, block: pa.Table, depth: int) -> int:
    """Tables ``level0``, ``level1``, ... of a block's nodes up to its root; how many levels there are above the leaves."""
    db.execute("set threads = 1")
    db.register("block", block.append_column("doc", pa.array(range(block.num_rows), pa.int64())))
    levels = min(depth, _levels(block.column("n")[0].as_py()))
    db.execute(f"create temp table level0 as select place % {FAN_OUT**depth} as place, leaf as h from block")
    for k in range(levels):
        db.execute(f"create temp table level{k + 1} as {_FOLD.format(k)}")
    return levels


def _block_root(depth: int):
    def run(block: pa.Table) -> pa.Table:
        with duckdb.connect() as db:
            levels = _folded(db, block, depth)
            (root,) = db.execute(f"select h from level{levels}").fetchone()
        n = -(-block.column("n")[0].as_py() // FAN_OUT**levels)
        first = block.slice(0, 1)
        return pa.table([first.column("lang"), first.column("block"), pa.array([n], pa.int64()), pa.array([root])], ["lang", "place", "n", "h"])

    return run


def _block_proofs(depth: int):
    def run(block: pa.Table) -> pa.Table:
        with duckdb.connect() as db:
            levels = _folded(db, block, depth)
            db.execute(f"create temp table climb0 as select doc, place % {FAN_OUT**depth} as place, changed as cur, '' as sib from block")
            db.execute("create temp table named as select doc, doc_id, leaf, subroot, root from block")
            for k in range(levels):
                db.execute(f"create temp table climb{k + 1} as {_CLIMB.format(k, k + 1)}")
            for k, step in enumerate(block.column("proof")[0].as_py(), levels):
                db.execute(f"create temp table climb{k + 1} as select doc, sha256($1 || cur || $2) as cur, sib || $1 || $2 as sib from climb{k}", [step["before"], step["after"]])
                levels = k + 1
            return db.sql(f"""select doc_id, leaf, subroot, root, sha256(sib) as proof_sha256, cur as folded_root, cur = root as verified
                from climb{levels} join named using (doc)""").to_arrow_table()

    return run


def _risen(nodes: DataFrame) -> list[DataFrame]:
    """``nodes (lang, place, n, h)`` and the tables above them: per language ever fewer nodes, until each has one.

    ``n`` counts the level's nodes of the language; a run has at most eight, so it is gathered safely.
    """
    tables = [nodes]
    while not tables[-1].where("n > 1").isEmpty():
        below = tables[-1].where("n > 1")
        runs = below.groupBy("lang", F.expr(f"place div {FAN_OUT}").alias("place"), F.expr(f"(n + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "")
        tables.append(written(runs.agg(joined.alias("run")).withColumn("h", F.sha2("run", 256)), "level"))
    return tables


def _handed_down(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """``lang, place, proof`` and what ``top (lang, proof, ...)`` carries, for the nodes of the lowest table.

    A proof lists the siblings ``(before, after)`` from a node's level to the root.
    """
    carried = [c for c in top.columns if c not in ("lang", "proof")]
    # A language's top node is the one whose level has a single node.
    roots = [t.where("n = 1").select("lang", "place") for t in tables]
    proofs = None
    for level in range(len(tables) - 1, -1, -1):
        here = roots[level].alias("a").join(top.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.lang", "a.place", "proof", *carried)
        if proofs is not None:
            above, up = proofs.alias("p"), tables[level + 1].alias("t")
            same = F.col("c.lang").eqNullSafe(F.col("p.lang")) & (F.expr(f"c.place div {FAN_OUT}") == F.col("p.place"))
            run = up.select("lang", "place", "run").alias("t")
            met = above.join(run, F.col("p.lang").eqNullSafe(F.col("t.lang")) & (F.col("p.place") == F.col("t.place"))).select("p.*", "t.run").alias("p")
            own = F.struct(F.expr(f"substring(p.run, 1, {_HEX} * int(c.place % {FAN_OUT}))").alias("before"), F.expr(f"substring(p.run, {_HEX} * int(c.place % {FAN_OUT} + 1) + 1)").alias("after"))
            down = tables[level].where("n > 1").alias("c").join(met, same).select("c.lang", "c.place", F.concat(F.array(own), F.col("p.proof")).alias("proof"), *[F.col(f"p.{c}") for c in carried])
            here = down.unionByName(here)
        proofs = written(here, "proofs") if level else here
    return proofs


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``."""
    stored = written(leaves(docs), "leaves")
    if stored.isEmpty():
        none = ", ".join(f"{c} {kind}" for c, kind in (("doc_id", "long"), *((c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", "boolean")))
        return docs.sparkSession.createDataFrame([], none)
    placed, kept = numbered(stored, "lang", ["doc_id", "leaf"])
    blocks = written(placed.withColumn("block", F.expr(f"place div {FAN_OUT**depth}")), "placed")
    removed(stored, kept)
    # The columns that fold alone travel to the first pass.
    roots = blocks.select("lang", "block", "place", "n", "leaf").groupBy("lang", "block").applyInArrow(_block_root(depth), "lang string, place long, n long, h string")
    inner = _risen(written(roots, "roots"))
    subroots = None
    for table in inner:
        top = table.where("n = 1").select("lang", "h")
        subroots = top if subroots is None else subroots.unionByName(top)
    named = written(subroots.withColumn("all", F.lit("")), "subroots")
    outer_leaves, ordered = numbered(named, "all", ["lang"])
    langs = written(outer_leaves.select(F.col("all").alias("lang"), "place", "n", "h", F.col("lang").alias("name")), "langs")
    outer = _risen(langs.select("lang", "place", "n", "h"))
    root = outer[-1].select("lang", F.array().cast("array<struct<before:string,after:string>>").alias("proof"), F.col("h").alias("root"))
    proofs = _handed_down(outer, root).alias("p").join(langs.alias("l"), F.col("p.place") == F.col("l.place"))
    top = written(proofs.select(F.col("l.name").alias("lang"), "p.proof", F.col("l.h").alias("subroot"), "p.root"), "tops")
    known = written(_handed_down(inner, top), "outer")
    met = blocks.alias("b").join(known.alias("k"), F.col("b.lang").eqNullSafe(F.col("k.lang")) & (F.col("b.block") == F.col("k.place")))
    wide = met.select("b.lang", "b.block", "b.doc_id", "b.place", "b.n", "b.leaf", "b.changed", "k.subroot", "k.root", "k.proof")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return wide.groupBy("lang", "block").applyInArrow(_block_proofs(depth), schema)
