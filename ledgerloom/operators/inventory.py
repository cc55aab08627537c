"""Inventories of content: one record per path, and the snapshot's fingerprint."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.paths import STATE_DIR, allowed_path, is_text, language
from ledgerloom.functions.text import line_count, sha256_hex, slashes
from ledgerloom.sources import tree
from ledgerloom.sources.shared import stored


def inventory(contents: DataFrame, path: Column, content: Column) -> DataFrame:
    """``path, size, sha256, language, line_count`` of texts held in a table."""
    raw = content.cast("binary")
    return contents.select(path.alias("path"), F.octet_length(raw).cast("long").alias("size"), sha256_hex(raw).alias("sha256"),
                           language(path).alias("language"), line_count(content.cast("string")).alias("line_count"))


def filtered_inventory(files: DataFrame, state_dir: str = STATE_DIR) -> DataFrame:
    """The inventory of listed ``files (path, content)``: one row per allowed path that holds text."""
    rows = files.withColumn("path", slashes(F.col("path"))).where(allowed_path(F.col("path"), state_dir)).where(is_text(F.col("content")))
    listed = inventory(rows, F.col("path"), F.col("content"))
    # Of a path's rows the one with the smallest digest; contents are hashed where they are read and never shuffled.
    rest = [c for c in listed.columns if c != "path"]
    return listed.groupBy("path").agg(F.min(F.struct("sha256", *[c for c in rest if c != "sha256"])).alias("one")).select("path", *[F.col(f"one.{c}") for c in rest])


def tree_inventory(spark: SparkSession, root: str, mode: str = "auto", content: bool = False, state_dir: str = STATE_DIR) -> DataFrame:
    """The inventory of a source tree, read by the ``tree`` source; filters on path and language keep files from being opened."""
    tree.register(spark)
    columns = ["path", "size", "sha256", "language", "line_count", *(["content"] if content else [])]
    asked = spark.read.format("tree").option("mode", mode).option("state_dir", state_dir).option("tasks", str(2 * spark.sparkContext.defaultParallelism))
    return asked.schema(", ".join(f"{c} {tree.COLUMNS[c]}" for c in columns)).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Files ``(path, content)``, or documents ``(path, json)`` as YAML, written below the root by the executors."""
    tree.register(files.sparkSession)
    files.write.format("tree").mode("append").save(root)


#: Bytes of records in one row of a sorted run.
_RUN = 8192


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a sorted range, some thousand bytes a row."""
    part, at, held = TaskContext.get().partitionId(), 0, bytearray()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "records": pa.array([bytes(held)], pa.binary())})

    for batch in batches:
        for path, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held += f"{path}\0{digest}\n".encode()
            if len(held) >= _RUN:
                yield row()
                at, held = at + 1, bytearray()
    if held:
        yield row()


def fingerprint(files: DataFrame) -> DataFrame:
    """One row ``source_hash``: SHA-256 over ``path NUL sha256 LF`` records in order of path.

    The paths are sorted in ranges, each by a task of its own, and written as runs of records.  The
    fold is one task by definition; it takes the runs in order, a row for some
    hundred files, and hashes them as they come.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = hashlib.sha256()
        for batch in batches:
            for records in batch.column("records"):
                total.update(records.as_buffer())
        yield pa.RecordBatch.from_pydict({"source_hash": [total.hexdigest()]})

    ranges = files.select("path", "sha256").repartitionByRange("path", "sha256").sortWithinPartitions("path", "sha256")
    runs = stored(ranges.mapInArrow(_runs, "part int, at long, records binary"), "runs")
    ordered = runs.repartition(1).sortWithinPartitions("part", "at").select("records")
    return ordered.mapInArrow(fold, "source_hash string").agg(F.coalesce(F.max("source_hash"), F.lit(hashlib.sha256().hexdigest())).alias("source_hash"))


def snapshot(files: DataFrame) -> DataFrame:
    """One row ``source_hash, files``: the snapshot as one document, whose list of files is one value."""
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "size", "sha256", "language"))).alias("files"))
    return fingerprint(files).crossJoin(listed)  # one row each


def snapshot_rows(files: DataFrame) -> DataFrame:
    """The snapshot as rows ``source_hash, path, size, sha256, language``, however many files it has."""
    return files.select("path", "size", "sha256", "language").crossJoin(F.broadcast(fingerprint(files))).select("source_hash", "path", "size", "sha256", "language")  # one row


def by_path(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def python_files(files: DataFrame) -> DataFrame:
    """Python sources, in order of path."""
    return files.where(F.endswith("path", F.lit(".py"))).orderBy("path")


def ignore_warnings(lines: DataFrame, watched: tuple[str, ...], text: str = "content") -> DataFrame:
    """``line, entry`` of ignore-file lines that name a watched path; comments and blank lines do not."""
    from ledgerloom.functions.text import split_lines, strip, trim_slashes

    rows = lines.select(F.posexplode(split_lines(F.col(text))).alias("at", "raw")).select((F.col("at") + 1).alias("line"), strip(F.col("raw")).alias("entry"))
    return rows.where((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")) & trim_slashes(F.col("entry")).isin(*watched))
