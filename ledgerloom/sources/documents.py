"""Catalog documents: YAML or JSON files as JSON text, one row each.

Folders are read by Spark and written through Hadoop's file systems, so a catalog
may lie wherever Spark reads and writes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.text import basename
from ledgerloom.schemas import Tags
from ledgerloom.sources.members import read_members

_DOCUMENT = "path string, json string, error string"


def to_json_text(name: str, content: bytes) -> tuple[str | None, str | None]:
    """``(json, error)`` of one document; the suffix ``.json`` selects JSON, all else is YAML."""
    try:
        if name.endswith(".json"):
            value = json.loads(content)
        else:
            import yaml

            value = yaml.safe_load(content.decode("utf-8"))
        return json.dumps(value, ensure_ascii=False, default=str), None
    except Exception as error:  # a bad document is a row with an error, not a failed job
        return None, f"{type(error).__name__}: {error}"


def parse_documents(files: DataFrame) -> DataFrame:
    """``path, json, error`` from ``files (path, content)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [to_json_text(p.as_py(), c.as_py()) for p, c in zip(batch.column("path"), batch.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([j for j, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["path", "json", "error"])

    return files.select("path", "content").mapInArrow(run, _DOCUMENT)


class _Place:
    """A path and the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = self.hadoop.Path(path)
        self.files = self.path.getFileSystem(self.conf)

    def holds_file(self) -> bool:
        return self.files.exists(self.path) and self.files.getFileStatus(self.path).isFile()

    def holds_folder(self) -> bool:
        return self.files.exists(self.path) and self.files.getFileStatus(self.path).isDirectory()

    def replace(self, content: bytes) -> None:
        """Readers see the old file or the whole new one: a new file is written beside it and renamed onto it."""
        beside = self.hadoop.Path(self.path.getParent(), f"_{uuid.uuid4().hex}")
        self.files.setWriteChecksum(False)
        try:
            stream = self.files.create(beside)
            stream.write(bytearray(content))
            stream.close()
            option = getattr(self.hadoop, "Options$Rename")
            self.hadoop.FileContext.getFileContext(self.files.getUri(), self.conf).rename(
                self.files.makeQualified(beside), self.files.makeQualified(self.path), self._only(option, option.OVERWRITE))
        finally:
            self.files.delete(beside, False)

    def _only(self, kind: Any, value: Any) -> Any:
        array = SparkSession.active().sparkContext._gateway.new_array(kind, 1)
        array[0] = value
        return array


def _read(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of a file, or of the documents of a folder; the path is taken literally."""
    return spark.read.format("binaryFile").option("__globPaths__", "false").load(path).select("path", "content")


def read_catalog(spark: SparkSession, root: str, tags: Tags = Tags()) -> tuple[DataFrame, DataFrame]:
    """The index document (no row if it is missing) and the workflow documents ``feature_id, json, error``."""
    folder = f"{root.rstrip('/')}/{tags.state_dir}"
    none = spark.createDataFrame([], _DOCUMENT)
    index = parse_documents(_read(spark, f"{folder}/features.yaml")) if _Place(spark, f"{folder}/features.yaml").holds_file() else none
    flows = none
    if _Place(spark, f"{folder}/workflows").holds_folder():
        flows = parse_documents(_read(spark, f"{folder}/workflows").where(F.endswith("path", F.lit(".yaml"))))
    return index.select("json", "error"), _named(flows)


def read_index(spark: SparkSession, root: str, tags: Tags = Tags()) -> DataFrame:
    """The index document as rows ``part, at, raw, error``; the root is a folder that all executors have mounted."""
    return read_members(spark, f"{root.rstrip('/')}/{tags.state_dir}/features.yaml")


def _named(documents: DataFrame) -> DataFrame:
    return documents.select(F.regexp_replace(basename(F.col("path")), r"\.yaml\z", "").alias("feature_id"), "json", "error")


def read_workflow(spark: SparkSession, root: str, feature_id: str, tags: Tags = Tags()) -> DataFrame:
    """``feature_id, json, error`` of one workflow; its file alone is read, no row if there is none."""
    path = f"{root.rstrip('/')}/{tags.workflow_path(feature_id)}"
    if not _Place(spark, path).holds_file():
        return _named(spark.createDataFrame([], _DOCUMENT))
    return _named(parse_documents(_read(spark, path)))


def write_document(path: str, value: Any) -> str:
    """Write a value as a YAML document."""
    import yaml

    _Place(SparkSession.active(), path).replace(yaml.safe_dump(value, default_flow_style=False, sort_keys=False).encode("utf-8"))
    return path


def write_if_changed(path: str, content: str) -> bool:
    """Write a text unless the file's digest says that it holds it already; whether it was written."""
    spark, data = SparkSession.active(), content.encode("utf-8")
    place = _Place(spark, path)
    if place.holds_file():
        held = _read(spark, path).select(F.sha2("content", 256)).first()
        if held and held[0] == hashlib.sha256(data).hexdigest():
            return False
    place.replace(data)
    return True
