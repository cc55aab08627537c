"""Tables kept between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import time
import uuid
from typing import BinaryIO
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set a fresh temporary folder is made and remembered, but only if
    the executors are threads of this process, as in local tests.
    """
    context = spark.sparkContext
    name = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not name:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """A shared path as the operating system names it; for sources and sinks that work on mounted folders."""
    if re.match(r"(?!file:)[a-zA-Z][\w+.-]*:", path):
        raise ValueError(f"{path} is not on a mounted file system")
    return re.sub(r"^file:(//(?=/))?", "", path)


class Staging:
    """A folder beside a target for what attempts write until the job commits.

    The driver makes it and removes it.  Attempts hold their folder open and create files below that handle,
    so one that still runs when the folder is gone fails instead of making it anew.
    """

    def __init__(self, target: str) -> None:
        self.path = f"{target}.staged-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        os.mkdir(self.path)

    def attempt(self) -> tuple[str, int]:
        """A new attempt's folder and its handle."""
        folder = os.path.join(self.path, uuid.uuid4().hex)
        os.mkdir(folder)
        return folder, os.open(folder, os.O_RDONLY | os.O_DIRECTORY)

    def remove(self) -> None:
        """Also while attempts that are being stopped still write to it."""
        for _ in range(200):
            shutil.rmtree(self.path, ignore_errors=True)
            if not os.path.lexists(self.path):
                return
            time.sleep(0.05)


def created(handle: int, place: str) -> BinaryIO:
    """A new file at a relative path below a folder's handle, with the folders in between."""
    folders = place.split(os.sep)[:-1]
    for k in range(len(folders)):
        try:
            os.mkdir(os.sep.join(folders[: k + 1]), dir_fd=handle)
        except FileExistsError:
            pass
    return os.fdopen(os.open(place, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o666, dir_fd=handle), "wb")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), page_rows: int = 20_000) -> DataFrame:
    """``df`` written once to the shared folder and read back: lost executors cost no more than a reread.

    Rows that are few and long, and looked up by an order, want fewer of them in a page.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).option("parquet.page.row.count.limit", page_rows).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
