"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Where the tables made by :func:`written` lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def renumbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns' places as names, ``_0, _1, ...``: Python stages take no names with dots or back-ticks."""
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))])


def bitmap(numbers: DataFrame, count: int, most: int = 27) -> np.ndarray:
    """Bytes with a bit for each row of ``numbers (number)``, modulo their number of bits: 64 a row, ``2**most`` (16 MB) at most.

    Fewer bits for many rows let through more that are not among them, and never hold one back.
    """
    bits = 1 << min(most, max(18, (64 * count).bit_length()))
    place = numbers.select((F.pmod("number", F.lit(bits)) + 1).alias("bit"))
    parts = place.groupBy(F.expr("bitmap_bucket_number(bit)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bytes")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for part in parts:
        whole = np.frombuffer(part["bytes"], np.uint8)
        out[(part["part"] - 1) * len(whole) :][: len(whole)] = whole
    return out


def in_bitmap(numbers: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which 64-bit numbers may be among a bitmap's."""
    at = numbers.view(np.uint64) & np.uint64(len(held) * 8 - 1)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to differ from the ``taken`` ones."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``, or as the context's checkpoint
    folder.  Where neither is set a fresh temporary folder is made and remembered,
    but only if the executors are threads of this process, as in local tests.
    """
    context = spark.sparkContext
    name = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not name:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut off from its lineage: written once to the shared folder and read back.

    The files outlive lost executors, and a retried task reads the same rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    return back


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
