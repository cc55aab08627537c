"""Make this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Functions that run in Python workers are sent by name, so workers import them;
    executors need not share a folder or a search path with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    name = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_package.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)
