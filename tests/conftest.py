from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from ledgerloom.shipping import ship

    ship(session)
    return session


@pytest.fixture
def source_repo(tmp_path: Path) -> Path:
    """A tree with one five-line source file."""
    root = tmp_path / "repo"
    root.mkdir()
    (root / "app.py").write_text("def start():\n    return run()\n\ndef run():\n    return 1\n")
    return root
