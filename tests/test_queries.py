from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ledgerloom.plans import queries, sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return int(value) if hasattr(value, "__index__") and not isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    wanted = duck.execute(sql.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    rows = sorted(repr([plain(r[c]) for c in order]) for r in found.collect())
    assert rows == sorted(repr([plain(dict(zip(columns, r))[c]) for c in order]) for r in wanted.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(sql.ORACLE_SQL)


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'inventory_documents' in q and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("line", ["import not_there_at_all", "import ledgerloom.not_there", "from ledgerloom.llm import not_there"])
def test_a_broken_import_inside_the_optional_subpackage_is_raised(tmp_path, line):
    shutil.copytree(ROOT / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "ledgerloom" / "llm").mkdir()
    (tmp_path / "ledgerloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "ledgerloom" / "llm" / "queries.py").write_text(line + "\nQUERIES = {}\nORACLE_SQL = {}\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "not_there" in done.stderr
