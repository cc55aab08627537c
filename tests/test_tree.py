from __future__ import annotations

import json
import os
import signal
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith

from ledgerloom.functions.paths import language
from ledgerloom.operators import inventory
from ledgerloom.sources import tree
from ledgerloom.sources.documents import parse_documents


def make(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"content of {name}\n")


NAMES = ["a.py", "src/b.py", "src/c.js", "src/deep/er/d.py", "src/deep/e.md", "lib/f.py", "lib/.hidden/g.py", "lib/node_modules/h.py", "docs/i.md", "docs/_j.txt"]


def rows_of(reader):
    return [r for p in reader.partitions() for r in reader.read(p)]


@pytest.fixture
def opened(monkeypatch):
    """Paths that a reader in this process opened."""
    found = Counter()
    real = tree.text_of
    monkeypatch.setattr(tree, "text_of", lambda root, path: found.update([path]) or real(root, path))
    return found


@pytest.mark.parametrize(("filters", "wanted"), [
    ([EqualTo(("language",), "python")], {"a.py", "src/b.py", "src/deep/er/d.py", "lib/f.py", "lib/.hidden/g.py"}),
    ([StringStartsWith(("path",), "src/de")], {"src/deep/er/d.py", "src/deep/e.md"}),
    ([In(("path",), ("a.py", "docs/i.md", "none"))], {"a.py", "docs/i.md"}),
    ([Not(EqualTo(("language",), "python")), StringContains(("path",), "i")], {"docs/i.md"}),
    ([StringEndsWith(("path",), ".md"), IsNotNull(("path",)), Not(StringStartsWith(("path",), "docs"))], {"src/deep/e.md"}),
])
@pytest.mark.parametrize("tasks", ["1", "3", "50"])
def test_rejected_files_are_not_opened(tmp_path, opened, filters, wanted, tasks):
    make(tmp_path, NAMES)
    reader = tree.TreeReader({"path": str(tmp_path), "mode": "walk", "tasks": tasks}, ["path", "language"])
    assert list(reader.pushFilters([*filters, more := GreaterThan(("size",), 3), null := EqualTo(("path",), None)])) == [more, null]
    assert {r[0] for r in rows_of(reader)} == wanted == set(opened) and set(opened.values()) == {1}


def test_folders_without_wanted_paths_are_not_listed(tmp_path, monkeypatch):
    make(tmp_path, NAMES)
    listed, real = [], tree._entries
    monkeypatch.setattr(tree, "_entries", lambda root, folder: listed.append(folder) or real(root, folder))
    reader = tree.TreeReader({"path": str(tmp_path), "mode": "walk"}, ["path"])
    assert not list(reader.pushFilters([StringStartsWith(("path",), "src/deep/e.")]))
    assert [r[0] for r in rows_of(reader)] == ["src/deep/e.md"] and set(listed) == {"", "src", "src/deep"}


def test_spark_hands_the_filters_over(spark, tmp_path, capfd):
    make(tmp_path, NAMES)
    found = inventory.tree_inventory(spark, str(tmp_path), "walk").where((F.col("language") == "python") & F.startswith("path", F.lit("lib/")) & (F.col("size") > 1))
    assert sorted(r["path"] for r in found.collect()) == ["lib/.hidden/g.py", "lib/f.py"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter"):].split("\n")[0]
    assert "size" in kept and "language" not in kept and "lib/" not in kept


def test_a_schema_leaves_columns_out(spark, tmp_path):
    make(tmp_path, NAMES[:2])
    tree.register(spark)
    read = lambda: spark.read.format("tree").option("mode", "walk")
    assert sorted(map(tuple, read().schema("language string, path string").load(str(tmp_path)).collect())) == [("python", "a.py"), ("python", "src/b.py")]
    assert read().load(str(tmp_path)).columns == ["path", "size", "sha256", "line_count", "mode", "language"]
    with pytest.raises(Exception, match="no column"):
        read().schema("owner string").load(str(tmp_path)).collect()


def test_language_is_that_of_the_columns(spark):
    paths = ["a.py", "a.PY", ".py", "..py", "a.", "a.tar.gz", "x/.b/c", "x.py/c", ".a.js", "é.ts", "a.py\n", "a.b\nc.py", "", "a..py", "...a.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", language(F.col("path")).alias("l")).collect()
    assert {r["path"]: r["l"] for r in rows} == {p: tree.language_of(p) for p in paths}


def test_a_large_tree_is_listed_by_tasks(tmp_path):
    made = set()
    for k in range(500):
        folder = tmp_path / f"d{k % 7}" / f"e{k % 50}" / f"f{k}"
        folder.mkdir(parents=True)
        for j in range(100):
            (folder / f"{j}.py").touch()
            made.add(f"d{k % 7}/e{k % 50}/f{k}/{j}.py")
    (tmp_path / "top.py").touch()
    reader = tree.TreeReader({"path": str(tmp_path), "mode": "walk", "tasks": "64"}, ["path"])
    parts = reader.partitions()
    assert 64 <= len(parts) < 1000 and all((tmp_path / f).is_dir() for p in parts for f, _ in p.folders)
    listed = [path for p in parts for path in reader.listing(p)]
    walked = {os.path.relpath(os.path.join(folder, f), tmp_path) for folder, _, files in os.walk(tmp_path) for f in files}
    assert len(listed) == len(set(listed)) == 50_001 and set(listed) == made | {"top.py"} == walked
    assert max(sum(1 for _ in reader.listing(p)) for p in parts) < 5_000


@pytest.mark.parametrize("tasks", ["1", "4", "40"])
def test_git_lists_by_folder(tmp_path, tasks):
    make(tmp_path, [*NAMES, "we[i]rd*/k.py", "we[i]rd*/sub/l.py", "weird/m.py", "src/ignored/n.py"])
    (tmp_path / ".gitignore").write_text("ignored/\n")
    tree._git(str(tmp_path), 30, "init", "-q")
    tree._git(str(tmp_path), 30, "add", "a.py", "src/b.py")
    reader = tree.TreeReader({"path": str(tmp_path), "mode": "git", "tasks": tasks}, ["path"])
    assert sorted(r[0] for r in rows_of(reader)) == sorted(p for p in [*NAMES, ".gitignore", "we[i]rd*/k.py", "we[i]rd*/sub/l.py", "weird/m.py"] if "node_modules" not in p)


# --- writing


def test_documents_round_trip(spark, tmp_path):
    rows = [(f"flows/{k % 3}/w{k}.yaml", json.dumps({"id": k, "text": f"é {k}\nline", "list": [1, None, {"a": True}], "odd": "- x: #"})) for k in range(50)]
    root = tmp_path / "out"
    inventory.write_tree(spark.createDataFrame(rows, "path string, json string").repartition(5), str(root))
    files = inventory.tree_inventory(spark, str(root), "walk", content=True)
    back = {r["path"]: json.loads(r["json"]) for r in parse_documents(files).collect()}
    assert back == {p: json.loads(j) for p, j in rows} and os.listdir(tmp_path) == ["out"]
    inventory.write_tree(spark.createDataFrame([("flows/0/w0.yaml", "{}")], "path string, json string"), str(root))
    assert (root / "flows/0/w0.yaml").read_text() == "{}\n" and sum(len(f) for *_, f in os.walk(root)) == 50


@pytest.mark.parametrize("how", ["raise", "kill", "bad path"])
def test_a_failed_job_leaves_no_file(spark, tmp_path, how):
    root = tmp_path / "out"
    make(root, ["old.txt"])

    def fail(batches):
        for k, batch in enumerate(batches):
            yield batch
        if how == "kill":
            os.kill(os.getpid(), signal.SIGKILL)
        if how == "raise":
            raise RuntimeError("stop")

    rows = spark.range(0, 400, 1, 4).select(F.concat(F.lit("n/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.lit("x").alias("content"))
    if how == "bad path":
        rows = rows.withColumn("path", F.when(F.col("path") == "n/399.txt", "../escape.txt").otherwise(F.col("path")))
    else:
        rows = rows.unionByName(rows.limit(1).mapInArrow(fail, rows.schema))
    with pytest.raises(Exception, match="."):
        inventory.write_tree(rows, str(root))
    assert [os.path.join(d, f) for d, _, files in os.walk(tmp_path) for f in files] == [str(root / "old.txt")] and os.listdir(tmp_path) == ["out"]


def test_only_committed_attempts_count(tmp_path):
    from pyspark.sql import Row
    from pyspark.sql.types import StringType, StructType

    schema = StructType().add("path", StringType()).add("content", StringType())
    writer = tree.TreeWriter({"path": str(tmp_path / "out")}, schema)
    writer.write(iter([Row(path="lost.txt", content="first attempt")]))
    kept = writer.write(iter([Row(path="a/kept.txt", content="second attempt")]))
    writer.commit([kept, None])
    assert [f for *_, files in os.walk(tmp_path) for f in files] == ["kept.txt"] and kept.files == 1
    other = tree.TreeWriter({"path": str(tmp_path / "out")}, schema)
    other.write(iter([Row(path="b.txt", content="x")]))
    other.abort([None])
    assert sorted(os.listdir(tmp_path / "out")) == ["a"] and os.listdir(tmp_path) == ["out"]


def test_an_attempt_that_outlives_the_job_leaves_no_file(tmp_path):
    from pyspark.sql import Row
    from pyspark.sql.types import StringType, StructType

    writer = tree.TreeWriter({"path": str(tmp_path / "out")}, StructType().add("path", StringType()).add("content", StringType()))

    def rows():
        yield Row(path="a/b.txt", content="x")
        writer.abort([])
        yield Row(path="c/d.txt", content="y")

    with pytest.raises(FileNotFoundError):
        writer.write(rows())
    with pytest.raises(FileNotFoundError):
        writer.write(iter([Row(path="e.txt", content="z")]))
    assert os.listdir(tmp_path) == []
