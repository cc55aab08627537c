from __future__ import annotations

import hashlib
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import inventory


def listed(spark, root, mode="walk"):
    return {r["path"] for r in inventory.tree_inventory(spark, str(root), mode).collect()}


def test_walk_keeps_text_and_hidden_names(spark, tmp_path):
    for name, content in {"main.py": b"x\n", "data.bin": b"a\x00b", ".catalog/features.yaml": b"a: 1", "node_modules/a.js": b"1", "pkg/__init__.py": b"",
                          ".gitignore": b"*.x\n", "pkg/_private.py": b"1\n", "bad.txt": b"\xff", "late.txt": b"x" * 8192 + b"\x00", "early.txt": b"x" * 8191 + b"\x00"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert listed(spark, tmp_path) == {"main.py", "pkg/__init__.py", ".gitignore", "pkg/_private.py", "late.txt"}


def test_git_mode_honours_ignore_rules(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, content in {".gitignore": "ignored.py\n", "tracked.py": "a\n", "new.py": "b\n", "ignored.py": "c\n"}.items():
        (tmp_path / name).write_text(content)
    subprocess.run(["git", "-C", str(tmp_path), "add", "tracked.py"], check=True)
    assert listed(spark, tmp_path, "git") == {".gitignore", "tracked.py", "new.py"}
    assert listed(spark, tmp_path, "auto") == listed(spark, tmp_path, "git")


def test_git_mode_needs_a_repository(spark, tmp_path):
    (tmp_path / "a.py").write_text("a\n")
    with pytest.raises(Exception, match="cannot be listed"):
        listed(spark, tmp_path, "git")
    assert listed(spark, tmp_path, "auto") == {"a.py"}


def test_links_out_of_the_root_are_left_out(spark, tmp_path):
    (tmp_path / "outside.txt").write_text("secret")
    root = tmp_path / "root"
    root.mkdir()
    (root / "in.txt").write_text("in\n")
    os.symlink(tmp_path / "outside.txt", root / "link.txt")
    os.symlink(root / "in.txt", root / "alias.txt")
    assert listed(spark, root) == {"in.txt", "alias.txt"}
    os.symlink(root, tmp_path / "root_link")
    assert listed(spark, tmp_path / "root_link") == {"in.txt", "alias.txt"}


def test_empty_tree(spark, tmp_path):
    files = inventory.tree_inventory(spark, str(tmp_path), "walk")
    assert files.count() == 0
    assert inventory.fingerprint(files).first()[0] == hashlib.sha256(b"").hexdigest()


def expected_hash(files):
    return hashlib.sha256(b"".join(p.encode() + b"\0" + hashlib.sha256(c).hexdigest().encode() + b"\n" for p, c in sorted(files.items()))).hexdigest()


def test_fingerprint_follows_content_and_order(spark):
    files = {"b.py": b"1", "a/ü.py": "é".encode(), "a.py": b"", "Z": b"z"}
    frame = lambda f: inventory.inventory(spark.createDataFrame(list(f.items()), "path string, c binary"), F.col("path"), F.col("c"))
    assert inventory.fingerprint(frame(files)).first()[0] == expected_hash(files)
    changed = files | {"b.py": b"2"}
    assert inventory.fingerprint(frame(changed)).first()[0] == expected_hash(changed) != expected_hash(files)
    assert [f["path"] for f in inventory.snapshot(frame(files)).first()["files"]] == sorted(files)


def test_inventory_of_a_table_dedups_paths(spark):
    rows = spark.createDataFrame([("a\\b.py", b"x\ny"), ("a/b.py", b"x\ny"), ("n.png", b"x"), ("z.md", b"\x00")], "path string, content binary")
    found = inventory.filtered_inventory(rows).collect()
    assert [(r["path"], r["size"], r["language"], r["line_count"]) for r in found] == [("a/b.py", 3, "python", 2)]


def test_ignore_warnings(spark):
    rows = spark.createDataFrame([("# .agents\n/.agents/\n.cursor\n\nsrc\n",)], "content string")
    assert [tuple(r) for r in inventory.ignore_warnings(rows, (".agents", ".cursor")).collect()] == [(2, "/.agents/"), (3, ".cursor")]


def test_a_repeated_path_is_one_row_whatever_the_order(spark):
    rows = [("a.py", b"one\n"), ("a.py", b"two\nlines\n"), ("a\\b.py", b"x"), ("a/b.py", b"x")]
    found = [sorted(map(tuple, inventory.filtered_inventory(spark.createDataFrame(given, "path string, content binary")).collect())) for given in (rows, rows[::-1])]
    assert found[0] == found[1] and [r[0] for r in found[0]] == ["a.py", "a/b.py"]
    assert found[0][0][2] == min(hashlib.sha256(c).hexdigest() for _, c in rows[:2])


def test_documents_are_replaced_whole_and_looked_up_alone(spark, tmp_path):
    from ledgerloom.sources import documents

    root = tmp_path / "a [b] {c}"
    index, flows = documents.read_catalog(spark, str(root))
    assert index.count() == 0 and flows.count() == 0 and documents.read_workflow(spark, str(root), "one").count() == 0
    for name, value in (("one", {"id": 1, "text": "é"}), ("two", [1, 2])):
        documents.write_document(f"{root}/.catalog/workflows/{name}.yaml", value)
    documents.write_document(f"{root}/.catalog/features.yaml", {"a": 1})
    documents.write_document(f"{root}/.catalog/features.yaml", {"a": 2})
    (root / ".catalog" / "workflows" / "three.yaml").write_text("a: [")
    index, flows = documents.read_catalog(spark, str(root))
    assert [r["json"] for r in index.collect()] == ['{"a": 2}']
    assert {r["feature_id"]: (r["json"], r["error"] is None) for r in flows.collect()} == {"one": ('{"id": 1, "text": "é"}', True), "two": ("[1, 2]", True), "three": (None, False)}
    assert [tuple(r) for r in documents.read_workflow(spark, str(root), "two").collect()] == [("two", "[1, 2]", None)]
    page = f"{root}/page.html"
    assert [documents.write_if_changed(page, t) for t in ("é", "é", "other")] == [True, False, True]
    assert (root / "page.html").read_text() == "other" and sorted(os.listdir(root)) == [".catalog", "page.html"]
    (root / ".catalog" / "features.yaml").write_text("a: 3")
    assert documents.read_catalog(spark, str(root))[0].first()["json"] == '{"a": 3}'
