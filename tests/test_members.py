from __future__ import annotations

import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from ledgerloom.sources import members

BLOCK = """# a comment
schema: s@1
"quoted": 3
areas:
# about them
- id: one
  text: |
    - not a member
    schema: no
- id: two
  list:
  - 1
  - 2
- 5

long: "a: b
  - c"
features:
  - id: f1
    x: 'y
      z'
  -
    id: f2
  # between
  - [1, {a: b}]
empty: []
flow: [1, 2, {k: v}]
nested:
  inner:
  - not at the top
"""


def expected(text):
    head, rows = yaml.safe_load(text), []
    if isinstance(head, dict):
        for key, value in head.items():
            if isinstance(value, list):
                rows += [(key, k, m) for k, m in enumerate(value)]
                head[key] = []
    return sorted([("head", 0, head), *rows], key=repr)


def read(path, split):
    reader = members.MembersReader({"path": str(path), "split": str(split)})
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert all(r[3] is None for r in rows)
    return sorted(((p, k, json.loads(raw)) for p, k, raw, _ in rows), key=repr), len(parts)


@pytest.mark.parametrize("split", [1, 20, 10**9])
@pytest.mark.parametrize("text", [BLOCK, BLOCK.replace("\n", "\r\n"), "a: 1\n", "[1, 2]", "- 1\n- 2\n", "text", "{a: [1, 2], b: 3}", "---\na:\n- 1\n- 2\n...\n", "a:\n- &x {k: 1}\n- *x\n- 2\nb:\n- *x\nc: *x\n", "a:\n- 1\n- 2", "é:\n- ü\n"])
def test_yaml_members(tmp_path, text, split):
    path = tmp_path / "index.yaml"
    path.write_bytes(text.encode())
    found, parts = read(path, split)
    assert found == expected(text)
    if text == BLOCK:
        assert parts == {1: 7, 20: 6, 10**9: 3}[split] or parts > 3


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
@pytest.mark.parametrize("value", [{"schema": "s", "areas": [{"id": "a", "n": 12345}, 5, "x\"]}", []], "features": [], "n": 123456, "more": {"list": [1]}}, [1, 2], {}, 7, {"a": [[1], [2, [3]]]}])
def test_json_members(tmp_path, monkeypatch, chunk, value):
    monkeypatch.setattr(members, "_CHUNK", chunk)
    path = tmp_path / "index.json"
    for indent in (None, 2):
        path.write_text(json.dumps(value, indent=indent))
        assert read(path, 5)[0] == expected(json.dumps(value))


@pytest.mark.parametrize(("name", "text"), [("a.yaml", "a: [1,"), ("a.yaml", "a:\n- 1\n- [\nb: 2\n"), ("a.json", '{"a": [1, 2'), ("a.json", "{} x"), ("a.json", '{"a" 1}')])
def test_a_bad_document_is_an_error_row(spark, tmp_path, name, text):
    (tmp_path / name).write_text(text)
    rows = members.read_members(spark, str(tmp_path / name), split=1).collect()
    assert any(r["part"] == "error" and r["error"] and r["raw"] is None for r in rows)


def test_missing_and_empty_documents(spark, tmp_path):
    assert members.read_members(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "empty.yaml").touch()
    assert [tuple(r) for r in members.read_members(spark, str(tmp_path / "empty.yaml")).collect()] == [("head", 0, "null", None)]


def rows_for(spark, n):
    listed = spark.range(0, n, 1, 6).select(F.lit("features").alias("part"), "id", F.to_json(F.struct(F.concat(F.lit("f"), "id").alias("id"), F.lit("- é: #\n  two").alias("text"), F.col("id").alias("n"))).alias("raw"))
    few = spark.createDataFrame([("head", 0, json.dumps({"schema": "s", "areas": [], "features": [], "none": []})), ("areas", 0, '{"id": "a"}'), ("areas", 1, "5")], "part string, id long, raw string")
    return few.unionByName(listed).withColumnRenamed("id", "at")


def test_round_trip_in_splits(spark, tmp_path):
    path = tmp_path / "index.yaml"
    rows = rows_for(spark, 2000)
    members.write_members(rows, str(path))
    found = members.read_members(spark, str(path), split=4000)
    assert found.rdd.getNumPartitions() > 20
    plain = lambda df: {(r["part"], r["at"]): json.loads(r["raw"]) for r in df.collect()}
    assert plain(found) == plain(rows) and found.count() == 2003
    whole = yaml.safe_load(path.read_text())
    assert list(whole) == ["schema", "areas", "features", "none"] and whole["features"][7]["n"] == 7 and os.listdir(tmp_path) == ["index.yaml"]


def test_a_failed_write_keeps_the_old_document(spark, tmp_path):
    path = tmp_path / "index.yaml"
    path.write_text("old: 1\n")
    bad = rows_for(spark, 50).withColumn("raw", F.when(F.col("at") == 40, "{not json").otherwise(F.col("raw")))
    with pytest.raises(Exception, match="JSON"):
        members.write_members(bad, str(path))
    assert path.read_text() == "old: 1\n" and os.listdir(tmp_path) == ["index.yaml"]
