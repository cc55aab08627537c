from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import ranges, rules, search


def test_places_and_running_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, 3, 3, 40]), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "g string, x int, k int").repartition(7)
    order = [F.col("x").asc_nulls_first(), F.col("k").asc()]
    placed = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    found = {r["k"]: (r["place"], r["before"]) for r in ranges.placed(frame, order, sums=F.col("k")).collect()}
    assert found == {r[2]: (at, sum(o[2] for o in placed[: at - 1])) for at, r in enumerate(placed, 1)}
    by = {r["k"]: (r["n"], r["b"]) for r in ranges.placed(frame, order, "n", ("g",), F.col("k"), "b").collect()}
    for g in ("a", "b", None):
        own = [r for r in placed if r[0] == g]
        assert {r[2]: by[r[2]] for r in own} == {r[2]: (at, sum(o[2] for o in own[: at - 1])) for at, r in enumerate(own, 1)}


def test_ties_have_places_of_their_own(spark):
    found = ranges.placed(spark.createDataFrame([(1,)] * 50 + [(0,)], "x int"), [F.col("x").asc()]).collect()
    assert sorted(r["place"] for r in found) == list(range(1, 52)) and [r["x"] for r in found if r["place"] == 1] == [0]


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], "x int, g string")
    assert ranges.placed(empty, [F.col("x").asc()]).columns == ["x", "g", "place"]
    assert ranges.placed(empty, [F.col("x").asc()]).count() == ranges.placed(empty, [F.col("x").asc()], by=("g",), sums=F.col("x")).count() == 0
    assert rules.joined_chunks(empty.withColumn("message", F.lit("m")), "x").count() == 0


def test_chunks_concatenate_to_the_joined_text(spark):
    rows = [("a" if k % 3 else "b", k * 7919 % 1009, None if k % 5 == 0 else f"message é {k}") for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, at int, message string").repartition(6)
    whole = {r["g"]: r["errors"] for r in rules.joined(frame, "at", by=("g",)).collect()}
    for size in (1, 7, 1000):
        chunks = rules.joined_chunks(frame, "at", by=("g",), rows=size).orderBy("g", "chunk").collect()
        for g, text in whole.items():
            own = [r for r in chunks if r["g"] == g]
            assert "".join(r["text"] for r in own) == text and [r["chunk"] for r in own] == list(range(len(own)))
            assert all(text[r["offset"] :].startswith(r["text"]) for r in own)
    assert "".join(r["text"] for r in rules.joined_chunks(frame, "at", rows=10).orderBy("chunk").collect()) == rules.joined(frame, "at").first()["errors"]


def test_no_window_over_the_whole_table(spark):
    areas = spark.createDataFrame([(k, ("product", "technical")[k % 2], k % 4) for k in range(40)], "id int, perspective string, order int")
    placed = search.placed_areas(areas, "id")
    assert "Window" not in placed._jdf.queryExecution().executedPlan().toString()
    want = sorted(range(40), key=lambda k: (k % 2, k % 4, k))
    assert [r["id"] for r in placed.orderBy("place").collect()] == want
