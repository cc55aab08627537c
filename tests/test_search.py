from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import flow, search


def scans(plan):
    """The file scans of an executed plan."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return scans(plan.plan())
    below = [found for k in range(plan.children().size()) for found in scans(plan.children().apply(k))]
    return below + ([plan] if kind == "FileSourceScanExec" else [])


TEXTS = [(1, ["Alpha Beta", None]), (2, ["beta"]), (3, ["al", "pha"]), (4, []), (5, None), (6, ["ÄÖÜ straße", "x"]), (7, ["a😀bc", "\n\t|"]), (8, ["100% _under"]), (9, ["İstanbul"]), (10, ["a" * 50_000 + "needle"])]


@pytest.fixture(scope="module")
def index(spark):
    frame = spark.createDataFrame([*TEXTS, (1, ["Alpha Beta"]), (3, ["other"])], "id long, texts array<string>")
    return frame, search.index_texts(frame, F.col("texts"))


@pytest.mark.parametrize("query", ["alpha", "ALPHA b", "beta", "alpha beta", "pha", "al", "a", "", "  beta ", "öü", "STRASSE", "straße", "😀b", "a😀bc", "% _", "i̇st", "needle", "aaaa", "nothing", "\n\t|", "beta|", "lph", "xyz"])
def test_the_index_finds_what_a_scan_finds(index, query):
    frame, built = index
    assert sorted(r["id"] for r in search.indexed_search(built, query).collect()) == sorted({r["id"] for r in frame.where(search.matches(F.col("texts"), query)).collect()})


def test_random_queries(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc ") for _ in range(8)) for _ in range(30)]
    frame = spark.createDataFrame([(f"v{k}", [" ".join(rng.choices(words, k=4)), rng.choice(words)]) for k in range(300)], "id string, texts array<string>").cache()
    built = search.index_texts(frame, F.col("texts"))
    for _ in range(6):
        query = rng.choice(words)[: rng.randint(3, 8)]
        assert sorted(r["id"] for r in search.indexed_search(built, query).collect()) == sorted({r["id"] for r in frame.where(search.matches(F.col("texts"), query)).collect()})


def test_texts_without_a_candidate_are_not_read(spark):
    frame = spark.createDataFrame([(k, [f"text number {k} of many", "needle" if k == 777 else "hay"]) for k in range(2000)], "id long, texts array<string>")
    built = search.index_texts(frame, F.col("texts"))
    found = search.indexed_search(built, "Needle")
    assert [r["id"] for r in found.collect()] == [777]
    read = [s for s in scans(found._jdf.queryExecution().executedPlan()) if "texts" in s.output().mkString(",")]
    assert len(read) == 1 and read[0].metrics().apply("numFiles").value() == 1
    assert read[0].metrics().apply("numOutputRows").value() < 2000 / search.SLOTS * 2


def test_postings_are_lists_in_order_of_their_grams(spark):
    rng = random.Random(8)
    texts = {k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ÄÖ😀") for _ in range(400)) for k in range(1500)}
    built = search.index_texts(spark.createDataFrame([(k, [t, None]) for k, t in texts.items()], "id long, texts array<string>"), F.col("texts"))
    plain = {(search._gram(t[k : k + 3]), i) for i, t in ((i, t.lower()) for i, t in texts.items()) for k in range(len(t) - 2)}
    rows = built.postings.withColumn("file", F.input_file_name()).collect()
    assert sum(len(r["ids"]) for r in rows) == len(plain) and {(r["gram"], i) for r in rows for i in r["ids"]} == plain and len(rows) < len(plain) / 2
    for file in {r["file"] for r in rows}:
        grams = [r["gram"] for r in rows if r["file"] == file]
        assert grams == sorted(grams)
    # Of each file, the pages with the gram are read.
    wanted = built.postings.where(F.col("gram") == search._gram("abc")).select("gram", F.size("ids"))
    assert 1 <= len(wanted.collect()) <= 16
    assert scans(wanted._jdf.queryExecution().executedPlan())[0].metrics().apply("numOutputRows").value() < len(rows) / 10


@pytest.mark.parametrize("characters", [3, 8, 40, 1 << 21])
def test_grams_of_runs_and_parts_of_texts(monkeypatch, characters):
    monkeypatch.setattr(search, "CHARACTERS", characters)
    rng = random.Random(characters)
    rows = [(f"v{k % 20}", None if k % 9 == 0 else ["".join(rng.choice("aä😀\0") for _ in range(rng.randint(0, 30))) for _ in range(k % 4)]) for k in range(60)] + [("last", [])]
    batches = [pa.RecordBatch.from_pylist([{"id": i, "texts": t} for i, t in part], pa.schema([("id", pa.string()), ("texts", pa.list_(pa.string()))])) for part in (rows[:25], rows[25:], [])]
    found = [(g, i) for batch in search._runs(iter(batches)) for r in batch.to_pylist() for g, i in ((r["gram"], i) for i in r["ids"])]
    plain = [(g, i) for i, texts in rows for g in {search._gram(t[k : k + 3]) for t in texts or () for k in range(len(t) - 2)}]
    assert sorted(found) == sorted(plain) and len(plain) > 500
    for batch in search._runs(iter(batches)):
        grams = batch.column("gram").to_pylist()
        assert grams == sorted(set(grams))


def test_grid_hits_on_a_long_chart(spark):
    steps = spark.range(10_000).select(F.lit(1).alias("workflow_id"), F.col("id").cast("int").alias("step"), (F.col("id") + 1).cast("int").alias("number"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("options"))
    shapes = flow.nodes(steps, flow.VERTICAL).cache()
    points = spark.range(3_000).select(F.col("id").alias("point_id"), F.lit(1).alias("workflow_id"), (F.col("id") % 400 - 200.0).alias("px"), (F.col("id") * 997.0).alias("py"))
    pairs = flow.near_shapes(points, shapes).groupBy("point_id").count().agg(F.max("count")).first()[0]
    assert pairs <= 8
    plain = points.join(shapes, "workflow_id").where(flow.contains(F.col("px"), F.col("py"))).groupBy("point_id").agg(F.min(F.struct("step", "option")).alias("hit")).select("point_id", "hit.step", "hit.option")
    found = flow.hits(points, shapes).select("point_id", "step", "option")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() > 300


def test_grid_hits_of_shapes_of_any_size(spark):
    rng = random.Random(2)
    shapes = [(k % 3, k, -1, rng.choice(["process", "decision"]), rng.uniform(-3000, 3000), rng.uniform(-3000, 3000), rng.choice([0.0, 1.0, 230.0, 460.0, 5000.0]), rng.choice([0.5, 126.0, 252.0, 9000.0])) for k in range(200)]
    points = [(k, k % 3, rng.uniform(-4000, 4000), rng.uniform(-4000, 4000)) for k in range(500)] + [(1000 + k, s[0], s[4] + s[6], s[5] + s[7]) for k, s in enumerate(shapes)] + [(5000, 0, None, 1.0)]
    shapes = spark.createDataFrame(shapes, "workflow_id int, step int, option int, kind string, x double, y double, w double, h double").where("kind = 'process' or w > 0")
    points = spark.createDataFrame(points, "point_id int, workflow_id int, px double, py double")
    plain = points.join(shapes, "workflow_id").where(flow.contains(F.col("px"), F.col("py"))).groupBy("point_id").agg(F.min(F.struct("step", "option")).alias("hit")).select("point_id", "hit.step", "hit.option")
    assert sorted(map(tuple, flow.hits(points, shapes).select("point_id", "step", "option").collect())) == sorted(map(tuple, plain.collect()))
