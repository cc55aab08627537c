from __future__ import annotations

import json

from ledgerloom.operators import readmodel, search
from ledgerloom.schemas import Tags
from tests.test_validate import complete_catalog, evidence

TAGS = Tags()


def views_of(spark, index, flows):
    frame = spark.createDataFrame([(json.dumps(index),)], "json string")
    docs = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in flows.items()], "feature_id string, json string")
    areas, features = readmodel.index_tables(frame)
    return readmodel.workflow_views(features, areas, docs, TAGS)


def test_manifest_states(spark):
    index, _ = complete_catalog()
    cases = [("ready", (json.dumps(index), None), ""), ("ready", (json.dumps(index), None), index["source_hash"]), ("stale_features", (json.dumps(index), None), "other"),
             ("invalid_features: broken", (None, "broken"), ""), ("legacy_features", (json.dumps({**index, "schema": "x"}), None), ""), ("invalid_features", (json.dumps({**index, "areas": 1}), None), "")]
    for state, row, now in cases:
        assert readmodel.manifest_state(spark.createDataFrame([row], "json string, error string"), now, TAGS).first()["state"].startswith(state)
    assert readmodel.manifest_state(spark.createDataFrame([], "json string, error string"), "", TAGS).first()["state"] == "missing_features"


def test_views_keep_what_is_broken(spark):
    index, flows = complete_catalog(features=("good", "broken", "absent", "orphan"))
    index["features"][3]["area_id"] = "nowhere"
    index["areas"].append({**index["areas"][0], "title": "Last wins", "order": 1})
    del flows["absent"]
    flows["broken"] = "[1, 2"
    flows["good"]["steps"][1]["options"] = [{"title": "", "text": "t", "phase": "backend", "evidence": [evidence(4, 5, "run", "lib/b.py")]}] * 2
    flows["orphan"]["steps"][0]["evidence"][0].pop("line")
    views = views_of(spark, index, flows).cache()
    rows = {r["id"]: r for r in views.collect()}
    assert [rows[n]["status"] for n in ("good", "broken", "absent", "orphan")] == ["pending", "pending", "pending", "generated"]
    assert rows["broken"]["missing_coverage"] == readmodel.PLACEHOLDER and rows["broken"]["step_count"] == 0
    assert rows["orphan"]["area_id"] is None and rows["orphan"]["perspective"] == "technical"
    assert rows["broken"]["area_title"] == "Last wins"
    assert rows["orphan"]["steps"][0]["file"] == "app.py" and rows["orphan"]["steps"][0]["code_end"] == 2
    assert readmodel.counts_by_status(views).first().asDict() == {"ready_count": 1, "partial_count": 0, "pending_count": 3}
    assert search.summary(views, "orphan").first().asDict() == {"complete": 1, "total": 4, "shown": 1}
    areas = spark.createDataFrame([("core", "Core", "product", 0), ("empty", "Empty", "product", 1)], "id string, title string, perspective string, `order` int")
    assert [(r["id"], [c["id"] for c in r["cards"]]) for r in search.sections(areas, views).collect()] == [("core", ["good", "broken", "absent"])]


def test_used_files_come_from_all_three_levels(spark):
    index, flows = complete_catalog()
    flow = flows["run_app"]
    flow["evidence"][0]["file"] = "a.py"
    flow["steps"][1]["options"] = [{"title": "o", "text": "t", "phase": "backend", "evidence": [evidence(1, 1, "run", f)]} for f in ("c.py", "gone.py")]
    views = views_of(spark, index, flows)
    files = spark.createDataFrame([(p,) for p in ("c.py", "a.py", "app.py", "unused.py")], "path string")
    assert [r["path"] for r in readmodel.used_files(readmodel.cited_files(views), files).collect()] == ["a.py", "app.py", "c.py"]
    assert search.search(views, " C.PY ").count() == 1
    assert search.search(views, "nothing like it").count() == 0
    assert search.search(views, "").count() == 1
