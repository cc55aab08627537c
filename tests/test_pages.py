from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import pages, readmodel
from ledgerloom.plans import catalog
from ledgerloom.schemas import Tags
from ledgerloom.sources.documents import write_document
from tests.test_validate import complete_catalog, evidence


def test_a_template_is_filled_in_one_pass(spark):
    row = spark.createDataFrame([("{{b}}", None, 3)], "a string, b string, c int")
    filled = row.select(text.fill("{{a}}-{{b}}-{{c}}-{{a}} {a} {{", a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("x")).first()[0]
    assert filled == "{{b}}--3-{{b}} {a} {{"
    with pytest.raises(ValueError, match="no value"):
        text.fill("{{other}}", a=F.lit(1))


def views_of(spark, index, flows):
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in flows.items()], "feature_id string, json string")
    areas, features = readmodel.index_tables(spark.createDataFrame([(json.dumps(index),)], "json string"))
    return areas, readmodel.workflow_views(features, areas, docs, Tags())


def test_a_site(spark):
    index, flows = complete_catalog(features=("one", "two", "absent"))
    index["areas"].append({**index["areas"][0], "id": "last", "title": "Last <area>", "order": 7})
    index["features"][0]["area_id"] = "last"
    index["features"][1]["area_id"] = "unknown"
    flows["one"]["title"] = "<script>"
    flows["one"]["steps"][1]["options"] = [{"title": t, "text": "t", "phase": "backend", "evidence": [evidence()]} for t in ("a", "b")]
    del flows["absent"]
    areas, views = views_of(spark, index, flows)
    found = {r["path"]: r["content"] for r in pages.site(areas, views).collect()}
    assert set(found) == {"index.html", "workflows/one.html", "workflows/two.html", "workflows/absent.html"}
    one = found["workflows/one.html"]
    assert "<title>&lt;script&gt;</title>" in one and one.count("<rect") == 4 and one.count("<polygon") == 1 and one.count("<polyline") == 5 and one.count("<li>") == 3
    assert "<svg" not in found["workflows/absent.html"]
    assert re.findall(r"<h2>(.*?)</h2>|html\">(.*?)</a>", found["index.html"]) == [("Core", ""), ("", "Title absent"), ("Last &lt;area&gt;", ""), ("", "&lt;script&gt;"), ("Other", ""), ("", "Title two")]


def test_cards_go_on_on_the_next_page(spark):
    cards = spark.createDataFrame([(k, f"t{k}", "generated", "s", "A" if k < 4 else None, 1 if k < 4 else None, k) for k in range(7)], "workflow_id int, title string, status string, summary string, area_title string, area_place long, at int")
    found = {r["path"]: r["content"] for r in pages.card_pages(cards, many=3).collect()}
    assert set(found) == {"index.html", "page-1.html", "page-2.html"} and 'href="page-2.html"' in found["page-1.html"] and "more" not in found["page-2.html"]
    assert [re.findall(r"<h2>(\w+)|>(t\d)<", found[p]) for p in ("index.html", "page-1.html")] == [[("A", ""), ("", "t0"), ("", "t1"), ("", "t2")], [("A", ""), ("", "t3"), ("Other", ""), ("", "t4"), ("", "t5")]]
    assert pages.card_pages(cards.limit(0)).count() == 0


def test_status_of_a_tree(spark, source_repo):
    found = catalog.scan(spark, str(source_repo), "walk")
    told = catalog.status(spark, found, "refresh")
    assert told["status"] == "needs_feature_workflows" and told["progress"] == {"source_files": 1, "source_hash": found.source_hash, "features": 0}
    assert "features catalog is missing or invalid" in told["next_action"][1] and "REFRESH: NEXT ACTION REQUIRED" in catalog.status_text(told, "refresh")
    index, flows = complete_catalog(found.source_hash)
    write_document(str(source_repo / ".catalog" / "features.yaml"), index)
    write_document(str(source_repo / ".catalog" / "workflows" / "run_app.yaml"), flows["run_app"])
    for _ in range(2):
        told = catalog.status(spark, found)
        assert told["status"] == "done" and told["progress"]["features"] == 1
        assert told["next_action"] == ["Saved 1 feature(s).", "Generated .catalog/explorer.html and .catalog/site."]
    assert sorted(os.listdir(source_repo / ".catalog" / "site")) == ["index.html", "workflows"] and sorted(os.listdir(source_repo / ".catalog")) == ["explorer.html", "features.yaml", "site", "workflows"]
    assert catalog.status_text(told, "init").startswith("INIT: COMPLETE\nstatus: done\n")


def test_a_large_catalog_has_pages_but_not_one_page(spark, source_repo, monkeypatch, capsys):
    from ledgerloom.__main__ import main

    found = catalog.scan(spark, str(source_repo), "walk")
    index, flows = complete_catalog(found.source_hash)
    write_document(str(source_repo / ".catalog" / "features.yaml"), index)
    write_document(str(source_repo / ".catalog" / "workflows" / "run_app.yaml"), flows["run_app"])
    assert main(["ui", str(source_repo)]) == 0
    assert [os.path.basename(x) for x in capsys.readouterr().out.split()] == ["explorer.html", "site"]
    monkeypatch.setattr(catalog, "ONE_PAGE", 0)
    assert [os.path.basename(p) for p in catalog.write_pages(spark, found, 1)] == ["site"] and catalog.listed_features(spark, found) == 1
