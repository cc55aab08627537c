from __future__ import annotations

import copy
import json

import pytest

from ledgerloom.operators import validate
from ledgerloom.plans import catalog
from ledgerloom.schemas import Tags
from ledgerloom.sources.documents import write_document

TAGS = Tags()
HASH = "h" * 64


def evidence(start=1, end=2, symbol="start", file="app.py"):
    return {"file": file, "symbol": symbol, "line": start, "code_start": start, "code_end": end}


def step(number, phase):
    return {"number": number, "phase": phase, "title": f"Step {number}", "text": "does it", "evidence": [evidence()]}


def complete_catalog(source_hash=HASH, features=("run_app",)):
    areas = [{"id": "core", "title": "Core", "summary": "The core.", "perspective": "product", "order": 0}]
    index = {"schema": TAGS.index_schema, "source_hash": source_hash, "generator": TAGS.index_generator, "areas": areas, "features": []}
    flows = {}
    for name in features:
        index["features"].append({"id": name, "area_id": "core", "title": f"Title {name}", "audience": "user", "summary": "Runs.", "workflow_path": TAGS.workflow_path(name)})
        flows[name] = {"schema": TAGS.workflow_schema, "source_hash": source_hash, "generator": TAGS.workflow_generator, "feature_id": name, "title": f"Title {name}", "summary": "Runs.",
                       "status": "generated", "missing_coverage": "", "evidence": [evidence()], "steps": [step(1, "backend"), step(2, "persistence"), step(3, "response")]}
    return index, flows


def verdict(spark, index, flows, files=(("app.py", 5), ("api/x.py", 5), ("frontend/x.ts", 5), ("server/y.py", 5))):
    inventory = spark.createDataFrame(list(files), "path string, line_count long")
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in flows.items()], "feature_id string, json string")
    rows = [] if index is None else [(json.dumps(index),)]
    report, each = validate.validate(spark.createDataFrame(rows, "json string"), docs, inventory, HASH, TAGS)
    return report.first()["error"] or "", each


def test_a_complete_catalog_is_accepted(spark):
    index, flows = complete_catalog()
    error, each = verdict(spark, index, flows)
    assert error == ""
    counts = validate.status_counts(spark.createDataFrame([(error,)], "error string"), each).first()
    assert counts.asDict() == {"features": 1, "generated": 1, "partial": 0, "pending": 0, "needs_work": False, "error": ""}


def test_key_order_does_not_matter(spark):
    index, flows = complete_catalog()
    index["features"] = [dict(reversed(index["features"][0].items()))]
    flows = {k: dict(reversed(v.items())) for k, v in flows.items()}
    assert verdict(spark, index, flows)[0] == ""


INDEX_CASES = {
    "schema must be": lambda i: i.update(schema="catalog/features@3"),
    "source_hash does not match": lambda i: i.update(source_hash="x"),
    "generator must be": lambda i: i.update(generator="x"),
    "at least one feature area": lambda i: i.update(areas=[]),
    "at least one feature$": lambda i: i.update(features=[]),
    "duplicate area id: core": lambda i: i["areas"].append({**i["areas"][0], "order": 1}),
    "repeats an order": lambda i: i["areas"].append({**i["areas"][0], "id": "other"}),
    "duplicate area id: Bad": lambda i: i["areas"][0].update(id="Bad"),
    "non-negative order": lambda i: i["areas"][0].update(order=-1),
    "perspective": lambda i: i["areas"][0].update(perspective="x"),
    "needs a title": lambda i: i["areas"][0].update(summary="  "),
    "area must be an object": lambda i: i["areas"].insert(0, 5),
    "duplicate feature id": lambda i: i["features"].append(dict(i["features"][0])),
    "invalid metadata": lambda i: i["features"][0].update(area_id="none"),
    "has invalid metadata": lambda i: i["features"][0].update(audience="x"),
    "not in canonical form": lambda i: i["features"][0].update(extra=1),
    "is not in canonical form": lambda i: i["features"][0].update(title=" Title run_app"),
}


def index_error(spark, index):
    return validate.index_failure(spark.createDataFrame([(json.dumps(index),)], "json string"), HASH, TAGS).first()["error"] or ""


@pytest.mark.parametrize("message", INDEX_CASES)
def test_index_rules(spark, message):
    index, _ = complete_catalog()
    INDEX_CASES[message](index)
    error = index_error(spark, index)
    pattern = message.rstrip("$")
    assert error.endswith(pattern) if message.endswith("$") else pattern in error


def test_trailing_newline_in_an_id_is_refused(spark):
    index, flows = complete_catalog()
    index["areas"][0]["id"] = "core\n"
    assert "invalid or duplicate area id" in index_error(spark, index)


def _options(count=2, **more):
    return [{"phase": "backend", "title": f"o{k}", "text": "t", "evidence": [evidence(4, 5, "run")], **more} for k in range(count)]


WORKFLOW_CASES = {
    "unsupported schema": lambda w: w.update(schema="x"),
    "source_hash does not match": lambda w: w.update(source_hash="x"),
    "generator must be": lambda w: w.update(generator="x"),
    "does not match its feature": lambda w: w.update(title="x"),
    "needs a summary": lambda w: w.update(summary=" "),
    "unsupported status": lambda w: w.update(status="done"),
    "has an unsupported status": lambda w: w.update(status="partial"),
    "non-empty evidence list": lambda w: w.update(evidence=[]),
    "pending workflows cannot": lambda w: w.update(status="pending", missing_coverage="m"),
    "generated workflows need steps": lambda w: w.update(steps=[]),
    "relative to the root: ../app.py": lambda w: w["evidence"][0].update(file="../app.py"),
    "relative to the root: /tmp/app.py": lambda w: w["evidence"][0].update(file="/tmp/app.py"),
    "not in the inventory: missing.py": lambda w: w["steps"][1]["evidence"][0].update(file="missing.py"),
    "needs a symbol": lambda w: w["steps"][0]["evidence"][0].update(symbol=" "),
    "invalid line range": lambda w: w["steps"][0]["evidence"][0].update(code_start=3, line=3),
    "exceeds app.py (5 lines)": lambda w: w["evidence"][0].update(code_end=999),
    "at least two branches": lambda w: w["steps"][1].update(options=_options(1)),
    "is incomplete or invalid": lambda w: w["steps"][0].update(number=2),
    "incomplete or invalid": lambda w: w["steps"].pop(),
    "not in canonical form": lambda w: w["evidence"][0].update(file="./app.py"),
    "is not in canonical form": lambda w: w.update(extra=1),
    "in canonical form": lambda w: w["steps"][0].update(options=None),
    "canonical form": lambda w: w["steps"][0]["evidence"][0].update(line=2),
}


def test_workflow_rules(spark):
    """One feature per case; each is refused with its own message, in order."""
    names = [f"case{k}" for k in range(len(WORKFLOW_CASES))]
    index, flows = complete_catalog(features=names)
    for name, (message, damage) in zip(names, WORKFLOW_CASES.items(), strict=True):
        damage(flows[name])
    error, each = verdict(spark, index, flows)
    messages = {r["id"]: r["message"] for r in each.select("id", "message").collect()}
    for name, message in zip(names, WORKFLOW_CASES, strict=True):
        assert message in messages[name], name
    assert error == "; ".join(messages[n] for n in names)


def test_branches_are_accepted_and_kept_in_order(spark):
    index, flows = complete_catalog()
    flows["run_app"]["steps"][1]["options"] = _options(3)
    error, each = verdict(spark, index, flows)
    assert error == ""
    assert [o["title"] for o in each.first()["workflow"]["steps"][1]["options"]] == ["o0", "o1", "o2"]


def test_booleans_are_no_integers(spark):
    index, flows = complete_catalog()
    flows["run_app"]["steps"][0]["number"] = True
    assert verdict(spark, index, flows)[0] != ""


def test_partial_and_pending_need_what_is_missing(spark):
    index, flows = complete_catalog(features=("a", "b"))
    flows["a"].update(status="partial", missing_coverage="tests")
    flows["b"].update(status="pending", missing_coverage="all", steps=[])
    error, each = verdict(spark, index, flows)
    assert error == ""
    assert {r["id"]: r["workflow"]["status"] for r in each.collect()} == {"a": "partial", "b": "pending"}


def test_every_missing_workflow_is_named_in_order(spark):
    index, _ = complete_catalog(features=("b", "a"))
    assert verdict(spark, index, {})[0] == "workflow file is missing or invalid for b; workflow file is missing or invalid for a"


def test_first_problem_of_a_workflow_wins(spark):
    index, flows = complete_catalog()
    flows["run_app"]["steps"][2]["evidence"][0]["file"] = "later.py"
    flows["run_app"]["steps"][0]["evidence"][0]["symbol"] = ""
    assert "needs a symbol" in verdict(spark, index, flows)[0]


def test_a_missing_index(spark):
    assert verdict(spark, None, {})[0] == "features catalog is missing or invalid"


FILES = {"frontend": "frontend/x.ts", "backend": "server/y.py", "plain": "app.py", "api": "api/x.py"}


COMPLETENESS = [
    (["user_action", "request", "backend", "ui_update"], ["frontend", "backend"], True),
    (["user_action", "request", "persistence", "ui_update"], ["frontend"], True),
    (["user_action", "request", "persistence", "ui_update"], ["frontend", "api"], False),
    (["user_action", "backend", "response"], ["frontend"], False),
    (["user_action", "backend", "persistence", "response"], ["frontend"], False),
    (["backend", "persistence", "response"], ["plain"], True),
    (["request", "persistence", "response"], ["plain"], False),
    (["backend", "persistence", "external"], ["plain"], False),
]


def test_completeness(spark):
    names = [f"case{k}" for k in range(len(COMPLETENESS))]
    index, flows = complete_catalog(features=names)
    for name, (phases, files, _) in zip(names, COMPLETENESS, strict=True):
        flows[name]["steps"] = [step(k + 1, p) for k, p in enumerate(phases)]
        for k, s in enumerate(flows[name]["steps"]):
            s["evidence"][0]["file"] = FILES[files[k % len(files)]]
    _, each = verdict(spark, index, flows)
    found = {r["id"]: r["message"] is None for r in each.select("id", "message").collect()}
    assert found == {n: fine for n, (*_, fine) in zip(names, COMPLETENESS, strict=True)}


def test_the_gate_over_a_tree(spark, source_repo):
    found = catalog.scan(spark, str(source_repo), "walk")
    assert catalog.gate(spark, found).first()["error"] == "features catalog is missing or invalid"
    index, flows = complete_catalog(found.source_hash)
    write_document(str(source_repo / ".catalog" / "features.yaml"), index)
    for name, flow in flows.items():
        write_document(str(source_repo / ".catalog" / "workflows" / f"{name}.yaml"), flow)
    assert catalog.scan(spark, str(source_repo), "walk").source_hash == found.source_hash
    assert catalog.gate(spark, found).first()["generated"] == 1
    payload = catalog.explorer(spark, found)
    assert set(payload) == {"root", "workflow_areas", "workflows", "workflow_state", "source_files"}
    assert payload["workflow_state"]["ready_count"] == 1 and [f["path"] for f in payload["source_files"]] == ["app.py"]
    page = catalog.export_page(payload, str(source_repo / ".catalog" / "explorer.html"))
    assert "Title run_app" in open(page).read()
    (source_repo / "app.py").write_text("changed\n")
    later = catalog.scan(spark, str(source_repo), "walk")
    assert "does not match" in catalog.gate(spark, later).first()["error"]
    stale = catalog.explorer(spark, later)
    assert stale["workflow_state"]["state"] == "stale_features" and len(stale["workflows"]) == 1
    legacy = copy.deepcopy(index) | {"schema": "catalog/features@3"}
    write_document(str(source_repo / ".catalog" / "features.yaml"), legacy)
    assert catalog.explorer(spark, later)["workflow_state"]["state"].startswith("legacy_features")
