"""Shape of a workflow, and whether a generated one is complete; typed columns in, booleans out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import non_empty, slashes
from ledgerloom.schemas import BACKEND_MARKERS, FRONTEND_MARKERS, PHASES, STATUSES, Tags


def _true(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def in_phase(phase: Column) -> Column:
    return _true(phase.isin(*PHASES))


def valid_evidence(items: Column) -> Column:
    """A non-empty list of evidence with file, symbol and a range."""
    ok = lambda e: _true(non_empty(e["file"]) & non_empty(e["symbol"]) & (e["code_start"] >= 1) & (e["code_end"] >= e["code_start"]))
    return _true((F.size(items) > 0) & F.forall(items, ok))


def _worded(item: Column) -> Column:
    return non_empty(item["title"]) & non_empty(item["text"]) & valid_evidence(item["evidence"])


def valid_options(options: Column, phase: Column) -> Column:
    """No options, or two and more; an option without a phase has its step's."""
    ok = lambda o: _worded(o) & in_phase(F.coalesce(o["phase"], phase))
    return options.isNull() | _true((F.size(options) >= 2) & F.forall(options, ok))


def valid_steps(steps: Column) -> Column:
    """Numbered from 1 in order, each with a phase, words, evidence and valid options."""
    numbered = F.transform(steps, lambda s, i: _true(s["number"] == i + 1) & in_phase(s["phase"]) & _worded(s) & valid_options(s["options"], s["phase"]))
    return _true((F.size(steps) > 0) & F.forall(numbered, lambda ok: ok))


def phases_of(steps: Column) -> Column:
    return F.array_distinct(F.transform(steps, lambda s: s["phase"]))


def evidence_of(steps: Column) -> Column:
    """All evidence of steps and their options, in order."""
    none = F.array().cast("array<struct<file:string,symbol:string,line:int,code_start:int,code_end:int>>")
    own = lambda x: F.coalesce(x["evidence"], none)
    branches = lambda s: F.coalesce(F.flatten(F.transform(s["options"], own)), none)
    return F.flatten(F.transform(steps, lambda s: F.concat(own(s), branches(s))))


def evidence_files(steps: Column) -> Column:
    """Distinct files of that evidence, in lower case with forward slashes."""
    return F.array_distinct(F.transform(evidence_of(steps), lambda e: F.lower(slashes(F.coalesce(e["file"], F.lit(""))))))


def is_frontend(path: Column) -> Column:
    hit = F.lit(False)
    for marker in FRONTEND_MARKERS:
        hit = hit | F.contains(path, F.lit(marker))
    return hit


def is_backend(path: Column) -> Column:
    hit = F.startswith(path, F.lit("api/"))
    for marker in BACKEND_MARKERS:
        hit = hit | F.contains(path, F.lit(marker))
    return hit


def complete(size: Column, phases: Column, files: Column) -> Column:
    """The completeness rule, on the number of steps and the sets of phases and files."""
    has = lambda *names: F.arrays_overlap(phases, F.array(*[F.lit(n) for n in names]))
    shown = has("response", "ui_update")
    front = (size >= 4) & has("user_action", "frontend") & has("request") & shown & (~F.exists(files, is_backend) | has("backend"))
    back = (size >= 3) & has("backend") & shown
    return _true(F.when(F.exists(files, is_frontend), front).otherwise(back))


def valid_workflow(workflow: Column, tags: Tags = Tags()) -> Column:
    """Whether a typed workflow has the shape its status asks for."""
    status, steps = workflow["status"], workflow["steps"]
    known = _true((workflow["schema"] == tags.workflow_schema) & status.isin(*STATUSES) & steps.isNotNull())
    said = non_empty(workflow["missing_coverage"])
    shaped = F.when(status == "pending", (F.size(steps) == 0) & said) \
        .when(status == "partial", valid_steps(steps) & said) \
        .otherwise(valid_steps(steps) & complete(F.size(steps), phases_of(steps), evidence_files(steps)))
    return known & _true(shaped)
