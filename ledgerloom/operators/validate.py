"""The strict gate: a catalog index and its workflows against the current snapshot.

The index fails on its first problem.  Each workflow fails on its own first problem,
and all messages are joined in the order of the features.  Documents are JSON text;
typed columns hold them, and a record is accepted only if it equals its canonical
form, keys and all.

Documented differences: booleans and floats are no integers; a record that breaks a
rule is a message, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.text import normalize_path, slashes, strip
from ledgerloom.operators.rules import earliest, first_failure, joined, joined_chunks, same_json
from ledgerloom.operators.shape import valid_workflow
from ledgerloom.schemas import AREA, AUDIENCES, EVIDENCE, FEATURE, ID_PATTERN, INDEX, OPTION, PERSPECTIVES, STATUSES, STEP, WORKFLOW, Tags


def _absent(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _shown(value: Column) -> Column:
    return F.when(_absent(value), F.lit("<missing>")).otherwise(value)


def _differs(value: Column, wanted: Column | str) -> Column:
    return ~value.eqNullSafe(wanted if isinstance(wanted, Column) else F.lit(wanted))


def _not(value: Column) -> Column:
    """True unless the condition is known to hold."""
    return ~F.coalesce(value, F.lit(False))


def index_rows(index: DataFrame) -> DataFrame:
    """An index document ``(json, error)`` as the rows ``part, at, raw, error`` that the ``members`` source yields."""
    if "part" in index.columns:
        return index
    given = index if "error" in index.columns else index.withColumn("error", F.lit(None).cast("string"))
    typed = given.withColumn("index", F.from_json("json", INDEX))
    zero, none = F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("error")
    members = [typed.select(F.lit(name).alias("part"), F.posexplode(f"index.{name}").alias("at", "raw")).select("part", F.col("at").cast("long").alias("at"), "raw", none) for name in ("areas", "features")]
    heads = typed.where("json is not null").select(F.lit("head").alias("part"), zero, F.col("json").alias("raw"), none)
    errors = typed.where("error is not null").select(F.lit("error").alias("part"), zero, F.lit(None).cast("string").alias("raw"), "error")
    return heads.unionByName(errors).unionByName(members[0]).unionByName(members[1])


def index_head(index: DataFrame) -> DataFrame:
    """At most one row ``json, error``: the document without its members, or why it cannot be read."""
    if "part" not in index.columns:
        return index
    # A document has one head; of the splits' errors one is told.
    ends = index.where(F.col("part").isin("head", "error")).agg(F.max("raw").alias("json"), F.min("error").alias("error"))
    return ends.where("json is not null or error is not null").select(F.when(F.col("error").isNull(), F.col("json")).alias("json"), "error")


def index_members(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas and features of the index, a document or its rows; typed, with their ordinal and raw text."""
    rows = index_rows(index)

    def members(name: str, kind: str) -> DataFrame:
        own = rows.where(F.col("part") == name).select(F.col("at").cast("int").alias("at"), "raw")
        return own.select("at", "raw", F.from_json("raw", kind).alias("x")).select("at", "raw", "x.*")

    return members("areas", AREA), members("features", FEATURE)


def area_failures(areas: DataFrame) -> DataFrame:
    """``at, message`` of areas that break a rule."""
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    rows = areas.withColumn("same_id", nth("id")).withColumn("same_order", nth("perspective", "order"))
    name = F.coalesce(F.col("id"), F.lit(""))
    message = first_failure(
        (F.col("id").isNull() & ~F.startswith("raw", F.lit("{")), "each feature area must be an object"),
        (_not(F.col("id").rlike(ID_PATTERN)) | (F.col("same_id") > 1), F.concat(F.lit("invalid or duplicate area id: "), _shown(F.col("id")))),
        (_not(F.col("perspective").isin(*PERSPECTIVES)) | _not(F.col("order") >= 0), F.concat(F.lit("area "), name, F.lit(" needs a perspective and a non-negative order"))),
        (F.col("same_order") > 1, F.concat(F.lit("area "), name, F.lit(" repeats an order within "), F.col("perspective"))),
        ((strip(F.col("title")) == "") | (strip(F.col("summary")) == ""), F.concat(F.lit("area "), name, F.lit(" needs a title and a summary"))),
    )
    return rows.select("at", message.alias("message")).where("message is not null")


def feature_failures(features: DataFrame, areas: DataFrame, tags: Tags = Tags()) -> DataFrame:
    """``at, message`` of features that break a rule, or are not in canonical form."""
    known = areas.select(F.col("id").alias("known_area")).distinct()
    rows = features.join(known, F.col("area_id") == F.col("known_area"), "left")
    rows = rows.withColumn("same_id", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    name = F.coalesce(F.col("id"), F.lit(""))
    texts = {c: strip(F.col(c)) for c in ("id", "area_id", "title", "audience", "summary")}
    canonical = F.to_json(F.struct(*[v.alias(c) for c, v in texts.items()], F.concat(F.lit(f"{tags.state_dir}/workflows/"), texts["id"], F.lit(".yaml")).alias("workflow_path")))
    message = first_failure(
        (F.col("id").isNull() & ~F.startswith("raw", F.lit("{")), "each feature must be an object"),
        (_not(texts["id"].rlike(ID_PATTERN)) | (F.col("same_id") > 1), F.concat(F.lit("invalid or duplicate feature id: "), _shown(F.col("id")))),
        (F.col("known_area").isNull() | (texts["title"] == "") | (texts["summary"] == "") | _not(texts["audience"].isin(*AUDIENCES)), F.concat(F.lit("feature "), name, F.lit(" has invalid metadata"))),
        (~same_json(F.col("raw"), canonical), F.concat(F.lit("feature "), name, F.lit(" is not in canonical form"))),
    )
    return rows.select("at", message.alias("message")).where("message is not null")


def orphan_features(features: DataFrame, areas: DataFrame) -> DataFrame:
    """Features whose area is not known."""
    return features.join(areas.select(F.col("id").alias("area_id")), "area_id", "left_anti")


def index_failure(index: DataFrame, source_hash: str, tags: Tags = Tags()) -> DataFrame:
    """One row ``error``: the index's first problem, null if there is none; the index is a document or its rows."""
    rows = index_rows(index)
    typed = index_head(rows).where("json is not null").select(F.from_json("json", INDEX).alias("i"))
    # Whether a list has members: one row for each list that has, however many they are.
    listed = rows.where(F.col("part").isin("areas", "features")).select("part").distinct()
    typed = typed.crossJoin(F.broadcast(listed.agg(F.collect_set("part").alias("listed"))))  # one row, two values at most
    has = lambda name: F.array_contains("listed", name)
    heads = typed.select(first_failure(
        (_differs(F.col("i.schema"), tags.index_schema), f"features schema must be {tags.index_schema}"),
        (_differs(F.col("i.source_hash"), source_hash), "features source_hash does not match the current snapshot"),
        (_differs(F.col("i.generator"), tags.index_generator), f"features generator must be {tags.index_generator}"),
        (~has("areas"), "the index must contain at least one feature area"),
    ).alias("message"), F.lit(0).alias("part"), F.lit(0).alias("at"))
    empty = typed.select(F.when(~has("features"), F.lit("features must contain at least one feature")).alias("message"), F.lit(2).alias("part"), F.lit(0).alias("at"))
    areas, features = index_members(rows)
    every = heads.unionByName(empty) \
        .unionByName(area_failures(areas).withColumn("part", F.lit(1))) \
        .unionByName(feature_failures(features, areas, tags).withColumn("part", F.lit(3)))
    return every.where("message is not null").agg(F.min_by("message", F.struct("part", "at")).alias("error"))


def _place(section: int, step: Column | int, branch: int, option: Column | int, evidence: Column | int) -> Column:
    parts = {"section": section, "step": step, "branch": branch, "option": option, "evidence": evidence}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(k) for k, v in parts.items()])


def _parts(w: Column) -> Column:
    """All that is looked at within a workflow, in one array: each evidence record with its place, and what its steps and options lack."""
    nothing, silent = F.lit(None).cast(EVIDENCE), F.lit(None).cast("string")
    part = lambda place, e, said: F.struct(place.alias("place"), e.alias("e"), said.alias("said"))
    listed = lambda items, kind: F.coalesce(items, F.array().cast(f"array<{kind}>"))
    needed = "a non-empty evidence list is required"
    lacking = lambda x: F.when((w["status"] != "pending") & (F.coalesce(F.size(x["evidence"]), F.lit(0)) < 1), F.lit(needed))

    def option_parts(step: Column, o: Column, at: Column) -> Column:
        cited = F.transform(listed(o["evidence"], EVIDENCE), lambda e, k: part(_place(1, step, 1, at, k), e, silent))
        return F.concat(F.array(part(_place(1, step, 1, at, -1), nothing, lacking(o))), cited)

    def step_parts(s: Column, at: Column) -> Column:
        few = F.when((w["status"] != "pending") & s["options"].isNotNull() & (F.size(s["options"]) < 2), F.lit("step options need at least two branches"))
        cited = F.transform(listed(s["evidence"], EVIDENCE), lambda e, k: part(_place(1, at, 0, 0, k), e, silent))
        options = F.flatten(F.transform(listed(s["options"], OPTION), lambda o, k: option_parts(at, o, k)))
        return F.concat(F.array(part(_place(1, at, 0, 0, -1), nothing, lacking(s)), part(_place(1, at, 1, -1, -1), nothing, few)), cited, options)

    size = F.coalesce(F.size(w["steps"]), F.lit(0))
    whole = first_failure(
        ((w["status"] == "pending") & (size > 0), "pending workflows cannot contain steps"),
        ((w["status"] != "pending") & (size < 1), F.concat(w["status"], F.lit(" workflows need steps"))))
    own = F.transform(listed(w["evidence"], EVIDENCE), lambda e, k: part(_place(0, 0, 0, 0, k), e, silent))
    # The steps as a whole are looked at after the workflow's own evidence, before any step.
    every = F.concat(own, F.array(part(_place(1, -1, 0, 0, 0), nothing, whole)), F.flatten(F.transform(listed(w["steps"], STEP), step_parts)))
    return F.filter(every, lambda p: p["e"].isNotNull() | p["said"].isNotNull())


def evidence_failures(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """``feature_id, place, message`` of evidence ``(feature_id, place, e)`` that breaks a rule.

    ``files`` is the inventory; one join brings each cited file's number of lines.  A row of
    ``evidence`` whose ``said`` is not null has that message.
    """
    said = F.col("said") if "said" in evidence.columns else F.lit(None).cast("string")
    given = slashes(F.coalesce(F.col("e.file"), F.lit("")))
    rows = evidence.withColumn("given", given).withColumn("file", normalize_path(given))
    rows = rows.join(files.select(F.col("path").alias("known"), "line_count"), F.col("file") == F.col("known"), "left")
    symbol, start = strip(F.col("e.symbol")), F.coalesce(F.col("e.code_start"), F.col("e.line"))
    stop = F.coalesce(F.col("e.code_end"), F.col("e.line"), start)
    message = first_failure(
        ((F.col("given") == "") | F.startswith("given", F.lit("/")) | (F.col("file") == "..") | F.startswith("file", F.lit("../")),
         F.concat(F.lit("evidence file must be relative to the root: "), _shown(F.col("given")))),
        (F.col("known").isNull(), F.concat(F.lit("evidence file is not in the inventory: "), F.col("file"))),
        (symbol == "", F.concat(F.lit("evidence in "), F.col("file"), F.lit(" needs a symbol"))),
        (_not((start >= 1) & (stop >= start)), F.concat(F.lit("evidence for "), symbol, F.lit(" has an invalid line range"))),
        (stop > F.col("line_count"), F.concat(F.lit("evidence for "), symbol, F.lit(" exceeds "), F.col("file"), F.lit(" ("), F.col("line_count").cast("string"), F.lit(" lines)"))),
    )
    return rows.select("feature_id", "place", F.coalesce(said, message).alias("message")).where("message is not null")


def canonical_evidence(items: Column) -> Column:
    """Evidence with a normal path, a trimmed symbol and a full range."""
    start = lambda e: F.coalesce(e["code_start"], e["line"])
    return F.transform(items, lambda e: F.struct(
        normalize_path(e["file"]).alias("file"), strip(e["symbol"]).alias("symbol"), start(e).alias("line"),
        start(e).alias("code_start"), F.coalesce(e["code_end"], e["line"], start(e)).alias("code_end")))


def canonical_options(options: Column, phase: Column) -> Column:
    return F.transform(options, lambda o: F.struct(
        F.when(_absent(o["phase"]), phase).otherwise(o["phase"]).alias("phase"), strip(o["title"]).alias("title"), strip(o["text"]).alias("text"), canonical_evidence(o["evidence"]).alias("evidence")))


def canonical_steps(steps: Column) -> Column:
    return F.transform(steps, lambda s: F.struct(
        s["number"].alias("number"), s["phase"].alias("phase"), strip(s["title"]).alias("title"), strip(s["text"]).alias("text"),
        canonical_evidence(s["evidence"]).alias("evidence"), canonical_options(s["options"], s["phase"]).cast(f"array<{OPTION}>").alias("options")))


def workflow_failures(features: DataFrame, workflows: DataFrame, files: DataFrame, source_hash: str, tags: Tags = Tags()) -> DataFrame:
    """``at, id, message, workflow`` for every feature: its workflow's first problem, null if it is accepted."""
    docs = workflows.select(F.col("feature_id").alias("doc_id"), "json")
    rows = features.select("at", "id", F.col("title").alias("feature_title")).join(docs, F.col("id") == F.col("doc_id"), "left")
    rows = rows.withColumn("w", F.when(F.startswith("json", F.lit("{")), F.from_json("json", WORKFLOW)))
    w, name = (lambda c: F.col(f"w.{c}")), F.col("id")
    said = lambda text: F.concat(F.lit("workflow "), name, F.lit(f" {text}"))
    head = first_failure(
        (F.col("w").isNull(), F.concat(F.lit("workflow file is missing or invalid for "), name)),
        (_differs(w("schema"), tags.workflow_schema), said("has an unsupported schema")),
        (_differs(w("source_hash"), source_hash), said("source_hash does not match the current snapshot")),
        (_differs(w("generator"), tags.workflow_generator), said(f"generator must be {tags.workflow_generator}")),
        (_differs(w("feature_id"), name) | _differs(w("title"), F.col("feature_title")), said("does not match its feature")),
        (strip(w("summary")) == "", said("needs a summary")),
        (_not(w("status").isin(*STATUSES)) | (w("status").isin("partial", "pending") & (strip(w("missing_coverage")) == "")), said("has an unsupported status")),
        (F.coalesce(F.size(w("evidence")), F.lit(0)) < 1, "a non-empty evidence list is required"),
    )
    # A workflow is parsed for its parts, exploded once, and once more for its canonical form.
    parts = rows.where("w is not null").select(F.col("id").alias("feature_id"), F.explode(_parts(F.col("w"))).alias("p")).select("feature_id", "p.place", "p.e", "p.said")
    nested = evidence_failures(parts, files)
    inner = earliest(nested, ["feature_id"], F.col("place")).select(F.col("feature_id").alias("inner_id"), F.col("message").alias("inner"))
    canonical = F.struct(
        F.lit(tags.workflow_schema).alias("schema"), F.lit(source_hash).alias("source_hash"), F.lit(tags.workflow_generator).alias("generator"), name.alias("feature_id"),
        F.col("feature_title").alias("title"), strip(w("summary")).alias("summary"), w("status").alias("status"), strip(w("missing_coverage")).alias("missing_coverage"),
        canonical_evidence(w("evidence")).alias("evidence"), F.coalesce(canonical_steps(w("steps")), F.array()).alias("steps"))
    checked = rows.withColumn("head", head).join(inner, F.col("id") == F.col("inner_id"), "left").withColumn("canonical", canonical)
    message = F.coalesce(F.col("head"), F.col("inner"), first_failure(
        (~valid_workflow(F.col("canonical"), tags), said("is incomplete or invalid")),
        (~same_json(F.col("json"), F.to_json("canonical")), said("is not in canonical form"))))
    return checked.select("at", "id", message.alias("message"), F.when(message.isNull(), F.col("canonical")).alias("workflow"))


def validate(index: DataFrame, workflows: DataFrame, files: DataFrame, source_hash: str, tags: Tags = Tags()) -> tuple[DataFrame, DataFrame]:
    """``(report, accepted)``: one row ``error`` (empty if all is accepted), and one row per feature.

    A broken index hides its workflows' problems.  The error is one value: for catalogs with very many
    problems see :func:`error_chunks`.
    """
    _, features = index_members(index)
    each = workflow_failures(features, workflows, files, source_hash, tags)
    found = index_failure(index, source_hash, tags).select(F.col("error").alias("index_error"))
    rest = joined(each, "at").select("errors")
    report = found.crossJoin(rest).crossJoin(_missing(index)).select(F.coalesce("none", "index_error", "errors").alias("error"))  # one row each
    return report, each


def _missing(index: DataFrame) -> DataFrame:
    """One row ``none``: the message if there is no index, or none that can be read."""
    return index_head(index).agg(F.when(F.count("json") == 0, F.lit("features catalog is missing or invalid")).alias("none"))


def error_chunks(index: DataFrame, workflows: DataFrame, files: DataFrame, source_hash: str, tags: Tags = Tags(), rows: int = 1000) -> DataFrame:
    """The error of :func:`validate` as rows ``chunk, offset, text``, in order its whole text; no row if all is accepted."""
    _, features = index_members(index)
    each = workflow_failures(features, workflows, files, source_hash, tags).select(F.col("at").cast("long").alias("at"), "message")
    whole = index_failure(index, source_hash, tags).crossJoin(_missing(index)).select(F.coalesce("none", "error").alias("whole"))  # one row each
    # What is wrong with the index stands alone: it comes instead of all others.
    said = each.crossJoin(F.broadcast(whole)).where("whole is null").select("at", "message")
    said = said.unionByName(whole.where("whole is not null").select(F.lit(-1).cast("long").alias("at"), F.col("whole").alias("message")))
    return joined_chunks(said, "at", rows=rows)


def status_counts(report: DataFrame, accepted: DataFrame) -> DataFrame:
    """One row of counts by status; all zero, and ``needs_work``, if anything was refused."""
    counts = accepted.agg(F.count("*").alias("features"), *[F.count_if(F.col("workflow.status") == s).alias(s) for s in STATUSES])
    fine = F.coalesce(F.col("error"), F.lit("")) == ""
    names = ["features", *STATUSES]
    return counts.crossJoin(report).select(*[F.when(fine, F.col(c)).otherwise(0).alias(c) for c in names], (~fine).alias("needs_work"), F.coalesce("error", F.lit("")).alias("error"))
