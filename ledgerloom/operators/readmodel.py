"""The lenient read model: what an explorer shows of a catalog, valid or not.

Rules differ from the strict gate on purpose: an invalid workflow becomes a pending
placeholder, a feature with an unknown area keeps null area fields, and of areas
with the same id the last one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.shape import valid_workflow
from ledgerloom.operators.validate import index_head, index_rows
from ledgerloom.schemas import AREA, EVIDENCE, FEATURE, INDEX, WORKFLOW, Tags

PLACEHOLDER = "Workflow file is missing or invalid."


def _or(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else empty."""
    given = [F.lit(v) if isinstance(v, str) else F.nullif(v, F.lit("")) for v in values]
    return F.coalesce(*given, F.lit(""))


def manifest_state(index: DataFrame, source_hash: str = "", tags: Tags = Tags()) -> DataFrame:
    """One row ``state, source_hash`` of an index, a document ``(json, error)`` or its rows, that may be missing."""
    index = index_head(index)
    listed = lambda name: F.startswith(F.coalesce(F.get_json_object("json", f"$.{name}"), F.lit("")), F.lit("["))
    typed = F.from_json("json", INDEX)
    state = F.when(F.col("error").isNotNull(), F.concat(F.lit("invalid_features: "), F.col("error"))) \
        .when(F.col("json").isNull() | (F.col("json") == "null"), "missing_features") \
        .when(~F.startswith("json", F.lit("{")) | ~typed["schema"].eqNullSafe(F.lit(tags.index_schema)), "legacy_features: regenerate the catalog") \
        .when(~listed("areas") | ~listed("features"), "invalid_features") \
        .when((F.lit(source_hash) != "") & ~typed["source_hash"].eqNullSafe(F.lit(source_hash)), "stale_features").otherwise("ready")
    one = index.select(state.alias("state"), typed["source_hash"].alias("source_hash"))
    return one.agg(F.coalesce(F.first("state"), F.lit("missing_features")).alias("state"), F.first("source_hash").alias("source_hash"))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("last")).select(key, "last.*")


def _hoisted(evidence: Column) -> list[Column]:
    """Place of the first evidence, as fields of the record that cites it."""
    first = F.get(evidence, F.lit(0))
    line = lambda name: F.coalesce(F.nullif(first[name], F.lit(0)), first["line"], F.lit(0))
    return [_or(first["file"]).alias("file"), _or(first["symbol"]).alias("symbol"), line("code_start").alias("code_start"), line("code_end").alias("code_end")]


def option_views(options: Column, phase: Column) -> Column:
    def view(o: Column) -> Column:
        evidence = F.coalesce(o["evidence"], F.array().cast(f"array<{EVIDENCE}>"))
        return F.struct(_or(o["phase"], phase).alias("phase"), _or(o["title"], F.get(evidence, F.lit(0))["symbol"], "Option").alias("title"),
                        _or(o["text"]).alias("text"), evidence.alias("evidence"), *_hoisted(evidence))

    return F.coalesce(F.transform(options, view), F.array())


def step_views(steps: Column) -> Column:
    def view(s: Column, i: Column) -> Column:
        evidence = F.coalesce(s["evidence"], F.array().cast(f"array<{EVIDENCE}>"))
        phase = _or(s["phase"], "backend")
        return F.struct(
            F.coalesce(F.nullif(s["number"], F.lit(0)), i + 1).cast("int").alias("number"), phase.alias("phase"),
            _or(s["title"], F.get(evidence, F.lit(0))["symbol"], F.concat(F.lit("Step "), (i + 1).cast("string"))).alias("title"),
            _or(s["text"]).alias("text"), evidence.alias("evidence"), option_views(s["options"], phase).alias("options"), *_hoisted(evidence))

    return F.coalesce(F.transform(steps, view), F.array())


def workflow_views(features: DataFrame, areas: DataFrame, workflows: DataFrame, tags: Tags = Tags()) -> DataFrame:
    """One view per feature, in order of ``at``.

    ``features (at, id, area_id, title, audience, summary)``, ``areas (at, id, title,
    perspective)``, ``workflows (feature_id, json)``.
    """
    known = last_of(areas.select("id", "at", "title", "perspective"), "id", "at")
    known = known.select(F.col("id").alias("k_id"), F.col("title").alias("k_title"), F.col("perspective").alias("k_perspective"))
    docs = workflows.select(F.col("feature_id").alias("d_id"), F.from_json("json", WORKFLOW).alias("typed"))
    rows = features.join(known, F.col("area_id") == F.col("k_id"), "left").join(docs, F.col("id") == F.col("d_id"), "left")
    good = F.coalesce(valid_workflow(F.col("typed"), tags), F.lit(False))
    rows = rows.withColumn("w", F.when(good, F.col("typed")))
    steps = step_views(F.col("w.steps"))
    return rows.select(
        "at", "id", _or(F.col("w.title"), F.col("title")).alias("title"), _or(F.col("w.summary"), F.col("summary")).alias("summary"),
        F.col("k_id").alias("area_id"), F.col("k_title").alias("area_title"), F.coalesce("k_perspective", F.lit("technical")).alias("perspective"),
        F.coalesce("audience", F.lit("developer")).alias("audience"), F.coalesce("w.status", F.lit("pending")).alias("status"), steps.alias("steps"),
        F.coalesce("w.evidence", F.array()).alias("evidence"), F.size(steps).cast("long").alias("step_count"),
        F.when(F.col("w").isNull(), PLACEHOLDER).otherwise(_or(F.col("w.missing_coverage"))).alias("missing_coverage"))


def index_tables(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas and features that an index, a document or its rows, lists; members that are no objects are left out."""
    rows = index_rows(index)

    def members(name: str, kind: str) -> DataFrame:
        own = rows.where((F.col("part") == name) & F.startswith("raw", F.lit("{")))
        return own.select(F.col("at").cast("int").alias("at"), F.from_json("raw", kind).alias("x")).select("at", "x.*")

    return members("areas", AREA), members("features", FEATURE)


def cited_files(views: DataFrame) -> DataFrame:
    """Distinct ``path`` of all evidence: of workflows, their steps and their options."""
    own = views.select(F.explode("evidence.file").alias("path"))
    of_steps = views.select(F.explode(F.flatten("steps.evidence")).alias("e")).select(F.col("e.file").alias("path"))
    options = views.select(F.explode(F.flatten("steps.options")).alias("o"))
    of_options = options.select(F.explode("o.evidence").alias("e")).select(F.col("e.file").alias("path"))
    return own.unionByName(of_steps).unionByName(of_options).where("path <> ''").distinct()


def used_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The inventory rows of cited ``paths (path)``, in order of path."""
    return files.join(paths.distinct(), "path", "left_semi").orderBy("path")


def first_used_file(used: DataFrame) -> DataFrame:
    """The first listed file, by which a viewer finds where sources are served; no row if none is listed."""
    return used.agg(F.min("path").alias("path")).where("path is not null")


def counts_by_status(views: DataFrame) -> DataFrame:
    """One row ``ready_count, partial_count, pending_count``."""
    names = {"ready_count": "generated", "partial_count": "partial", "pending_count": "pending"}
    return views.agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in names.items()])


def is_stale(documents: DataFrame, recorded: str, current: DataFrame) -> DataFrame:
    """``documents`` with ``stale``: a current hash is known and the recorded one differs."""
    now = F.coalesce("source_hash", F.lit(""))
    return documents.crossJoin(F.broadcast(current.select("source_hash"))) \
        .withColumn("stale", (now != "") & ~F.col(recorded).eqNullSafe(F.col("source_hash"))).drop("source_hash")  # current: one row
