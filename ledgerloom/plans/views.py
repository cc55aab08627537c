"""Registered queries of the strict gate, the read model and the viewer, over whole driver tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import text
from ledgerloom.operators import flow, health, inventory, locate, ranges, readmodel, search, validate
from ledgerloom.plans import mapped
from ledgerloom.plans.mapped import table
from ledgerloom.schemas import OPTION, Tags
from ledgerloom.sources.documents import parse_documents
from ledgerloom.sources.members import SCHEMA, read_members, write_members
from ledgerloom.sources.shared import fresh_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TAGS = Tags()


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory(mapped.files(spark, sf_dir), F.col("path"), F.col("content"))


def _named(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("string"))


# --- code health


def _branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module per document: a function with branches around an inner one; some do not parse, some are not readable."""
    body = F.concat(
        F.lit("def f(a, b):\n"), F.repeat(F.lit("    if a and b:\n        a = b\n"), (F.col("doc_id") % 20).cast("int")), F.lit("    def g():\n"),
        F.repeat(F.lit("        assert a or b\n"), (F.col("doc_id") % 3).cast("int")), F.lit("        return a\n    return g\n"))
    content = F.when(F.col("doc_id") % 7 == 0, "def (:\n").when(F.col("doc_id") % 11 != 0, body)
    folder = F.when(F.col("doc_id") % 2 == 0, "src/").when(F.col("doc_id") % 4 == 1, "tests/").otherwise("docs/")
    return table(spark, sf_dir, "documents").select(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), content.alias("content"))


@_query
def function_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.complexities(_branching(spark, sf_dir))


@_query
def health_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.totals(health.health(_branching(spark, sf_dir)))


@_query
def targeted_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = health.targeted(_branching(spark, sf_dir), "src", tests=True)
    found = health.health(files, limits=health.Limits(complexity=25))
    return found.select("path", "metric", F.coalesce("value", F.lit(0)).alias("value"))


# --- the index and its rules


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations and customers with ``at``, their place from 0 in order of their keys."""
    kinds = (("nation", "n_nationkey"), ("customer", "c_custkey"))
    nations, customers = (ranges.placed(table(spark, sf_dir, name), [F.col(key).asc()], "at").withColumn("at", F.col("at") - 1) for name, key in kinds)
    return nations, customers


def _index(members: tuple[DataFrame, DataFrame], faulty_areas: bool = False, faulty_features: bool = False, schema: str = TAGS.index_schema) -> DataFrame:
    """The rows of one index document: nations are its areas, customers its features; some of either break a rule."""
    nations, customers = members
    k = F.col("n_nationkey")
    fault = lambda at, wrong, right: F.when(F.lit(faulty_areas) & (k == at), wrong).otherwise(right)
    side = F.when(k % 2 == 0, "product").otherwise("technical")
    area = F.struct(
        fault(3, F.lit("Bad Id"), fault(5, F.lit("area_4"), _named("area_", "n_nationkey"))).alias("id"), F.col("n_name").alias("title"),
        fault(13, F.lit("  "), F.lit("About it.")).alias("summary"), fault(7, F.lit("sideways"), fault(11, F.lit("product"), side)).alias("perspective"),
        fault(9, F.lit(-1), fault(11, F.lit(10), k.cast("int"))).alias("order"))
    c = F.col("c_custkey") % 10
    wrong = lambda rest, bad, good: F.when(F.lit(faulty_features) & (c == rest), bad).otherwise(good)
    name = _named("f", "c_custkey")
    audience = F.get(F.array(*[F.lit(a) for a in ("user", "admin", "developer", "operator")]), (F.col("c_custkey") % 4).cast("int"))
    feature = F.struct(
        wrong(0, _named("F", "c_custkey"), name).alias("id"), wrong(1, F.lit("nowhere"), _named("area_", "c_nationkey")).alias("area_id"),
        wrong(3, F.concat(F.lit(" "), F.col("c_name")), F.col("c_name")).alias("title"), wrong(2, F.lit("nobody"), audience).alias("audience"),
        F.col("c_mktsegment").alias("summary"), wrong(4, F.lit("elsewhere.yaml"), F.concat(F.lit(f"{TAGS.state_dir}/workflows/"), name, F.lit(".yaml"))).alias("workflow_path"))
    listed = nations.select(F.lit("areas").alias("part"), "at", F.to_json(area).alias("raw")).unionByName(customers.select(F.lit("features").alias("part"), "at", F.to_json(feature).alias("raw")))
    return _head(nations.sparkSession, schema).unionByName(listed.withColumn("error", F.lit(None).cast("string")))


def _head(spark: SparkSession, schema: str = TAGS.index_schema) -> DataFrame:
    """The head of an index document whose members are rows of their own."""
    head = json.dumps({"schema": schema, "source_hash": "h", "generator": TAGS.index_generator, "areas": [], "features": []})
    return spark.createDataFrame([("head", 0, head, None)], SCHEMA)


@_query
def area_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas, _ = validate.index_members(_index(_numbered(spark, sf_dir), faulty_areas=True))
    return validate.area_failures(areas)


@_query
def feature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is written as one document and read in splits."""
    path = f"{fresh_path(spark, 'index')}.yaml"
    write_members(_index(_numbered(spark, sf_dir), faulty_features=True), path)
    # Stored: the rules look at the members several times.
    areas, features = validate.index_members(stored(read_members(spark, path, split=1 << 16), "members"))
    return validate.feature_failures(features, areas, TAGS)


@_query
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of an index that was written as one document, read in splits."""
    path = f"{fresh_path(spark, 'index')}.yaml"
    write_members(_index(_numbered(spark, sf_dir)), path)
    found = read_members(spark, path, split=1 << 16)
    return found.select("part", "at", *[F.get_json_object("raw", f"$.{c}").alias(c) for c in ("id", "title", "summary", "schema")], "error")


@_query
def index_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first problem of several indexes."""
    members = _numbered(spark, sf_dir)
    given = {"fine": ({}, "h"), "areas": ({"faulty_areas": True}, "h"), "features": ({"faulty_features": True}, "h"),
             "hash": ({"faulty_areas": True}, "other"), "schema": ({"schema": "older@1", "faulty_features": True}, "other")}
    found = [validate.index_failure(_index(members, **how), now, TAGS).select(F.lit(name).alias("variant"), "error") for name, (how, now) in given.items()]
    return reduce(DataFrame.unionByName, found)


@_query
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _numbered(spark, sf_dir)
    fine, older = _index(members), _index(members, schema="older@1")
    bad = fine.where("part = 'head'").select(F.lit("error").alias("part"), "at", F.lit(None).cast("string").alias("raw"), F.lit("broken").alias("error"))
    no_list = fine.where("part <> 'features'").withColumn("raw", F.when(F.col("part") == "head", F.replace("raw", F.lit('"features":'), F.lit('"others":'))).otherwise(F.col("raw")))
    given = {"ready": (fine, "h"), "stale": (fine, "now"), "unknown now": (fine, ""), "missing": (fine.where("part = 'none'"), "h"), "older": (older, "h"), "unreadable": (fine.unionByName(bad), "h"), "no list": (no_list, "h")}
    found = [readmodel.manifest_state(index, now, TAGS).select(F.lit(name).alias("variant"), "state") for name, (index, now) in given.items()]
    return reduce(DataFrame.unionByName, found)


@_query
def document_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML or JSON document per order, some broken."""
    key = F.col("o_orderkey")
    ending = F.when(key % 5 == 0, ".json").otherwise(".yaml")
    yaml = F.concat(F.lit("# a comment\nid: "), key.cast("string"), F.lit("\ntags:\n  - a\n  - 'b: c'\n"))
    content = F.when(key % 7 == 0, "id: [1,\n").when(key % 5 == 0, F.concat(F.lit('{"id": '), key.cast("string"), F.lit(', "tags": ["a", "b: c"]}'))).otherwise(yaml)
    files = table(spark, sf_dir, "orders").select(F.concat(key.cast("string"), ending).alias("path"), content.cast("binary").alias("content"))
    found = parse_documents(files)
    return found.select("path", F.get_json_object("json", "$.id").cast("long").alias("id"), F.get_json_object("json", "$.tags[1]").alias("tag"), F.col("error").isNotNull().alias("broken"))


# --- evidence and workflows


def _cited(file: Column, symbol: Column | str = "s", start: Column | int = 1, stop: Column | int = 1) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(file.alias("file"), as_column(symbol).alias("symbol"), as_column(start).cast("int").alias("line"), as_column(start).cast("int").alias("code_start"), as_column(stop).cast("int").alias("code_end"))


@_query
def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 8
    file = F.when(case == 1, "..\\x").when(case == 2, "/abs").when(case == 3, "a/../missing.py").when(case == 7, F.concat(F.lit(".//"), "path")).otherwise(F.col("path"))
    symbol, start, stop = F.when(case == 4, " ").otherwise("s"), F.when(case == 5, 3).otherwise(1), F.when(case == 5, 2).when(case == 6, 99_999).otherwise(1)
    place = F.struct(*[F.lit(0).alias(n) for n in ("section", "step", "branch", "option", "evidence")])
    rows = mapped.files(spark, sf_dir).select(F.col("doc_id").alias("feature_id"), place.alias("place"), _cited(file, symbol, start, stop).alias("e"))
    return validate.evidence_failures(rows, _inventory(spark, sf_dir)).select("feature_id", "message")


def _workflow(options: Column, status: Column, missing: Column) -> Column:
    """A workflow of three steps about a row's own file, as JSON."""
    cited = F.array(_cited(F.col("path")))
    step = lambda number, phase, more: F.struct(F.lit(number).alias("number"), F.lit(phase).alias("phase"), F.lit(f"step {number}").alias("title"), F.lit("does it").alias("text"), cited.alias("evidence"), more.alias("options"))
    none = F.lit(None).cast(f"array<{OPTION}>")
    return F.to_json(F.struct(
        F.lit(TAGS.workflow_schema).alias("schema"), F.lit("h").alias("source_hash"), F.lit(TAGS.workflow_generator).alias("generator"), _named("f", "doc_id").alias("feature_id"),
        F.lit("t").alias("title"), F.lit("s").alias("summary"), status.alias("status"), missing.alias("missing_coverage"), cited.alias("evidence"),
        F.array(step(1, "backend", none), step(2, "persistence", options.cast(f"array<{OPTION}>")), step(3, "response", none)).alias("steps")))


def _options(count: Column, phase: Column) -> Column:
    """Branches that cite a file of their own, null if there are none."""
    one = lambda i: F.struct(phase.alias("phase"), F.concat(F.lit("branch "), i.cast("string")).alias("title"), F.lit("or so").alias("text"), F.array(_cited(F.col("path"), "branch_symbol")).alias("evidence"))
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), one))


@_query
def branches_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows of every status with up to three branches; one branch, a branch without a phase and pending steps are refused."""
    status = F.when(F.col("doc_id") % 3 == 0, "generated").when(F.col("doc_id") % 3 == 1, "partial").otherwise("pending")
    phase = F.when(F.col("doc_id") % 5 != 0, "external")
    rows = mapped.files(spark, sf_dir)
    document = _workflow(_options((F.col("doc_id") % 4).cast("int"), phase), status, F.when(F.col("doc_id") % 3 == 0, "").otherwise("tests"))
    features = rows.select(F.col("doc_id").alias("at"), _named("f", "doc_id").alias("id"), F.lit("t").alias("title"))
    found = validate.workflow_failures(features, rows.select(_named("f", "doc_id").alias("feature_id"), document.alias("json")), _inventory(spark, sf_dir), "h", TAGS)
    return found.select(F.col("at").alias("doc_id"), "message", F.get("workflow.steps", F.lit(1))["options"]["title"].alias("titles")).withColumn("titles", F.array_join("titles", ","))


@_query
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status where all is accepted, and where something is refused."""
    rows = mapped.files(spark, sf_dir).where("content <> ''")
    status = F.when(F.col("doc_id") % 2 == 0, "generated").otherwise("partial")
    document = _workflow(_options(F.lit(0), F.lit("backend")), status, F.when(F.col("doc_id") % 2 == 0, "").otherwise("tests"))
    features = rows.select(F.col("doc_id").alias("at"), _named("f", "doc_id").alias("id"), F.lit("t").alias("title"))
    flows = rows.select(_named("f", "doc_id").alias("feature_id"), document.alias("json"))
    members, files = _numbered(spark, sf_dir), _inventory(spark, sf_dir)
    each = validate.workflow_failures(features, flows, files, "h", TAGS)
    out = []
    for name, given in (("accepted", _index(members)), ("refused", _index(members, faulty_areas=True))):
        error = validate.index_failure(given, "h", TAGS)
        out.append(validate.status_counts(error, each).select(F.lit(name).alias("variant"), "*"))
    return out[0].unionByName(out[1])


@_query
def catalog_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined errors of a catalog with a feature per document; some workflows are missing, some of an older snapshot, some wrong."""
    rows = ranges.placed(mapped.files(spark, sf_dir), [F.col("doc_id").asc()], "at").withColumn("at", F.col("at") - 1)
    name, nothing = _named("f", "doc_id"), F.lit(None).cast("string").alias("error")
    feature = F.struct(name.alias("id"), F.lit("a").alias("area_id"), F.lit("t").alias("title"), F.lit("user").alias("audience"), F.lit("s").alias("summary"),
                       F.concat(F.lit(f"{TAGS.state_dir}/workflows/"), name, F.lit(".yaml")).alias("workflow_path"))
    area = json.dumps({"id": "a", "title": "A", "summary": "About it.", "perspective": "product", "order": 0})
    index = _head(spark).unionByName(spark.createDataFrame([("areas", 0, area, None)], SCHEMA)).unionByName(rows.select(F.lit("features").alias("part"), "at", F.to_json(feature).alias("raw"), nothing))
    text = _workflow(_options((F.col("doc_id") % 4).cast("int"), F.lit("external")), F.lit("partial"), F.lit("tests"))
    text = F.when(F.col("doc_id") % 17 == 0, F.replace(text, F.lit('"source_hash":"h"'), F.lit('"source_hash":"older"'))).otherwise(text)
    flows = rows.where("doc_id % 13 <> 0").select(name.alias("feature_id"), text.alias("json"))
    found = validate.error_chunks(index, flows, _inventory(spark, sf_dir), "h", TAGS, rows=100)
    return found.select("chunk", "offset", "text")


# --- the read model


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a feature per document: some have a workflow, some a broken one or none, some an unknown area."""
    rows = mapped.files(spark, sf_dir)
    case = F.col("doc_id") % 4
    document = _workflow(_options(F.when(case == 0, 2).otherwise(0), F.lit("external")), F.lit("partial"), F.lit("tests"))
    flows = rows.where(case != 2).select(_named("f", "doc_id").alias("feature_id"), F.when(case == 1, "[1, 2").otherwise(document).alias("json"))
    features = rows.select(
        F.col("doc_id").alias("at"), _named("f", "doc_id").alias("id"), F.concat(F.lit("a"), (F.col("doc_id") % 5).cast("string")).alias("area_id"), _named("Title ", "doc_id").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, "admin").alias("audience"), F.lit("Feature summary").alias("summary"))
    areas = spark.createDataFrame([(k, f"a{k % 4}", f"Area {k}", ("product", "technical")[k % 2]) for k in range(6)], "at int, id string, title string, perspective string")
    return readmodel.workflow_views(features, areas, flows, TAGS)


@_query
def workflow_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("steps", F.lit(0))
    options = F.get("steps", F.lit(1))["options"]
    return _views(spark, sf_dir).select(
        "id", "title", "summary", "area_id", "area_title", "perspective", "audience", "status", "step_count", "missing_coverage", first["number"].alias("first_number"),
        first["file"].alias("first_file"), first["code_end"].alias("first_end"), F.array_join(options["title"], ",").alias("branches"), F.get(options, F.lit(0))["symbol"].alias("branch_symbol"))


@_query
def view_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three queries in an index of all views' texts: one in branches, one in files, one in titles."""
    index = search.index_texts(_views(spark, sf_dir))
    found = [search.indexed_search(index, query).select(F.lit(query).alias("query"), "id") for query in ("BRANCH_SYMBOL", " 0007", "title 12")]
    return reduce(DataFrame.unionByName, found)


@_query
def view_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.used_files(readmodel.cited_files(_views(spark, sf_dir)), _inventory(spark, sf_dir)).select("path", "sha256")


@_query
def first_source_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.first_used_file(view_files(spark, sf_dir))


@_query
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _views(spark, sf_dir)
    return readmodel.counts_by_status(views).crossJoin(search.summary(views, "branch_symbol"))  # one row each


@_query
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mapped.files(spark, sf_dir)
    path = files.where("doc_id = 7").select("path")
    return locate.open_sources(files, path).select("path", F.sha2("content", 256).alias("content_sha256"))


# --- the viewer


@_query
def section_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that tie keep their place in the input, here the last nation first."""
    areas = mapped.areas(spark, sf_dir).withColumn("order", F.col("order") % 2).withColumn("at", -F.col("id"))
    return search.sections(areas, mapped.features(spark, sf_dir)).select("id", "perspective", "place", F.size("cards").cast("long").alias("n_cards"))


@_query
def horizontal_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = mapped.steps(spark, sf_dir)
    lines = flow.connectors(flow.edges(steps), flow.nodes(steps, flow.HORIZONTAL), flow.HORIZONTAL)
    point = lambda k: (F.col("points")[k]["x"].alias(f"x{k}"), F.col("points")[k]["y"].alias(f"y{k}"))
    return lines.select("workflow_id", "from_step", "from_option", "to_step", "to_option", *point(0), *point(1), *point(2), *point(3))


@_query
def arrow_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = mapped.steps(spark, sf_dir)
    lines = flow.connectors(flow.edges(steps), flow.nodes(steps, flow.VERTICAL), flow.VERTICAL).withColumn("head", flow.arrow_head(F.col("points")))
    corner = lambda k: (F.round(F.col("head")[k]["x"], 6).alias(f"x{k}"), F.round(F.col("head")[k]["y"], 6).alias(f"y{k}"))
    return lines.select("workflow_id", "from_step", "from_option", "to_step", "to_option", *corner(0), *corner(1), *corner(2))


#: Narrow letters, as a font would have them; all others are one wide.
NARROW = {"i": 0.5, "l": 0.5, "t": 0.5}


@_query
def wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.wrapped(F.col("text"), 24.0, NARROW, 1.0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(lines, "|").alias("lines"), F.array_join(F.slice(lines, 1, 2), "|").alias("clamped"))


PATHS = ("a/b.py", "./a//b.py", "a/../b", "../x/./y", "a\\b\\..\\c", "/abs/../d", ".", "a/b/../..")


@_query
def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("event_id") % len(PATHS)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.normalize_path(given).alias("path"))


@_query
def ignore_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ignore file per nation."""
    content = F.concat(F.lit("# .agents\n  /.agents/ \n\n*.pyc\n"), F.when(F.col("n_nationkey") % 2 == 0, ".cursor\n").otherwise("cursor\n"), F.lower("n_name"))
    return inventory.ignore_warnings(table(spark, sf_dir, "nation").select(content.alias("content")), (".agents", ".cursor", "france"))


@_query
def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.by_path(_inventory(spark, sf_dir)).select("path", "line_count")
