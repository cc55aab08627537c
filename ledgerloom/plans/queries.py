"""Registered queries of the catalog engine, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import paths, text
from ledgerloom.operators import flow, health, inventory, locate, readmodel, rules, search, shape, validate
from ledgerloom.plans import jobs, mapped, views as view_queries
from ledgerloom.plans.mapped import table
from ledgerloom.schemas import OPTION

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory(mapped.files(spark, sf_dir), F.col("path"), F.col("content"))


@_query
def inventory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir)


@_query
def filtered_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path is listed twice, with either slash; texts with a NUL byte and excluded paths are listed too."""
    files = mapped.files(spark, sf_dir).select("path", "content")
    again = files.select(F.translate("path", "/", "\\").alias("path"), "content")
    binary = files.select(F.concat(F.lit("bin/"), "path").alias("path"), F.concat(F.lit("\x00"), "content").alias("content"))
    excluded = files.select(F.concat(F.lit("lib/node_modules/"), "path").alias("path"), "content")
    return inventory.filtered_inventory(files.unionByName(again).unionByName(binary).unionByName(excluded)).select("path", "size", "language")


@_query
def snapshot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.fingerprint(_inventory(spark, sf_dir))


@_query
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inventory.snapshot_rows(_inventory(spark, sf_dir))
    return rows.groupBy("source_hash").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@_query
def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.python_files(_inventory(spark, sf_dir)).select("path", "line_count")


@_query
def language_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@_query
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).alias("line_count"))


@_query
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.source_lines(mapped.files(spark, sf_dir))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation per document: its last line's first word, said to be in lines 2 to 3."""
    last = F.element_at(text.split_lines(F.col("content")), -1)
    return mapped.files(spark, sf_dir).select(F.col("path").alias("file"), F.split_part(last, F.lit(" "), F.lit(1)).alias("symbol"),
                                              F.lit(2).alias("code_start"), F.lit(3).alias("code_end"))


@_query
def relocate_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.relocate(_evidence(spark, sf_dir), mapped.files(spark, sf_dir)).select("file", "symbol", "start", "end", "relocated")


@_query
def highlighted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = locate.relocate(_evidence(spark, sf_dir), mapped.files(spark, sf_dir))
    return locate.highlighted_lines(found, mapped.files(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("active"), F.min("number").alias("first_active"))


@_query
def evidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped.files(spark, sf_dir).withColumn("a", (1 + F.col("doc_id") % 3).cast("int")).withColumn("b", (1 + F.col("doc_id") % 4).cast("int"))
    return rows.select("doc_id", locate.evidence_label(F.col("path"), F.col("a"), F.col("b")).alias("label"), locate.editor_link("/srv/repo", F.col("path"), F.col("a")).alias("link"),
                       text.counted(F.col("a"), "source reference", "source references").alias("references"))


@_query
def evidence_range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("doc_id") % 3 + 1).cast("long")
    cited = mapped.files(spark, sf_dir).select(F.col("path").alias("file"), start.alias("code_start"), (start + 4).alias("code_end"))
    return locate.range_violations(cited, _inventory(spark, sf_dir))


@_query
def known_file_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped.files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "path")


@_query
def unknown_file_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped.files(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "path")


@_query
def orphan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = mapped.areas(spark, sf_dir).where(F.col("order") != 3)
    return validate.orphan_features(mapped.features(spark, sf_dir), known).select("id", "area_id", "title")


@_query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodel.counts_by_status(mapped.features(spark, sf_dir))


@_query
def last_area_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("title"))
    return readmodel.last_of(rows, "id", "at")


@_query
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where(search.matches(F.array("text", "lang", "source"), "License")).select("doc_id", "source")


@_query
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.summary(mapped.features(spark, sf_dir), "BUILD", F.array("title", "summary"))


@_query
def area_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.placed_areas(mapped.areas(spark, sf_dir), "id").select("id", "perspective", "place")


@_query
def catalog_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = mapped.features(spark, sf_dir).where(search.matches(F.array("title", "summary"), "auto"))
    found = search.sections(mapped.areas(spark, sf_dir), shown)
    return found.select("id", "title", "perspective", F.size("cards").cast("long").alias("n_cards"), F.array_join(F.transform("cards", lambda c: c["id"].cast("string")), ",").alias("card_ids"))


@_query
def first_and_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapped.features(spark, sf_dir)
    return search.first_workflow(rows).select("id", "title").unionByName(search.selected(rows, "7").select("id", "title"))


@_query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "copy")


@_query
def step_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as workflows whose steps are sound but for their numbers."""
    cited = F.array(F.struct(F.lit("a.py").alias("file"), F.lit("s").alias("symbol"), F.lit(1).alias("line"), F.lit(1).alias("code_start"), F.lit(1).alias("code_end")))
    step = F.struct("turn", (F.col("turn") + 1).cast("int").alias("number"), F.lit("backend").alias("phase"), F.lit("t").alias("title"), F.lit("x").alias("text"),
                    cited.alias("evidence"), F.lit(None).cast(f"array<{OPTION}>").alias("options"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.select("conv_id", shape.valid_steps(F.col("steps")).alias("numbered"), F.size(readmodel.step_views(F.col("steps"))).cast("long").alias("step_count"))


@_query
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.edges(mapped.steps(spark, sf_dir))


@_query
def vertical_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.nodes(mapped.steps(spark, sf_dir), flow.VERTICAL)


@_query
def horizontal_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.nodes(mapped.steps(spark, sf_dir), flow.HORIZONTAL)


@_query
def flow_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.bounds(vertical_layout(spark, sf_dir))


@_query
def flow_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.fit(flow_bounds(spark, sf_dir), 1200, 900)


@_query
def flow_first_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.first_view(vertical_layout(spark, sf_dir), 1200, 150)


@_query
def flow_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = mapped.steps(spark, sf_dir)
    lines = flow.connectors(flow.edges(steps), flow.nodes(steps, flow.VERTICAL), flow.VERTICAL)
    point = lambda k: (F.col("points")[k]["x"].alias(f"x{k}"), F.col("points")[k]["y"].alias(f"y{k}"))
    return lines.select("workflow_id", "from_step", "from_option", "to_step", "to_option", *point(0), *point(1), *point(2), *point(3))


@_query
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    screen = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("point_id"), F.col("conv_id").alias("workflow_id"),
                          ((F.col("conv_id") * 37 + F.col("turn") * 13) % 400 - 200.0).alias("sx"), (F.col("turn") * 170.0 + F.col("conv_id") % 90).alias("sy"))
    point = flow.canvas_point(F.col("sx"), F.col("sy"), F.lit(40.0), F.lit(-20.0), F.lit(0.5))
    points = screen.select("point_id", "workflow_id", point["x"].alias("px"), point["y"].alias("py"))
    return flow.hits(points, vertical_layout(spark, sf_dir))


@_query
def completeness_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as steps: roles are phases, a fifth step brings a request."""
    phase = F.when(F.col("role") == "user", "user_action").when(F.col("role") == "assistant", "response").otherwise("backend")
    file = F.concat(F.when(F.col("conv_id") % 2 == 0, "frontend\\").otherwise("lib/"), F.col("role"))
    cited = lambda name: F.array(F.struct(name.alias("file"), F.lit("s").alias("symbol"), F.lit(1).alias("line"), F.lit(1).alias("code_start"), F.lit(1).alias("code_end")))
    none = F.lit(None).cast(f"array<{OPTION}>").alias("options")
    step = F.struct(phase.alias("phase"), cited(file).alias("evidence"), none)
    request = F.array(F.struct(F.lit("request").alias("phase"), cited(F.lit("lib/request")).alias("evidence"), none))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list(step).alias("steps"))
    rows = rows.withColumn("steps", F.when(F.col("n") > 4, F.concat("steps", request)).otherwise(F.col("steps")))
    return rows.select("conv_id", shape.complete(F.col("n"), shape.phases_of(F.col("steps")), shape.evidence_files(F.col("steps"))).alias("complete"))


@_query
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = rules.first_failure((F.col("lang") != "en", F.concat(F.lit("language "), F.col("lang"))), (F.col("n_chars") < 400, "too short"), (~F.contains("text", F.lit("\n")), "one line"))
    return table(spark, sf_dir, "documents").select("doc_id", message.alias("message"))


@_query
def joined_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("n_chars") < 200, F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" is short")))
    return rules.joined(table(spark, sf_dir, "documents").select("source", "doc_id", message.alias("message")), "doc_id", by=("source",))


@_query
def used_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that cite a file each: of themselves, in a step, or in a branch of one."""
    docs = mapped.files(spark, sf_dir).select("doc_id", F.array(F.struct(F.col("path").alias("file"))).alias("evidence"))
    none = F.array().cast("array<struct<file:string>>")
    steps = {
        "labels": ("doc_id", F.col("evidence"), F.array(F.struct(none.alias("evidence"), F.array(F.struct(none.alias("evidence"))).alias("options")))),
        "benchmark": ("item_id", none, F.array(F.struct(F.col("evidence"), F.array(F.struct(none.alias("evidence"))).alias("options")))),
        "conversations": ("conv_id", none, F.array(F.struct(none.alias("evidence"), F.array(F.struct(F.col("evidence"))).alias("options")))),
    }
    views = [docs.join(table(spark, sf_dir, name).select(F.col(key).alias("doc_id")), "doc_id").select(own.alias("evidence"), inner.alias("steps")) for name, (key, own, inner) in steps.items()]
    cited = readmodel.cited_files(views[0].unionByName(views[1]).unionByName(views[2]))
    return readmodel.used_files(cited, _inventory(spark, sf_dir)).select("path", "size", "sha256")


PATHS = ("src/main.py", "./node_modules/x.js", ".git/config", "a/.git/config", "pkg/__init__.py", "img/LOGO.PNG", "x.egg-info/y", "dir\\build\\z.py", "build", "", "..venv/q.py", ".gitignore", "a/b.tar.gz")


@_query
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*[F.lit(p) for p in PATHS]), (F.col("doc_id") % len(PATHS)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("path"))
    return rows.select("doc_id", "path", paths.allowed_path(F.col("path")).alias("allowed"), text.suffix(text.slashes(F.col("path"))).alias("suffix"), paths.language(text.slashes(F.col("path"))).alias("language"))


@_query
def stale_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = F.when(F.col("toxic") == 1, "0" * 64).otherwise("1" * 64)
    docs = table(spark, sf_dir, "labels").select("doc_id", recorded.alias("recorded"))
    return readmodel.is_stale(docs, "recorded", inventory.fingerprint(_inventory(spark, sf_dir))).select("doc_id", "stale")


@_query
def escaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    script = text.json_for_script(F.to_json(F.struct("url", "html")))
    back = F.from_json(script, "url string, html string", {"allowBackslashEscapingAnyCharacter": "true"})
    # The text within a script, of what any JSON writer puts the same.
    plain = F.concat(F.lit('{"page_id":'), F.col("page_id").cast("string"), F.lit(',"html":"'), F.regexp_replace("html", r"[\x00-\x1f\"\\]", " "), F.lit('"}'))
    same = back["url"].eqNullSafe(F.col("url")) & back["html"].eqNullSafe(F.col("html"))
    return pages.select("page_id", text.escape_html(F.col("html")).alias("attribute"), F.sha2(text.escape_html(F.col("html"), quotes=False), 256).alias("element_sha256"),
                        (same & ~F.contains(script, F.lit("</script>")) & ~F.contains(script, F.lit("<!--"))).alias("embeddable"), F.sha2(text.json_for_script(plain), 256).alias("script_sha256"))


@_query
def phase_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.phase_label(F.concat("event_type", F.lit("_of_user"))).alias("label"))


@_query
def managed_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = text.upsert_block(F.col("text"), F.lit("  kept  "), "# BEGIN", "# END")
    again = text.upsert_block(first, F.lit("changed"), "# BEGIN", "# END")
    return docs.select("doc_id", F.sha2(first, 256).alias("first_sha256"), F.sha2(again, 256).alias("again_sha256"))


@_query
def code_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (F.col("doc_id") % 450).cast("int")
    few = F.least(lines, F.lit(14))  # with so many branches a function is still simple enough
    body = F.concat(F.lit("def f(x):\n"), F.repeat(F.lit("    x = 1 if x else 2\n"), few), F.repeat(F.lit("    x += 1\n"), lines - few), F.lit("    return x\n"))
    # The ids are dealt out before the sources are made from them, so that all tasks parse.
    ids = table(spark, sf_dir, "documents").select("doc_id").repartition(spark.sparkContext.defaultParallelism)
    made = ids.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))
    return health.health(made).select("path", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("name", F.lit("")).alias("name"), "metric", "value", "limit")


@_query
def workflow_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partial workflow per document, citing its own file with a range that may exceed it."""
    files = _inventory(spark, sf_dir)
    rows = mapped.files(spark, sf_dir).select("doc_id", "path", (F.lit(1) + F.col("doc_id") % 12).cast("int").alias("stop"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    cited = F.array(F.struct(F.col("path").alias("file"), F.lit("s").alias("symbol"), F.lit(1).alias("line"), F.lit(1).alias("code_start"), F.col("stop").alias("code_end")))
    tags = validate.Tags()
    step = F.struct(F.lit(1).alias("number"), F.when(F.col("doc_id") % 7 == 0, "unheard_of").otherwise("backend").alias("phase"), F.lit("t").alias("title"), F.lit("x").alias("text"), cited.alias("evidence"))
    doc = F.struct(F.lit(tags.workflow_schema).alias("schema"), F.lit("h").alias("source_hash"), F.lit(tags.workflow_generator).alias("generator"), name.alias("feature_id"), F.lit("t").alias("title"),
                   F.when(F.col("doc_id") % 5 == 0, " s").otherwise("s").alias("summary"), F.lit("partial").alias("status"), F.lit("m").alias("missing_coverage"), cited.alias("evidence"), F.array(step).alias("steps"))
    workflows = rows.where(F.col("doc_id") % 11 != 0).select(name.alias("feature_id"), F.to_json(doc).alias("json"))
    features = rows.select(F.col("doc_id").alias("at"), name.alias("id"), F.lit("t").alias("title"))
    found = validate.workflow_failures(features, workflows, files, "h", tags)
    return found.select(F.col("at").alias("doc_id"), "message", F.col("workflow").isNotNull().alias("accepted"))


QUERIES.update(view_queries.QUERIES)
QUERIES.update(jobs.QUERIES)
