"""Registered queries of sources, sinks and ordered jobs that spread over many tasks."""

from __future__ import annotations

import subprocess
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import text
from ledgerloom.operators import health, inventory, pages, ranges, rules, search
from ledgerloom.plans import mapped
from ledgerloom.sources.shared import fresh_path, local_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- source trees


def _tree(spark: SparkSession, sf_dir: str, extra: list[tuple[str, str]]) -> str:
    """The root of a tree that holds every document as a file, and ``extra`` files."""
    root = fresh_path(spark, "tree")
    inventory.write_tree(mapped.files(spark, sf_dir).select("path", "content"), root)
    inventory.write_tree(spark.createDataFrame(extra, "path string, content string"), root)
    return root


_EXTRA = [("node_modules/x.py", "left out\n"), ("src1/build/y.py", "left out\n"), ("src1/blob.py", "a\x00b"), (".catalog/src1.md", "left out\n")]


@_query
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as a tree: the Python and Markdown files whose path starts with ``src1``; no other is opened."""
    files = inventory.tree_inventory(spark, _tree(spark, sf_dir, _EXTRA), "walk")
    return files.where(F.startswith("path", F.lit("src1")) & F.col("language").isin("python", "markdown"))


@_query
def tree_listed_by_git(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, written as a tree that Git lists: ignore rules leave out a folder and an ending."""
    root = _tree(spark, sf_dir, [*_EXTRA, (".gitignore", "*.js\n/src2/\n")])
    subprocess.run(["git", "init", "-q", local_path(root)], check=True, timeout=60)
    return inventory.tree_inventory(spark, root, "git").where(F.startswith("path", F.lit("src"))).groupBy("language").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("line_count").alias("lines"), F.min("path").alias("first_path"))


@_query
def tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of the documents, written as a tree."""
    return inventory.fingerprint(stored(inventory.tree_inventory(spark, _tree(spark, sf_dir, _EXTRA[:2]), "walk"), "inventory"))


# --- order over whole tables


@_query
def joined_error_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of each source's short lines, joined, in chunks of five hundred."""
    key = F.col("l_orderkey").cast("string")
    message = F.when(F.col("l_quantity") < 40, F.concat(F.lit("order "), key, F.lit(" is short in "), F.col("l_returnflag")))
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", order.alias("at"), message.alias("message"))
    found = rules.joined_chunks(rows, "at", by=("l_linestatus",), rows=500)
    return found.select("l_linestatus", "chunk", "offset", F.sha2("text", 256).alias("text_sha256"))


@_query
def inventory_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the sorted inventory, and the bytes before it, as in one concatenated file."""
    files = mapped.files(spark, sf_dir)
    listed = inventory.inventory(files, F.col("path"), F.col("content")).select("path", "size")
    return ranges.placed(listed, [F.col("path").asc()], sums=F.col("size"))


# --- search


@_query
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of several queries in an index of the trigrams of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    index = search.index_texts(docs, F.array("text", "lang", "source"), "doc_id")
    found = [search.indexed_search(index, query).select(F.lit(query).alias("query"), F.col("id").alias("doc_id")) for query in ("License", " SRC13", "the s", "en", "not to be found")]
    return reduce(DataFrame.unionByName, found)


# --- pages


@_query
def workflow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per conversation, with its chart and steps."""
    steps = mapped.steps(spark, sf_dir).withColumn("phase", F.concat(F.col("title"), F.lit("_turn")))
    flows = steps.groupBy("workflow_id").agg(F.count("*").alias("n"))
    titles = flows.select("workflow_id", F.concat(F.lit("Talk <"), F.col("workflow_id").cast("string"), F.lit(">")).alias("title"), F.lit("generated").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" turns & more")).alias("summary"))
    return pages.workflow_pages(titles, steps).select("path", F.sha2("content", 256).alias("content_sha256"))


@_query
def card_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all customers by nation, a hundred on a page, written as files and read again."""
    areas = ranges.placed(mapped.areas(spark, sf_dir), [F.col("title").asc()], "area_place").select(F.col("id").alias("area_id"), F.col("title").alias("area_title"), "area_place")
    cards = mapped.features(spark, sf_dir).withColumnRenamed("id", "workflow_id").join(areas, "area_id")
    root = fresh_path(spark, "pages")
    inventory.write_tree(pages.card_pages(cards, many=100), root)
    return inventory.tree_inventory(spark, root, "walk").select("path", "size", "sha256")


@_query
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of four places filled from every page; values that name a place stay as they are."""
    template = "<style>{{styles}}</style><script>{{data}}</script>{{view}}{{view}}<b>{{page}}</b>"
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    filled = text.fill(template, styles=F.lit("{{data}}"), data=text.json_for_script(F.col("html")), view=text.escape_html(F.col("url")), page=F.col("page_id"))
    return rows.select("page_id", F.sha2(filled, 256).alias("filled_sha256"))


# --- code health


@_query
def text_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a module per document: a function whose comment lines are the document's."""
    body = F.concat(F.lit("def f():\n    # "), F.replace("text", F.lit("\n"), F.lit("\n    # ")), F.lit("\n    return 1\n"))
    made = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))
    return health.health(made).select("path", "metric", "value", "limit")
