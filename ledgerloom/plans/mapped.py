"""The driver's tables as a catalog: documents as files, conversations as workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENDINGS = (".py", ".js", ".md", ".gz", "", ".YAML")


def path_of(doc_id: F.Column, source: F.Column) -> F.Column:
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (doc_id % len(ENDINGS)).cast("int"))
    return F.concat(source, F.lit("/"), F.lpad(doc_id.cast("string"), 8, "0"), ending)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, content`` of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", path_of(F.col("doc_id"), F.col("source")).alias("path"), F.col("text").alias("content"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``workflow_id, step, number, title, options`` of all conversations; some turns decide."""
    n = F.when(F.col("role") == "system", 2).when(F.length("text") % 5 == 0, 3)
    options = F.when(n.isNotNull(), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("option "), i.cast("string"))))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("workflow_id"), F.col("turn").cast("int").alias("step"), (F.col("turn") + 1).cast("int").alias("number"),
        F.col("role").alias("title"), options.alias("options"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, perspective, order``: nations."""
    perspective = F.when(F.col("n_regionkey") % 2 == 0, "technical").otherwise("product")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), perspective.alias("perspective"), (F.col("n_nationkey") % 5).alias("order"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``at, id, area_id, title, status, summary``: customers."""
    status = F.when(F.col("c_custkey") % 3 == 0, "pending").when(F.col("c_custkey") % 3 == 1, "generated").otherwise("partial")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("at"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("area_id"), F.col("c_name").alias("title"),
        status.alias("status"), F.col("c_mktsegment").alias("summary"))
