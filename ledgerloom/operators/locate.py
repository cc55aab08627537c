"""Source lines, evidence ranges and their relocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import split_lines


def source_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """``path, number, line``, as a viewer numbers them."""
    rows = files.select("path", F.posexplode(split_lines(F.col(content))).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).cast("long").alias("number"), "line")


def relocated(lines: Column, symbol: Column, start: Column, end: Column) -> Column:
    """``start, end, relocated`` of cited code within the lines.

    The range stays if its text holds the symbol (or no symbol is given); else it moves to the first
    line that holds it; if none does it stays.
    """
    start = F.coalesce(F.nullif(start, F.lit(0)), F.lit(1)).cast("long")
    end = F.coalesce(F.nullif(end, F.lit(0)).cast("long"), start)
    stored = F.array_join(F.slice(lines, start.cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int")), "\n")
    found = F.array_position(F.transform(lines, lambda line: F.contains(line, symbol)), F.lit(True))
    stays = (F.coalesce(symbol, F.lit("")) == "") | F.contains(stored, symbol) | (found == 0)
    return F.when(stays, F.struct(start.alias("start"), end.alias("end"), F.lit(False).alias("relocated"))) \
        .otherwise(F.struct(found.alias("start"), found.alias("end"), F.lit(True).alias("relocated")))


def relocate(evidence: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """``evidence (file, symbol, code_start, code_end)`` with where its code is now."""
    texts = files.select(F.col("path").alias("file"), split_lines(F.col(content)).alias("_lines"))
    found = relocated(F.col("_lines"), F.col("symbol"), F.col("code_start"), F.col("code_end"))
    return evidence.join(texts, "file").withColumn("at", found).select(*evidence.columns, "at.start", "at.end", "at.relocated")


def highlighted_lines(found: DataFrame, files: DataFrame, content: str = "content") -> DataFrame:
    """``path, number, line`` of the lines within ``found (file, start, end)``; the others are never made rows."""
    lines = files.select("path", split_lines(F.col(content)).alias("_lines")).join(found, F.col("path") == F.col("file"))
    first = F.greatest(F.col("start"), F.lit(1)).cast("int")
    part = F.slice("_lines", first, F.greatest(F.col("end") - first + 1, F.lit(0)).cast("int"))
    rows = lines.select("path", first.alias("_first"), F.posexplode(part).alias("_at", "line"))
    return rows.select("path", (F.col("_first") + F.col("_at")).cast("long").alias("number"), "line")


def highlighted(number: Column, start: Column, end: Column) -> Column:
    return number.between(start, end)


def range_violations(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """``evidence`` whose range is not within its file's lines, with the number of lines."""
    rows = evidence.join(files.select(F.col("path").alias("file"), "line_count"), "file")
    return rows.where((F.col("code_start") < 1) | (F.col("code_end") < F.col("code_start")) | (F.col("code_end") > F.col("line_count")))


def editor_link(root: str, file: Column, line: Column) -> Column:
    return F.format_string("vscode://file%s/%s:%d", F.lit(root), file, F.coalesce(F.nullif(line, F.lit(0)), F.lit(1)))


def evidence_label(file: Column, start: Column, end: Column) -> Column:
    """``file:3`` or ``file:3–9``."""
    return F.concat(file, F.lit(":"), start.cast("string"), F.when(end != start, F.concat(F.lit("–"), end.cast("string"))).otherwise(""))


def open_source(files: DataFrame, path: str) -> DataFrame:
    """The content of one inventoried path."""
    return files.where(F.col("path") == path)


def open_sources(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The contents of all inventoried ``paths (path)``."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")
