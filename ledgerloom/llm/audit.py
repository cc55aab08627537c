"""Filter interaction audit: what each filter removes in every order of five filters.

Flags
    Each document has five flags, one per filter that it fails, as the bits of one
    integer: A under 200 words; B fewer than half of the words are distinct; C more
    than 2 % capitals A-Z; D holds one of ``#$%&*|``; E its text is also that of a
    smaller id, anywhere in the table.

Replay
    Documents' flags meet the 120 orders, a broadcast table of fixed size.  Each pair
    gets the step of its first failure, is exploded into its five steps, and the
    counts are conditional sums by part, order and step.  They are combined where the
    rows are made: a task sends 600 rows per part that it met, however many documents
    a part has, so neither a hot source nor the table's size reaches the shuffle.

Edge cases
    * null or empty text: no words, so it fails A; null and empty texts are identical;
    * null ids: no id is smaller than a null one and a null one is smaller than none,
      so E never fails such rows, and they have no labels;
    * repeated rows: each is a document; rows of one id do not fail E by each other;
    * several label rows of an id: it is good or toxic if one of them says so;
    * a null source is the part of the empty string;
    * a part has all its 600 rows, zeros included; an empty table gives an empty result;
    * extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm.common import WORD, written

FILTERS = "ABCDE"
#: What the five filters ask of a text.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, JUNK = 200, 50, 2, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_flags(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    few = F.size(words) < LEAST_WORDS
    dull = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words)
    loud = 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MOST_CAPITALS * F.length(text)
    junk = text.rlike(JUNK)
    return sum((F.when(bad, _bit(letter)).otherwise(0) for letter, bad in zip("ABCD", (few, dull, loud, junk), strict=True)), start=F.lit(0))


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, mask, good, toxic``, a row per document; ``mask`` holds the flags."""
    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    narrow = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # Written: texts are read once, and what is joined by a hot digest can be split.
    seen = written(narrow.select("doc_id", "part", text_flags(F.col("text")).alias("own"), F.sha2("text", 256).alias("digest")), "flags")
    first = written(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "copies")
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    mask = F.col("own") + F.when(late, _bit("E")).otherwise(0)
    told = [F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")]
    return seen.join(first, "digest", "left").join(said, "doc_id", "left").select("doc_id", "part", mask.alias("mask"), *told)


def orders(spark: SparkSession, letters: str = FILTERS) -> DataFrame:
    """``filter_order, steps``: every order of the filters; a step is ``(step, letter, bit)``."""
    rows = [("".join(o), [(k, letter, _bit(letter)) for k, letter in enumerate(o, 1)]) for o in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step int, letter string, bit int>>")


def replay(flagged: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and counts, from ``flagged (part, mask, good, toxic)``."""
    ways = orders(flagged.sparkSession)
    failing = [F.when(F.col("mask").bitwiseAND(F.col("steps")[k]["bit"]) != 0, k + 1) for k in range(len(FILTERS))]
    crossed = flagged.select("part", "mask", "good", "toxic").crossJoin(F.broadcast(ways))  # 120 rows
    crossed = crossed.withColumn("first_failure", F.coalesce(*failing, F.lit(len(FILTERS) + 1)))
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", "first_failure", F.inline("steps"))
    here, fails = F.col("first_failure") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    counted = steps.groupBy("part", "filter_order", "step", "letter").agg(
        F.count_if(F.col("first_failure") > F.col("step")).alias("kept"), F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("first_failure") < F.col("step"))).alias("redundant"), F.count_if(F.col("mask") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"), F.count_if(here & F.col("toxic")).alias("toxic_lost"))
    # 120 rows of a part have the same letter.
    whole = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return counted.select("part", "filter_order", "step", *_COUNTS, whole.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step``, the six counts and ``shapley`` for all documents."""
    return replay(flags(docs, labels))
