"""Catalog search, ordered sections and the summary line."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerloom.functions.text import contains_lower
from ledgerloom.operators.ranges import placed
from ledgerloom.sources.shared import stored


def matches(texts: Column, query: str) -> Column:
    """Whether any of an array of texts contains the query, ignoring case; an empty query matches."""
    wanted = query.strip().lower()
    return F.lit(True) if not wanted else F.coalesce(F.exists(texts, lambda t: contains_lower(t, F.lit(wanted))), F.lit(False))


def view_texts() -> Column:
    """All searched texts of a workflow view: its own, its steps', options' and evidence's."""
    cited = lambda e: F.array(e["file"], e["symbol"])
    words = lambda x: F.concat(F.array(x["title"], x["text"], x["phase"], x["file"], x["symbol"]), F.flatten(F.transform(x["evidence"], cited)))
    steps = F.transform("steps", lambda s: F.concat(words(s), F.flatten(F.transform(s["options"], words))))
    return F.concat(F.array("title", "summary", "audience", "area_title"), F.flatten(steps), F.flatten(F.transform("evidence", cited)))


def search(views: DataFrame, query: str) -> DataFrame:
    return views.where(matches(view_texts(), query))


#: Folders that an index's texts are dealt to.
SLOTS = 64
#: Characters whose grams a task brings in order at a time, before Spark sorts what all of its runs hold.
CHARACTERS = 1 << 21
#: Rows of postings in a page of a file, which is what a query reads for a gram at least.
PAGE_ROWS = 200
#: Of a query's grams, so many of the rarest ones are looked up.
LOOKED_UP = 4


@dataclass(frozen=True)
class TextIndex:
    """Stored tables: ``postings (gram, ids)``, files in order of their grams, and lower-cased ``texts (id, texts, slot)``, in folders by slot.

    A gram is a number, see :func:`_gram`; it has a row in each run of texts that it occurs in, with the texts' ids.
    """

    postings: DataFrame
    texts: DataFrame


def _dealt(value: Column, parts: int) -> Column:
    return (F.crc32(value.cast("string").cast("binary")) % parts).cast("int")


def _gram(characters: str) -> int:
    """Three code points as one number, 21 bits each."""
    a, b, c = map(ord, characters)
    return a << 42 | b << 21 | c


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


def _grams(texts: list[str] | None) -> np.ndarray:
    """The distinct trigrams of a row's texts, in order."""
    found = [np.empty(0, np.int64)]
    for text in texts or ():
        for at in range(0, len(text) - 2, CHARACTERS):
            c = np.frombuffer(text[at : at + CHARACTERS + 2].encode("utf-32-le"), np.uint32).astype(np.int64)
            found.append(_distinct(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    return _distinct(np.concatenate(found)) if len(found) > 2 else found[-1]


def _posted(ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
    """``gram, ids`` of a run of rows, from their ids and grams."""
    grams, places = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.diff(grams, prepend=-1))
    offsets = pa.array(np.append(starts, len(grams)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(grams[starts]), pa.ListArray.from_arrays(offsets, ids.take(pa.array(places[order])))], ["gram", "ids"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("texts")
        first, rows, held = 0, [], 0
        for k in range(batch.num_rows):
            rows.append(_grams(texts[k].as_py()))
            held += len(rows[-1])
            if held >= CHARACTERS // 4 or k + 1 == batch.num_rows:
                yield _posted(ids.slice(first, len(rows)), rows)
                first, rows, held = k + 1, [], 0


def index_texts(views: DataFrame, texts: Column | None = None, key: str = "id") -> TextIndex:
    """All searched texts of ``views``, lower-cased, and their trigrams.

    Texts are dealt once, and their grams stay where they are read: no row for a gram of a text is made or shuffled.  Each
    task writes the postings of its texts in order of the grams, so a query reads the pages of its own grams in each file.
    A view's key may have several rows.
    """
    searched = F.filter(view_texts() if texts is None else texts, lambda t: t.isNotNull())
    slots = views.select(F.col(key).alias("id"), F.transform(searched, F.lower).alias("texts")).withColumn("slot", _dealt(F.col("id"), SLOTS))
    rows = stored(slots.repartition("slot", _dealt(F.concat(F.lit("-"), F.col("id").cast("string")), 8)).sortWithinPartitions("slot", "id"), "texts", ("slot",))
    kinds = T.StructType([T.StructField("gram", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    return TextIndex(stored(rows.select("id", "texts").mapInArrow(_runs, kinds).sortWithinPartitions("gram"), "postings", page_rows=PAGE_ROWS), rows)


def _holding(texts: DataFrame, wanted: str) -> DataFrame:
    """``id`` of an index's texts that contain what is wanted."""
    return texts.where(F.exists("texts", lambda t: F.contains(t, F.lit(wanted))) if wanted else F.lit(True)).select("id").distinct()


def indexed_search(index: TextIndex, query: str) -> DataFrame:
    """``id`` of the views that :func:`search` finds; of texts, the folders with a candidate are read, and no others.

    Candidates have the query's rarest grams; whether they contain the query is then asked of their texts.  A
    query of one or two characters has no gram, and all texts are read.
    """
    wanted = query.strip().lower()
    grams = sorted({_gram(wanted[k : k + 3]) for k in range(len(wanted) - 2)})
    if not grams:
        return _holding(index.texts, wanted)
    counts = {r["gram"]: r["n"] for r in index.postings.where(F.col("gram").isin(*grams)).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row per gram of the query
    if len(counts) < len(grams):
        return index.texts.where(F.lit(False)).select("id")
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:LOOKED_UP]
    bit = F.coalesce(*[F.when(F.col("gram") == g, F.lit(1 << k)) for k, g in enumerate(rarest)])
    posted = index.postings.where(F.col("gram").isin(*rarest)).select(bit.alias("bit"), F.explode("ids").alias("id"))
    candidates = stored(posted.groupBy("id").agg(F.bit_or("bit").alias("met")).where(F.col("met") == (1 << len(rarest)) - 1).select("id"), "candidates")
    slots = [r["slot"] for r in candidates.select(_dealt(F.col("id"), SLOTS).alias("slot")).distinct().collect()]  # as many as there are folders
    read = index.texts.where(F.col("slot").isin(*slots)) if slots else index.texts.where(F.lit(False))
    return _holding(read.join(candidates, "id", "left_semi"), wanted)


def perspective_rank(perspective: Column) -> Column:
    return F.when(perspective == "product", 0).when(perspective == "technical", 1)


def placed_areas(areas: DataFrame, *ties: str) -> DataFrame:
    """Areas with ``place``, from 1, by perspective, order and ties: the id in an index, the input place in a viewer."""
    return placed(areas, [perspective_rank(F.col("perspective")).asc(), F.col("order").asc(), *[F.col(c).asc() for c in ties]])


def ordered_areas(areas: DataFrame, *ties: str) -> DataFrame:
    """Areas in order of their place."""
    return placed_areas(areas, *ties).orderBy("place").drop("place")


def sections(areas: DataFrame, shown: DataFrame) -> DataFrame:
    """``area id, title, perspective, order, place, cards``: areas with any shown workflow, cards in order.

    ``areas (id, title, perspective, order)``, ``shown (at, id, area_id, title, status, summary)``.  Areas
    that tie stay in order of ``at``, their place in the input, if they have it, else of their id.
    """
    cards = shown.groupBy("area_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "title", "status", "summary"))).alias("cards"))
    numbered = placed_areas(areas, "at" if "at" in areas.columns else "id")
    return numbered.join(cards, numbered.id == cards.area_id).drop("area_id").orderBy("place")


def summary(views: DataFrame, query: str, texts: Column | None = None) -> DataFrame:
    """One row ``complete, total, shown``; workflows without an area count too."""
    hit = matches(view_texts() if texts is None else texts, query)
    return views.agg(F.count_if(F.col("status") == "generated").alias("complete"), F.count("*").alias("total"), F.count_if(hit).alias("shown"))


def first_workflow(views: DataFrame) -> DataFrame:
    """The workflow selected by default: the first."""
    return views.orderBy("at").limit(1)


def selected(views: DataFrame, workflow_id: str) -> DataFrame:
    """The first workflow with the id."""
    return views.where(F.col("id") == workflow_id).orderBy("at").limit(1)
