r"""Chat formatting with a grammar round trip.  DataFrame functions only.

Grammar
    ::

        conversation := turn*
        turn         := "<s>[INST]" level role "[/INST]" text "</s>"
        level        := "0" | "1"        0: raw, 1: escaped role and text

    ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` are control strings; none may
    occur in a role or text.  The escape doubles every backslash and then puts one
    behind the first character of each control string (``<\s>``, ``[\/INST]``);
    dropping one backslash of each ``\x`` undoes it.

Round trip
    Each turn is rendered raw and reparsed; a turn that does not come back is
    escaped.  The whole rendered conversation is reparsed then and compared with
    its source; should it still differ, every turn of it is escaped and it is
    parsed again.  ``identical`` says whether the last parse equals the source.

Edge cases
    * null role or text: empty; null turn: before all others; null conversation
      id: one conversation of its own;
    * repeated rows and tied turns are kept, in order of turn, role and text;
    * a very long conversation is one output row, hence one value: it must fit
      what a column value may hold (2 GiB);
    * extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_PIECE = r"(?s)^<s>\[INST\]([01])(.*?)\[/INST\](.*)$"


def escaped(value: Column) -> Column:
    """``value`` without control strings; undone by :func:`unescaped`."""
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for word in CONTROL:
        value = F.replace(value, F.lit(word), F.lit(f"{word[0]}\\{word[1:]}"))
    return value


def unescaped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def _render(level: Column, role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), level, role, F.lit("[/INST]"), text, F.lit("</s>"))


def _parsed(formatted: Column) -> Column:
    """Turns ``(role, text)`` of a rendered conversation; null where one breaks the grammar."""
    pieces = F.split(formatted, "</s>", -1)

    def turn(piece: Column) -> Column:
        role, text = F.regexp_extract(piece, _PIECE, 2), F.regexp_extract(piece, _PIECE, 3)
        raw = F.regexp_extract(piece, _PIECE, 1) == "0"
        bad = ~piece.rlike(_PIECE)
        for word in CONTROL:
            bad = bad | F.contains(role, F.lit(word)) | F.contains(text, F.lit(word))
        return F.when(~bad, F.struct(F.when(raw, role).otherwise(unescaped(role)).alias("role"),
                                     F.when(raw, text).otherwise(unescaped(text)).alias("text")))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``rows (conv_id, turn, role, text)``.

    ``conv_id, formatted, turns`` (parsed from ``formatted``), ``loss_spans`` (start
    from 0 and length in code points of each ``loss_role`` text within
    ``formatted``, and whether it is escaped there), ``mask`` (the same with a place for every
    turn, null for other roles) and ``identical``.
    One shuffle, by conversation; its turns are sorted and summed where they arrive.
    """
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = F.struct("role", "text")
    alone = _parsed(_render(F.lit("0"), F.col("role"), F.col("text")))
    raw = (F.size(alone) == 1) & F.coalesce(alone[0] == source, F.lit(False))
    turns = turns.withColumn("raw", raw)
    plain = _render(F.lit("0"), F.col("role"), F.col("text"))
    safe = _render(F.lit("1"), escaped(F.col("role")), escaped(F.col("text")))
    one = turns.select("conv_id", "turn", "role", "text", F.when(F.col("raw"), plain).otherwise(safe).alias("piece"),
                       F.when(F.col("raw"), F.length("text")).otherwise(F.length(escaped(F.col("text")))).alias("chars"),
                       F.length(safe).alias("safe_chars"), F.length(escaped(F.col("text"))).alias("safe_text"), (~F.col("raw")).alias("escaped"))
    # Where each turn's text starts, as rendered first and as rendered if all turns are escaped: running sums.
    upto = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = lambda size: F.sum(size.cast("long")).over(upto) - len("</s>")
    one = one.withColumn("end", end(F.length("piece"))).withColumn("safe_end", end(F.col("safe_chars")))
    span = lambda stop, size, said: F.struct((F.col(stop) - F.col(size)).alias("start"), F.col(size).cast("long").alias("length"), said.alias("escaped"))
    one = one.withColumn("span", span("end", "chars", F.col("escaped"))).withColumn("safe_span", span("safe_end", "safe_text", F.lit(True)))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "end", "piece", "span", "safe_span"))).alias("rows"))
    whole = whole.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"], r["text"])).alias("source"),
                         F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("first"),
                         F.transform("rows", lambda r: F.when(r["role"] == loss_role, r["span"])).alias("span"),
                         F.transform("rows", lambda r: F.when(r["role"] == loss_role, r["safe_span"])).alias("safe_span"))
    whole = whole.withColumn("back", _parsed(F.col("first")))
    again = F.array_join(F.transform("source", lambda r: _render(F.lit("1"), escaped(r["role"]), escaped(r["text"]))), "")
    good = F.coalesce(F.col("back") == F.col("source"), F.lit(False))
    whole = whole.select("conv_id", "source", F.when(good, F.col("first")).otherwise(again).alias("formatted"),
                         F.when(good, F.col("back")).alias("back"), F.when(good, F.col("span")).otherwise(F.col("safe_span")).alias("mask"))
    whole = whole.withColumn("turns", F.coalesce("back", _parsed(F.col("formatted"))))
    spans = F.filter("mask", lambda m: m.isNotNull()).alias("loss_spans")
    return whole.select("conv_id", "formatted", "turns", spans, "mask", F.coalesce(F.col("turns") == F.col("source"), F.lit(False)).alias("identical"))


def masked_texts(formatted: DataFrame, *kept: str) -> DataFrame:
    """``conv_id``, other ``kept`` columns and ``texts``: the texts under the loss mask, in order and unescaped, cut out of ``formatted`` by the mask's offsets.

    The rendered conversation is split at its turns' ends; each span is cut out of its own turn, by
    its offset from where that turn starts, so the cost grows with a conversation's length alone.
    """
    pieces = F.split("formatted", "</s>", -1)
    cut = formatted.select("conv_id", *kept, F.posexplode(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("piece"), F.col("mask").alias("span"))).alias("at", "x"))
    cut = cut.select("conv_id", *kept, "at", "x.piece", "x.span")
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum((F.length("piece") + len("</s>")).cast("long")).over(earlier), F.lit(0))
    text = F.substring(F.col("piece"), (F.col("span.start") - F.col("begins") + 1).cast("int"), F.col("span.length").cast("int"))
    text = F.when(F.col("span.escaped"), unescaped(text)).otherwise(text)
    rows = cut.withColumn("begins", begins).select("conv_id", *kept, F.when(F.col("span").isNotNull(), F.struct("at", text.alias("text"))).alias("one"))
    return rows.groupBy("conv_id", *kept).agg(F.transform(F.array_sort(F.collect_list("one")), lambda o: o["text"]).alias("texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the rendered conversations, as counts and hashes: turns by the parse, loss texts by the mask."""
    turns = F.array_join(F.flatten(F.transform("turns", lambda t: F.array(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    read = formatted.select("conv_id", "formatted", "mask", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    found = masked_texts(read, "n_turns", "turns_sha256", "formatted_chars").withColumn("loss", F.array_join("texts", ""))
    return found.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
