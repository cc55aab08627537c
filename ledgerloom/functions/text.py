"""Column functions on strings and lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: White space as a general-purpose string strip removes it, beyond plain spaces.
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(value: Column) -> Column:
    """``value`` without leading and trailing white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), _STRIP, "")


def non_empty(value: Column) -> Column:
    return strip(value) != ""


def slashes(value: Column) -> Column:
    """Backslashes as slashes."""
    return F.replace(value, F.lit("\\"), F.lit("/"))


def lstrip_set(value: Column, characters: str) -> Column:
    """``value`` without leading characters of the set."""
    return F.ltrim(value, F.lit(characters))


def trim_slashes(value: Column) -> Column:
    return F.btrim(value, F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The lower-cased extension with its dot; names that only start with dots have none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1))


def normalize_path(path: Column) -> Column:
    """A relative path without ``.``, empty and resolvable ``..`` parts; ``.`` if nothing is left."""
    parts = F.filter(F.split(slashes(path), "/", -1), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    done = F.array_join(F.aggregate(parts, start, step), "/")
    absolute = F.startswith(slashes(path), F.lit("/"))
    return F.when(absolute, F.concat(F.lit("/"), done)).when(done == "", ".").otherwise(done)


def line_count(content: Column) -> Column:
    """Lines under universal newlines; an unterminated last line counts, an empty text has none."""
    pieces = F.size(F.split(content, "\r\n|\r|\n", -1))
    ended = F.endswith(content, F.lit("\n")) | F.endswith(content, F.lit("\r"))
    return F.when(content == "", 0).otherwise(pieces - F.when(ended, 1).otherwise(0)).cast("long")


def split_lines(content: Column) -> Column:
    """Lines as a viewer splits them: by line feed alone."""
    return F.split(content, "\n", -1)


def contains_lower(value: Column, query: Column) -> Column:
    return F.contains(F.lower(F.coalesce(value, F.lit(""))), query)


def escape_html(value: Column, quotes: bool = True) -> Column:
    value = F.coalesce(value, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#39;")) if quotes else ())):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def phase_label(phase: Column) -> Column:
    """Upper case, the first underscore as a space."""
    return F.upper(F.concat_ws(" ", F.split(phase, "_", 2)))


def counted(count: Column, one: str, many: str) -> Column:
    """``1 reference`` or ``3 references``."""
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, one).otherwise(many))


def json_for_script(json: Column) -> Column:
    """JSON that may stand within a script element."""
    return F.replace(F.replace(json, F.lit("</script>"), F.lit("<\\/script>")), F.lit("<!--"), F.lit("<\\!--"))


def upsert_block(existing: Column, body: Column, begin: str, end: str) -> Column:
    """``existing`` with the block between two markers replaced, or appended if it has none."""
    block = F.concat(F.lit(begin + "\n"), strip(body), F.lit("\n" + end + "\n"))
    start, stop = F.instr(existing, begin), F.instr(existing, end)
    tail = F.ltrim(F.substring(existing, stop + len(end), F.length(existing)), F.lit("\n"))
    replaced = F.concat(F.substring(existing, F.lit(1), start - 1), block, tail)
    gap = F.when(F.endswith(existing, F.lit("\n")), "\n").otherwise("\n\n")
    return F.when((start > 0) & (stop > start), replaced).when(existing == "", block).otherwise(F.concat(existing, gap, block))


def text_width(value: Column, widths: dict[str, float], other: float) -> Column:
    """The width of a text from its characters'; ``other`` is that of characters not listed."""
    known = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    each = F.transform(F.split(value, ""), lambda c: F.coalesce(F.element_at(known, c), F.when(c == "", 0.0).otherwise(other)))
    return F.aggregate(each, F.lit(0.0), lambda total, w: total + w)


def wrapped(value: Column, room: float, widths: dict[str, float], other: float, most: int = 3) -> Column:
    """The first ``most`` lines of a text set in a given room; a word that is too wide has a line of its own."""
    words = F.transform(F.split(F.coalesce(value, F.lit("")), r"(?U)\s+", -1), lambda w: F.struct(w.alias("word"), text_width(w, widths, other).alias("width")))
    gap = widths.get(" ", other)
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("width"))

    def add(done: Column, w: Column) -> Column:
        wide = done["width"] + gap + w["width"]
        return F.when(done["line"] == "", F.struct(done["lines"].alias("lines"), w["word"].alias("line"), w["width"].alias("width"))) \
            .when(wide > room, F.struct(F.array_append(done["lines"], done["line"]).alias("lines"), w["word"].alias("line"), w["width"].alias("width"))) \
            .otherwise(F.struct(done["lines"].alias("lines"), F.concat(done["line"], F.lit(" "), w["word"]).alias("line"), wide.alias("width")))

    done = F.aggregate(words, start, add)
    return F.slice(F.when(done["line"] == "", done["lines"]).otherwise(F.array_append(done["lines"], done["line"])), 1, most)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fill(template: str, **values: Column) -> Column:
    """A template with each ``{{name}}`` replaced by its value, in one pass: names within values stay as they are."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    unknown = set(parts[1::2]) - set(values)
    if unknown:
        raise ValueError(f"the template names {sorted(unknown)[0]}, which has no value")
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])
