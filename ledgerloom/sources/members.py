"""Python Data Source ``members``: one YAML or JSON document as rows, a row per member of its lists.

A catalog's index is one document, however many features it lists.  Its rows
``part, at, raw, error`` are the ``head`` (the document as JSON text, its lists empty) and the
members of each list at its top (``part`` is the list's key, ``at`` the place from 0, ``raw`` the member as JSON
text), so that no value and no task holds the whole document.

Reading
    Of a YAML document in block style the driver looks at the lines' beginnings once, as bytes, and
    keeps an offset per split; tasks parse the members of their split.  A split that does not parse
    alone (it refers to an anchor elsewhere, say) is read again by streaming the document from its
    beginning.  JSON is streamed in one task, a member at a time.  A document
    that cannot be read is a row ``error`` with its message; one without a mapping at the top is a head.
    A line in a list's own indentation that begins with a dash is a member: text within quotes must not
    be continued so.

Writing
    Rows ``part, at, raw``, sorted by ranges of part and place (:func:`write_members`), become one YAML document.  Each task
    writes its members' text beside the document; the commit puts the texts behind each other and
    the document in its place, whole.  A failed job leaves the old document.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerloom.sources.shared import Staging, created, local_path

SCHEMA = "part string, at long, raw string, error string"
#: Bytes of a split.
SPLIT = 8 << 20
_CHUNK = 1 << 20


def _loader() -> Any:
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def as_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def as_yaml(value: Any) -> str:
    import yaml

    return yaml.dump(value, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), default_flow_style=False, sort_keys=False, allow_unicode=True)


@dataclass
class Span(InputPartition):
    """Members of one list from place ``at``, or, without a key, the parts of the document that are in no list."""

    key: str | None
    at: int
    pieces: list[tuple[int, int]]


#: A key at the margin and the first dash of its list.
_LIST = re.compile(rb"""(?m)^(?:"([^"\\\n]+)"|'([^'\n]+)'|([^\s:'"{}\[\]#&*!|>%@`,?\-][^:\n]*)):()[ \t]*(?:\#[^\n]*)?\r?\n(?:[ \t]*(?:\#[^\n]*)?\r?\n)*([ ]*)-(?=[ \r\n])""")
_END = re.compile(rb"(?m)^(?:[^\s#\-]|--)")


def spans(content: bytes | mmap.mmap, split: int = SPLIT) -> list[Span]:
    """A block-style document's splits, the one of its other parts first."""
    other, found, after = [], [], 0
    for list_ in _LIST.finditer(content):
        key = next(g for g in list_.group(1, 2, 3) if g is not None).decode("utf-8", "replace")
        begin, end = list_.start(5), _END.search(content, list_.end())
        stop = end.start() if end else len(content)
        other.append((after, list_.start(4)))
        start, first, at = begin, 0, 0
        for dash in re.compile(rb"(?m)^ {%d}-(?=[ \r\n]|\Z)" % len(list_[5])).finditer(content, begin, stop):
            if dash.start() - start >= split:
                found.append(Span(key, first, [(start, dash.start())]))
                start, first = dash.start(), at
            at += 1
        found.append(Span(key, first, [(start, stop)]))
        after = stop
    return [Span(None, 0, [*other, (after, len(content))]), *found]


def _streamed(path: str) -> Iterator[tuple[str | None, int, Any]]:
    """``(key, at, member)`` of a YAML document's lists, one after another, and at last ``(None, 0, the rest)``."""
    import yaml

    with open(path, "rb") as handle:
        loader = yaml.SafeLoader(handle)
        build = lambda: loader.construct_document(loader.compose_node(None, None))
        rest: Any = {}
        loader.get_event()
        if loader.check_event(yaml.StreamEndEvent):
            yield None, 0, None
            return
        loader.get_event()
        if not loader.check_event(yaml.MappingStartEvent):
            yield None, 0, build()
            return
        loader.get_event()
        while not loader.check_event(yaml.MappingEndEvent):
            key = build()
            if loader.check_event(yaml.SequenceStartEvent):
                loader.get_event()
                at = 0
                while not loader.check_event(yaml.SequenceEndEvent):
                    yield key, at, build()
                    at += 1
                loader.get_event()
                rest[key] = []
            else:
                rest[key] = build()
        yield None, 0, rest


def _json_streamed(path: str) -> Iterator[tuple[str | None, int, Any]]:
    """The same of a JSON document, read by pieces."""
    decoder, blank = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
    with open(path, encoding="utf-8") as handle:
        held, at, ended = "", 0, False

        def more() -> None:
            nonlocal held, at, ended
            piece = handle.read(max(_CHUNK, len(held) - at))
            held, at, ended = held[at:] + piece, 0, not piece

        def seen() -> str:
            """The next character that is not blank; empty at the end."""
            nonlocal at
            while True:
                at = blank.match(held, at).end()
                if at < len(held) or ended:
                    return held[at : at + 1]
                more()

        def taken(one: str) -> None:
            nonlocal at
            if seen() != one:
                raise ValueError(f"expected {one!r} in JSON text")
            at += 1

        def value() -> Any:
            nonlocal at
            seen()
            while True:
                try:
                    found, end = decoder.raw_decode(held, at)
                    # A number may go on in the next piece.
                    if end < len(held) or ended:
                        at = end
                        return found
                except ValueError:
                    if ended:
                        raise
                more()

        if seen() != "{":
            yield None, 0, value()
        else:
            taken("{")
            rest: dict[str, Any] = {}
            while seen() != "}":
                if rest or held[at] == ",":
                    taken(",")
                key = value()
                taken(":")
                if seen() != "[":
                    rest[key] = value()
                    continue
                taken("[")
                place, rest[key] = 0, []
                while seen() != "]":
                    if place:
                        taken(",")
                    yield key, place, value()
                    place += 1
                taken("]")
            taken("}")
            yield None, 0, rest
        if seen():
            raise ValueError("text after the JSON document")


class MembersReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = local_path(options["path"])
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path) and not self.path.endswith(".json") and os.path.getsize(self.path):
            with open(self.path, "rb") as handle, mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ) as content:
                return spans(content, self.split)
        return [InputPartition(None)]

    def _whole(self) -> Iterator[tuple]:
        for key, at, value in (_json_streamed if self.path.endswith(".json") else _streamed)(self.path):
            yield ("head" if key is None else str(key), at, as_json(value), None)

    def _alone(self, span: Span) -> list[tuple]:
        """The rows of a span by its own bytes."""
        import yaml

        with open(self.path, "rb") as handle:
            texts = []
            for begin, end in span.pieces:
                handle.seek(begin)
                texts.append(handle.read(end - begin))
        if span.key is not None:
            members = yaml.load(texts[0], Loader=_loader())
            return [(span.key, span.at + k, as_json(m), None) for k, m in enumerate(members)]
        head = yaml.load(b" []\n".join(texts), Loader=_loader())
        rows = []
        if isinstance(head, dict):
            for key, value in head.items():
                if isinstance(value, list):
                    rows += [(str(key), k, as_json(m), None) for k, m in enumerate(value)]
                    head[key] = []
        return [("head", 0, as_json(head), None), *rows]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not os.path.isfile(self.path):
            return
        try:
            if not isinstance(partition, Span):
                yield from self._whole()
                return
            try:
                rows = self._alone(partition)
            except Exception:  # it needs what is elsewhere in the document
                rows = None
            if rows is not None:
                yield from rows
            else:
                yield from self._of(partition)
        except Exception as error:  # a bad document is a row with an error, not a failed job
            yield ("error", 0, None, f"{type(error).__name__}: {error}")

    def _of(self, span: Span) -> Iterator[tuple]:
        """A span's rows, by streaming the document: its list's members up to the next span's; of the head all that no span has."""
        with open(self.path, "rb") as handle, mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ) as content:
            every = spans(content, self.split)
        keys = {s.key for s in every}
        end = min((s.at for s in every if s.key == span.key and s.at > span.at), default=None)
        for row in self._whole():
            if span.key is None and row[0] not in keys or row[0] == span.key and span.at <= row[1] and (end is None or row[1] < end):
                yield row


@dataclass
class Texts(WriterCommitMessage):
    """What one attempt wrote: ``(part, first place, file)``, and the head if it had it."""

    parts: list[tuple[str, int, str]]
    head: str | None


class MembersWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = local_path(options["path"])
        self.staging = Staging(self.path)

    def write(self, iterator: Iterator[Row]) -> Texts:
        folder, handle = self.staging.attempt()
        done, file = Texts([], None), None
        try:
            for row in iterator:
                if row["part"] == "head":
                    done.head = row["raw"]
                    continue
                if not done.parts or done.parts[-1][0] != row["part"]:
                    if file:
                        file.close()
                    name = str(len(done.parts))
                    done.parts.append((row["part"], row["at"], os.path.join(folder, name)))
                    file = created(handle, name)
                file.write(as_yaml([json.loads(row["raw"])]).encode("utf-8"))
        finally:
            if file:
                file.close()
            os.close(handle)
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        texts = [m for m in messages if isinstance(m, Texts)]
        heads = [m.head for m in texts if m.head is not None]
        parts = sorted(p for m in texts for p in m.parts)
        head = json.loads(heads[0]) if heads else {}
        head |= {p: [] for p, *_ in parts}
        whole = os.path.join(self.staging.path, "whole")
        with open(whole, "wb") as to:
            for key, value in head.items():
                own = [file for part, _, file in parts if part == key]
                to.write((as_yaml({key: None}).partition(":")[0] + ":\n" if own else as_yaml({key: value})).encode("utf-8"))
                for file in own:
                    with open(file, "rb") as given:
                        shutil.copyfileobj(given, to)
        os.replace(whole, self.path)
        self.staging.remove()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.staging.remove()


class MembersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MembersReader:
        return MembersReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MembersWriter:
        return MembersWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    from ledgerloom.shipping import ship

    ship(spark)
    spark.dataSource.register(MembersSource)


def read_members(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``part, at, raw, error`` of a document; no row if there is none."""
    register(spark)
    return spark.read.format("members").option("split", str(split)).load(path)


def write_members(rows: DataFrame, path: str) -> None:
    """``part, at, raw`` as one YAML document."""
    register(rows.sparkSession)
    ordered = rows.select("part", F.col("at").cast("long").alias("at"), "raw").repartitionByRange("part", "at").sortWithinPartitions("part", "at")
    ordered.write.format("members").mode("append").save(path)
