"""Interleaved document sequences: ordered text and media references, resolved by digest.

* :func:`sequences` parses HTML into an ordered array of ``text`` and ``media``
  items.  A media item carries the payload's digest, its place and its caption: that
  of the nearest enclosing figure that has one, else the alternative text.  Media
  elements that point elsewhere are listed apart, with the place they stand at.
* :func:`encode_media` stores payloads losslessly as 8-bit grey PNG images, 64
  samples a row, one row per distinct payload.
* :func:`read_media` reads stored images back: payload, checks and a feature.
* :func:`resolve` joins references with what the store holds, by digest; an
  unresolved reference keeps its place with null media columns.

Copies of a payload are stored once, so a hot payload is one row of the store; its
references are rows of a join by digest, which the engine may split.

Edge cases
    * null text: empty; a payload is padded with zero bytes to a positive multiple
      of 64, so an empty text is 64 zero bytes;
    * null or empty HTML: an empty sequence;
    * unclosed tags: an element ends with the one around it; a figure that is never
      closed ends with the page, a caption that is never closed with its first block;
    * a caption outside a figure, or in one without media, is text at its place;
    * repeated rows keep their own result rows; extra columns are ignored; empty
      tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import WORD, fresh

ROW = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SCHEME = "media:"
#: Where elements refer to media, in order; of a ``srcset`` every candidate is a reference.
_REFERENCES = {"img": ("src", "data-src", "srcset", "data-srcset"), "source": ("src", "data-src", "srcset", "data-srcset"), "audio": ("src", "data-src"), "video": ("src", "data-src", "poster"),
               "track": ("src",), "embed": ("src",), "iframe": ("src", "data-src"), "object": ("data",)}
#: Elements that end a run of text at either side, beside the blocks.
_BREAKS = frozenset("address button caption dd details dialog dl dt fieldset form hr label legend menu noscript option pre search select summary tbody template textarea tfoot thead title".split())
_BLOCKS = frozenset("article section main header footer aside nav div blockquote figure figcaption p ul ol li table tr td th h1 h2 h3 h4 h5 h6".split())
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
OUTSIDE = "array<struct<position:int,src:string,caption:string>>"


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of the payload, ``ROW`` samples a row; the length is a multiple of it."""
    lines = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The payload of an image made by :func:`to_png`; raises ValueError if it is damaged."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, width = 8, b"", 0
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """A 64-bit mean hash over the image's columns and the mean sample in thousandths."""
    sums = np.frombuffer(payload, np.uint8).reshape(-1, ROW).sum(axis=0, dtype=np.int64)
    total = int(sums.sum())
    bits = np.packbits(sums * ROW > total).tobytes().hex()
    return f"{bits}-{total * 1000 // len(payload)}"


def sources_of(tag: str, attributes: dict[str, str | None]) -> list[str]:
    """What a media element refers to, each once."""
    found: dict[str, None] = {}
    for name in _REFERENCES.get(tag, ()):
        value = (attributes.get(name) or "").strip()
        # Candidates end with the commas behind them, or behind what is said of their size.
        candidates = re.findall(r"[\s,]*(\S*[^\s,])(?:,+(?=\s|$)|[^,]*(?:,|$))", value) if name.endswith("srcset") else [value]
        found.update(dict.fromkeys(c for c in candidates if c))
    return list(found)


class _Figure:
    """An open figure: places of its media, which still lack a caption, and of its caption's blocks."""

    def __init__(self) -> None:
        self.media: list[int] = []
        self.said: list[int] = []


class _Sequence(HTMLParser):
    """Collects text runs and media references in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.open: list[tuple[str, _Figure | None, int]] = []  # element, its figure, blocks said before
        self.silent = 0

    def inner(self) -> tuple[str, _Figure | None]:
        """The innermost open figure or caption, and its figure."""
        return next(((tag, figure) for tag, figure, _ in reversed(self.open) if figure), ("", None))

    def add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> None:
        tag, figure = self.inner()
        if figure and kind != "text":
            figure.media.append(len(self.items))
        elif figure and tag == "figcaption":
            figure.said.append(len(self.items))
        self.items.append({"kind": kind, "text": text, "digest": digest, "caption": caption})

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.add("text", text, None, None)

    def leave(self) -> None:
        """Close the innermost open element."""
        self.flush()
        tag, figure, _ = self.open.pop()
        if tag != "figure" or not figure.media:
            return
        if figure.said:
            caption = " ".join(self.items[at]["text"] for at in figure.said)
            for at in figure.media:
                self.items[at]["caption"] = caption
            for at in figure.said:
                self.items[at]["kind"] = ""
        elif self.inner()[1]:
            self.inner()[1].media += figure.media

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        elif tag in _REFERENCES:
            named = dict(attrs)
            for source in sources_of(tag, named):
                self.flush()
                ours = source[: len(_SCHEME)].lower() == _SCHEME
                self.add("media" if ours else "outside", None, source[len(_SCHEME) :] if ours else source, named.get("alt") or None)
        elif tag in _BLOCKS:
            self.flush()
            if self.open and (self.open[-1][0] == "p" or self.open[-1][0] == tag == "li"):
                self.leave()
            figure = _Figure() if tag == "figure" else self.inner()[1] if tag == "figcaption" else None
            self.open.append((tag, figure, len(figure.said) if figure else 0))
        elif tag == "br" or tag in _BREAKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in _BREAKS:
            self.flush()
        elif tag in _BLOCKS:
            self.flush()
            if any(tag == t for t, *_ in (self.open[-1:] if tag == "p" else self.open)):
                while self.open[-1][0] != tag:
                    self.leave()
                self.leave()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)

    def finish(self) -> tuple[list[dict], list[dict]]:
        """The items, numbered, and the media elements that point elsewhere."""
        self.flush()
        for tag, figure, before in self.open:
            if tag == "figcaption" and figure:
                del figure.said[before + 1 :]
        while self.open:
            self.leave()
        items, outside = [], []
        for item in self.items:
            if item["kind"] == "outside":
                outside.append({"position": len(items), "src": item["digest"], "caption": item["caption"]})
            elif item["kind"]:
                items.append({"position": len(items), **item})
        return items, outside


def parse_page(html: str | None) -> tuple[list[dict], list[dict]]:
    """The ordered items of one page, and its media elements that point elsewhere."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    return parser.finish()


def parse_html(html: str | None) -> list[dict]:
    """The ordered items of one page."""
    return parse_page(html)[0]


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col, items, outside`` for every row of ``pages``.

    ``outside`` lists what points elsewhere: the position it stands before, its source and caption.
    """
    (html,) = fresh([id_col], "_html")
    narrow = pages.select(id_col, F.col(html_col).cast("string").alias(html))
    schema = narrow.select(id_col, F.lit(None).cast(ITEMS).alias("items"), F.lit(None).cast(OUTSIDE).alias("outside")).schema
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    other = pa.list_(pa.struct([("position", pa.int32()), ("src", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [parse_page(h.as_py()) for h in part.column(html)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array([p for p, _ in parsed], kind), pa.array([o for _, o in parsed], other)], [id_col, "items", "outside"])

    return narrow.mapInArrow(run, schema)


def page_report(pages: DataFrame) -> DataFrame:
    """``page_id, n_texts, n_media, n_outside, words, sequence_sha256`` for every row of ``pages (page_id, html)``.

    The hash is over the items in order, each as its kind, text or digest, and caption.
    """
    found = sequences(pages, "page_id", "html")
    of = lambda kind: F.filter("items", lambda i: i["kind"] == kind)
    told = F.array_join(F.transform("items", lambda i: F.concat_ws("\x1f", i["kind"], F.coalesce(i["text"], i["digest"], F.lit("")), F.coalesce(i["caption"], F.lit("")))), "\x1e")
    words = F.aggregate(of("text"), F.lit(0).cast("long"), lambda n, i: n + F.regexp_count(i["text"], F.lit(WORD)))
    return found.select("page_id", *[F.size(of(k)).cast("long").alias(f"n_{k}" if k == "media" else f"n_{k}s") for k in ("text", "media")], F.size("outside").cast("long").alias("n_outside"), words.alias("words"), F.sha2(told, 256).alias("sequence_sha256"))


def payload_of(text: Column) -> Column:
    """A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / ROW)).cast("int") * ROW
    return F.rpad(raw, size, F.lit(b"\x00"))


def encode_media(payloads: DataFrame) -> DataFrame:
    """The store ``digest, media`` of the distinct payloads in ``payloads (payload)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                seen = {hashlib.sha256(p.as_buffer()).hexdigest(): p for p in batch.column("payload").slice(at, 256)}
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([to_png(p.as_py()) for p in seen.values()], pa.binary())], ["digest", "media"])

    made = payloads.where("payload is not null").select("payload").mapInArrow(run, "digest string, media binary")
    return made.groupBy("digest").agg(F.first("media").alias("media"))


def read_media(store: DataFrame) -> DataFrame:
    """What the stored images say of themselves, read back from ``store (digest, media)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                stored = media.as_py()
                payload = from_png(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
                             len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def references(parsed: DataFrame) -> DataFrame:
    """One row per media item of :func:`sequences`' result: its place, digest and caption."""
    kept = [c for c in parsed.columns if c not in ("items", "outside")]
    items = parsed.select(*kept, F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item"))
    return items.select(*kept, "item.position", "item.digest", "item.caption")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the media columns of their digest; unresolved ones keep nulls."""
    return refs.join(media, "digest", "left")


def document_page(text: Column, digest: Column) -> Column:
    """A page of a text: its first line, a figure of the payload, its other lines, a link elsewhere and the payload again."""
    safe = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(char), F.lit(entity))
    lines = F.split(safe, "\n", -1)
    rest = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    return F.concat(
        F.lit("<article><p>"), F.get(lines, F.lit(0)), F.lit(f'</p><figure><img src="{_SCHEME}'), digest, F.lit('" alt="text"><figcaption>Text of '),
        F.octet_length(text).cast("string"), F.lit(" bytes</figcaption></figure>"), F.array_join(rest, ""),
        F.lit(f'<p>Cover: <img src="https://example.org/cover.png" alt="cover"> and again</p><img src="{_SCHEME}'), digest, F.lit('" alt="again"></article>'))


def placed_media(docs: DataFrame) -> DataFrame:
    """Every document's text as a stored image, referenced from a page and resolved by digest.

    Each document becomes a page with its lines, a figure and another reference; the page
    is parsed and the figure's reference joined to what was read back from the store.
    ``position`` and ``caption`` are the figure's, ``n_items`` counts the page's items and
    ``last_position`` is the other reference's.
    """
    narrow = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(payload_of(F.col("text")), 256)
    pages = narrow.select(F.struct("doc_id", F.octet_length("text").cast("long").alias("n_bytes")).alias("page"), document_page(F.col("text"), digest).alias("html"))
    parsed = sequences(pages, "page", "html")
    places = F.struct(F.col("page.doc_id"), F.col("page.n_bytes"), F.size("items").alias("n_items"), F.element_at("items", -1)["position"].alias("last_position"))
    refs = references(parsed.select(places.alias("page"), "items")).where("position < page.last_position")
    store = encode_media(narrow.select(payload_of(F.col("text")).alias("payload")))
    return resolve(refs.select("page.*", "position", "caption", "digest"), read_media(store)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "last_position")


def document_media(docs: DataFrame) -> DataFrame:
    """:func:`placed_media` without the places on the page."""
    return placed_media(docs).drop("position", "caption", "n_items", "last_position")
