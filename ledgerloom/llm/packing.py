"""Best-fit packing of token pieces, certified by dual-feasible-function bounds.

Tokens
    A document is its tokenizer ids, then one end id.  Only documents longer than
    the capacity are cut, into full pieces and a rest.  Words are encoded once per
    worker, Latin ones by the vocabulary's model alone, and kept in a bounded cache;
    the tokenizer itself drops white space, so the ids of a text are those of its
    words in order.  Its white space is that of ``str.split`` but for U+001C to
    U+001F, which are text to it.

Packing
    Pieces are dealt into groups of about ``GROUP_ROWS``; each group is packed by
    best-fit decreasing and gets a lower bound on its number of bins from
    dual-feasible functions.  A group whose bins equal its bound is certified and
    gives up its loosest bin alone, what its pieces leave over.  Groups with a gap
    give up the pieces of their loosest bins.  What is given up is exchanged (dealt
    anew, into as few groups as it fills) and packed again.  The
    exchange goes on while it closes bins and the bins exceed the bound of all
    pieces together; :func:`certificate` states bins, bound and the gap that is left.

Edge cases
    * null or empty text: the end id alone;
    * repeated rows are packed once each; ties by length go by id and piece;
    * null ids are packed like others;
    * extra columns are dropped by :func:`token_pieces` and kept by :func:`pack`, but
      one named ``sequence_id`` or ``offset``, its results, is replaced;
    * an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import fresh, quoted, removed, written

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
GROUP_ROWS = 100_000
#: Words that one worker keeps, some 80 MB; when full, it keeps those it met first, which are mostly the common ones.
CACHE_WORDS, CACHE_KEPT = 400_000, 300_000
_MARK, _MARK_ID = "<|endoftext|>", 49407


@cache
def _plain_letters() -> str:
    """The letters, as the inside of a regex class, that NFC keeps and lower-casing makes one letter of."""
    ranges: list[list[int]] = []
    for point in range(0xD800):
        c = chr(point)
        low = c.lower()
        # Letters of an old Unicode are letters to every tokenizer.
        if c.isalpha() and len(low) == 1 and unicodedata.ucd_3_2_0.category(c)[0] == "L" and unicodedata.normalize("NFC", c + low) == c + low:
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in ranges)


@cache
def _stop() -> re.Pattern[str]:
    """A stop after a letter is a token of its own, so it may be split from the word; but NFC and lower-casing
    make a letter and a mark of some letters, and that mark and the stop are one token."""
    return re.compile(rf"[.,](?<=[{_plain_letters()}][.,])(?=\s|\Z)")


@cache
def _latin() -> str:
    """Of these letters NFC, lower-casing and byte-level symbols are the same a letter at a time as in any context."""
    return "".join(re.findall(f"[{_plain_letters()}]", "".join(map(chr, range(0x250)))))


#: ``str.split`` drops these, the tokenizer does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORDS = re.compile(rf"[\S{_SEPARATORS}]+")


def _byte_symbols() -> dict[int, int]:
    """Byte-level tokenizers' symbol of each byte: printable ones stand for themselves, the others follow from U+0100."""
    others = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    return {b: 256 + n for n, b in enumerate(others)}


_SYMBOLS = _byte_symbols()


def words_of(text: str) -> list[str]:
    """The parts of a text that can be encoded on their own."""
    text = _stop().sub(r" \g<0>", text)
    return _WORDS.findall(text) if any(c in text for c in _SEPARATORS) else text.split()


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        # Whether this vocabulary takes a Latin word as one lower-case byte-level piece.
        probes = [*_latin(), *("a" + c + "b" for c in _latin())]
        self.latin = re.compile(f"[{re.escape(_latin())}]+").fullmatch
        self.direct = all(self._whole(w) == self._piece(w) for w in probes)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker and file; a name without a folder is a public vocabulary where the worker runs."""
        if "/" not in path:
            import public_tokenizers

            path = str(public_tokenizers.path(path))
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _piece(self, word: str) -> bytes:
        """The ids of a Latin word by the model alone, without what the tokenizer does around it."""
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SYMBOLS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        if self.direct:
            others = []
            for word in words:
                if self.latin(word):
                    self.words[word] = self._piece(word)
                else:
                    others.append(word)
            words = others
        plain = [w for w in words if "<|" not in w]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode(_MARK.join([*part, ""]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == _MARK_ID)
            if len(ends) != len(part):
                raise ValueError("the marker is not a token of its own in this vocabulary")
            data, start = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist(), strict=True):
                self.words[word] = data[4 * start : 4 * end]
                start = end + 1
        for word in words:
            if "<|" in word:
                self.words[word] = self._whole(word)

    def encode(self, text: str) -> bytes:
        words = words_of(text)
        found = list(map(self.words.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None))
            if len(self.words) + len(new) > CACHE_WORDS:
                self.words = dict(islice(self.words.items(), CACHE_KEPT))
                new = [w for w in dict.fromkeys(words) if w not in self.words]
            self._learn(new)
            found = map(self.words.__getitem__, words)
        return b"".join(found)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) for every piece of every row."""
    narrow = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            owners, rows, ids = [], [], []
            for at, text in enumerate(batch.column("text")):
                data = encoder.encode(text.as_py() or "") + end
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start : start + 4 * capacity]
                    owners.append(at)
                    rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, np.uint32).astype(np.int64))
            columns = list(zip(*rows)) if rows else [[]] * 4
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owners, pa.int64())), pa.array(columns[0], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in columns[1:]), *([pa.array(ids, pa.list_(pa.int64()))] * with_ids)], names)

    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit of the lengths in the given order: each one's bin and its offset there."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r: a bin with r free tokens is open
    for at, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, chosen = capacity, made
            made += 1
        bins[at], offsets[at] = chosen, capacity - room
        if room > length:
            open_bins[room - length].append(chosen)
            rooms |= 1 << room - length
    return bins, offsets


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins, the best of several dual-feasible functions."""
    return least_bins_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def least_bins_of(counts: np.ndarray, capacity: int) -> int:
    """The same of a histogram: how many pieces there are of each length from 0 to the capacity."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 13):
        # u(x) = x where (k+1)x is whole, else floor((k+1)x)/k; here times k * capacity
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    held = np.concatenate([[0], np.cumsum(counts)])
    sums = np.concatenate([[0], np.cumsum(counts * x)])
    for least in range(1, capacity // 2 + 1):
        # pieces over capacity-least need a bin each, pieces under least count nothing
        large = held[-1] - held[capacity - least + 1]
        middle = sums[capacity - least + 1] - sums[least]
        best = max(best, int(large) - (-int(middle) // capacity))
    return best


def _pack_group(capacity: int, last: bool, names: list[str]):
    def run(group: pa.Table) -> pa.Table:
        tie, bin_, at, loose_ = names
        group = group.sort_by([("length", "descending"), (tie, "ascending")])
        lengths = group.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        made = int(bins.max()) + 1
        fills = np.bincount(bins, lengths, made)
        loose = np.zeros(made, bool)
        if not last:
            # With a gap, enough of the loosest bins that their pieces can be arranged anew; else what is left over.
            many = max(64, made // 8) if made > least_bins(lengths, capacity) else 1
            order = np.lexsort((np.arange(made), fills))[:many]
            loose[order[fills[order] < capacity]] = True
        for name, values in ((bin_, bins), (at, offsets), (loose_, loose[bins])):
            group = group.set_column(group.column_names.index(name), name, pa.array(values))
        return group

    return run


def _bound(pieces: DataFrame, capacity: int) -> int:
    """The lower bound of all pieces together, from their histogram of at most ``capacity`` rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return least_bins_of(counts, capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """``bins`` of a packing, the lower ``bound`` on any packing's and the ``gap`` between them."""
    bins, bound = packed.select("sequence_id").distinct().count(), _bound(packed, capacity)
    return {"bins": bins, "bound": bound, "gap": bins - bound}


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ties = [c for c in ("doc_id", "piece") if c in names]
    # Grouped Python stages take no names with dots or back-ticks.
    plain = [c if c == "length" else f"_{k}" for k, c in enumerate(names)]
    tie, group, bin_, at, loose = fresh(plain, "_tie", "_group", "_bin", "_offset", "_loose")
    zero = F.lit(0).cast("long")
    left = pieces.select(*[quoted(c).alias(p) for c, p in zip(names, plain, strict=True)], F.xxhash64(*ties, F.lit(7)).alias(tie) if ties else zero.alias(tie),
                         zero.alias(group), zero.alias(bin_), zero.alias(at), F.lit(True).alias(loose))
    bound, rows = _bound(pieces, capacity), pieces.count()
    done, closed, rounds, before = None, 0, 0, None
    while True:
        groups = max(1, math.ceil(rows / group_rows))
        # The row's place keeps many equal rows from meeting in one group.
        place = F.pmod(F.xxhash64(tie, F.monotonically_increasing_id(), F.lit(rounds)), F.lit(groups))
        dealt = left.withColumn(group, place)
        run = _pack_group(capacity, groups == 1, [tie, bin_, at, loose])
        packed = written(dealt.groupBy(group).applyInArrow(run, dealt.schema), "packed")
        said = packed.groupBy(group, loose).agg(F.count_distinct(bin_).alias("bins"), F.count("*").alias("rows"))
        said = said.groupBy(loose).agg(F.sum("bins").alias("bins"), F.sum("rows").alias("rows")).collect()
        bins = {r[loose]: r["bins"] for r in said}
        total = closed + sum(bins.values())
        # An exchange that closed no bin, or a packing at the bound, is the last.
        last = not bins.get(True) or total == bound or before is not None and total >= before
        number = ((F.lit(rounds) * (1 << 22) + F.col(group)) * (1 << 24) + F.col(bin_)).alias("sequence_id")
        final = (packed if last else packed.where(~F.col(loose))).select(*plain, number, F.col(at).alias("offset"))
        done = final if done is None else done.unionByName(final)
        if last:
            return done.toDF(*names, "sequence_id", "offset")
        left, rows, before = packed.where(F.col(loose)), next(r["rows"] for r in said if r[loose]), total
        closed += bins.get(False, 0)
        rounds += 1


def pack_documents(docs: DataFrame, tokenizer: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """All rows of ``docs`` as packed pieces; ``tokenizer`` is a public vocabulary's name, or a path that all workers have."""
    pieces = written(token_pieces(docs, str(tokenizer), capacity=capacity), "pieces")
    packed = pack(pieces, capacity)
    removed(pieces)  # the packing is written
    return packed
