"""Exact removal of repeated byte strings by a sparse, range-partitioned suffix array.

A byte of a document is removed if a string of ``LENGTH`` bytes that covers it also
starts in a document with a smaller id, judged on the input.

Sparse suffixes
    Of the ``LENGTH``-byte windows of a text, neighbours whose smallest ``GRAM``-byte
    hash is the same make one *stretch* (at most ``MOST`` windows).  Two equal
    windows always have the same smallest hash, so only suffixes at stretches need
    sorting, about one in 17 of all.  A stretch's leading token is that hash.

Range partitioning
    Splitters sampled from the leading tokens of a sample of documents, spread over
    the whole table by a hash of the id, cut the tokens' range into buckets of about
    ``BUCKET_BYTES`` of text, as many as the data takes.  What travels is packed
    tokens, not text.  A bucket sorts its suffixes by token; those whose token also
    leads suffixes of another document are *open*.

Local sort and compare
    Only the bytes of open stretches are cut from the text and sent to their bucket.
    There, equal stretches are found by hash and then compared byte by byte with the
    first; what is left of a token with several kinds of stretches is sorted as
    single windows, by multikey sort on eight bytes at a time, and compared with its
    neighbours.  Hashes only ever choose what is compared: nothing is removed that
    was not compared in bytes.  Equal leading tokens share a bucket, so there is
    nothing to compare across a boundary.

Hot tokens
    Equal stretches within a batch of texts are compared there, and the smallest id
    alone sends them on.  A token that more than ``HOT`` documents have, as the sample
    tells, has no bucket: its windows are dealt on their own, by a
    hash of their bytes, after equal ones of a batch were compared.  So a string that
    every document has costs a row per batch, and no task receives a token's or a
    string's whole share of the corpus.  The sample touches the balance alone.

Copies
    Copies of a whole text are found by their SHA-256 and removed whole; within a
    batch only the smallest id of a text sends its tokens.

The text is shuffled once (cut and final assembly reuse the exchange), for joins that the
engine may split where rows repeat.

Edge cases
    * null text: empty; texts shorter than ``LENGTH`` keep everything;
    * null ids: such rows are kept whole and remove nothing elsewhere;
    * repeated rows: an id is not smaller than itself, so they do not remove each
      other; each gets its own result row;
    * very long texts are hashed in overlapping segments, with the same result;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import bitmap, in_bitmap, removed, written

LENGTH = 50
GRAM = 20
MOST = 31
BUCKET_BYTES = 32 << 20
#: Documents of the sample, at least, and one in so many of a large table.
SAMPLE_DOCS, SAMPLE_SHARE = 2_000, 100_000
#: A token is hot if, by the sample, more documents than this have it, and at least ``LEAST_HOT`` sampled ones do.
HOT, LEAST_HOT = 500_000, 4
#: Windows that a task compares at once.
PART_WINDOWS = 500_000
#: Tokens taken from a segment of a sampled document, and tokens from which splitters are made.
SAMPLE_TOKENS, SPLIT_TOKENS = 1_024, 25_600
_SEGMENT = 1 << 20
_EMIT = 8 << 20
#: Groups that a bucket's open stretches are dealt to, by token.
_DEALT = 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)
_OPEN = np.dtype([("start", "<u4"), ("windows", "<u4"), ("token", "<u8")])


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Tokens of texts; keeps its tables between segments."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        self.up = self.down = np.zeros(0, np.uint64)

    def stretches(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """``(row, start, windows, token, content)`` arrays of all stretches of the texts."""
        parts: list[bytes] = []
        rows: list[int] = []
        bases: list[int] = []
        size = 0
        for row, text in enumerate(texts):
            for base in range(0, max(len(text) - self.length + 1, 0), _SEGMENT):
                part = text[base : base + _SEGMENT + self.length - 1]
                if size + len(part) > 2 * _SEGMENT:
                    yield self._segment(parts, rows, bases)
                    parts, rows, bases, size = [], [], [], 0
                parts.append(part)
                rows.append(row)
                bases.append(base)
                size += len(part)
        if parts:
            yield self._segment(parts, rows, bases)

    def _segment(self, parts: list[bytes], rows: list[int], bases: list[int]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(parts), np.uint8)
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.down[: len(data)], out=sums[1:])
        grams = (sums[self.gram :] - sums[: -self.gram]) * self.up[: len(data) - self.gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
        least, have, width = grams, 1, self.length - self.gram + 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        counts = lengths - self.length + 1  # windows of each part; a part has one at least
        first = np.repeat(ends - lengths - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        at = first + np.arange(len(first))
        token = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (token[1:] != token[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        runs = np.diff(np.append(begin, len(at)))
        split = -(-runs // MOST)
        nth = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
        start = np.repeat(begin, split) + nth * MOST
        windows = np.minimum(np.repeat(runs, split) - nth * MOST, MOST)
        place = at[start]
        content = (sums[place + windows + self.length - 1] - sums[place]) * self.up[place]
        content ^= content >> np.uint64(31)
        content *= np.uint64(0xBF58476D1CE4E5B9)
        part = np.searchsorted(ends, place, "right")
        offset = place - (ends - lengths)[part] + np.array(bases)[part]
        return np.array(rows)[part], offset, windows, token[start], content >> np.uint64(16)


def _encoded(ids: np.ndarray, keys: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray, token: np.ndarray, cut: bytes = b"") -> bytes:
    """Stretches of one bucket, in order of row, and what was cut at them, as one compressed string."""
    new = np.concatenate([[True], row[1:] != row[:-1]])
    begin = np.flatnonzero(new)
    step = start.astype(np.int64).copy()
    step[1:] -= np.where(new[1:], 0, start[:-1])
    narrow = lambda x, n: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()
    head = np.array([len(begin), len(row)], "<u4").tobytes()
    body = [ids[row[begin]].astype("<i8").tobytes(), keys[row[begin]].astype("<i8").tobytes(), np.diff(np.append(begin, len(row))).astype("<u4").tobytes(),
            step.astype("<u4").tobytes(), windows.astype(np.uint8).tobytes(), narrow(token & np.uint64((1 << 48) - 1), 6), cut]
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def _decoded(blob: bytes) -> tuple[np.ndarray, ...]:
    docs, n = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    data, at = zstandard.ZstdDecompressor().decompress(blob[8:]), 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    ids, keys, counts, step, windows = take("<i8", docs), take("<i8", docs), take("<u4", docs), take("<u4", n), take("u1", n)
    token = np.zeros((n, 8), np.uint8)
    token[:, :6] = take("u1", 6 * n).reshape(-1, 6)
    total = np.cumsum(step.astype(np.int64))
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    start = total - np.repeat(total[before] - step[before], counts)
    return ids, keys, counts, start, windows.astype(np.int64), token.view("<u8").ravel(), np.frombuffer(data, np.uint8, offset=at)


def _joined(blobs: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
    """All stretches of the strings: ids, keys, row, start, windows, token and the bytes cut."""
    parts, docs = [], 0
    for blob in blobs:
        ids, keys, counts, start, windows, token, cut = _decoded(blob.as_py())
        parts.append((ids, keys, np.repeat(np.arange(docs, docs + len(ids), dtype=np.int32), counts), start.astype(np.uint32), windows.astype(np.uint8), token, cut))
        docs += len(ids)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order by several columns: ties of one column are refined by the next alone."""
    order = np.argsort(columns[0], kind="stable")
    run = np.concatenate([[0], np.cumsum(columns[0][order][1:] != columns[0][order][:-1])]) if len(order) else order
    for column in columns[1:]:
        size = np.bincount(run, minlength=1)
        tied = np.flatnonzero(size[run] > 1) if len(run) else run
        if not len(tied):
            break
        inner = np.lexsort((column[order[tied]], run[tied]))
        order[tied] = order[tied][inner]
        value = column[order]
        new = np.concatenate([[False], (run[1:] != run[:-1]) | ((value[1:] != value[:-1]) & (size[run[1:]] > 1))])
        run = np.cumsum(new)
    return order


def _first_of(run: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each run's first value, for every member; runs are consecutive numbers."""
    begin = np.concatenate([[True], run[1:] != run[:-1]])
    return values[begin][np.cumsum(begin) - 1]


def _runs(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _copies(data: np.ndarray, place: np.ndarray, windows: np.ndarray, content: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches equal, in bytes, one of a smaller document; and which are their kind's first, or unlike it."""
    whole, lead = np.zeros(len(place), bool), np.ones(len(place), bool)
    order = np.argsort(content, kind="stable")
    order = order[_tied(_runs(content[order]))]
    order = order[np.lexsort((doc[order], content[order]))]
    first = _first_of(_runs(content[order]), order) if len(order) else order
    later = np.flatnonzero(doc[order] > doc[first])
    width = np.arange(MOST + length - 1)
    for at in range(0, len(later), 20_000):
        part = later[at : at + 20_000]
        a, b = order[part], first[part]
        inside = width < (windows[a].astype(np.int64) + length - 1)[:, None]
        last = len(data) - 1
        same = (data[np.minimum(place[a][:, None] + width, last)] == data[np.minimum(place[b][:, None] + width, last)]) | ~inside
        same = same.all(axis=1) & (windows[a] == windows[b])
        whole[a[same]] = True
    lead[whole] = False
    return whole, lead


def _tied(run: np.ndarray) -> np.ndarray:
    """Which members of consecutive runs are not alone."""
    same = run[1:] == run[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(run) else np.zeros(0, bool)


def _later(data: np.ndarray, place: np.ndarray, lead: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which windows also start in a smaller document.

    A multikey sort: by the leading key, then by eight bytes at a time, and what is
    alone leaves; so most windows are read no further than their first bytes.
    """
    found = np.zeros(len(place), bool)
    at = np.argsort(lead, kind="stable")
    run = _runs(lead[at])
    for offset in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        tied = _tied(run)
        at, run = at[tied], run[tied]
        word = np.zeros(len(at), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | data[place[at] + offset + k]
        inner = np.lexsort((word, run))
        at, run = at[inner], _runs(run[inner], word[inner])
    tied = _tied(run)
    at, run = at[tied], run[tied]
    if len(at):
        inner = np.lexsort((doc[at], run))
        at, run = at[inner], run[inner]
        found[at] = doc[at] > _first_of(run, doc[at])
    return found


def _spread(start: np.ndarray, place: np.ndarray, windows: np.ndarray, *owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Single windows of stretches: their starts, places and what belongs to their stretch."""
    counts = windows.astype(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(start.astype(np.int64), counts) + nth, np.repeat(place, counts) + nth, *(np.repeat(o, counts) for o in owners)


def _by_row(row: np.ndarray, keep: np.ndarray) -> list[np.ndarray]:
    """The kept places, a group for each row."""
    order = np.argsort(row, kind="stable")
    order = order[keep[order]]
    return np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []


def _spans(start: np.ndarray, size: np.ndarray | int) -> bytes:
    return np.stack([start.astype(np.int64), start.astype(np.int64) + size], axis=1).astype("<u4").tobytes()


#: What travels to a group: a bucket's tokens, a part's hot windows (numbered on from the buckets), or spans (below zero).
_SENT = "bucket int, doc_id long, key long, tokens binary, spans binary"
_MARKS = "doc_id long, key long, bucket int, spans binary, opens binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "doc_id", "key", "tokens", "spans"])


def _token_batches(splitters: np.ndarray, hot: np.ndarray, buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(length)
        for batch in batches:
            for part in _parts(batch):
                yield _sent(_batch_rows(hasher, part, splitters, hot, buckets))

    return run


def _batch_rows(hasher: Hasher, batch: pa.RecordBatch, splitters: np.ndarray, hot: np.ndarray, buckets: int) -> list[tuple]:
    length = hasher.length
    ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
    least: dict[bytes, int] = {}
    texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
    for row, text in enumerate(texts):
        if text not in least or ids[row] < ids[least[text]]:
            least[text] = row
    texts = [t if least[t] == row else b"" for row, t in enumerate(texts)]
    found = list(hasher.stretches(texts))
    if not found:
        return []
    row, start, windows, token, content = (np.concatenate(x) for x in zip(*found, strict=True))
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum([0, *map(len, texts)])
    place = base[row] + start
    # Stretches that a smaller document of the batch has too go no further.
    order = np.argsort(token)
    shared = order[_tied(_runs(token[order]))]
    whole = np.zeros(len(row), bool)
    whole[shared] = _copies(data, place[shared], windows[shared], token[shared] ^ content[shared], ids[row[shared]], length)[0]
    out = [(-1 - int(keys[row[p[0]]]) % buckets, int(ids[row[p[0]]]), int(keys[row[p[0]]]), None, _spans(start[p], windows[p] + (length - 1))) for p in _by_row(row, whole)]
    frequent = ~whole & in_bitmap(token, hot)
    bucket = np.searchsorted(splitters, token, "right")
    sent = np.flatnonzero(~whole & ~frequent)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    for part in np.split(sent, np.flatnonzero(np.diff(bucket[sent])) + 1) if len(sent) else []:
        out.append((int(bucket[part[0]]), None, None, _encoded(ids, keys, *(x[part] for x in (row, start, windows, token))), None))
    for part in np.array_split(np.flatnonzero(frequent), -(-int(windows[frequent].sum()) // 100_000) or 1):
        if len(part):
            out += _hot_rows(data, ids, keys, *_spread(start[part], place[part], windows[part], row[part]), buckets, length)
    return out


def _digests(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window's bytes."""
    mixed = np.zeros(len(place), np.uint64)
    for k in range(length):
        mixed = (mixed ^ data[place + k]) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def _hot_rows(data, ids, keys, start, place, row, buckets: int, length: int) -> list[tuple]:
    """Windows dealt by a hash of their bytes; of equal ones the smallest document's."""
    mixed = _digests(data, place, length)
    gone = _later(data, place, mixed, ids[row], length)
    out = [(-1 - int(keys[row[p[0]]]) % buckets, int(ids[row[p[0]]]), int(keys[row[p[0]]]), None, _spans(start[p], length)) for p in _by_row(row, gone)]
    number = (mixed % np.uint64(buckets)).astype(np.int64)
    left = np.flatnonzero(~gone)
    left = left[np.lexsort((start[left], row[left], number[left]))]
    cut = np.lib.stride_tricks.sliding_window_view(data, length)
    for part in np.split(left, np.flatnonzero(np.diff(number[left])) + 1) if len(left) else []:
        ones = np.ones(len(part), np.int64)
        out.append((buckets + int(number[part[0]]), None, None, _encoded(ids, keys, row[part], start[part], ones, mixed[part], cut[place[part]].tobytes()), None))
    return out


def _mark_group(buckets: int, length: int):
    """A group's marks: open stretches of a bucket, spans of a part's hot windows, or spans as they came."""

    def run(group: pa.Table) -> pa.Table:
        number = group.column("bucket")[0].as_py()
        out: list[tuple] = []
        if number < 0:
            out = [(d.as_py(), k.as_py(), None, s.as_py(), None) for d, k, s in zip(*(group.column(c) for c in ("doc_id", "key", "spans")), strict=True)]
        else:
            ids, keys, row, start, windows, token, cut = _joined(group.column("tokens"))
            doc = ids[row]
            if number >= buckets:
                place = np.arange(len(row), dtype=np.int64) * length
                gone = _later(cut, place, _digests(cut, place, length), doc, length)
                out = [(int(ids[row[p[0]]]), int(keys[row[p[0]]]), None, _spans(start[p], length), None) for p in _by_row(row, gone)]
            else:
                order = multikey_order([token, doc])
                lead = _runs(token[order])
                low, high = _first_of(lead, doc[order]), _first_of(lead[-1] - lead[::-1], doc[order][::-1])[::-1]
                opened = np.zeros(len(row), bool)
                opened[order] = low < high
                opens = np.zeros(len(row), _OPEN)
                opens["start"], opens["windows"], opens["token"] = start, windows, token
                out = [(int(ids[row[p[0]]]), int(keys[row[p[0]]]), number, None, opens[p].tobytes()) for p in _by_row(row, opened)]
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = {"doc_id": pa.int64(), "key": pa.int64(), "bucket": pa.int32(), "spans": pa.binary(), "opens": pa.binary()}
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return run


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``_EMIT`` bytes of text; one text is never split."""
    column, at = batch.column("text"), 0
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)) if len(column) else []
    while at < batch.num_rows:
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _EMIT)))
        yield batch.slice(at, stop - at)
        at = stop


def _cut_batches(length: int):
    """The open stretches with their bytes, packed for each group of tokens; a row that repeats in a batch counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                rows = _cut_rows(part, length)
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["bucket", "tokens"])

    return run


def _cut_rows(batch: pa.RecordBatch, length: int) -> list[tuple[int, bytes]]:
    ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key"))
    met: set[tuple] = set()
    opens, row, bucket, texts = [], [], [], []
    for at, (text, lists) in enumerate(zip(batch.column("text"), batch.column("lists"), strict=True)):
        name = (int(ids[at]), int(keys[at]))
        texts.append(b"" if name in met else text.as_buffer().to_pybytes())
        for item in [] if name in met else lists.as_py():
            opens.append(np.frombuffer(item["opens"], _OPEN))
            row.append(at)
            bucket.append(item["bucket"])
        met.add(name)
    if not opens:
        return []
    counts = [len(o) for o in opens]
    row, bucket, opens = np.repeat(row, counts), np.repeat(bucket, counts), np.concatenate(opens)
    data = np.frombuffer(b"".join(texts), np.uint8)
    place = np.cumsum([0, *map(len, texts)])[row] + opens["start"]
    sizes = opens["windows"].astype(np.int64) + length - 1
    group = bucket * _DEALT + (opens["token"] % np.uint64(_DEALT)).astype(np.int64)
    order = np.lexsort((opens["start"], row, group))
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        size = sizes[part]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        cut = data[np.repeat(place[part], size) + inner]
        one = opens[part]
        out.append((int(group[part[0]]), _encoded(ids, keys, row[part], one["start"], one["windows"], one["token"], cut.tobytes())))
    return out


def _resolve_bucket(length: int):
    powers = _powers(_BASE, MOST + length)

    def run(group: pa.Table) -> pa.Table:
        ids, keys, row, start, windows, token, data = _joined(group.column("tokens"))
        start, windows, doc = start.astype(np.int64), windows.astype(np.int64), ids[row]
        sizes = windows + length - 1
        base = np.cumsum(sizes) - sizes
        content = np.concatenate([_contents(data, base[a : a + 50_000], sizes[a : a + 50_000], powers) for a in range(0, len(base), 50_000)])
        whole, lead = _copies(data, base, windows, token ^ content, doc, length)
        gone_rows, gone_spans = [row[whole]], [np.stack([start[whole], (start + sizes)[whole]], axis=1)]
        # Firsts of their kind are compared window by window if their token has other documents' kinds too.
        left = np.flatnonzero(lead)
        left = left[np.lexsort((doc[left], token[left]))]
        run_of = _runs(token[left])
        low, high = _first_of(run_of, doc[left]), _first_of(run_of[-1] - run_of[::-1], doc[left][::-1])[::-1]
        left = left[low < high]
        # Equal tokens stay in one part; parts bound the memory of the windows, and of a larger one the windows' first byte does.
        ends = np.flatnonzero(np.diff(token[left]) != 0) + 1
        load = np.cumsum(windows[left]) // PART_WINDOWS
        cuts = ends[np.diff(load[ends - 1], prepend=0) > 0] if len(ends) else ends
        for part in np.split(left, cuts):
            slices = -(-int(windows[part].sum()) // (2 * PART_WINDOWS))
            for nth in range(slices):
                begin, place, owner, leading = _spread(start[part], base[part], windows[part], row[part], token[part])
                if slices > 1:
                    here = data[place] % slices == nth
                    begin, place, owner, leading = (x[here] for x in (begin, place, owner, leading))
                found = _later(data, place, leading, ids[owner], length)
                gone_rows.append(owner[found])
                gone_spans.append(np.stack([begin[found], begin[found] + length], axis=1))
        row, spans = np.concatenate(gone_rows), np.concatenate(gone_spans)
        out = [(int(ids[row[p[0]]]), int(keys[row[p[0]]]), spans[p].astype("<u4").tobytes()) for p in _by_row(row, np.ones(len(row), bool))]
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "key": pa.array(columns[1], pa.int64()), "spans": pa.array(columns[2], pa.binary())})

    return run


def _contents(data: np.ndarray, base: np.ndarray, sizes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """A hash of each stretch, whose bytes lie one after the other."""
    part = data[base[0] : base[-1] + sizes[-1]]
    inner = np.arange(len(part)) - np.repeat(base - base[0], sizes)
    return np.add.reduceat(_TABLE[part] * powers[inner], base - base[0])


def _kept_batches(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lists in zip(batch.column("text"), batch.column("lists"), strict=True):
                data = text.as_buffer().to_pybytes()
                spans = np.concatenate([np.frombuffer(s.as_buffer(), "<u4").reshape(-1, 2) for s in lists.values])
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                edges = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + bool(gone[:1].any())
                out.append((int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(columns[: 3 + with_text], (pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                ["doc_id", "key", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def _sampled(rows: DataFrame, info: DataFrame, number: int, length: int) -> DataFrame:
    """``token`` of the distinct tokens of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met = Hasher(length), set()
        for batch in batches:
            for doc, key, text in zip(*(batch.column(c) for c in ("doc_id", "key", "text")), strict=True):
                if (doc.as_py(), key.as_py()) in met:
                    continue
                met.add((doc.as_py(), key.as_py()))
                few = [token[:: -(-len(token) // SAMPLE_TOKENS)] for *_, token, _ in hasher.stretches([text.as_buffer().to_pybytes()])]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([*few, np.zeros(0, np.uint64)])).view(np.int64))], ["token"])

    chosen = info.where("doc_id is not null").select("doc_id", "key").orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(number).distinct()
    # A sample's ids and hashes, 16 bytes each: 16 MB for 10**11 documents.
    return written(rows.join(F.broadcast(chosen), ["doc_id", "key"]).mapInArrow(run, "token long"), "sampled")


def _splitters(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of the buckets' ranges, between sampled tokens where there are more buckets than these."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    tokens = np.sort(tokens)
    places = np.linspace(0, len(tokens) - 1, buckets + 1)[1:-1]
    return np.unique(np.interp(places, np.arange(len(tokens)), tokens.astype(np.float64)).astype(np.uint64))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    info = written(every.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    total, count = info.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count("*")).first()
    rows = every.where("doc_id is not null")
    buckets = max(12, math.ceil(total / BUCKET_BYTES))
    number = max(SAMPLE_DOCS, count // SAMPLE_SHARE)
    sampled = _sampled(rows, info, number, length)
    unsigned = lambda found: np.array([r["token"] for r in found], np.int64).view(np.uint64)
    often = max(LEAST_HOT, math.ceil(HOT * min(number, count) / max(1, count)))
    # Some tokens more pass for hot, in every document alike; they are dealt by their windows, and nothing is lost.
    many = written(sampled.groupBy("token").count().where(F.col("count") >= often).select(F.col("token").alias("number")), "hot")
    hot = bitmap(many, many.count())
    tokens = unsigned(sampled.sample(min(1.0, SPLIT_TOKENS / max(1, sampled.count())), 17).collect())
    removed(sampled, many)
    sent = rows.mapInArrow(_token_batches(_splitters(tokens[~in_bitmap(tokens, hot)], buckets), hot, buckets, length), _SENT)
    marks = written(sent.groupBy("bucket").applyInArrow(_mark_group(buckets, length), _MARKS), "marks")

    opens = marks.where("opens is not null").groupBy("doc_id", "key").agg(F.collect_list(F.struct("bucket", "opens")).alias("lists"))
    cut = rows.join(opens.hint("merge"), ["doc_id", "key"]).mapInArrow(_cut_batches(length), "bucket int, tokens binary")
    found = cut.groupBy("bucket").applyInArrow(_resolve_bucket(length), "doc_id long, key long, spans binary")
    spans = marks.where("spans is not null").select("doc_id", "key", "spans").unionByName(found)
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("lists"))
    touched = rows.join(spans.hint("merge"), ["doc_id", "key"]).mapInArrow(
        _kept_batches(False), "doc_id long, key long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "key"])

    # Written, so that the join by a hot text has two plain sides and can be split.
    first = written(info.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first")), "first")
    named = info.join(first, "sha", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= length), F.lit(False))
    result = named.withColumn("copy", copy).join(touched, ["doc_id", "key"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return result.select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
