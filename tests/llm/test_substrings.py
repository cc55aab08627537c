from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import substrings


def plain(rows, length):
    """Brute force: what each row keeps."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            if doc is not None:
                first[data[k : k + length]] = min(first.get(data[k : k + length], doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if doc is not None and first[data[k : k + length]] < doc:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "ééé", "x", "river", "mill", "stone"]
    passages = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(12)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.randrange(0, 30)))]
        for _ in range(rng.randrange(0, 3)):
            cut = rng.choice(passages)
            parts.append(cut[rng.randrange(0, 20) : len(cut) - rng.randrange(0, 20)])
            parts.append(rng.choice(["", "tail", " ".join(rng.choice(words) for _ in range(9))]))
        rows.append((k * 2, "".join(parts)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "a" * 400), (203, "b" + "a" * 120), (204, "ab" * 90), (205, "ba" * 60), (206, ""), (207, None), (208, "short"), (208, "short")]
    rows += [(300, rows[7][1]), (300, rows[7][1]), (301, "z" * 49), (302, "z" * 50), (303, "z" * 50), (304, rows[3][1][:-1] + "!"), (None, rows[5][1]), (1, "€" * 100), (3, "x€" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = cases(seed)
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_bytes string")
    assert sorted((tuple(r) for r in substrings.remove_repeats(frame).collect()), key=str) == plain(rows, 50)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_SEGMENT", 64)
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(2000)) for _ in range(3)]
    whole = list(substrings.Hasher().stretches(texts))
    windows = set()
    for row, start, count, *_ in zip(*(np.concatenate(x) for x in zip(*whole))):
        windows |= {(int(row), int(start) + k) for k in range(int(count))}
    assert windows == {(r, k) for r in range(3) for k in range(1951)}


def test_equal_windows_have_equal_tokens():
    rng = random.Random(8)
    shared = bytes(rng.choice(b"abcdefgh") for _ in range(300))
    texts = [b"left " * 20 + shared + b" right" * 20, shared + b"tail" * 30]
    tokens = [{}, {}]
    for row, start, count, token, _ in zip(*(np.concatenate(x) for x in zip(*substrings.Hasher().stretches(texts)))):
        for k in range(int(count)):
            tokens[int(row)][texts[int(row)][start + k : start + k + 50]] = int(token)
    both = set(tokens[0]) & set(tokens[1])
    assert len(both) >= 251 and all(tokens[0][w] == tokens[1][w] for w in both)


def test_multikey_order():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, 4, 500) for _ in range(4)]
    order = substrings.multikey_order(columns)
    rows = list(zip(*(c.tolist() for c in columns)))
    assert [rows[k] for k in order] == sorted(rows)
    assert len(substrings.multikey_order([np.zeros(0, int), np.zeros(0, int)])) == 0


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [1, 10**9])
def test_a_passage_in_every_document(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "LEAST_HOT", 1)
    rng = random.Random(15)
    passage = "Permission is granted to copy this notice, as long as it stays whole and comes first. "
    rows = [(k, "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 90))) + passage + "".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 200)))) for k in range(300)]
    rows += [(k, rows[k - 300][1][: rng.randrange(40, 200)]) for k in range(300, 400)] + [(7, "the same id, another text " + passage)] * 3
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in substrings.remove_repeats(frame).collect()), key=str) == plain_by_row(rows, 50)


def plain_by_row(rows, length):
    """As plain(), where an id's rows differ: each row is judged on its own text."""
    return sorted(plain(rows, length), key=str)


def test_equal_hashes_are_not_enough():
    texts = [b"a" * 60, b"a" * 59 + b"b", b"a" * 60, b"c" * 60]
    data = np.frombuffer(b"".join(texts), np.uint8)
    same = np.zeros(4, np.uint64)
    whole, lead = substrings._copies(data, np.arange(4) * 60, np.full(4, 11), same, np.array([1, 2, 3, 4]), 50)
    assert whole.tolist() == [False, False, True, False] and lead.tolist() == [True, True, False, True]


def test_splitters_for_any_number_of_buckets():
    tokens = np.random.default_rng(2).integers(0, 2**64, 500, dtype=np.uint64)
    for buckets in (1, 12, 499, 100_000):
        ends = substrings._splitters(tokens, buckets)
        assert len(ends) <= buckets - 1 and np.all(ends[1:] > ends[:-1]) and len(ends) > 0.9 * (buckets - 1) - 1


def test_windows_are_compared_in_parts(monkeypatch):
    """The bucket's own function, with small parts, against all pairs."""
    monkeypatch.setattr(substrings, "PART_WINDOWS", 40)
    rng = random.Random(6)
    shared = bytes(rng.choice(b"xyz ") for _ in range(90))
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30))) + shared[rng.randrange(0, 20) : 90 - rng.randrange(0, 20)] + bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    row, start, windows, token, _ = (np.concatenate(x) for x in zip(*substrings.Hasher().stretches(texts)))
    opens = np.zeros(len(row), substrings._OPEN)
    opens["start"], opens["windows"], opens["token"] = start, windows, token & np.uint64((1 << 48) - 1)
    lists = [[{"bucket": 0, "opens": opens[row == k].tobytes()}] if (row == k).any() else [] for k in range(len(texts))]
    ids = list(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"doc_id": ids * 2, "key": ids * 2, "text": texts * 2, "lists": lists * 2})
    groups = {}
    for g, blob in substrings._cut_rows(batch, 50):
        groups.setdefault(g, []).append(blob)
    gone = {k: set() for k in range(len(texts))}
    for r in [r for blobs in groups.values() for r in substrings._resolve_bucket(50)(pa.table({"tokens": blobs})).to_pylist()]:
        for a, b in np.frombuffer(r["spans"], "<u4").reshape(-1, 2).tolist():
            gone[r["doc_id"]] |= set(range(a, b))
    for k, text in enumerate(texts):
        want = set()
        for a in range(len(text) - 49):
            if any(text[a : a + 50] in other for other in texts[:k]):
                want |= set(range(a, a + 50))
        assert gone[k] == want
