from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import jaccard


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()


def plain_join(rows):
    """``(doc_id, n_shingles, component_id, n_links)`` of ``(doc_id, text)`` rows, every pair compared."""
    sets = [plain_set(t) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                links[a] += 1
                links[b] += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return [(doc, len(s), least.get(x) if s else doc, n) for (doc, _), s, x, n in zip(rows, sets, label, links, strict=True)]


def texts_of(rng):
    vocabulary = [f"w{k}" for k in range(2000)]
    passage = " ".join(rng.choice(vocabulary, 60))
    texts = ["", None, " \t\x0b\n", "one", "ONE", "one two", "one two three", "one two three four", "a a a a a a", "a a a a", "É é", "é é", "word " * 5000]
    for size in (5, 12, 30, 120, 400):
        for _ in range(3):
            words = list(rng.choice(vocabulary, size))
            for _ in range(6):
                other = list(words)
                for at in rng.choice(size, rng.integers(0, 1 + max(1, size // 30)), replace=False):
                    other[at] = f"edit{rng.integers(0, 4)}"
                texts.append(" ".join(other))
    # One passage that many documents have, of which some are hardly more.
    texts += [passage + " " + " ".join(rng.choice(vocabulary, n)) for n in [*[80] * 30, *[2, 4, 6, 8] * 4]]
    return texts


def found(frame, **more):
    return sorted(map(tuple, jaccard.join(frame, **more).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=repr)


@pytest.mark.parametrize("tokens", [jaccard.BLOCK_TOKENS, 500])
def test_equals_all_pairs(spark, monkeypatch, tokens):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", tokens)
    texts = texts_of(np.random.default_rng(11))
    rows = [(3 * k + 2, t) for k, t in enumerate(texts)]
    rows += [rows[4], rows[40], (5, texts[60]), (None, texts[45]), (None, "alone in the world of texts"), (None, ""), (1, texts[45]), (10**9, texts[5].upper())]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class int, `a.b` string").repartition(5)
    assert found(frame) == sorted(plain_join(rows), key=repr)


def test_common_shingles_are_found_and_come_last(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, " ".join(rng.choice([f"w{j}" for j in range(500)], 40)) + " " + passage) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    common = jaccard.common_tokens(frame)
    assert set(jaccard.token_set(passage)) <= set(common)
    batch = frame.select("doc_id", "text").withColumn("row", frame.doc_id)
    kinds = "doc_id long, row long, n long, need long, class long, rare array<long>, common array<long>"
    sets = batch.mapInArrow(jaccard._sets(4, 85, common), kinds).collect()
    assert all(r["rare"] and not r["common"] for r in sets)
    assert found(frame) == sorted(plain_join(rows), key=repr)


def plain_reaching(lists, least):
    counts = Counter(i for x in lists for i in x.tolist())
    return {i: n for i, n in counts.items() if n >= least}


@pytest.mark.parametrize("heaped", [0, 10**9])
def test_divide_skip(monkeypatch, heaped):
    monkeypatch.setattr(jaccard, "HEAPED", heaped)
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = int(rng.integers(1, 60))
        lists = [np.unique(rng.integers(0, ids, rng.integers(1, 40))) for _ in range(rng.integers(1, 25))]
        for least in (1, 2, 5, len(lists)):
            got = jaccard.merged(lists, least)
            assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == plain_reaching(lists, least)
            assert got[0].tolist() == sorted(got[0].tolist())
            want = {i: n for i, n in plain_reaching(lists, least).items() if n >= least + i % 2}
            got = jaccard.reaching(lists, lambda ids, least=least: least + ids % 2, least)
            assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_links_equal_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, rng.integers(1, 200), replace=False), rng.integers(0, 2**63, 1, dtype=np.uint64))) for _ in range(60)]
    sets += [np.delete(base, rng.integers(0, 300, 20)) for _ in range(30)]
    sets = sorted((np.unique(s) for s in sets), key=len)
    want = {(a, b) for a in range(len(sets)) for b in range(a) if 185 * (o := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b])) and o}
    got = {(q, int(i)) for q, ids in jaccard.links(sets) for i in ids}
    assert got == want and len(want) > 200


def test_another_shingle_and_similarity(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i x"), (3, "q r s")]
    assert [r[3] for r in found(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, least=70)] == [1, 1, 0]


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
