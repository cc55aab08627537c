from __future__ import annotations

import numpy as np
import xxhash

from ledgerloom.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


TEXTS = ["one two three four five six seven eight " * 5, "One TWO three four five six seven eight " * 5, "", None, " \t\n", "a b", "a  b", "word", "É é x y z w",
         " ".join(f"w{k}" for k in range(4000)), " ".join(f"w{k}" for k in range(3999)) + " changed", "the the the the the", "the " * 300]


def test_fingerprints():
    for text in TEXTS:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(50)]
    texts = list(TEXTS)
    for _ in range(12):
        words = list(rng.choice(vocabulary, 120))
        for _ in range(4):
            other = list(words)
            for at in rng.choice(120, rng.integers(0, 4), replace=False):
                other[at] = "edited"
            texts.append(" ".join(other))
    rows = [(k * 3 + 1, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[0], "n"), (None, "alone in the world of texts", "n")], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 3
    label = plain_groups([plain_fingerprint(t) for t in texts])
    by_id = {r["doc_id"]: r for r in found}
    for k, text in enumerate(texts):
        assert by_id[3 * k + 1]["fingerprint"] == f"{plain_fingerprint(text):016x}"
        assert by_id[3 * k + 1]["component_id"] == 3 * label[k] + 1
    assert sorted(str(r["component_id"]) for r in found if r["doc_id"] is None) == ["1", "None"]
    kept = simhash.representatives(docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted([0, 0, *{3 * x + 1 for x in label}])
    assert kept.columns == docs.columns


def test_rows_of_an_id_in_different_groups_all_stay(spark):
    alone = [" ".join(f"{k}x{j}" for j in range(40)) for k in range(6)]
    rows = [(1, alone[0]), (2, alone[0]), (2, alone[1]), (2, alone[2]), (2, alone[2]), (3, alone[2]), (3, alone[3]), (None, alone[4])]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, alone[0]), (2, alone[1]), (2, alone[2]), (3, alone[3]), (None, alone[4])]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_prefix_links_find_all_pairs():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(x) for x in seeds]
    for x in list(prints):
        for _ in range(5):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    p = np.unique(np.array(prints, np.uint64))
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4, 1))
    ends = [[], []]
    for prefix in range(256):
        near = np.flatnonzero(np.bitwise_count(p >> np.uint64(56) ^ np.uint64(prefix)) <= 2)
        for side, found in zip(ends, simhash.prefix_links(p[near], prefix, 8), strict=True):
            side.append(near[found])
    assert np.array_equal(simhash._roots(len(p), a, b), simhash._roots(len(p), *(np.concatenate(e) for e in ends)))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 10), (7, 7), (None, 3), (20, 25), (25, 21), (21, 30), (30, 22), *[(100, 100 + k) for k in range(1, 60)]]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(1, 6), 1), 10: 10, 11: 10, **dict.fromkeys((20, 21, 22, 25, 30), 20), **dict.fromkeys(range(100, 160), 100)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_dense_family_is_dealt_by_more_bits(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**63))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 9), replace=False)) for _ in range(400)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 200)}
    prints = np.array(sorted(prints), np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4, 1))
    want = simhash._roots(len(prints), a, b)
    frame = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long").cache()
    place = {int(x): k for k, x in enumerate(prints.view(np.int64))}
    for most, sorted_at_once in ((2_000_000, 1 << 20), (50, 500)):
        monkeypatch.setattr(simhash, "PREFIX_ROWS", most)
        monkeypatch.setattr(simhash, "SORTED", sorted_at_once)
        found = simhash.links(frame, len(prints)).collect()
        ends = np.array([(place[r["u"]], place[r["v"]]) for r in found], np.int64).reshape(-1, 2)
        assert np.array_equal(simhash._roots(len(prints), ends[:, 0], ends[:, 1]), want)


def test_representatives_keep_clashing_columns_and_agree(spark):
    rows = [(k, f"some words that are number {k // 2} of a few", k, k * 2, None) for k in range(20)] + [(0, "some words that are number 0 of a few", 77, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp long, _kept long, root string")
    kept = sorted(map(str, simhash.representatives(docs).collect()))
    assert len(kept) == 10 and simhash.representatives(docs).columns == docs.columns
    assert kept == sorted(map(str, simhash.representatives(docs.repartition(3)).collect()))


def test_small_sorts_find_the_same_links(monkeypatch):
    rng = np.random.default_rng(12)
    family = np.uint64(0xABCDEF0123456789) ^ np.array([sum(1 << int(b) for b in rng.choice(56, 3, replace=False)) for _ in range(300)], np.uint64)
    prints = np.unique(np.concatenate([family, rng.integers(0, 2**64, 300, dtype=np.uint64)]))
    prefix = 0xAB
    whole = simhash._roots(len(prints), *simhash.prefix_links(prints, prefix, 8))
    monkeypatch.setattr(simhash, "SORTED", 200)
    assert np.array_equal(simhash._roots(len(prints), *simhash.prefix_links(prints, prefix, 8)), whole) and len(set(whole)) < len(prints) - 200
