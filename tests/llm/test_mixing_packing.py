from __future__ import annotations

import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from ledgerloom.llm import mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, full, left = 1.5 * sum(sizes.values()), {}, dict(weight)
    while left:
        rest = budget - sum(full.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in share if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {**full, **share}
        for s in over:
            full[s] = 2.0 * sizes[s]
            del left[s]
    return full


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(900):
        source = rng.choice(["b", "a", "é", "Z", None, *(["hot"] * 4)])
        rows.append((k, rng.choice([None, "", "w " * rng.randrange(1, 60), "same\tsize text"]), source, "clash"))
    rows += [rows[0], (None, "an id is missing", "a", "x"), (None, "an id is missing", "a", "x"), (5000, "w " * 4000, "b", "x"), (5001, None, "nothing", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    found = mixing.mixture(frame).collect()
    assert len(found) == len(rows)
    sizes, taken, said = Counter(), Counter(), {}
    by_id = {r[0]: r for r in rows}
    for r in found:
        text, source = by_id[r["doc_id"]][1], by_id[r["doc_id"]][2]
        assert r["size"] == len((text or "").split())
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        said[source] = (r["source_size"], r["target"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    for source, target in plain_targets(sizes).items():
        assert said[source][0] == sizes[source] and abs(said[source][1] - target) < 1e-6
        # One document may be most of its source; no sum of the others comes near then.
        assert abs(taken[source] - target) <= (300 if source == "b" else 1)
    again = mixing.mixture(frame.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mixture(frame.limit(0)).count() == 0


def test_fill_is_a_best_subset_sum():
    rng = random.Random(7)
    for _ in range(60):
        sizes = rng.sample(range(1, 40), rng.randrange(1, 4))
        counts = [rng.randrange(0, 4) for _ in sizes]
        budget = rng.randrange(0, 120)
        taken = mixing.fill(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        total = sum(s * c for s, c in zip(sizes, counts))
        sums = [sum(s * n for s, n in zip(sizes, ns)) for ns in product(*[range(c + 1) for c in counts])]
        best = min(abs(x - budget) for x in sums)
        assert abs(sum(s * t for s, t in zip(sizes, taken)) - budget) == (best if total > budget else budget - total)


def test_fill_of_a_large_budget():
    rng = random.Random(9)
    sizes = rng.sample(range(1, 9000), 1500)
    counts = [rng.randrange(1, 9) for _ in sizes]
    budget = sum(s * c for s, c in zip(sizes, counts)) * 37 // 100
    assert sum(s * t for s, t in zip(sizes, mixing.fill(sizes, counts, budget))) == budget


TEXTS = ["Hello, World! it's a test.", "", None, "a.b.c ... x", "don't  we'll\tgo\n", "ÀÉ ﬁne café ² ½. Ⅷ.", "<|endoftext|> mid<|startoftext|>dle <| x", "中文 テスト。 end.", "é ́x", "word " * 5000, "1234 5.6,7", "😀. a b c", "x.\n\ny,", "Σας ΟΔΟΣ. İstanbul."]


def test_pieces_have_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    frame = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = defaultdict(list)
    for r in packing.token_pieces(frame, path, with_ids=True).collect():
        rows[r["doc_id"]].append(r)
    for k, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        parts = sorted(rows[k], key=lambda r: r["piece"])
        assert [i for p in parts for i in p["ids"]] == ids, text
        assert [(p["piece"], p["start"], p["length"]) for p in parts] == [(n, s, min(4096, len(ids) - s)) for n, s in enumerate(range(0, len(ids), 4096))]
        assert all(p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in parts)


@pytest.mark.parametrize("pattern", ["ab{}cd", "ab {}. x", "a{}, {}", "ab.{}x,{}"])
def test_every_character_has_the_tokenizers_ids(pattern):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    points = [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]
    for at in range(0, len(points), 8192):
        texts = [pattern.replace("{}", chr(c)) for c in points[at : at + 8192]]
        want = tokenizer.encode_batch(texts, add_special_tokens=False)
        wrong = [t for t, w in zip(texts, want, strict=True) if encoder.encode(t) != np.array(w.ids, "<u4").tobytes()]
        assert not wrong, wrong[:5]


def test_a_full_cache_changes_nothing(monkeypatch):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(20)]
    want = [packing.Encoder(path).encode(t) for t in texts]
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "CACHE_KEPT", 10)
    small = packing.Encoder(path)
    assert [small.encode(t) for t in texts] == want and len(small.words) <= 60


def check_packing(found, lengths, capacity):
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["length"] for r in found) == sorted(lengths)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


@pytest.mark.parametrize("group_rows", [10_000, 300])
def test_packing_is_gapless_and_near_its_bound(spark, group_rows):
    rng = random.Random(11)
    lengths = [rng.choice([4096, rng.randrange(1, 4096), rng.randrange(1, 400), 1]) for _ in range(2000)]
    frame = spark.createDataFrame([(k % 700, 0, n, "x") for k, n in enumerate(lengths)] + [(None, 0, 7, "x")] * 3, "doc_id long, piece int, length long, offset string")
    found = packing.pack(frame, group_rows=group_rows).collect()
    made = check_packing(found, [*lengths, 7, 7, 7], 4096)
    assert made <= packing.least_bins(np.array([*lengths, 7, 7, 7]), 4096) * 1.005 + 1


def test_bounds_hold_and_best_fit_is_valid():
    rng = random.Random(3)
    for _ in range(40):
        lengths = np.array(sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 60))), reverse=True))
        bins, offsets = packing.best_fit(lengths, 100)
        made = check_packing([{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist())], lengths.tolist(), 100)
        assert packing.least_bins(lengths, 100) <= made
    assert packing.least_bins(np.array([51] * 10), 100) == 10


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_exchange_ends_at_a_stated_gap(spark):
    rng = random.Random(21)
    lengths = [rng.choice([rng.randrange(1300, 1500), rng.randrange(900, 1400), 2100]) for _ in range(3000)]
    frame = spark.createDataFrame([(k, 0, n, 1, 2) for k, n in enumerate(lengths)], "doc_id long, piece int, length long, _group long, _loose int")
    one, many = (packing.pack(frame, group_rows=n) for n in (10_000, 200))
    assert one.columns == ["doc_id", "piece", "length", "_group", "_loose", "sequence_id", "offset"]
    for packed in (one, many):
        said = packing.certificate(packed)
        assert said["bins"] == check_packing(packed.collect(), lengths, 4096) and said["gap"] == said["bins"] - said["bound"] >= 0
    assert packing.certificate(many)["bins"] <= packing.certificate(one)["bins"] * 1.01 + 1
    exact = spark.createDataFrame([(k, 0, 1024, 0, 0) for k in range(1000)], "doc_id long, piece int, length long, _group long, _loose int")
    assert packing.certificate(packing.pack(exact, group_rows=100))["gap"] == 0


def test_seeded_texts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(31)
    alphabet = [*map(chr, range(0x21)), *"abzAZ09.,'!<|>", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "İ", "́", "़", "क़", "ড়", "ਲ਼", "​", " ", "　", "ﬁ", "é", "中", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if encoder.encode(t) != np.array(w.ids, "<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_the_mix_keeps_columns_named_like_its_own(spark):
    rows = [(k, "w " * (k % 30 + 1), "s" + str(k % 4), 99, 98, 97, 96, "f", "g") for k in range(200)]
    names = "doc_id long, text string, source string, size int, target int, source_size int, times int, _from string, _times string"
    frame = spark.createDataFrame(rows, names)
    found = mixing.mixed(frame)
    assert found.columns == frame.columns and set(map(tuple, found.collect())) <= set(rows)


def test_many_sources_meet_plain_targets(spark):
    rng = random.Random(14)
    sizes = {f"s{rng.randrange(10**9)}": rng.choice([0, 1, 5, rng.randrange(1, 10**4), 10 ** rng.randrange(1, 9)]) for _ in range(1500)}
    frame = spark.createDataFrame([("0" + s, n) for s, n in sizes.items()], "_source string, source_size long")
    found = {r["_source"][1:]: r["target"] for r in mixing.targets(frame).collect()}
    want = plain_targets(sizes)
    assert set(found) == set(want) and all(abs(found[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_the_program_keeps_little_however_many_sizes():
    import tracemalloc

    sizes = [2 * k for k in range(1, 20_001)]
    tracemalloc.start()
    taken = mixing.fill(sizes, [1] * len(sizes), 1_000_001)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert abs(sum(s * t for s, t in zip(sizes, taken)) - 1_000_001) == 1


def test_words_put_together_from_parts_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(41)
    pieces = ["'s", "'S", "'t", "'re", "'ve", "'m", "'ll", "'d", "''", "'", "don", "ING", "tion", "É", "é", "ß", "ÿ", "Ǆ", "ǅ", "ĸ", "ŉ", "ı", "º", "ª", "7", "42", "_", "-", "...", "<", "|", ">", "a", "Z", "ſ", "ǆ", "Ɏ", "ȷ", "×", "÷", "µ", "²", "Σ", "Å"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 8))) + rng.choice(["", " x", ".", ". y"]) for _ in range(30_000)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if encoder.encode(t) != np.array(w.ids, "<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_latin_words_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, encoder, whole = Tokenizer.from_file(path), packing.Encoder(path), packing.Encoder(path)
    assert encoder.direct
    whole.direct = False
    rng = random.Random(43)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = ["".join(rng.choice(letters if k % 2 else "etaoinshrdluETAÉéñ") for _ in range(rng.randrange(1, 30))) for k in range(20_000)]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, w in zip(texts, want, strict=True) if not encoder.encode(t) == whole.encode(t) == np.array(w.ids, "<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_importing_builds_no_tables():
    code = "from ledgerloom.llm import packing as p; assert not p._plain_letters.cache_info().currsize; assert p.words_of('a. b') == ['a', '.', 'b']"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True, timeout=60)
