from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm import toxicity

KIND, RUDE = ["the calm river runs by the old mill", "a green field under a clear sky", "bread and butter on a wooden table"], ["you utter numbskull go away", "what a numbskull thing to say", "numbskull fools everywhere here"]


def tables(spark, extra=()):
    rows, labels = [], []
    for k in range(240):
        text = (RUDE if k % 4 == 0 else KIND)[k % 3] + f" number {k}"
        rows.append((k, text, "x"))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = tables(spark, [(None, None, None), (1000, "", "y"), (1001, None, "y"), (3, KIND[0] + " number 3", "x")])
    found = toxicity.scored(docs, labels).collect()
    assert len(found) == 244
    held = [r for r in found if r["held_out"] and r["doc_id"] < 240]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (1000, 1001)}
    assert len(empty) == 1 and [r["held_out"] for r in found if r["doc_id"] is None] == [False]


def test_held_out_labels_are_never_seen(spark):
    import zlib

    docs, labels = tables(spark)
    wrong = [(k, int(k % 4 == 0) if zlib.crc32(str(k).encode()) % 5 else 1 - int(k % 4 == 0)) for k in range(240)]
    same = toxicity.scored(docs, spark.createDataFrame(wrong, "doc_id long, toxic int"))
    first = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in same.collect()} == first


def test_no_labels_and_no_rows(spark):
    docs, labels = tables(spark)
    none = toxicity.scored(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.scored(docs.limit(0), labels.limit(0)).count() == 0


def test_a_score_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.1)
    texts = ["", "a", "ab", "abc", None, "x" * 5000, "Äö €uro 😀", "abc"] * 3
    together = toxicity.score_texts(model, texts)
    assert np.allclose(together, [toxicity.score_texts(model, [t])[0] for t in texts])


def test_extra_columns_are_kept(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    assert toxicity.score_frame(docs, model, score_col="_score").columns == ["doc_id", "text", "score", "_score"]


def bucket(gram):
    """A gram's bucket, in plain integers."""
    value = ord(gram[0])
    for c in gram[1:]:
        value = (value * 0x100000001B3 + ord(c)) % 2**64
    return (value + len(gram)) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - toxicity.BITS


def plain_counts(text):
    text = (text or "").lower()
    return Counter(bucket(text[k : k + n]) for n in (3, 4, 5) for k in range(len(text) - n + 1))


def plain_model(rows):
    """Ratios and weights from ``(text, label)`` rows, by the module's description, with dictionaries."""
    counts = [(plain_counts(t), y) for t, y in rows]
    positive = sum(y for _, y in rows)
    have = {b: [sum(b in c for c, y in counts if y == label) for label in (0, 1)] for b in set().union(*[c for c, _ in counts])}
    ratio = {b: math.log((h[1] + 0.5) / (positive + 1)) - math.log((h[0] + 0.5) / (len(rows) - positive + 1)) for b, h in have.items()}
    ratio = {b: r for b, r in ratio.items() if sum(have[b]) >= 3 and abs(r) >= 1.0}
    vectors = [({b: n / sum(c.values()) * ratio[b] for b, n in c.items() if b in ratio}, y) for c, y in counts]
    norm = math.sqrt(sum(v * v for x, _ in vectors for v in x.values()) / len(rows))
    vectors = [({b: v / norm for b, v in x.items()}, y) for x, y in vectors]
    weight, bias, seen, seen_bias = dict.fromkeys(ratio, 0.0), 0.0, dict.fromkeys(ratio, 0.0), 0.0
    scale = {1: math.sqrt(len(rows) / (2 * positive)), 0: math.sqrt(len(rows) / (2 * (len(rows) - positive)))}
    for _ in range(80):
        errors = [scale[y] * (1 / (1 + math.exp(-(sum(weight[b] * v for b, v in x.items()) + bias))) - y) for x, y in vectors]
        slope = dict.fromkeys(ratio, 0.0)
        for (x, _), e in zip(vectors, errors):
            for b, v in x.items():
                slope[b] += v * e / len(rows)
        for b in ratio:
            g = slope[b] + 1e-6 * weight[b]
            seen[b] += g * g
            weight[b] -= 0.5 * g / (math.sqrt(seen[b]) + 1e-8)
        g = sum(errors) / len(errors)
        seen_bias += g * g
        bias -= 0.5 * g / (math.sqrt(seen_bias) + 1e-8)
    return {b: weight[b] * ratio[b] / norm for b in ratio}, bias


def test_scores_equal_a_plain_second_implementation(spark):
    docs, labels = tables(spark)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [(rows[k], int(k % 4 == 0)) for k in rows if zlib.crc32(str(k).encode()) % 5]
    weights, bias = plain_model(seen)
    for r in toxicity.scored(docs, labels).collect():
        counts = plain_counts(rows[r["doc_id"]])
        logit = sum(weights.get(b, 0.0) * n for b, n in counts.items()) / max(1, sum(counts.values())) + bias
        assert abs(r["score"] - 1 / (1 + math.exp(-logit))) < 1e-5


def test_repeated_ids_do_not_grow_the_fit(spark):
    docs, labels = tables(spark)
    first = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    copies = docs.unionByName(docs.where("doc_id = 4").crossJoin(spark.range(500)).drop("id"))
    again = toxicity.scored(copies, labels).collect()
    assert len(again) == 740 and {r["doc_id"]: r["score"] for r in again} == first
    many = docs.unionByName(spark.range(500).selectExpr("4L as doc_id", "concat('other text ', id) as text", "'x' as score"))
    ids = [str(k) for k in range(5)]
    met = pa.RecordBatch.from_pydict({"_id": ids * 3, "_key": [7] * 15, "_text": ["some text"] * 15, "_label": pa.array([1] * 15, pa.int32())})
    assert sum(b.num_rows for b in toxicity._count_batches(iter([met, met]))) == 5
    assert toxicity.scored(many, labels, toxicity.fit(many, labels, max_fit_rows=50)).count() == 740
