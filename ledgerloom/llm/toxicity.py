"""Toxicity scoring: a character n-gram linear classifier on features scaled by
naive Bayes log-count ratios (NB-SVM style, with a logistic loss).

Model
    A document is the bag of its character n-grams (orders ``ORDERS``) of the
    lower-cased text, hashed into ``2**BITS`` buckets.  Each bucket j has a
    log-count ratio ``r_j`` between the two classes.  The classifier is linear
    in ``r_j * count_j / total``, so it weighs the density of telling n-grams
    and a long text is neither favoured nor punished.

Fit
    On a bounded sample of labelled rows: of the ``max_fit_rows`` labelled training
    ids with the smallest hash, the ``max_fit_rows`` texts with the smallest hash of
    id and text.  Executors turn the sampled texts (whole, never prefixes) into
    counts; one executor task takes these, at most ``max_fit_rows`` sparse vectors
    however often an id or a row repeats, and runs a fixed number of full-batch
    steps, so the fit is deterministic and the driver receives the weights alone.

Scoring
    One Arrow pass over all rows; no shuffle.  The weight table (``2**BITS``
    floats, one megabyte) is all that is shipped.

Edge cases
    * null or empty text: no n-grams, the score is the model's bias alone;
    * null ids: scored, never used for fitting, ``held_out`` is false;
    * null labels or ids in the label table: ignored; repeated labels of an id
      count by their maximum (any toxic vote marks the row);
    * no training row of one of the classes: every score is the share of
      positive labels (0.5 with no label at all);
    * repeated rows are scored each and fitted once; an id with several texts is
      fitted with each of them, under its one label;
    * extra columns, also ones named like a result (``held_out``, ``predicted``),
      are dropped by :func:`scored`; :func:`score_frame` keeps them all but one named
      like its ``score_col``, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import quoted, renumbered

ORDERS = (3, 4, 5)
BITS = 18
#: Documented bound of the fit: labelled rows used for it.
MAX_FIT_ROWS = 5000
_STEPS = 80
#: Buckets with a smaller absolute log-count ratio carry no weight.
_LEAST_RATIO = 1.0
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Model:
    """``logit = scale * (sum of weights over n-grams / number of n-grams) + bias``."""

    weights: np.ndarray
    bias: float


def _hashed(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: bucket ids of all n-grams of the texts, one text after the
    other, and each text's number of n-grams."""
    lowered = [(t or "").lower() for t in texts]
    lengths = np.fromiter((len(t) for t in lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    rolling = codes.astype(np.uint64)
    wide = rolling
    for n in range(2, max(ORDERS) + 1):
        if len(rolling) <= 1:
            rolling = rolling[:0]
        else:
            rolling = rolling[:-1] * _STEP + wide[n - 1 :]
        if n in ORDERS:
            ids = ((rolling + np.uint64(n)) * _MULT >> np.uint64(64 - BITS)).astype(np.int32)
            yield ids[left[: len(ids)] >= n], np.maximum(lengths - n + 1, 0)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths, empty runs included."""
    ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    stop = np.cumsum(counts)
    return ends[stop] - ends[stop - counts]


def _chunks(texts: list[str | None], limit: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts of about ``limit`` characters; one text is never split."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of the toxic label for each text."""
    parts = [np.zeros(0)]
    for part in _chunks(texts):
        total, number = np.zeros(len(part)), np.zeros(len(part))
        for ids, counts in _hashed(part):
            total += _sums(model.weights[ids], counts)
            number += counts
        parts.append(total / np.maximum(number, 1) + model.bias)
    return 1.0 / (1.0 + np.exp(-np.clip(np.concatenate(parts), -500, 500)))


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their counts."""
    every = [ids for ids, _ in _hashed([text])]
    return np.unique(np.concatenate([*every, np.zeros(0, np.int32)]), return_counts=True)


def fit_counts(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Fit from ``(buckets, counts, label)`` rows; full-batch, deterministic."""
    size = 1 << BITS
    labels = np.array([y for *_, y in rows], np.float64)
    positive = labels.sum()
    if not len(rows) or positive in (0, len(rows)):
        share = np.clip((positive + 0.5) / (len(rows) + 1), 1e-6, 1 - 1e-6)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    # Log-count ratios from document frequencies: a bucket of one long text says little.
    have = np.zeros((2, size))
    for buckets, _, label in rows:
        have[label, buckets] += 1
    ratio = np.log((have[1] + 0.5) / (positive + 1)) - np.log((have[0] + 0.5) / (len(rows) - positive + 1))
    ratio[(have.sum(axis=0) < 3) | (np.abs(ratio) < _LEAST_RATIO)] = 0.0

    kept = [(b[t], c[t] / max(1, c.sum()) * ratio[b[t]]) for b, c, _ in rows for t in [ratio[b] != 0]]
    ids = np.concatenate([b for b, _ in kept])
    values = np.concatenate([v for _, v in kept])
    number = np.array([len(b) for b, _ in kept])
    of_row = np.repeat(np.arange(len(rows), dtype=np.int32), number)

    norm = np.sqrt(np.mean(_sums(values * values, number))) or 1.0
    values /= norm
    weight, bias = np.zeros(size), 0.0
    balance = np.where(labels == 1, len(rows) / (2 * positive), len(rows) / (2 * (len(rows) - positive)))
    balance = np.sqrt(balance)
    seen = np.zeros(size)
    seen_bias = 0.0
    for _ in range(_STEPS):
        logit = _sums(values * weight[ids], number) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels)
        gradient = np.bincount(ids, values * error[of_row], minlength=size) / len(rows) + 1e-6 * weight
        seen += gradient * gradient
        weight -= 0.5 * gradient / (np.sqrt(seen) + 1e-8)
        slope = error.mean()
        seen_bias += slope * slope
        bias -= 0.5 * slope / (np.sqrt(seen_bias) + 1e-8)
    return Model((weight * ratio / norm).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train: F.Column | None = None, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on at most ``max_fit_rows`` labelled rows for which ``train`` holds."""
    votes = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    votes = votes.where("_id is not null and _label is not null").groupBy("_id").agg(F.max("_label").alias("_label"))
    if train is not None:
        votes = votes.where(train)
    chosen = votes.orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit("fit")), "_id").limit(max_fit_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", F.xxhash64("_text"))
    # Both samples are bounded by max_fit_rows, so they may be broadcast at any input size.
    labelled = texts.select("_id", "_key").join(F.broadcast(chosen), "_id").distinct()
    sample = labelled.orderBy(F.xxhash64("_id", "_key"), "_id", "_key").limit(max_fit_rows)
    rows = texts.join(F.broadcast(sample), ["_id", "_key"]).mapInArrow(_count_batches, "_id string, key long, label int, buckets binary, counts binary")
    rows = rows.dropDuplicates(["_id", "key"])
    # One executor task fits on the bounded sample; the driver gets the weights alone.
    fitted = rows.groupBy().applyInArrow(_fit_table, "weights binary, bias double").first()
    if fitted is None:
        return fit_counts([])
    return Model(np.frombuffer(fitted["weights"], np.float32), fitted["bias"])


def _fit_table(group: pa.Table) -> pa.Table:
    rows = [
        (np.frombuffer(b.as_buffer(), np.int32), np.frombuffer(c.as_buffer(), np.int32), y.as_py())
        for b, c, y in zip(*(group.column(k) for k in ("buckets", "counts", "label")), strict=True)
    ]
    ids = group.column("_id").to_pylist()
    model = fit_counts([rows[k] for k in sorted(range(len(rows)), key=lambda k: (ids[k], rows[k][0].tobytes()))])
    return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias]})


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each (id, text) that a task meets, once; there are no more of them than the sample has."""
    met: set[tuple] = set()
    for batch in batches:
        names = list(zip(batch.column("_id").cast(pa.string()).to_pylist(), batch.column("_key").to_pylist(), strict=True))
        new = [at for at, name in enumerate(names) if name not in met and not met.add(name)]
        for at in range(0, len(new), 64):
            part = batch.take(pa.array(new[at : at + 64], pa.int64()))
            pairs = [counts_of(t) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column("_id").cast(pa.string()), part.column("_key"), part.column("_label"),
                pa.array([b.astype(np.int32).tobytes() for b, _ in pairs], pa.binary()),
                pa.array([c.astype(np.int32).tobytes() for _, c in pairs], pa.binary()),
            ], ["_id", "key", "label", "buckets", "counts"])


def score_frame(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` added (replaced if there)."""
    kept = [c for c in docs.columns if c != score_col]
    plain = renumbered(docs.select(*map(quoted, kept)))
    text = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(model, batch.column(text).cast(pa.string()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "_score"])

    return plain.mapInArrow(run, plain.withColumn("_score", F.lit(0.0)).schema).toDF(*kept, score_col)


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    if model is None:
        model = fit(docs, labels, train=F.crc32(F.col("_id").cast("string")) % 5 != 0)
    result = score_frame(docs.select("doc_id", "text", F.coalesce(remainder == 0, F.lit(False)).alias("held_out")), model)
    return result.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
