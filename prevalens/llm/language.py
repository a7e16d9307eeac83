"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram (one to three characters) of every learned text:
each task keeps one small count matrix and hands over its non-zero cells, which
Spark sums by (label, bucket).  The log-probability matrix (buckets x labels) is
broadcast; its size is fixed by ``buckets`` and the number of labels.  Batches
are scored by gathering the rows of their n-grams' buckets and summing them per
text: the product of the sparse count matrix and the log-probability matrix.

Text is lower-cased and every run of non-letters counts as one space.

Edge cases: null text, empty text and text without a letter give ``und`` with
score 0; without any learned row every text is ``und``; ties go to the first
label in code-point order; null labels are not learned; very long texts are read
whole; repeated rows count and are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import code_points, letters, slices, sum_by_text

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    labels: list
    log_prior: np.ndarray      # labels
    log_prob: np.ndarray       # buckets x labels


def _grams(texts: list, buckets: int):
    """(letter counts per text, [(bucket ids, counts per text) for every order])."""
    cp, offsets = code_points([t.lower() for t in texts])
    is_letter = letters()[cp]
    n_letters = np.add.reduceat(is_letter, offsets[:-1], dtype=np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]           # one space after every run of letters
    kept = np.flatnonzero(keep)
    c = np.where(is_letter[kept], cp[kept], np.uint32(32))
    first = np.searchsorted(kept, offsets)
    out, h = [], np.zeros(len(c), dtype=np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + c[n - 1:] + np.uint32(n)
        # an n-gram belongs to the text it starts in; those that would run over its end are cut off
        ends = np.maximum(first[1:] - (n - 1), first[:-1])
        counts = ends - first[:-1]
        if n > 1:
            inside = np.ones(m + 1, dtype=np.int32)
            gap = np.zeros(m + 2, dtype=np.int32)
            np.add.at(gap, np.minimum(ends, m), 1)
            np.add.at(gap, np.minimum(first[1:], m), -1)
            inside = np.cumsum(gap[:m]) == 0
            out.append((((h * np.uint32(0x9E3779B1)) >> shift)[inside], counts))
        else:
            out.append(((h * np.uint32(0x9E3779B1)) >> shift, counts))
    return n_letters, out


def fit(docs: DataFrame, text: str = "text", label: str = "lang", buckets: int = BUCKETS) -> LanguageModel:
    """Learn from every row with a text and a label."""
    rows = docs.select(F.col(label).alias("label"), F.col(text).alias("text")).where(
        F.col("label").isNotNull() & F.col("text").isNotNull())

    def count(batches):
        held = {}
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.column("label").to_pylist()
                _, grams = _grams(part.column("text").to_pylist(), buckets)
                number = {}
                owner = np.array([number.setdefault(x, len(number)) for x in names])
                total = np.zeros(len(number) * buckets, dtype=np.int64)
                for ids, counts in grams:
                    total += np.bincount(np.repeat(owner, counts) * buckets + ids, minlength=len(total))
                for name, i in number.items():
                    cells, docs_seen = held.get(name, (0, 0))
                    held[name] = (cells + total[i * buckets:(i + 1) * buckets],
                                  docs_seen + int((owner == i).sum()))
        for name, (cells, seen) in held.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([name] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1), pa.int32()),
                "n": pa.array(np.append(cells[at], seen), pa.int64())})

    summed = (rows.mapInArrow(count, "label string, bucket int, n long")
              .groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    cells = summed.toPandas()            # at most labels x (buckets + 1) rows
    labels = sorted(set(cells["label"]))
    if not labels:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0), np.float32))
    column = cells["label"].map({x: i for i, x in enumerate(labels)}).to_numpy()
    bucket, n = cells["bucket"].to_numpy(), cells["n"].to_numpy()
    prior = np.zeros(len(labels))
    prior[column[bucket < 0]] = n[bucket < 0]
    counts = np.ones((buckets, len(labels)))
    counts[bucket[bucket >= 0], column[bucket >= 0]] += n[bucket >= 0]
    return LanguageModel(labels, np.log(prior / prior.sum()),
                         np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predict_texts(model: LanguageModel, texts: list) -> tuple[list, np.ndarray]:
    """(labels, probabilities) of a list of texts without nulls."""
    n_letters, grams = _grams(texts, model.log_prob.shape[0])
    if not model.labels:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    logits = np.tile(model.log_prior, (len(texts), 1))
    for ids, counts in grams:
        logits += sum_by_text(model.log_prob[ids], counts)
    best = logits.argmax(axis=1)
    top = 1.0 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)
    known = n_letters > 0
    return ([model.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())],
            np.where(known, top, 0.0))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list | None = None,
            predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep`` columns plus the predicted label and its probability."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (predicted, score)]
    source = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]]
                       + [f"`{predicted}` string", f"`{score}` double"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                labels, p = predict_texts(shared.value, part.column("__text").fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(labels, pa.string()), pa.array(p, pa.float64())],
                    names=keep + [predicted, score])

    return source.mapInArrow(run, schema)


def held_out(key: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the checksum of a key's text falls on the held-out remainder; a null key does not."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))
