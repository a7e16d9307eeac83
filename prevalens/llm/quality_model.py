"""Quality classifier: supervised subword embeddings trained by numpy gradient descent.

A document is the average of learned vectors of its words, its word pairs and the character
n-grams (three to five, with a border mark on each side of a word), all hashed
into ``buckets`` rows; a linear layer and a softmax over the two labels follow.

Training runs on the driver over a bounded sample of labelled documents
(``MAX_TRAIN`` documents, chosen by a hash of the id; the bound is a parameter),
whose hashed counts, not texts, are fetched.  After training, the contribution
of a bucket to the difference of the two logits is one number, so scoring needs
one float per bucket (broadcast, fixed size) and one pass over the text.

Edge cases: null and empty texts have no features and score the class prior;
without labelled rows every score is 0.5; with labels of one class only the
scores lean to that class; documents labelled more than once count once per
label row; null labels are ignored; very long texts are read whole in bounded
memory; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import mixed, slices, sum_by_text, utf8, word_hashes, word_spans

BUCKETS = 1 << 16
DIM = 8
EPOCHS = 6
RATE = 0.6
MAX_TRAIN = 4_000
ORDERS = (3, 4, 5)


def features(column: pa.Array, buckets: int = BUCKETS) -> list:
    """[(bucket ids, counts per text)]: words, word pairs, every order of character n-grams (UTF-8 bytes)."""
    raw, offsets = utf8(column)
    starts, ends, first = word_spans(raw, offsets)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    words, per_text = word_hashes(raw, starts, ends), np.diff(first)
    out = [((mixed(words) >> shift).astype(np.int32), per_text)]
    # two words in a row, hashed by their difference: a word and itself is one bucket for all words
    pair = np.ones(max(0, len(words) - 1), dtype=bool)
    edge = first[1:-1]
    pair[edge[(edge > 0) & (edge < len(words))] - 1] = False
    out.append(((mixed(words[1:] ^ words[:-1]) >> shift).astype(np.int32)[pair], np.maximum(per_text - 1, 0)))
    # every word between two border marks in one long array
    n = ends - starts
    size = n + 2
    begin = np.cumsum(size) - size
    flat = np.full(int(size.sum()), 32, dtype=np.uint32)
    if len(flat):
        inner = np.ones(len(flat), dtype=bool)
        inner[begin] = inner[begin + size - 1] = False
        source = np.repeat(starts - begin - 1, size) + np.arange(len(flat))
        flat[inner] = raw[source[inner]]
    word_at = np.repeat(np.arange(len(n)), size)
    text_words = np.concatenate([[0], np.cumsum(size)])[first]      # bounds of each text in flat
    h = flat
    for i in range(1, max(ORDERS)):
        h = h[:-1] * np.uint32(0x01000193) + flat[i:]
        if i + 1 in ORDERS and len(h) > 0:
            whole = word_at[:len(h)] == word_at[i:]
            ids = ((h * np.uint32(0x9E3779B1) + np.uint32(i)) * np.uint32(0x85EBCA6B)
                   >> np.uint32(32 - (buckets.bit_length() - 1)))[whole]
            counted = np.concatenate([[0], np.cumsum(whole)])
            out.append((ids.astype(np.int32),
                        np.diff(counted[np.minimum(text_words, len(whole))])))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                  buckets: int, limit: int) -> list:
    """[(label, bucket ids, weights)] of the sampled labelled documents; weights sum to 1."""
    chosen = (labels.select(F.col(key).alias("k"), F.col(label).alias("y"))
              .where(F.col("y").isNotNull() & F.col("k").isNotNull())
              .orderBy(F.xxhash64("k"), "k", "y").limit(limit))
    # at most ``limit`` rows of two numbers: broadcast is bounded by that parameter
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def sparse(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                made = features(part.column("t"), buckets)
                texts = np.concatenate([np.repeat(np.arange(part.num_rows), c) for _, c in made])
                cells, n = np.unique(texts * buckets + np.concatenate([i for i, _ in made]),
                                     return_counts=True)
                cuts = np.searchsorted(cells // buckets, np.arange(part.num_rows + 1))
                ids, n = (cells % buckets).astype("<i4"), n.astype("<f4")
                yield pa.RecordBatch.from_pydict({
                    "k": part.column("k").cast(pa.string()), "y": part.column("y").cast(pa.int32()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    "n": pa.array([n[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    found = rows.mapInArrow(sparse, "k string, y int, ids binary, n binary").collect()
    out = []
    for r in sorted(found, key=lambda r: (r["k"], r["y"], bytes(r["ids"]))):
        n = np.frombuffer(r["n"], "<f4")
        out.append((r["y"], np.frombuffer(r["ids"], "<i4"), n / max(1.0, n.sum())))
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        label: str = "quality", buckets: int = BUCKETS, limit: int = MAX_TRAIN,
        dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple:
    """(difference of logits per bucket, bias) after gradient descent with a decaying rate."""
    rows = training_rows(docs, labels, key, text, label, buckets, limit)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    weights, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    size, step, steps = 32, 0, max(1, epochs * -(-len(rows) // 32))
    for _ in range(epochs if rows else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            some = [rows[i] for i in order[at:at + size]]
            ids = np.concatenate([r[1] for r in some])
            n = np.concatenate([r[2] for r in some])
            counts = np.array([len(r[1]) for r in some])
            y = np.array([1 if r[0] == 1 else 0 for r in some])
            hidden = sum_by_text(vectors[ids] * n[:, None], counts).astype(np.float32)
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            now = rate * (1 - step / steps)
            step += 1
            back = p @ weights.T
            weights -= now * hidden.T @ p
            bias -= 0.1 * now * p.mean(axis=0)
            owner = np.repeat(np.arange(len(some)), counts)
            used, slot = np.unique(ids, return_inverse=True)
            for d in range(dim):
                # the step of a bucket follows its share in the documents of the batch
                vectors[used, d] -= now * 8 * np.bincount(slot, n * back[owner, d], len(used))
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def predict(docs: DataFrame, model: tuple, text: str = "text", keep: list | None = None) -> DataFrame:
    """``keep`` columns plus ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    source = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]]
                       + ["score double", "predicted int"])

    def run(batches):
        values, bias = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                made = features(part.column("__text"), len(values))
                total = sum(sum_by_text(values[ids], counts) for ids, counts in made)
                n = sum(counts for _, counts in made)
                p = 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -50, 50)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))]
                    + [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))],
                    names=keep + ["score", "predicted"])

    return source.mapInArrow(run, schema)
