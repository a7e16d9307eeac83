"""Near duplicates by many universal hash minima, banding, verification and star components.

A document's set is its distinct ``NGRAM``-word shingles.  Sets with equal
shingles are one class (two 64-bit sums and the size name it), so copies are
signed and compared once.

Signatures.  ``BANDS`` times ``ROWS`` multiply-shift functions, h(x) = a x + b
modulo 2**64, give a class its minima.  ``ROWS`` minima make the key of a band;
classes that share a band are candidates.  At a similarity of 0.8 five minima
agree with probability 0.33, so 28 bands miss a pair with probability 2e-5; above that
less.

Candidates without all pairs.  A band's classes are first compared with one of
them only, the centre.  The links found are closed into components, and a band
whose classes are all in one component is settled: the pairs it still holds
could tell nothing new.  Of the others, those up to ``MAX_GROUP`` classes compare
their pairs across components; the classes of larger ones are grouped anew by their
rare shingles (``rare_elements``: two linked classes always share one, those that
share a passage rarely do), and treated again in the same way.  What is large and
unsettled then is compared in full, groups that overlap only once: blocks of
``BLOCK`` classes against blocks inside tasks, and only links that join two
components leave a task.  Nothing is capped.

Verification.  A pair whose signatures agree in less than ``LEAST_AGREEING`` of
their minima goes (a linked pair falls below with probability under 1e-5); the rest
is confirmed on the full sets of 64-bit shingle hashes.

Components by alternating large-star and small-star over the links.

Edge cases: null and empty texts and texts without words have the empty set, are
linked with nothing and keep their own id as component; fewer words than
``NGRAM`` make one shingle; a row with a null id is compared with nothing, has a
null component and is kept; rows with one id are one document whose sets all
count; equal rows of one id are all kept or all dropped; an empty table gives no
rows; extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .jaccard_join import (components, in_blocks, joining_links, merged_groups, rare_elements, rarity, sets_of,
                           shingle_sets)
from .textnum import mixed, slices

NGRAM = 2
THRESHOLD = (80, 100)
ROWS = 5
BANDS = 28
#: Unsettled bands up to this size compare their pairs at once.
MAX_GROUP = 16
#: Classes of a block in the full comparison of large unsettled groups.
BLOCK = 512
#: Share of agreeing minima below which a pair cannot be linked.
LEAST_AGREEING = 0.65
#: Classes whose texts are picked by a broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_CLASSES = 300_000
_SEED = 20_240_601


def functions(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hash functions."""
    rng = np.random.default_rng(_SEED)
    a, b = rng.integers(0, 1 << 63, (2, number), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray, cuts: np.ndarray, number: int) -> np.ndarray:
    """Upper 32 bits of the minima of every set, one row per function; an empty set has the largest."""
    out = np.full((number, len(cuts) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(cuts))
    if not len(full):
        return out
    at = cuts[:-1][full]
    buffer = np.empty_like(h)
    for i, (a, b) in enumerate(zip(*functions(number))):
        np.multiply(h, a, out=buffer)
        np.add(buffer, b, out=buffer)
        out[i, full] = np.minimum.reduceat(buffer, at) >> np.uint64(32)
    return out


def _sums(h: np.ndarray, cuts: np.ndarray) -> list:
    """Two order-free 64-bit names of every set."""
    return [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[cuts])
            .astype(np.uint64).view(np.int64) for x in (mixed(h + np.uint64(7)), mixed(h ^ np.uint64(0x6A09E667F3BCC909)))]


def signed(docs: DataFrame, key: str, text: str, n: int = NGRAM, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, k1, k2, bands, minima): band keys (8 bytes each) and lowest bytes of the minima."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                h, cuts = shingle_sets(part.column("t"), n)
                least = minima(h, cuts, bands * rows)
                keys = np.empty((bands, part.num_rows), np.uint64)
                for j in range(bands):
                    x = np.full(part.num_rows, j + 1, np.uint64)
                    for m in least[j * rows:(j + 1) * rows]:
                        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + m)
                    keys[j] = x
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(cuts)), *map(pa.array, _sums(h, cuts)),
                     pa.array([x.tobytes() for x in np.ascontiguousarray(keys.T)], pa.binary()),
                     pa.array([x.tobytes() for x in np.ascontiguousarray(least.astype(np.uint8).T)], pa.binary())],
                    names=["id", "n_shingles", "k1", "k2", "bands", "minima"])

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return source.mapInArrow(run, "id long, n_shingles long, k1 long, k2 long, bands binary, minima binary")


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, cid): one row per class and band."""
    def run(batches):
        for batch in batches:
            keys = [np.frombuffer(x, "<i8") for x in batch.column("bands").to_pylist()]
            if keys:
                cid = batch.column("cid").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(cid, [len(k) for k in keys]))],
                    names=["key", "cid"])

    return classes.select("cid", "bands").mapInArrow(run, "key long, cid long")


def rare_rows(members: DataFrame, classes: DataFrame, texts: DataFrame, n: int, threshold,
              repeated: bool) -> DataFrame:
    """(key, cid): the rare shingles of the classes of some groups; two linked classes share one."""
    few = _texts_of(members, classes, texts, n, repeated)
    counts = few.sparkSession.sparkContext.broadcast(rarity(few, n))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                found, owner = rare_elements(*shingle_sets(part.column("t"), n), counts.value, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), part.column("cid").take(pa.array(owner))], names=["key", "cid"])

    return few.mapInArrow(run, "key long, cid long")


def groups(rows: DataFrame, name: str) -> DataFrame:
    """(key, cid, size, centre): rows whose key several classes have."""
    counted = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("centre"))
               .where("size > 1"))
    return saved(rows.join(counted, "key"), name)


def _agreeing(pairs: DataFrame, classes: DataFrame, threshold, least: float) -> DataFrame:
    """Pairs whose sizes and signatures allow the similarity."""
    num, den = threshold
    side = {x: classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n{x}"),
                              F.col("minima").alias(f"m{x}")) for x in "ab"}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("ma", "mb"))
            kept = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in "ab"], names=["a", "b"])

    sized = (pairs.select("a", "b").join(side["a"], "a").join(side["b"], "b")
             .where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    return sized.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def _class_texts(need: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(cid, t): a text of every class in ``need`` (cid, id, k1, k2)."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                k1, k2 = _sums(*shingle_sets(part.column("t"), n))
                kept = pa.array((k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(kept) for c in ("cid", "t")],
                                                 names=["cid", "t"])

    some = texts.join(F.broadcast(need) if need.count() <= BROADCAST_CLASSES else need, "id")
    return some.select("cid", "t", "k1", "k2").mapInArrow(run, "cid long, t string")


def _texts_of(members: DataFrame, classes: DataFrame, texts: DataFrame, n: int, repeated: bool) -> DataFrame:
    """(cid, t): a text of every class that ``members`` names."""
    need = saved(members.select("cid").distinct().join(classes.select("cid", "id", "k1", "k2"), "cid"), "minhash-need")
    few = _class_texts(need, texts, n)
    # several rows with one id: one text per class
    return saved(few.dropDuplicates(["cid"]) if repeated else few, "minhash-texts")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, threshold, least: float,
             repeated: bool) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the threshold."""
    num, den = threshold
    pairs = saved(_agreeing(pairs, classes, threshold, least), "minhash-likely")
    few = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")), classes, texts, n, repeated)

    def run(batches):
        held = (None, None)
        for batch in batches:
            keep, done = np.zeros(batch.num_rows, dtype=bool), 0
            for part in slices(batch, "tb"):
                h, cuts = shingle_sets(part.column("tb"), n)
                names, left = part.column("a").to_pylist(), part.column("ta")
                for i, name in enumerate(names):
                    if held[0] != name:
                        held = (name, shingle_sets(left.slice(i, 1), n)[0])
                    x, y = held[1], h[cuts[i]:cuts[i + 1]]
                    same = _shared(x, y)
                    keep[done + i] = den * same >= num * (len(x) + len(y) - same)
                done += part.num_rows
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in "ab"], names=["a", "b"])

    joined = (pairs.join(few.select(F.col("cid").alias("b"), F.col("t").alias("tb")), "b")
              .join(few.select(F.col("cid").alias("a"), F.col("t").alias("ta")), "a"))
    return saved(joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "minhash-links")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _blocks(left: DataFrame, classes: DataFrame, texts: DataFrame, n: int, threshold, block: int,
            repeated: bool) -> DataFrame:
    """(a, b): links that join the components inside large groups.

    ``left`` has key, cid, size, label.  Groups that overlap are compared once.  Members are
    dealt by a hash into blocks of about ``block`` sets and ``block`` times 512 shingles; a task counts the
    intersections of two blocks and emits links across components only.  A link merges its two
    components, so there are fewer links than components.
    """
    few = _texts_of(left, classes, texts, n, repeated)
    merged = merged_groups(left.select(F.col("key").alias("big"), F.col("cid").alias("id"),
                                       F.col("label").alias("component")), "minhash")
    members = (merged.join(classes.select(F.col("cid").alias("id"), "n_shingles"), "id")
               .join(few.withColumnRenamed("cid", "id"), "id"))
    number = members.groupBy("big", "one").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / (block * 512))).cast("int").alias("of"))

    def compare(table: pa.Table) -> list:
        return joining_links(table, *sets_of(table.column("t"), n), threshold)

    return in_blocks(members, ["big", "one"], number, ["component", "t"], compare)


def _unsettled(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``members`` with their component, of the groups that hold several components."""
    labels = components(links, name)
    named = (members.join(labels.withColumnRenamed("id", "cid"), "cid", "left")
             .withColumn("label", F.coalesce("component", "cid")).drop("component"))
    apart = (named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
             .where("x <> y").select("key"))
    return saved(named.join(apart, "key"), f"{name}-unsettled")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM,
                    threshold=THRESHOLD, bands: int = BANDS, rows: int = ROWS, max_group: int = MAX_GROUP,
                    block: int = BLOCK, least: float = LEAST_AGREEING) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per row of ``docs``."""
    made = signed(docs, key, text, n, bands, rows)
    made = saved(made, "minhash-signed")
    keys = made.select("id", "n_shingles", "k1", "k2")
    named = ["k1", "k2", "n_shingles"]
    classes = (made.where("n_shingles > 0 and id is not null").groupBy(*named)
               .agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("minima").alias("minima")))
    # written once, so that the numbers of the classes stay
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "minhash-classes")
    texts = (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
             .where(F.col("t").isNotNull() & F.col("id").isNotNull()))
    repeats = keys.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = not repeats.isEmpty()
    links = []
    if repeated:                      # the classes of one id are linked
        own = keys.join(repeats.select("id"), "id").select(F.col("id").alias("of"), *named).join(
            classes.select(*named, "cid"), named).select("of", "cid").distinct()
        first = own.groupBy("of").agg(F.min("cid").alias("a"))
        links.append(saved(own.join(first, "of").where("a <> cid").select("a", F.col("cid").alias("b")).distinct(),
                           "minhash-links"))
    source = band_rows(classes)
    for depth in ("one", "two"):
        members = groups(source, f"minhash-groups-{depth}")
        star = members.where("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
        links.append(verified(star, classes, texts, n, threshold, least, repeated))
        left = _unsettled(members, _all(links), f"minhash-{depth}")
        small = left.where(F.col("size") <= max_group).select("key", "cid", "label", "centre")
        pairs = (small.alias("x").join(small.alias("y"), "key")
                 .where("x.cid < y.cid and x.label <> y.label and x.cid <> x.centre")
                 .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct())
        links.append(verified(pairs, classes, texts, n, threshold, least, repeated))
        large = left.where(F.col("size") > max_group)
        if large.isEmpty():
            break
        if depth == "one":
            source = saved(rare_rows(large, classes, texts, n, threshold, repeated), "minhash-rare")
        else:
            links.append(saved(_blocks(large, classes, texts, n, threshold, block, repeated), "minhash-links"))
    labels = components(_all(links), "minhash-components")
    member = classes.join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    low = member.groupBy("component").agg(F.min("id").alias("component_id"))
    found = member.join(low, "component").select(*named, "component_id")
    out = keys.join(found, named, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _all(parts: list) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
