"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a share of the corpus size by its weight; a source may be
repeated at most ``max_epochs`` times and what it cannot take is shared among
the others again.  Inside a source the documents are put in the order of a
hash-random key.  The order is cut into key ranges, the ranges' sizes are
summed (small, map-side combined), and running sums of the ranges plus running
sums inside one range give every document its place.  The source's budget is
whole epochs plus a remainder that ends exactly inside one document, so the
words taken meet the budget to the word.

A hot source only has more key ranges; no task holds more than one range.

Edge cases: null text has size 0 and takes nothing; an empty table gives no
rows; a null source is a source of its own (last in order); the key hashes id
and text, so one id on many rows is spread too, and equal rows are
interchangeable; documents of size 0 take 0; a corpus of size 0 has targets 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved, word_count, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that one key range should hold; ranges per source follow from the row count.
ROWS_PER_RANGE = 4_000
#: Sources whose cuts may be broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target): water filling under the epoch limit.

    A source is capped when its fair share exceeds its limit.  In the order of
    ``limit / weight`` the capped sources come first, so the level is found with
    running sums over the list of sources, which is one row per source.
    """
    per = (sizes.groupBy("source")
           .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (per.withColumn("weight", F.element_at(
        cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", (F.col("source_size") * max_epochs).cast("double")))
    total = F.sum("source_size").over(Window.partitionBy())
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_first())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = (ranked
               .withColumn("level", (total.cast("double")
                                     - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                           / F.sum("weight").over(after))
               .withColumn("free", F.col("level") * F.col("weight") < F.col("limit")))
    # the first source that is not capped fixes the level of all that follow
    fixed = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(fixed.isNull(), F.col("limit")).otherwise(
        F.least(F.col("limit"), F.col("weight") * fixed))
    return leveled.select("source", "source_size", "n_docs", target.alias("target"))


def _order(key: str, text: str, seed: int) -> list:
    """Hashes that put the documents of a source in a random order."""
    return [F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h1"),
            F.xxhash64(F.lit(seed + 1), F.col(text)).alias("h2")]


def _positioned(docs: DataFrame, text: str, source: str, key: str, weights, max_epochs: int, seed: int) -> DataFrame:
    """doc_id, source, size, source_size, target, the order's hashes, whole ``epochs`` and ``last``,
    the words of the last epoch; no text is carried."""
    keyed = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"), *_order(key, text, seed))
    sizes = saved(keyed, "mix-sizes")
    targets = saved(source_targets(sizes, weights, max_epochs), "mix-targets")

    n_ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / ROWS_PER_RANGE))
    # position of the key in [0, 1) times the number of ranges: equal shares of a random key
    unit = (F.shiftrightunsigned("h1", 11)).cast("double") / float(1 << 53)
    placed = (sizes.withColumnRenamed("source", "src")
              .join(targets, F.col("src").eqNullSafe(F.col("source")))
              .withColumn("range", F.floor(unit * n_ranges))
              # the unsigned order of the key, so that ranges and keys agree
              .withColumn("hkey", F.shiftrightunsigned("h1", 1)))
    ranges = placed.groupBy("src", "range").agg(F.sum("size").alias("range_size"))
    prior = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("src").alias("rsrc"), F.col("range").alias("rrange"),
                           F.coalesce(F.sum("range_size").over(prior), F.lit(0)).alias("start"))
    inside = (Window.partitionBy("src", "range")
              .orderBy("hkey", "h1", F.col("doc_id").asc_nulls_first(), "h2")
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    positioned = (summed.join(ranges, F.col("src").eqNullSafe(F.col("rsrc"))
                              & (F.col("range") == F.col("rrange")))
                  .withColumn("ahead", F.col("ahead") + F.col("start")))
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("ahead")))
    return positioned.select("doc_id", F.col("src").alias("source"), "size",
                             F.col("source_size").cast("long").alias("source_size"), "target", "hkey", "h1", "h2",
                             epochs.cast("long").alias("epochs"), last.alias("last"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken.

    ``taken`` is the number of words the mix reads from the document, repeats
    counted: whole epochs times its size, plus its part of the last epoch.
    """
    taken: Column = (F.col("epochs") * F.col("size") + F.col("last")).cast("long")
    return _positioned(docs, text, source, key, weights, max_epochs, seed).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def cuts(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
         weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """One row per source: source, epochs, the place ``at`` in the source's order that the last
    epoch reaches, the whole documents it takes there, and the words of a further one.

    Several documents share a place only if they are equal in id and text.
    """
    rows = _positioned(docs, text, source, key, weights, max_epochs, seed)
    place = F.struct("hkey", "h1", "doc_id", "h2")
    rows = saved(rows.select("source", "epochs", "size", "last", place.alias("place")), "mix-places")
    ends = rows.groupBy("source").agg(F.max("epochs").alias("epochs"),
                                      F.max(F.when(F.col("last") > 0, F.col("place"))).alias("at"))
    there = (rows.select(F.col("source").alias("s"), "size", "last", "place")
             .join(ends, F.col("s").eqNullSafe(F.col("source")) & F.col("place").eqNullSafe(F.col("at")))
             .groupBy("source").agg(F.count_if(F.col("last") == F.col("size")).alias("whole"),
                                    F.max(F.when(F.col("last") < F.col("size"), F.col("last"))).alias("part"),
                                    F.count(F.lit(1)).alias("equal")))
    named = there.select(F.col("source").alias("s"), "whole", "part", "equal")
    return saved(ends.join(named, F.col("s").eqNullSafe(F.col("source")), "left").drop("s"), "mix-cuts")


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
               weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per whole epoch of a document, and
    one with its first words where the budget ends inside it.

    The cuts, one row per source, are joined to the documents, and every document then
    knows its copies from its own hashes: no text is shuffled where that table is small
    enough to be broadcast (``BROADCAST_SOURCES``).  Equal rows at a source's cut are
    interchangeable; they are counted together.
    """
    ends = cuts(docs, text, source, key, weights, max_epochs, seed).select(
        F.col("source").alias("__s"), "epochs", "at", "whole", "part", "equal")
    if ends.count() <= BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    h1, h2 = _order(key, text, seed)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(source).alias("__source"),
                       word_count(F.col(text)).alias("__size"),
                       let(h1, lambda h: F.struct(F.shiftrightunsigned(h, 1).alias("hkey"), h.alias("h1"),
                                                  F.col(key).alias("doc_id"), h2)).alias("__place"))
    placed = rows.join(ends, F.col("__source").eqNullSafe(F.col("__s"))).where("__size > 0")
    before = F.coalesce(F.col("__place") < F.col("at"), F.lit(False))
    edge = F.coalesce(F.col("__place") == F.col("at"), F.lit(False)) & (F.col("equal") == 1)
    whole = (F.col("epochs") + before.cast("long") + F.when(edge, F.col("whole")).otherwise(F.lit(0))).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(edge & F.col("part").isNotNull(), F.array(
        F.col("part").cast("int"))).otherwise(F.array().cast("array<int>")))
    taken = placed.select("__row", F.explode(parts).alias("first_words"))
    # several equal rows at the cut: their share of the last epoch is given out once
    several = placed.where((F.col("equal") > 1) & (F.col("__place") == F.col("at")))
    first = several.groupBy("__source").agg(F.first("__row").alias("__row"), F.max("whole").alias("whole"),
                                            F.max("part").alias("part"))
    extra = first.select("__row", F.explode(F.concat(
        F.array_repeat(F.lit(-1), F.col("whole").cast("int")),
        F.when(F.col("part").isNotNull(), F.array(F.col("part").cast("int"))).otherwise(
            F.array().cast("array<int>")))).alias("first_words"))
    rows = taken.unionByName(extra)
    old = F.col(f"__row.{text}")
    new = F.when(F.col("first_words") < 0, old).otherwise(
        F.array_join(F.slice(words(old), 1, F.greatest(F.col("first_words"), F.lit(0))), " "))
    return rows.select(*[new.alias(c) if c == text else F.col(f"__row.{c}").alias(c) for c in docs.columns])
