"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer (20 code points) is an anchor when the smallest hash of its inner
substrings (5 code points, 16 of them) is the first or the last one.  Whether a
k-mer is an anchor depends on the k-mer alone, so an edit changes only the
anchors that touch it: the fingerprint of an edited text takes the anchors of
its unchanged part from the original and looks only at the rest again.

The fingerprint lists the anchors' 32-bit hashes in text order (8 hex digits
each); the likeness of two fingerprints is the Dice coefficient of their anchor
sets.  Texts are read in chunks that overlap by k - 1 code points, so working
memory does not follow the text length, and no anchor is lost at a border.

``with_next`` finds the next document in descending id without a global window:
ids are range-partitioned (ids only) to get bucket borders, the rows are dealt
into these buckets once, and the first row of every bucket is also sent to the
bucket that precedes it in the order.

Edge cases: null text is empty; an empty text has the empty fingerprint, and two
empty fingerprints are alike (1.0), an empty and another are not (0.0); a text
without any anchor (always so below 20 code points) lists all its inner
substrings, below 5 code points the hash of the whole; a null id sorts last; rows with equal ids are ordered by a hash
of the text; a single document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

S = 5                     # inner substring
K = 4 * S                 # k-mer: four inner substrings side by side cover it
INNER = K - S + 1         # 16 inner substrings in a k-mer
CHUNK = 4_096
ROWS_PER_BUCKET = 1_000
MAX_BUCKETS = 100_000
_MASK = (1 << 32) - 1


def _chunk_anchors(chunk: Column, start: Column) -> Column:
    """Anchors of one chunk: position * 2**32 + hash."""
    smers = F.regexp_extract_all(chunk, F.lit("(?s)(?=(.{%d}))." % S), F.lit(1))

    def pick(h: Column) -> Column:
        # minimum over 16 neighbours: over four, then over four of these
        def least(a: Column, reach: int) -> Column:
            return F.transform(a, lambda x, i: F.least(
                x, F.get(a, i + reach), F.get(a, i + 2 * reach), F.get(a, i + 3 * reach)))

        def marked(low: Column) -> Column:
            last = F.size(h) - INNER
            return F.filter(F.transform(low, lambda x, i: F.when(
                (i <= last) & ((F.get(h, i) == x) | (F.get(h, i + (INNER - 1)) == x)),
                F.shiftleft((start + i).cast("long"), 32).bitwiseOR(
                    F.hash(F.get(h, i), F.get(h, i + S), F.get(h, i + 2 * S), F.get(h, i + 3 * S))
                    .cast("long").bitwiseAND(F.lit(_MASK))))), lambda x: x.isNotNull())

        return let(least(h, 1), lambda a: let(least(a, 4), marked))

    return let(F.transform(smers, lambda x: F.hash(x)), pick)


def anchors(text: Column, begin: Column | None = None) -> Column:
    """Anchors of the k-mers that start at ``begin`` (code points) or later, in text order."""
    begin = F.lit(0) if begin is None else begin
    return let(F.length(text) - K, lambda last: F.when(
        last < begin, F.array().cast("array<long>")).otherwise(F.flatten(F.transform(
            F.sequence(begin, F.greatest(last, begin), F.lit(CHUNK)),
            lambda at: _chunk_anchors(text.substr(at + 1, F.lit(CHUNK + K - 1)), at)))))


def or_whole(found: Column, text: Column) -> Column:
    """The anchors, or for a text that has none all its inner substrings, or the hash of the whole."""
    short = F.when(F.length(text) < S, F.array(F.hash(text))).otherwise(F.transform(
        F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % S), F.lit(1)), lambda x: F.hash(x)))
    # bound once: the array is needed for the test and for the result
    return let(found, lambda a: F.when((F.size(a) == 0) & (F.length(text) > 0), F.transform(
        short, lambda x: x.cast("long").bitwiseAND(F.lit(_MASK)))).otherwise(a))


def hashes(found: Column) -> Column:
    return F.transform(found, lambda x: x.bitwiseAND(F.lit(_MASK)))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(hashes(found), lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the sets of two arrays; two empty ones are alike."""
    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), lambda p: let(
        F.size(p["a"]) + F.size(p["b"]), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(p["a"], p["b"])) * 2.0 / n)))


def _bucket(order: Column, borders: list) -> Column:
    """Number of the last border that is not above ``order``: binary search in a constant array."""
    table = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<long>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(borders).bit_length())))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        inside = F.get(table, middle) <= order
        return F.struct(F.when(inside, middle).otherwise(s["low"]).alias("low"),
                        F.when(inside, s["high"]).otherwise(F.greatest(middle - 1, s["low"])).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(borders) - 1).alias("high")),
                       halve, lambda s: s["low"])


def bucketed(docs: DataFrame, key: str = "doc_id", text: str = "text",
             rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple:
    """(rows with bucket and copy flag, window over a bucket in descending order of ids)."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("o"))
    count = ids.count()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       order.alias("o"), F.xxhash64(F.col(text)).alias("h"))
    if not count:
        ends = [(0, 0)]
    else:
        parts = max(1, min(MAX_BUCKETS, -(-count // rows_per_bucket)))
        # at most MAX_BUCKETS rows of two numbers
        ends = sorted((r["a"], r["b"]) for r in ids.repartitionByRange(parts, "o")
                      .groupBy(F.spark_partition_id()).agg(F.min("o").alias("a"), F.max("o").alias("b")).collect())
    bucket = _bucket(F.col("o"), [a for a, _ in ends])
    tops = F.split(F.lit(",".join(str(b) for _, b in ends)), ",").cast("array<long>")
    placed = rows.withColumn("bucket", bucket).withColumn("copy", F.explode(F.when(
        F.col("o") == F.get(tops, F.col("bucket")), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    moved = placed.withColumn("bucket", F.when(
        F.col("copy") == 1, (F.col("bucket") + 1) % len(ends)).otherwise(F.col("bucket")))
    return moved, Window.partitionBy("bucket").orderBy("copy", F.col("o").desc(), "h")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``fingerprint``."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("fingerprint", as_text(or_whole(anchors(t), t)))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last third replaced by the head of the next document.
    """
    rows, order = bucketed(docs, key, text)
    found = (rows.withColumn("next_text", F.lead("text").over(order))
             .withColumn("raw", anchors(F.col("text")))
             .withColumn("next_raw", F.lead("raw").over(order))
             .where("copy = 0"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third),
                      F.col("next_text").substr(F.lit(1), third))
    shaped = found.select("doc_id", "raw", or_whole(F.col("raw"), F.col("text")).alias("found"),
                          or_whole(F.col("next_raw"), F.col("next_text")).alias("next_found"),
                          n.cast("long").alias("n_chars"),
                          edited.alias("edited"), (n - third).alias("kept"))
    # k-mers inside the kept part are those of the original; the others are looked at anew
    fresh = F.greatest(F.col("kept") - (K - 1), F.lit(0))
    kept = F.filter(F.col("raw"), lambda x: F.shiftright(x, 32) < fresh)
    again = F.when(F.length("edited") < K, F.array().cast("array<long>")).otherwise(
        F.concat(kept, anchors(F.col("edited"), fresh)))
    compared = shaped.withColumn("edited_found", or_whole(again, F.col("edited")))
    return compared.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("found")).alias("fingerprint"), as_text(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(hashes(F.col("found")), hashes(F.col("edited_found"))).alias("near_edited"),
        likeness(hashes(F.col("found")), hashes(F.col("next_found"))).alias("near_next"))
