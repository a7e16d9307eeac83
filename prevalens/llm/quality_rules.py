"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, DataFrame functions only.

The method compares two multinomials over hashed word n-grams (one and two
words): the trusted target and the raw corpus.  Each document's score is the
sum of ``log p_target - log p_raw`` over its n-grams, divided by their number,
and a document is kept when the score is not far below those of the trusted
texts of the same corpus: the cut is their median less ``SPREADS`` times the
distance from it to their 1 % quantile, so it moves with the corpus.  Both
multinomials count every n-gram of every text.  A count is one
``groupBy(bucket)`` whose result has at most ``buckets`` rows, so what crosses
the network is bounded by (tasks x buckets) pairs of integers; the log ratios
are a broadcast table of ``buckets`` rows, whose size does not depend on the
corpus.  Scores are joined back by a 128-bit hash of the row.

The trusted target is a boolean column; by default ``running_prose``, a strict
rule on the text itself.  The rule only feeds the target's counts: every
document is judged by its score.

Edge cases: null or empty text has no words, fails the base rules and scores 0;
an empty table gives no rows; one-word texts have one n-gram; very long texts
are read whole; repeated rows are scored one by one; extra columns are ignored;
a corpus without any trusted text gives every document the score 0, and under
``MIN_TRUSTED`` trusted texts the score drops nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved, words

BUCKETS = 1 << 20
#: The cut lies so many lower spreads under the median score of the trusted texts.
SPREADS = 3
#: Fewer trusted texts give no cut.
MIN_TRUSTED = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
_UNIT = 1 << 24         # log ratios are whole multiples of 1 / _UNIT
_CELLS = 1 << 12        # histogram cells per unit of the score
_POS_BITS = 28          # position of a window inside a packed long


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more (first occurrence included).

    A window's hash bits and its position are packed in one long, so a plain sort
    of longs brings equal windows together; these candidates are then compared
    by their words.  The words covered by windows at sorted positions p are the
    sum of min(3, next p - p).
    """
    high = F.lit(((1 << 35) - 1) << _POS_BITS)
    low = F.lit((1 << _POS_BITS) - 1)
    near = F.lit(1 << _POS_BITS)

    def neighbour(a: Column, x: Column, i: Column, key) -> Column:
        return (key(x) == key(F.get(a, i - 1))) | (key(x) == key(F.get(a, i + 1)))

    def covered(candidates: Column, w: Column) -> Column:
        named = F.sort_array(F.transform(candidates, lambda x: let(
            x.bitwiseAND(low).cast("int"),
            lambda i: F.struct(F.array_join(F.slice(w, i + 1, 3), " ").alias("t"), i.alias("i")))))
        equal = let(named, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: F.coalesce(neighbour(s, x, i, lambda v: v["t"]), F.lit(False))),
            lambda x: x["i"])))
        return let(equal, lambda q: F.aggregate(
            F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        packed = F.sort_array(F.transform(
            F.slice(w, 1, F.size(w) - 2),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high)
            .bitwiseOR(i.cast("long"))))
        # windows with equal hash bits lie less than 2**28 apart; others that do are sorted out below
        candidates = let(packed, lambda p: F.array_distinct(F.flatten(F.transform(
            F.filter(F.transform(p, lambda x, i: F.when(F.get(p, i + 1) - x < near, i)),
                     lambda i: i.isNotNull()),
            lambda i: F.array(F.get(p, i), F.get(p, i + 1))))))
        return let(candidates, lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(covered(c, w)))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(w, count)).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"),
                     lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def ngram_hashes(w: Column) -> Column:
    """Hashes of the one- and two-word sequences of a text (case kept: shouting is a signal)."""
    ones = F.transform(w, lambda x: F.xxhash64(x))
    twos = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                       lambda x, i: F.xxhash64(F.get(w, i), x))
    return F.concat(ones, twos)


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def running_prose(w: Column, text: Column) -> Column:
    """Strict rule for the trusted target: enough different words, no symbols, no shouting."""
    n = F.size(w)
    return ((n >= MIN_WORDS) & (F.regexp_count(text, F.lit(SYMBOLS)) * 1000 <= n)
            & (F.regexp_count(text, F.lit(r"\p{Lu}{2}")) * 5 <= n)
            & (F.size(F.array_distinct(w)) * 4 >= n))


def log_ratios(docs: DataFrame, text: str = "text", trusted: str | None = None,
               buckets: int = BUCKETS) -> DataFrame:
    """(b, ratio): log p_target - log p_raw of every bucket that occurs, in units of 1 / ``_UNIT``.

    Each multinomial is smoothed by one count a bucket.
    """
    # the words are bound inside one expression: a reference from a lambda to a column of an
    # inner select could be inlined by the optimizer and split the text once per word
    counted = saved(_grams(docs, text, trusted, buckets, [])
                    .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trust").alias("target"))
                    .where(F.col("b").isNotNull()), "rules-buckets")
    raw, target = counted.agg(F.sum("raw"), F.sum("target")).first()
    if not target:                       # nothing trusted: no evidence either way
        return counted.select("b", F.lit(0).cast("long").alias("ratio"))
    shift = math.log(raw + buckets) - math.log(target + buckets)
    ratio = F.log(F.col("target") + 1.0) - F.log(F.col("raw") + 1.0) + F.lit(shift)
    return counted.select("b", F.round(ratio * _UNIT).cast("long").alias("ratio"))


def _grams(docs: DataFrame, text: str, trusted: str | None, buckets: int, keep: list) -> DataFrame:
    """``keep`` columns, trust and one bucket ``b`` per n-gram; a text without any has a null one."""
    flag = ((lambda w: F.coalesce(F.col(trusted), F.lit(False))) if trusted
            else (lambda w: running_prose(w, F.col(text))))
    found = let(words(F.col(text)), lambda w: F.struct(
        flag(w).alias("trust"), ngram_hashes(w).alias("h")))
    # the outer form: the plain one infers a filter that evaluates the array twice; hashes become
    # buckets after it, in compiled code and not in the lambda
    return (docs.select(*keep, found.alias("f"))
            .select(*keep, F.col("f.trust").alias("trust"), F.explode_outer("f.h").alias("h"))
            .select(*keep, "trust", F.pmod("h", F.lit(buckets)).cast("int").alias("b")))


def corpus_cut(scores: DataFrame) -> float:
    """The least score of a kept document: ``SPREADS`` lower spreads under the median of the trusted ones.

    The lower spread is the distance from the median to the 1 % quantile.  Both come from a
    histogram whose cells do not depend on the layout of the table, nor their number on its size.
    """
    cells = (scores.where("trust").groupBy(F.floor(F.col("llr") * _CELLS).alias("cell"))
             .agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect())
    total = sum(r["n"] for r in cells)
    if total < MIN_TRUSTED:
        return -math.inf

    def quantile(share: float) -> float:
        seen = 0
        for r in cells:
            seen += r["n"]
            if seen >= share * total:
                return r["cell"] / _CELLS
        return cells[-1]["cell"] / _CELLS

    middle = quantile(0.5)
    return middle - SPREADS * (middle - quantile(0.01))


def score(docs: DataFrame, text: str = "text", trusted: str | None = None, buckets: int = BUCKETS,
          threshold: float | None = None) -> DataFrame:
    """All input columns plus the base counts, ``base_failed``, ``llr`` and ``kept``.

    ``threshold`` replaces the cut that is derived from the scores of the trusted texts.
    """
    t = F.col(text)
    # rows that are equal in all columns share a key, and their score; maps have no hash
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumns({"_k1": F.xxhash64(*plain), "_k2": F.xxhash64(F.lit(1), *plain)})
    # at most ``buckets`` rows: broadcast is bounded by that parameter
    ratios = F.broadcast(log_ratios(docs, text, trusted, buckets))
    # whole numbers: their sum does not depend on the order
    summed = (_grams(keyed, text, trusted, buckets, ["_k1", "_k2"]).join(ratios, "b")
              .groupBy("_k1", "_k2").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"),
                                         F.max("trust").alias("trust")))
    scores = saved(summed.select("_k1", "_k2", (F.col("sum") / F.col("n") / _UNIT).alias("llr"), "trust"),
                   "rules-scores")
    cut = corpus_cut(scores) if threshold is None else threshold
    facts = let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbol_count(t).alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counted = (keyed.withColumn("_facts", facts)
               .select(*[F.col(c) for c in docs.columns if c not in names + ("llr", "base_failed", "kept")],
                       "_k1", "_k2", *[F.col(f"_facts.{n}").alias(n) for n in names])
               .join(scores.drop("trust"), ["_k1", "_k2"], "left").drop("_k1", "_k2")
               .withColumn("llr", F.coalesce("llr", F.lit(0.0))))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return (counted.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(float(cut)))))
