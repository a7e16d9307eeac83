"""Phrase collocations by dynamic itemset counting.

Words are runs of anything but space and tab inside pieces (texts are split at
punctuation and line ends); phrases are two or three neighbouring words of a
piece, counted per language.  The corpus is dealt by a hash of the text into
``SHARDS`` shards, which are scanned in a cycle, one shard a step.  Words are
counted from the first step on.  As soon as both subphrases of a longer phrase
(its words, or its first and last two words) have reached the least count, the
phrase is active: it is counted from the next step on, alongside the shorter
ones, and is complete after one full cycle of its own.  The scans end when no phrase
is in its cycle any more, at the latest after three cycles.

Activation is one byte per hash bucket: the first step at which a subphrase of
that bucket had reached the least count.  The table has ``BUCKETS`` entries
whatever the corpus, and is all that is broadcast.  A bucket may hold several
subphrases, so a phrase may be active earlier than it should, though never before
its words; then it is counted earlier, still for exactly one cycle, and counts stay
exact.  A phrase whose count
reaches the threshold has subphrases that do, so none is missed.

A task names a word by a 64-bit hash, sums its counts before the shuffle and
hands over words as text only once.  Counts of phrases travel in blocks, one row per
task, language and bucket of phrases; a bucket's blocks are summed in one group, whose
size is bounded by the number of buckets (``WORDS_PER_PART``).  A block holds phrases that
became active after one step, its *cohort*: they are complete together, so later
steps sum no cohort again that is.  Words are complete after the first cycle, and are
summed once more then, as text too.  Words that share a hash would merge, so the
complete word table is tested, and the whole count starts anew with another seed
should it hold one hash twice.  Counts therefore are exact.

Scores are integer arithmetic on decimals of 38 digits: exact for counts up to
10**15.

Edge cases: null and empty texts have no phrases; a null language is ``und``;
repeated rows all count; ties follow the phrase's UTF-8 bytes; an empty table
gives no rows; extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, saved
from .textnum import mixed, slices, utf8, word_hashes

LEAST = 10
LONGEST = 3
SHARDS = 2
BUCKETS = 1 << 23
KEEP_PERCENT = 50
TOP = 2_000
UNKNOWN = "und"
#: Counts that a task holds before it hands them over (24 to 40 bytes each).
HELD = 1_000_000
#: Rows of a batch that a task hands over.
BATCH = 1 << 16
#: Words of the corpus for one bucket of phrases that is summed in one group.
WORDS_PER_PART = 1 << 20
#: Odd factors that make one number of a phrase's word hashes.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
#: Bytes of a word up to which the polynomial hash tells words apart.
PLAIN = 256
_NEVER = 255
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True


def piece_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, joined): the words, and whether each follows the word before it in the same piece."""
    stop = _BREAK[raw]
    inner = ~(_BLANK[raw] | stop)
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    begins[cut] = inner[cut]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inner[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # pieces are numbered by the breaks before them; a text's start is a break too
    breaks = np.cumsum(stop)
    text = np.searchsorted(offsets, starts, side="right")
    joined = np.zeros(len(starts), dtype=bool)
    if len(starts):
        joined[1:] = (breaks[starts[1:]] == breaks[starts[:-1]]) & (text[1:] == text[:-1])
    return starts, ends, joined


def named(lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """64-bit hash of a subphrase; its lowest bits are the bucket."""
    h = np.atleast_1d(lang)
    for w in words:
        h = mixed(h * np.uint64(3) + w)
    return h


def buckets(names: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of named subphrases in a table of a power of two entries."""
    return (names & np.uint64(len(table) - 1)).astype(np.int64)


class _Sums:
    """Counts per key; a key is a row of several 64-bit numbers."""

    def __init__(self, width: int):
        self.width, self.held, self.size = width, [], 0

    def add(self, keys: list, counts: np.ndarray | None = None) -> None:
        if len(keys[0]):
            self.held.append(_summed([*keys, np.ones(len(keys[0]), np.int64) if counts is None else counts]))
            self.size += len(self.held[-1][0])

    def take(self) -> list:
        """All sums so far, once."""
        out = _summed([np.concatenate(x) for x in zip(*self.held)]) if self.held else \
            [np.zeros(0, np.uint64)] * self.width + [np.zeros(0, np.int64)]
        self.held, self.size = [], 0
        return out


def _one_number(keys: list) -> np.ndarray:
    """One 64-bit number of every row of hashes; equal rows have equal ones."""
    out = keys[0] * _FACTORS[0]
    for k, f in zip(keys[1:], _FACTORS[1:]):
        out = out + k * f
    return out


def _summed(cols: list) -> list:
    """Counts of equal rows of hashes, summed; sorted by one number of the row."""
    *keys, counts = cols
    if not len(counts):
        return cols
    code = _one_number(keys)
    order = np.argsort(code)
    code, keys = code[order], [k[order] for k in keys]
    new = np.ones(len(order), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    if any((~new[1:] & (k[1:] != k[:-1])).any() for k in keys):
        # two rows share the number
        again = np.lexsort(keys[::-1])
        order, keys = order[again], [k[again] for k in keys]
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [*[k[at] for k in keys], np.add.reduceat(counts[order], at)]


def _blocks(cols: list, parts: int):
    """(part, rows, bytes) of summed counts: the counts and the hashes of the phrases of one part."""
    *keys, counts = cols
    part = ((_one_number(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    rows = np.stack([counts, *[k.view(np.int64) for k in keys]])
    if (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        part, rows = part[order], rows[:, order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
        yield int(part[a]), b - a, rows[:, a:b].tobytes()


def _lang_hash(langs: list, seed: int) -> dict:
    """Any number per language; it only spreads buckets."""
    import zlib
    return {x: np.uint64(zlib.crc32(x.encode()) + (seed << 32)) for x in langs}


_COUNTS = "lang string, h1 long, h2 long, word string, c long, length int, part int, since int, counts binary"


def count_step(shard: DataFrame, step: int, reach, seed: int, shards: int = SHARDS) -> DataFrame:
    """Counts of one scan of a shard.  Words: lang, h1, h2 = 0, word, c.  Blocks of phrases: lang, their
    ``length``, ``part``, the step ``since`` which they are active, the number of ``c`` rows, and ``counts``,
    the counts and hashes (``_blocks``).

    ``reach`` broadcasts the byte table of activation steps and the number of parts.  A phrase is
    counted if its cycle contains this step.
    """
    def run(batches):
        table, parts = reach.value
        rows = {}                                        # (lang, length, since) -> sums
        texts: dict = {}                                 # (lang, hash) -> word
        columns = [x.split()[0] for x in _COUNTS.split(", ")]

        def add(lang: str, since: np.ndarray, *cols: np.ndarray):
            for s in np.unique(since).tolist():
                at = since == s
                rows.setdefault((lang, len(cols), s), _Sums(len(cols))).add([c[at] for c in cols])

        def out():
            for (lang, n, since), sums in rows.items():
                cols = sums.take()
                if not len(cols[0]):
                    continue
                if n > 1:
                    held = list(_blocks(cols, parts))
                    size = len(held)
                    part, c, data = zip(*held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang, pa.string()), size), *[pa.nulls(size, pa.int64())] * 2,
                         pa.nulls(size, pa.string()), pa.array(c, pa.int64()), pa.array([n] * size, pa.int32()),
                         pa.array(part, pa.int32()), pa.array([since] * size, pa.int32()),
                         pa.array(data, pa.binary())], names=columns)
                    continue
                for i in range(0, len(cols[0]), BATCH):
                    h, c = (x[i:i + BATCH] for x in cols)
                    size = len(c)
                    word = pa.array([texts.pop((lang, x), None) for x in h.tolist()], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(lang, pa.string()), size), pa.array(h.view(np.int64)),
                         pa.array(np.zeros(size, np.int64)), word, pa.array(c), pa.array([1] * size, pa.int32()),
                         *[pa.nulls(size, pa.int32())] * 2, pa.nulls(size, pa.binary())], names=columns)

        for batch in batches:
            for whole in slices(batch, "t"):
                langs = np.array(whole.column("lang").to_pylist(), dtype=object)
                number = _lang_hash(sorted(set(langs)), seed)
                for lang, code in number.items():
                    part = whole.column("t").filter(pa.array(langs == lang))
                    raw, offsets = utf8(part)
                    starts, ends, joined = piece_words(raw, offsets)
                    if not len(starts):
                        continue
                    w = named_words(raw, starts, ends, seed)
                    if step < shards:
                        sums = rows.setdefault((lang, 1, 0), _Sums(1))
                        found, first, c = np.unique(w, return_index=True, return_counts=True)
                        sums.add([found], c)
                        for h, i in zip(found.tolist(), first.tolist()):
                            if (lang, h) not in texts:
                                texts[lang, h] = _word(raw, starts[i], ends[i])
                    one = table[buckets(named(code, w), table)].astype(np.int64)
                    since = np.maximum(one[1:], one[:-1])
                    two = joined[1:] & (since < _NEVER)
                    use = np.flatnonzero(two & (since < step) & (since >= step - shards))
                    add(lang, since[use], w[use], w[use + 1])
                    if step > 0 and len(w) > 2:
                        # never before the pairs' words: a shared bucket may be older than they are
                        pair = np.full(len(w) - 1, _NEVER, np.int64)
                        at = np.flatnonzero(two)
                        pair[at] = np.maximum(table[buckets(named(code, w[at], w[at + 1]), table)], since[at])
                        since = np.maximum(pair[1:], pair[:-1])
                        use = np.flatnonzero((since < step) & (since >= step - shards))
                        add(lang, since[use], w[use], w[use + 1], w[use + 2])
                if sum(s.size for s in rows.values()) > HELD:
                    for sums in rows.values():
                        cols = sums.take()
                        sums.held, sums.size = [cols], len(cols[0])
                    if sum(s.size for s in rows.values()) > HELD // 2:
                        yield from out()
                        texts.clear()
        yield from out()

    return shard.mapInArrow(run, _COUNTS)


def named_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the words, never 0.  Long words can be built to share the plain one, and get another."""
    w = mixed(word_hashes(raw, starts, ends, lower=True) ^ mixed(np.array([seed + 1], np.uint64)))
    for i in np.flatnonzero(ends - starts > PLAIN):
        code = hashlib.blake2b(bytes(raw[starts[i]:ends[i]]).lower(), digest_size=8, key=b"%d" % seed)
        w[i] = int.from_bytes(code.digest(), "little")
    return np.maximum(w, np.uint64(1))                   # 0 stands for no word


def _word(raw: np.ndarray, a: int, b: int) -> str:
    return bytes(raw[a:b]).lower().decode("utf-8", "surrogatepass")


def _names(batch, length: int, langs: dict, seed: int) -> np.ndarray:
    """Hashes of the phrases of a batch of counts."""
    found = batch.column("lang").dictionary_encode()
    names = found.dictionary.to_pylist()
    langs |= _lang_hash([x for x in names if x not in langs], seed)
    code = np.array([langs[x] for x in names], np.uint64)[found.indices.to_numpy()]
    return named(code, *[batch.column(f"h{i + 1}").to_numpy().view(np.uint64) for i in range(length)])


def _frequent(found: DataFrame, length: int, least: int) -> DataFrame:
    """(lang, h1, h2, h3, c, since): the phrases of a length whose counts so far reach ``least``.

    A group sums one part of a cohort; a phrase is in one cohort only.
    """
    def run(key: tuple, table: pa.Table) -> pa.Table:
        since, held = key[1].as_py(), {}
        for lang, data in zip(table.column("lang").to_pylist(), table.column("counts").to_pylist()):
            held.setdefault(lang, []).append(np.frombuffer(data, np.int64).reshape(length + 1, -1))
        out = []
        for lang, blocks in held.items():
            c, *keys = np.concatenate(blocks, axis=1)
            *keys, c = _summed([*[k.view(np.uint64) for k in keys], c])
            use = c >= least
            size = int(use.sum())
            hashes = [k[use].view(np.int64) for k in keys] + [np.zeros(size, np.int64)] * (3 - length)
            out.append(pa.Table.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), *map(pa.array, hashes),
                                             pa.array(c[use]), pa.array([since] * size, pa.int32())],
                                            names=["lang", "h1", "h2", "h3", "c", "since"]))
        return pa.concat_tables(out)

    return (found.where(F.col("length") == length).select("part", "since", "lang", "counts")
            .groupBy("part", "since").applyInArrow(run, "lang string, h1 long, h2 long, h3 long, c long, since int"))


def _words(found: DataFrame) -> DataFrame:
    """(lang, h1, c, word, other): sums of all words; ``other`` differs from ``word`` if two words share a hash."""
    # texts are group keys first: sums of numbers need no sorting, and few rows are left for min and max
    each = found.where("h2 = 0").groupBy("lang", "h1", "word").agg(F.sum("c").alias("c"))
    return each.groupBy("lang", "h1").agg(
        F.sum("c").alias("c"), F.min("word").alias("word"), F.max("word").alias("other"))


def _reached(large: DataFrame, length: int, reach, seed: int) -> np.ndarray:
    """Buckets, not yet active, of phrases of a length that have reached the least count.

    At most one number per bucket reaches the driver.
    """
    size = len(reach.value[0])

    def run(batches):
        table, langs = reach.value[0], {}
        for batch in batches:
            at = buckets(_names(batch, length, langs, seed), table)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at[table[at] == _NEVER]))], names=["at"])

    out = np.zeros(size, dtype=bool)
    with freed(large.sparkSession):
        at = large.mapInArrow(run, "at long").distinct().toArrow()
    out[at.column("at").to_numpy()] = True
    return out


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                  shards: int = SHARDS) -> DataFrame:
    """(lang, h1, h2, h3, word, c): complete counts of all words and of all phrases that reach ``least``."""
    dealt = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("t")).where(
        "t is not null")
    number = F.pmod(F.xxhash64("t"), F.lit(shards))
    spark = docs.sparkSession
    seed = 0
    while True:
        reach = np.full(BUCKETS, _NEVER, np.uint8)
        counted, busy, parts = [], shards, int(spark.conf.get("spark.sql.shuffle.partitions"))
        step, pairs, pairs_until = 0, [], 0
        # a phrase that became active after step s is counted in the steps s + 1 ... s + shards
        while step < busy and step < LONGEST * shards:
            sent = spark.sparkContext.broadcast((reach, parts))
            counted.append(saved(count_step(dealt.where(number == step % shards), step, sent, seed, shards),
                                 f"phrases-step{step}", codec="zstd"))
            so_far = _all(counted)
            if step < shards:
                if step == 0:                            # phrases are counted from the next step on
                    with freed(spark):
                        seen = so_far.agg(F.sum("c")).first()[0] or 0
                    parts = max(parts, -(-seen * shards // WORDS_PER_PART))
                if step == shards - 1:                   # a whole cycle: words are complete
                    large = words = saved(_words(so_far), "phrases-words")
                else:
                    large = so_far.where("h2 = 0").groupBy("lang", "h1").agg(F.sum("c").alias("c"))
                new = _reached(large.where(F.col("c") >= least), 1, sent, seed)
                if new.any():
                    reach = np.where(new & (reach == _NEVER), np.uint8(step), reach)
                    busy = max(busy, step + 1 + shards)
                    pairs_until = step + shards          # the last step that counts pairs
            if 1 <= step <= pairs_until:
                whole = step - shards                    # the cohort that this step completes; older ones are done
                large = saved(_frequent(_all(counted[max(0, whole + 1):]).where(F.col("since") >= whole), 2, least),
                              "phrases-pairs")
                pairs.append(large.where(F.col("since") == whole))
                new = _reached(large, 2, sent, seed)
                if new.any():
                    reach = np.where(new & (reach == _NEVER), np.uint8(step), reach)
                    busy = max(busy, step + 1 + shards)
            sent.unpersist()
            step += 1
        if words.where("word <> other").isEmpty():
            none = F.lit(0).cast("long")
            out = words.select("lang", "h1", none.alias("h2"), none.alias("h3"), "word", "c")
            threes = [saved(_frequent(_all(counted), 3, least), "phrases-threes")] if pairs else []
            for phrases in [*pairs, *threes]:
                out = out.unionByName(phrases.drop("since").withColumn("word", F.lit(None).cast("string")))
            return out
        seed += 1                                        # two words share a hash: count anew


def _all(parts: list) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cut_score(left: str, right: str) -> Column:
    """floor(10**6 a**2 / (left right)) of the count columns."""
    return F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) "
                  f"div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                 top: int | None = TOP, keep_percent: int = KEEP_PERCENT, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    counts = count_phrases(docs, text, lang, least, shards)
    words = counts.where("h2 = 0").select("lang", F.col("h1").alias("h"), "word", "c")
    n = words.groupBy("lang").agg(F.sum("c").alias("n"))
    pairs = counts.where("h2 <> 0 and h3 = 0").select("lang", "h1", "h2", F.col("c").alias("a"))
    threes = counts.where("h3 <> 0").select("lang", "h1", "h2", "h3", F.col("c").alias("a"))

    def one(name: str, value: str) -> DataFrame:
        return words.select("lang", F.col("h").alias(name), F.col("c").alias(value))

    def two(first: str, second: str, value: str) -> DataFrame:
        return pairs.select("lang", F.col("h1").alias(first), F.col("h2").alias(second), F.col("a").alias(value))

    both = pairs.join(one("h1", "l"), ["lang", "h1"]).join(one("h2", "r"), ["lang", "h2"])
    both = both.withColumn("score", cut_score("l", "r")).withColumn("h3", F.lit(0).cast("long"))
    long_ = (threes.join(one("h1", "l1"), ["lang", "h1"]).join(two("h2", "h3", "r1"), ["lang", "h2", "h3"])
             .join(two("h1", "h2", "l2"), ["lang", "h1", "h2"]).join(one("h3", "r2"), ["lang", "h3"]))
    long_ = long_.withColumn("s1", cut_score("l1", "r1")).withColumn("s2", cut_score("l2", "r2"))
    first = F.col("s1") <= F.col("s2")
    long_ = long_.select("lang", "h1", "h2", "h3", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
                         F.least("s1", "s2").alias("score"))
    # a pair goes when a longer candidate around it has half of its count
    around = (threes.select("lang", "h1", "h2", "a").union(threes.select("lang", "h2", "h3", "a"))
              .groupBy("lang", "h1", "h2").agg(F.max("a").alias("longer")))
    both = both.join(around, ["lang", "h1", "h2"], "left").where(
        F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * keep_percent)
    names = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    rated_ = both.select(*names).union(long_.select(*names))
    best = [F.col("score").desc(), F.col("a").desc()]
    if top is not None:
        # what cannot be among the first ``top`` by score and count goes before the words are read
        salt = F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(64))
        for part in ([F.col("lang"), salt], [F.col("lang")]):
            rated_ = rated_.withColumn("at", F.rank().over(Window.partitionBy(*part).orderBy(*best))).where(
                F.col("at") <= top)
        rated_ = rated_.drop("at")

    def told_of(name: str) -> DataFrame:
        return words.select("lang", F.col("h").alias(f"h{name}"), F.col("word").alias(f"w{name}"))

    told = (saved(rated_, "phrases-best").join(told_of("1"), ["lang", "h1"]).join(told_of("2"), ["lang", "h2"])
            .join(told_of("3"), ["lang", "h3"], "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase"))
    out = told.withColumn("rank", rank.cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
