"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised (byte-level BPE ids, then id 0) and cut into pieces of
at most ``LENGTH`` tokens; whole pieces of that length are sequences of their
own.  The other pieces are dealt at random into blocks of about ``BLOCK``
pieces, and every block is packed by a genetic algorithm that works on bins:

* a solution is a list of bins; the first ones come from best-fit on random
  and on decreasing orders;
* crossover injects well-filled whole bins of one parent into a copy of the
  other, removes the bins that hold duplicates of injected documents, and puts
  the documents that lost their bin back by best fit (largest first);
* fitness is the mean of (fill / length) squared, which rewards full bins.

Each block is evolved on ``ISLANDS`` islands.  After every epoch the islands'
best solutions (elites) migrate: a shuffle by block brings them together and
each island starts its next epoch with the elites of all others.  The best
solution of the last epoch is the result.  Blocks and islands are groups of
bounded size, so the work scales with the number of blocks.

Edge cases: null text is empty and still has the one token 0; a text of any
length is read whole; equal lengths keep the order of ids; repeated rows are
separate documents (told apart by a row number among equal ids); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, saved
from .textnum import slices

LENGTH = 2048
BLOCK = 6_000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 8
POPULATION = 4
#: Word pieces kept by a worker's memory of encoded words.
CACHE = 100_000
VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for texts without a special token's string.
RANKS = "byte_bpe_50k.tiktoken"
_HARD_SPACES = re.compile(r"\s \s*|\s\Z| \s")


@lru_cache(1)
def load_encoder(vocabulary: str = VOCABULARY, ranks_file: str = RANKS):
    """text -> little-endian bytes of its ids; words are looked up in a bounded memory.

    The ids are those of the ``tokenizers`` file.  A text that holds the string of one of its
    special tokens is encoded by that library; for all others the same merges are read as
    ranks, which is faster (tests compare both).  A space before a letter always starts a new
    piece, so a text whose spaces all stand alone is the concatenation of its space-led
    words; other texts are encoded in one go.  A worker reads the files once, not once a task.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    named = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    special = re.compile("|".join(re.escape(t.content) for t in named.get_added_tokens_decoder().values()) or r"(?!)")
    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})
    memory: dict = {}

    def ids(text: str) -> bytes:
        return np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if special.search(text):
            return np.array(named.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if _HARD_SPACES.search(text) or len(text) < 64:
            return ids(text)
        first, *rest = text.split(" ")
        out = [ids(first)]
        if len(memory) > CACHE:
            memory.clear()
        for w in rest:
            piece = memory.get(w)
            if piece is None:
                piece = memory[w] = ids(" " + w)
            out.append(piece)
        return b"".join(out)

    return encode


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
           vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the first piece of a long document may be shorter."""
    def run(batches):
        encode = load_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "t"):
                rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for k, t in zip(part.column("id").to_pylist(), part.column("t").to_pylist()):
                    ids = encode(t or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    cuts = [0] + list(range(n % length or length, n + 1, length))
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows["doc_id"].append(k)
                        rows["piece"].append(i)
                        rows["start"].append(a)
                        rows["length"].append(b - a)
                        rows["ids_crc32"].append(zlib.crc32(ids[4 * a:4 * b]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(rows["doc_id"], pa.int64()), "piece": pa.array(rows["piece"], pa.int32()),
                    **{c: pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")}})

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the genetic algorithm on one block --------------------------------------------
def best_fit(sizes: list, items, bins: list, length: int) -> list:
    """Put ``items`` one by one into the fullest bin that has room; opens new bins.  Bins: [room, items]."""
    by_room: list = [[] for _ in range(length + 1)]
    mask = 0
    for b in bins:
        by_room[b[0]].append(b)
        mask |= 1 << b[0]
    for i in items:
        s = sizes[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            b[1].append(i)
        else:
            b = [length, [i]]
            bins.append(b)
        b[0] = (b[0] if not fits else room) - s
        by_room[b[0]].append(b)
        mask |= 1 << b[0]
    return bins


def fitness(bins: list, length: int) -> float:
    """Mean squared fill; fewer and fuller bins are better."""
    return sum(((length - b[0]) / length) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: list, b: list, sizes: list, length: int, rng) -> list:
    """Inject whole well-filled bins of ``b`` into ``a``."""
    ranked = sorted(b, key=lambda x: x[0])
    good = ranked[:max(1, len(ranked) // 2)]
    count = int(rng.integers(1, max(2, len(good) // 2 + 1)))
    injected = [good[i] for i in rng.choice(len(good), size=min(count, len(good)), replace=False)]
    taken = {i for x in injected for i in x[1]}
    keep, displaced = [[x[0], list(x[1])] for x in injected], []
    for x in a:
        if taken.isdisjoint(x[1]):
            keep.append([x[0], list(x[1])])
        else:
            displaced += [i for i in x[1] if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, keep, length)


def mutate(a: list, sizes: list, length: int, rng) -> list:
    """Empty a few of the worst-filled bins and some at random, and put their documents back."""
    ranked = sorted(a, key=lambda x: -x[0])
    n = max(1, len(ranked) // 20)
    drop = {id(x) for x in ranked[:n]} | {id(ranked[i]) for i in rng.integers(0, len(ranked), n)}
    displaced = [i for x in a if id(x) in drop for i in x[1]]
    rng.shuffle(displaced)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, [[x[0], list(x[1])] for x in a if id(x) not in drop], length)


def evolve(sizes: list, elites: list, seed: int, length: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> list:
    """The best solution of one island; ``elites`` are solutions to start with."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(sizes) // length)
    pool = [[[b[0], list(b[1])] for b in e] for e in elites][:population]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    if not pool:
        pool.append(best_fit(sizes, order, [], length))
    while len(pool) < population and len(pool[0]) > bound:
        # decreasing order with noise: different, still good solutions
        noise = rng.normal(0, 0.08 * length, len(sizes))
        pool.append(best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -(sizes[i] + noise[i])), [], length))
    rate = lambda s: (-len(s), fitness(s, length))
    pool.sort(key=rate, reverse=True)
    for _ in range(generations):
        if len(pool[0]) <= bound or len(pool) < 2:
            break
        a, b = rng.choice(len(pool), 2, replace=False)
        child = crossover(pool[a], pool[b], sizes, length, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, length, rng)
        pool = sorted(pool + [child], key=rate, reverse=True)[:population]
    return pool[0]


def pack(items: DataFrame, length: int = LENGTH, block: int = BLOCK, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """``items`` (with column ``length``) plus ``sequence_id`` and ``offset``.

    A sequence id is block * 2**24 + bin; blocks are numbered from 0.
    """
    kept = saved(items.withColumn("copy", F.monotonically_increasing_id()), "pack-pieces",
                 batch=TEXT_ROWS)
    partial = kept.where(F.col("length") < length)
    count = partial.count()
    blocks = max(1, -(-count // block))
    # a random deal; the row number tells repeated rows apart
    dealt = saved(partial.select(
        (F.pmod(F.xxhash64("copy", "length", "ids_crc32"), F.lit(blocks))).alias("block"), "copy", "length"),
        "pack-blocks")
    state = None
    names = [f"e{i}" for i in range(islands)]

    def solve(epoch: int):
        def run(table: pa.Table) -> pa.Table:
            number = table.column("block")[0].as_py()
            island = table.column("island")[0].as_py()
            rows = table.select(["copy", "length"] + (names if epoch else [])).sort_by("copy")
            sizes = rows.column("length").to_pylist()
            elites = []
            for name in names if epoch else ():
                made = {}
                for i, b in enumerate(rows.column(name).to_pylist()):
                    made.setdefault(b, []).append(i)
                elites.append([[length - sum(sizes[i] for i in m), m] for m in made.values()])
            # the island's own elite last, the others' first: every island mixes differently
            elites = elites[island + 1:] + elites[:island + 1] if elites else []
            best = evolve(sizes, elites, (number * islands + island) * epochs + epoch, length)
            place, offset = [0] * len(sizes), [0] * len(sizes)
            for b, (_, members) in enumerate(best):
                at = 0
                for i in members:
                    place[i], offset[i] = b, at
                    at += sizes[i]
            n = len(sizes)
            return pa.table({"block": pa.array([number] * n, pa.int64()), "copy": rows.column("copy"),
                             "length": rows.column("length"), "island": pa.array([island] * n, pa.int32()),
                             "bin": pa.array(place, pa.int32()), "offset": pa.array(offset, pa.int64()),
                             "bins": pa.array([len(best)] * n, pa.int32())})
        return run

    schema = "block long, copy long, length long, island int, bin int, offset long, bins int"
    every = F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")
    for epoch in range(epochs):
        if epoch == 0:
            source = dealt.select("*", every)
        else:                 # migration: the elites of all islands, side by side
            source = state.groupBy("block", "copy", "length").agg(
                *[F.max(F.when(F.col("island") == i, F.col("bin"))).alias(f"e{i}") for i in range(islands)]
            ).select("*", every)
        state = saved(source.groupBy("block", "island").applyInArrow(solve(epoch), schema), f"pack-epoch{epoch}")
    best = (state.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best"))
            .select("block", F.col("best.island").alias("island")))
    placed = state.join(best, ["block", "island"]).select(
        "copy", (F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    joined = kept.join(placed, "copy", "left")
    # whole pieces are sequences of their own, numbered below zero
    return joined.select(
        *[c for c in items.columns],
        F.coalesce("sequence_id", -1 - F.col("copy")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                   vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, key, text, length, vocabulary), length)
