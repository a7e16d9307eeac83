"""Cross-tokenizer alignment by merge-path partitioning.

A document's token ends under tokenizer A and under tokenizer B are two sorted
lists of byte offsets.  Merging them walks a path of ``n_a + n_b`` steps through
the grid of both lists.  The path is cut at equally spaced diagonals; a binary
search on every diagonal (all searches run side by side) finds where the path
crosses it, so each piece knows its first A and first B token without the
pieces before it.  All pieces then walk their ``WORK`` steps independently and
emit the overlaps of A and B tokens; a piece also emits the places where both
lists end together.  Such cuts close a group; groups that start in one piece and
end in another are stitched by reading the cuts of all pieces in order.

At equal ends the path takes A first, so an A step always closes an overlap,
and a B step closes one unless the A token before it ended at the same byte
(then it is a cut).  Hence n_links = n_a + n_b - n_groups.

Tokens.  Neither tokenizer joins anything across a single space between two
characters that are not white space, so a text is encoded segment by segment
(a space and what follows), and the encodings of segments are kept in a bounded
memory.  A very long text is a batch of its own; a task's memory follows the
longest text, not the number of documents.

Counts.  Texts are tokenised and aligned once; what is written is a document's
digest and its links as 32-bit id pairs.  From that table the pairs are counted,
map side first, and then looked up document by document.  The table of counts has
at most one row per pair of vocabulary entries; up to ``BROADCAST_PAIRS`` of them
are broadcast, more are joined by a shuffle on the pair.

Edge cases: null and empty texts, and texts whose tokens do not spell a space
and the text (for example where tokenizer B normalises something), have no
tokens: zeros and ''.  Repeated rows count once each; a null id stays null; an
empty table gives no rows; extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .textnum import slices

A_FILE = "byte_bpe_50k.json"
#: Vocabulary A as ranks: the same merges, read by a faster library.
A_RANKS = "byte_bpe_50k.tiktoken"
B_FILE = "piece_bpe_32k.model"
#: Steps of the merge path that one piece walks.
WORK = 256
#: Segments kept by a task's memory, and the longest one that is kept (characters).
CACHE = 600_000
CACHED_LENGTH = 64
#: Id pairs that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 6_000_000
_PAIR = np.uint32(1 << 16)
_ANY_HARD = re.compile(r" (?:\s|\Z)|[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] |\A ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


# ---- merge path ---------------------------------------------------------------------
def diagonal_starts(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For every diagonal d the number i of A ends among the first d merge steps (A first at ties)."""
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        # the path has taken more than mid A ends exactly if a[mid] <= b[d - 1 - mid]
        more = open_.copy()
        more[open_] = a[mid[open_]] <= b[diagonals[open_] - 1 - mid[open_]]
        low = np.where(more, mid + 1, low)
        high = np.where(open_ & ~more, mid, high)


def merge_path(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple:
    """(A index, B index of every overlap; A count, B count at every common end), in path order.

    ``a`` and ``b`` hold the ends of all tokens, ascending, with the same last
    end; several documents may follow each other, every document's last ends
    being equal.
    """
    steps = len(a) + len(b)
    if not steps:
        return (np.zeros(0, np.int64),) * 4
    starts = np.arange(0, steps, work, dtype=np.int64)
    i = diagonal_starts(a, b, starts)
    j = starts - i
    pieces = len(starts)
    # sentinels: a list that is used up never wins, and nothing ended before the first token
    big = np.int64(np.iinfo(np.int64).max)
    ae = np.concatenate([a, [big]])
    be = np.concatenate([b, [big]])
    before = np.concatenate([[np.int64(-1)], a])
    li = np.empty((work, pieces), np.int64)
    lj = np.empty((work, pieces), np.int64)
    kind = np.zeros((work, pieces), np.int8)          # 1: overlap, 2: common end
    last = np.full(pieces, work, np.int64)
    last[-1] = steps - starts[-1]
    for step in range(work):
        x, y = ae[i], be[j]
        take_a = x <= y
        li[step], lj[step] = i, j
        kind[step] = np.where(take_a | (before[i] != y), 1, 2)
        i = np.minimum(i + take_a, len(a))
        j = np.minimum(j + ~take_a, len(b))
    kind[np.arange(work)[:, None] >= last[None, :]] = 0
    # piece after piece, steps in order: groups over piece borders are stitched by this order
    kind, li, lj = kind.T.ravel(), li.T.ravel(), lj.T.ravel()
    overlap, cut = kind == 1, kind == 2
    return li[overlap], lj[overlap], li[cut], lj[cut] + 1


# ---- tokens ---------------------------------------------------------------------------
class _Flat:
    """Ragged rows of numbers in growing arrays."""

    def __init__(self):
        self.rows, self.used = 0, 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.uint16)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start, self.count = (_room(x, self.rows + len(counts)) for x in (self.start, self.count))
        self.ids = _room(self.ids, self.used + len(ids))
        to = self.rows + len(counts)
        self.ids[self.used:self.used + len(ids)] = ids
        self.count[self.rows:to] = counts
        self.start[self.rows:to] = self.used + np.cumsum(counts) - counts
        self.rows, self.used = to, self.used + len(ids)


def _room(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)])


class Tokens:
    """Both tokenizers behind one memory of segments.

    Segments are encoded for A by the ranks of its vocabulary, which take a special token's
    string as plain text; tests compare them with the tokenizer file itself.
    """

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE, a_ranks: str | None = A_RANKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(public_tokenizers.path(a_file))
        self.a.encode_special_tokens = True
        self.ranks = None
        if a_ranks and a_file == A_FILE:
            with open(public_tokenizers.path(a_ranks), "rb") as f:
                ranks = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        self.a_bytes = _byte_level(self.a)
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("an id pair has 32 bits: at most 65,536 entries a vocabulary")
        self.length = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        # whether a piece joins something to a space that follows it
        self.joins = any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.b_bytes)
        self.reset()

    def reset(self) -> None:
        self.known: dict = {}
        self.good = np.zeros(1 << 12, dtype=bool)
        self.flat_a, self.flat_b = _Flat(), _Flat()

    def segments(self, text: str) -> list:
        """The text in segments; all but the first had one space before them."""
        if self.joins:
            return [text]
        return _LONE_SPACE.split(text) if _ANY_HARD.search(text) else text.split(" ")

    def learn(self, fresh: list) -> None:
        """Encode segments (without their space) and keep ids and byte lengths."""
        if self.ranks:
            in_a = [self.ranks.encode_ordinary(" " + s) for s in fresh]
        else:
            in_a = [x.ids for x in self.a.encode_batch_fast([" " + s for s in fresh], add_special_tokens=False)]
        in_b = self.b.encode(fresh, num_threads=1)
        first = self.flat_a.rows
        good = np.ones(len(fresh), dtype=bool)
        for flat, spelt, rows in ((self.flat_a, self.a_bytes, in_a), (self.flat_b, self.b_bytes, in_b)):
            ids = list(chain.from_iterable(rows))
            flat.add(np.array(ids, np.uint16), np.fromiter(map(len, rows), np.int64, len(rows)))
            if b"".join([spelt[i] for i in ids]) != (" " + " ".join(fresh)).encode():
                good &= [b"".join([spelt[i] for i in x]) == (" " + s).encode() for x, s in zip(rows, fresh)]
        self.good = _room(self.good, first + len(fresh))
        self.good[first:first + len(fresh)] = good
        self.known.update(zip(fresh, range(first, first + len(fresh))))

    def encode(self, texts: list) -> tuple:
        """Tokens of all texts: per side (ids, ends, tokens per text); texts that fail have none.

        The ends run on from text to text.
        """
        if len(self.known) > CACHE or self.flat_a.used > 16 * CACHE:
            self.reset()
        every, number = [], []
        for t in texts:
            part = self.segments(t) if t else []
            every += part
            number.append(len(part))
        found = list(map(self.known.get, every))
        if None in found:
            fresh = list(dict.fromkeys(s for s, i in zip(every, found) if i is None))
            self.learn(fresh)
            found = list(map(self.known.get, every))
            for s in fresh:                  # long ones are not kept; their numbers stay valid until the next reset
                if len(s) > CACHED_LENGTH:
                    del self.known[s]
        at = np.array(found, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), number)
        fails = np.zeros(len(texts), bool)
        fails[owner[~self.good[at]]] = True
        if fails.any():
            use = ~fails[owner]
            at, owner = at[use], owner[use]
        out = []
        for flat, length in zip((self.flat_a, self.flat_b), self.length):
            start, count = flat.start[at], flat.count[at]
            stop = np.cumsum(count)
            ids = flat.ids[np.repeat(start - (stop - count), count) + np.arange(int(count.sum()))]
            out.append((ids, np.cumsum(length[ids]),
                        np.bincount(owner, count, minlength=len(texts)).astype(np.int64)))
        return tuple(out)


@lru_cache(1)
def shared_tokens(a_file: str = A_FILE, b_file: str = B_FILE) -> Tokens:
    """The tokenizers of a worker process; its memory of segments serves task after task."""
    return Tokens(a_file, b_file)


def _byte_level(tokenizer) -> list:
    """Bytes of every entry: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain}
    of.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))})
    entries = tokenizer.get_vocab()
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return out


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8", "surrogatepass")


def align(texts: list, tokens: Tokens, work: int = WORK) -> dict:
    """Tokens, overlaps and groups of several texts.

    ``a``, ``b``: ids; ``n_a`` ... ``n_links``: numbers per text; ``pair``: the id
    pair of every overlap; ``link_of``: its text; ``cut_a``, ``cut_b``: tokens up to
    every group's end.
    """
    (a, ends_a, n_a), (b, ends_b, n_b) = tokens.encode(texts)
    i, j, cut_a, cut_b = merge_path(ends_a, ends_b, work)
    stop_a = np.cumsum(n_a)
    # a group belongs to the text of its last A token
    owner = np.searchsorted(stop_a, cut_a - 1, side="right")
    n_groups = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    return {"a": a, "b": b, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups,
            "pair": a[i].astype(np.uint32) * _PAIR + b[j], "cut_a": cut_a, "cut_b": cut_b}


def group_texts(found: dict) -> list:
    """``a1,a2|b1;a3|b2,b3`` of every text, as bytes; b'' without tokens."""
    a, b, cut_a, cut_b = (found[k] for k in ("a", "b", "cut_a", "cut_b"))
    total = len(a) + len(b)
    if not total:
        return [b""] * len(found["n_a"])
    first_a, first_b = np.concatenate([[0], cut_a[:-1]]), np.concatenate([[0], cut_b[:-1]])
    in_a, in_b = cut_a - first_a, cut_b - first_b
    ids = np.empty(total, np.int64)
    ids[np.arange(len(a)) + np.repeat(first_b, in_a)] = a
    ids[np.arange(len(b)) + np.repeat(cut_a, in_b)] = b
    mark = np.full(total, ord(","), np.uint8)
    mark[cut_a + first_b - 1] = ord("|")
    mark[cut_a + cut_b - 1] = ord(";")
    top = int(ids.max()) + 1
    digits = np.array([str(x).encode() for x in range(top)], dtype=f"S{len(str(top))}")
    wide = digits.view(np.uint8).reshape(top, -1)
    chars = np.concatenate([wide[ids], mark[:, None]], axis=1)
    shown = chars != 0
    length = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
    flat = chars[shown].tobytes()
    stop = np.cumsum(found["n_a"] + found["n_b"])
    begin = stop - found["n_a"] - found["n_b"]
    return [flat[length[x]:length[y] - 1] if y > x else b"" for x, y in zip(begin.tolist(), stop.tolist())]


# ---- jobs -----------------------------------------------------------------------------
def linked(docs: DataFrame, text: str = "text", keep: list | None = None, a_file: str = A_FILE,
           b_file: str = B_FILE, work: int = WORK) -> DataFrame:
    """One row per document, written once: row, k0, k1, ... (``keep``), n_a, n_b, n_groups, n_links,
    groups_sha256 and links, the 32-bit id pairs of all overlaps."""
    inner = [f"k{i}" for i in range(len(keep or []))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep or [], inner)], F.col(text).alias("t"))

    def run(batches):
        tokens = shared_tokens(a_file, b_file)
        for batch in batches:
            for part in slices(batch, "t"):
                found = align(part.column("t").to_pylist(), tokens, work)
                shown = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(found)]
                stop = np.cumsum(found["n_links"]).tolist()
                raw = found["pair"].astype("<u4")
                cols = {**{k: part.column(k) for k in inner}, **{k: pa.array(found[k]) for k in _COUNTS},
                        "groups_sha256": pa.array(shown, pa.string()),
                        "links": pa.array([raw[x:y].tobytes() for x, y in zip([0, *stop], stop)], pa.binary())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    front = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(inner, rows.schema))
    made = rows.mapInArrow(run, front + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, links binary")
    # numbered where they are written, so that the numbers stay
    return saved(made.withColumn("row", F.monotonically_increasing_id()), "align-links", codec="zstd")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): links that hold the id pair; whether no pair of its B id has more."""
    def run(batches):
        held, size = [], 0

        def total():
            pair = np.concatenate([p for p, _ in held])
            order = np.argsort(pair, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(pair[order]) != 0]))
            return pair[order][at], np.add.reduceat(np.concatenate([c for _, c in held])[order], at)

        def rows(pair, count):
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(count)],
                                              names=["pair", "count"])

        for batch in batches:
            for part in slices(batch, "links"):
                found = np.frombuffer(b"".join(part.column("links").to_pylist()), "<u4")
                if not len(found):
                    continue
                held.append(np.unique(found, return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [total()]
                    if len(held[0][0]) > 2_000_000:      # memory is bounded: hand over and go on
                        yield rows(*held[0])
                        held = []
                    size = sum(len(p) for p, _ in held)
        if held:
            yield rows(*total())

    counted = (links.select("links").mapInArrow(run, "pair long, count long")
               .groupBy("pair").agg(F.sum("count").alias("count")))
    counted = saved(counted, "align-pairs")
    by_b = F.pmod(F.col("pair"), F.lit(int(_PAIR)))
    most = counted.groupBy(by_b.alias("b")).agg(F.max("count").alias("most"))
    return saved(counted.join(most, by_b == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-best")


def score(links: DataFrame, counts: DataFrame, keep: list | None = None,
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: ``keep`` columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    inner = [f"k{i}" for i in range(len(keep or []))]
    plain = inner + list(_COUNTS) + ["groups_sha256"]
    types = dict(links.dtypes)
    if counts.count() <= broadcast_pairs:
        # whole table within the bound: sorted arrays, 12 bytes a pair
        got = counts.orderBy("pair").select("pair", (F.col("count") * 2 + F.col("best").cast("long")).alias("v")).toArrow()
        sent = links.sparkSession.sparkContext.broadcast(
            (got.column("pair").to_numpy().astype(np.uint32), got.column("v").to_numpy()))

        def run(batches):
            pair, value = sent.value
            for batch in batches:
                for part in slices(batch, "links"):
                    found = np.frombuffer(b"".join(part.column("links").to_pylist()), "<u4")
                    n = part.column("n_links").to_numpy()
                    own, back = np.unique(found, return_inverse=True)
                    v = value[np.searchsorted(pair, own)][back] if len(own) else np.zeros(0, np.int64)
                    stop = np.cumsum(n)
                    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (v & 1, v >> 1)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(c) for c in plain] + [pa.array(s[stop] - s[stop - n]) for s in sums],
                        names=plain + ["n_best", "count_sum"])

        out = links.select(*plain, "links").mapInArrow(
            run, ", ".join(f"{c} {types[c]}" for c in plain) + ", n_best long, count_sum long")
    else:
        def pairs(batches):
            for batch in batches:
                for row, raw in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist()):
                    p, c = np.unique(np.frombuffer(raw, "<u4"), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(p), pa.int64()), pa.array(p.astype(np.int64)), pa.array(c)],
                        names=["row", "pair", "n"])

        spread = links.select("row", "links").mapInArrow(pairs, "row long, pair long, n long")
        sums = spread.join(counts, "pair").groupBy("row").agg(
            F.sum(F.col("n") * F.col("best").cast("long")).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum"))
        out = links.drop("links").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, keep or [])], "n_a", "n_b", "n_groups", "n_links",
                      "n_best", "count_sum", "groups_sha256")


def alignments(docs: DataFrame, text: str = "text", keep: list | None = None, a_file: str = A_FILE,
               b_file: str = B_FILE, work: int = WORK, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Align all texts and score their links: see ``score``."""
    links = linked(docs, text, keep, a_file, b_file, work)
    return score(links, pair_counts(links), keep, broadcast_pairs)
