"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct five-word shingles.  Sets with equal shingles
are one class, named by a 64-bit key of the set; a task signs a class once,
however many copies it reads, so a large group of copies adds one entry per task.

Signatures.  A pair with Jaccard similarity of at least g has a symmetric
difference of at most (|a| + |b|) (1 - g) / (1 + g).  Sizes are cut into bands
that double; a band's *instance* serves the pairs whose larger set lies in it,
so a set signs for its own band and, if a partner may be that large, for the
next one.  An instance splits the shingle domain into ``n1`` first-level
partitions (by the leading hash bits), each into ``n2`` second-level ones.  If
at most k elements differ and k < q (k2 + 1), then among any q first-level
partitions one has at most k2 second-level partitions that differ, and the
hash of its elements in the n2 - k2 others is a signature that both sets emit.
A set emits the subsets of its first partitions, up to the q-th one that has
elements in more than k2 second-level partitions (the shared projection is then
never empty); of two linked sets the one that stops first decides.  A set with
fewer such partitions emits all it has, and the single shingles too, so that
two of these sets meet as well.  No linked pair is lost.

Level one (n2 = 1, k2 = 0) signs every class.  Signatures held by more
than ``max_group`` sets are not expanded into pairs: their sets are compared
with the group's first set only, its centre.  Groups with one centre are one
group, so they cost a row for each set that a centre has, not for each signature.
Groups that are not yet all in one component are signed again on the next level.
Every linked pair of such a group lies in this smaller input, so a level is complete for it.  Level two signs by
rare shingles: of two sets with a Jaccard similarity of g, ordered alike, both
hold a common element among their first |a| - ceil(g |a|) + 1, so with the rare
ones first a passage that many texts share brings only those together that consist
of it.  The order comes from a fixed table of counts of hashed shingles; any order is
complete.  The levels after it are PartEnum's with longer projections.  What the last
level leaves is compared in full, block against block inside tasks: groups that
overlap are merged where that makes fewer pairs, intersections are counted by matrix
products of the sets, and a task hands over only links that join two components.

Candidate pairs pass two lower bounds of the symmetric difference (counts of
elements in cells, first few cells, then many), which never reject a linked
pair, and are then verified on the shingle sets themselves (64-bit hashes).
Links are closed into components by repeated minimum labels.

Edge cases: null or empty text and texts without words have the empty set and
are linked with nothing; fewer than five words make one shingle; a null id
keeps a row with a null component; rows with the same id are one document whose
sets all count; an empty table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, freed, saved, text_batches
from .textnum import mixed, shingle_hashes, slices, utf8, word_hashes, word_spans

THRESHOLD = (75, 100)
NGRAM = 5
MAX_GROUP = 32
#: Texts of a block in the full comparison of groups that the last level leaves.
BLOCK = 512
_HELD_PAIRS = 1_000_000
#: Columns of a matrix of a block's sets.
_COLUMNS = 4_096
#: (n2, k2) of the levels: longer projections, more subsets.
LEVELS = ((1, 0), (4, 1), (6, 2))
#: Cells of the table of counts that orders shingles by rarity.
RARITY = 1 << 18
DOCS_PER_BUCKET = 2_000
#: Signatures that a task holds before it hands them over (16 bytes each).
_HELD_SIGNATURES = 1 << 20
#: Pairs whose sketches a task unfolds at once.
_HELD_SKETCHES = 500
#: Cells of the count sketch; the sum of cell differences never exceeds the symmetric difference.
SKETCH = 128
#: Cells of the fine sketch of a set: about its size, within these powers of two.
FINE = (7, 13)
#: Largest count of a cell of a packed fine sketch: four cells a byte.
PACKED = 3
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Links that the driver closes into components by itself (16 bytes each); more take rounds of joins.
DRIVER_LINKS = 200_000
#: Pairs whose ids need not be made distinct before they are broadcast.
_FEW_PAIRS = 50_000
#: Cells of the table of counts that travel as one row.
_RARITY_CELLS = 1_024


def shingle_sets(column: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes text by text, offsets)."""
    raw, offsets = utf8(column)
    starts, ends, first = word_spans(raw, offsets)
    h, made = shingle_hashes(word_hashes(raw, starts, ends, lower=True), first, n)
    cuts = np.concatenate([[0], np.cumsum(made)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[cuts[:-1][made > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[cuts]


def _set_sums(h: np.ndarray, cuts: np.ndarray) -> list:
    """Two 64-bit keys of every set: order-free sums of differently mixed hashes."""
    return [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])[cuts])
            .astype(np.uint64).view(np.int64) for x in (mixed(h), mixed(h ^ np.uint64(0x5851F42D4C957F2D)))]


def _sketches(h: np.ndarray, cuts: np.ndarray) -> tuple[list, list]:
    """Numbers of elements (at most 255) in ``SKETCH`` cells and in about as many cells as elements."""
    sizes = np.diff(cuts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = mixed(h + np.uint64(41))
    coarse = np.minimum(np.bincount(
        owner * SKETCH + (cell % np.uint64(SKETCH)).astype(np.int64), minlength=len(sizes) * SKETCH),
        255).astype(np.uint8).reshape(-1, SKETCH)
    width = np.int64(1) << np.clip(np.frexp(np.maximum(sizes, 1))[1], *FINE).astype(np.int64)
    begin = np.cumsum(width) - width
    at = begin[owner] + (cell % width[owner].astype(np.uint64)).astype(np.int64)
    fine = np.minimum(np.bincount(at, minlength=int(width.sum())), 255).astype(np.uint8)
    return ([c.tobytes() for c in coarse],
            [fine[x:y].tobytes() for x, y in zip(begin.tolist(), (begin + width).tolist())])


def pack_cells(cells: bytes) -> bytes:
    """Counts of at most ``PACKED``, four to a byte; larger ones are cut, which keeps a lower bound of differences."""
    c = np.minimum(np.frombuffer(cells, np.uint8), PACKED).reshape(-1, 4)
    return (c << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def unpacked_cells(packed: np.ndarray) -> np.ndarray:
    """The counts of rows of packed cells."""
    return (packed[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(packed), -1)


def set_keys(docs: DataFrame, key: str, text: str, n: int, packed: bool = False) -> DataFrame:
    """(id, n_shingles, k1, k2, sketch, fine): equal sets have equal keys and sketches.

    ``packed``: the fine sketch, named ``packed``, has two bits a cell.
    """
    name = "packed" if packed else "fine"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                h, cuts = shingle_sets(part.column("t"), n)
                coarse, fine = _sketches(h, cuts)
                fine = [pack_cells(x) for x in fine] if packed else fine
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(cuts)), *map(pa.array, _set_sums(h, cuts)),
                     pa.array(coarse, pa.binary()), pa.array(fine, pa.binary())],
                    names=["id", "n_shingles", "k1", "k2", "sketch", name])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"id long, n_shingles long, k1 long, k2 long, sketch binary, {name} binary")


def signatures(h: np.ndarray, cuts: np.ndarray, level: tuple, threshold=THRESHOLD) -> tuple:
    """(signature hashes, index of the set) of all sets of a slice, for one level."""
    n2, k2 = level
    num, den = threshold
    sizes = np.diff(cuts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out_s, out_d = [], []
    band = np.frexp(np.maximum(sizes, 1))[1]              # sizes in [2^(band-1), 2^band)
    largest = sizes * den // num                          # of any partner
    for step in (0, 1):
        inst = band + step
        top = (np.int64(1) << inst.astype(np.int64)) - 1
        use = (sizes > 0) if step == 0 else (sizes > 0) & (largest > (top >> 1))
        if not use.any():
            continue
        differ = (sizes + np.minimum(largest, top)) * (den - num) // (den + num)
        need = differ // (k2 + 1) + 1
        n1 = (0.34 * top).astype(np.int64) // (k2 + 1) + 4
        el = use[owner]
        hh, oo = h[el], owner[el]
        p1 = ((hh >> np.uint64(32)) * n1[oo].astype(np.uint64)) >> np.uint64(32)
        inner = mixed(hh + np.uint64(0x2545F4914F6CDD1D))
        p2 = inner % np.uint64(n2) if n2 > 1 else None
        begins = np.ones(len(hh), dtype=bool)
        begins[1:] = (oo[1:] != oo[:-1]) | (p1[1:] != p1[:-1])
        at = np.flatnonzero(begins)
        run_owner, run_p = oo[at], p1[at]
        value = mixed(inner)
        if n2 > 1:
            cell = np.stack([np.add.reduceat(np.where(p2 == j, value, np.uint64(0)), at)
                             for j in range(n2)])
            has = np.stack([np.logical_or.reduceat(p2 == j, at) for j in range(n2)])
        else:
            cell, has = np.add.reduceat(value, at)[None], np.ones((1, len(at)), dtype=bool)
        good = has.sum(axis=0) > k2
        # number of qualifying partitions of the set before this one
        ahead = np.cumsum(good) - good
        first_run = np.searchsorted(run_owner, np.arange(len(sizes)))
        base = np.append(ahead, good.sum())[first_run]
        emit = (ahead - base[run_owner]) < need[run_owner]
        total = np.bincount(run_owner, good, minlength=len(sizes))
        seed = mixed(inst.astype(np.uint64) * np.uint64(1000003) + np.uint64(17 * n2 + k2))
        for subset in combinations(range(n2), n2 - k2):
            some = emit & has[list(subset)].any(axis=0)
            code = np.uint64(sum(1 << j for j in subset) + 1)
            s = mixed(sum((mixed(cell[j] + np.uint64(j + 1)) for j in subset), np.uint64(0))
                      + mixed(run_p + seed[run_owner] + code))
            out_s.append(s[some])
            out_d.append(run_owner[some])
        short = use & (total < need)
        if short.any():
            el = short[owner]
            out_s.append(mixed(h[el] + seed[owner[el]] + np.uint64(99)))
            out_d.append(owner[el])
    if not out_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_s), np.concatenate(out_d)


def rarity(texts: DataFrame, n: int, cells: int = RARITY) -> np.ndarray:
    """Numbers of shingles of all texts in ``cells`` cells of a hash; tasks hand over runs of cells, not cells."""
    spark = texts.sparkSession

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch, "t"):
                total += np.bincount(_cells(shingle_sets(part.column("t"), n)[0], cells), minlength=cells)
        parts = [(i, total[i:i + _RARITY_CELLS].tobytes()) for i in range(0, cells, _RARITY_CELLS)
                 if total[i:i + _RARITY_CELLS].any()]
        at, held = zip(*parts) if parts else ((), ())
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(held, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
        return pa.table({"at": pa.array([table.column("at")[0].as_py()], pa.int32()),
                         "n": pa.array([total.tobytes()], pa.binary())})

    with freed(spark), text_batches(spark):
        found = (texts.select("t").mapInArrow(run, "at int, n binary").groupBy("at")
                 .applyInArrow(summed, "at int, n binary").toArrow())
    counts = np.zeros(cells, np.int64)
    for at, held in zip(found.column("at").to_pylist(), found.column("n").to_pylist()):
        counts[at:at + len(held) // 8] = np.frombuffer(held, np.int64)
    return counts


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(h + np.uint64(77)) % np.uint64(cells)).astype(np.int64)


def rare_elements(h: np.ndarray, cuts: np.ndarray, counts: np.ndarray, threshold=THRESHOLD) -> tuple:
    """(element, index of the set): of every set the first elements, by count, of which two linked sets share one."""
    num, den = threshold
    sizes = np.diff(cuts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, counts[_cells(h, len(counts))], owner))
    place = np.arange(len(h)) - cuts[:-1][owner]
    first = order[place < (sizes + (-sizes * num) // den + 1)[owner]]
    return h[first], owner[first]


def _signature_blocks(texts: DataFrame, level: tuple | None, buckets: int, n: int, threshold) -> DataFrame:
    """(bucket, sigs, ids): per task batch and bucket, 32-bit signatures and the codes of their classes.

    A code is the low half of a class key; classes that share one are paired apart.  Without a
    level the signatures are the rare elements.
    """
    counts = None if level else texts.sparkSession.sparkContext.broadcast(rarity(texts, n))

    def signed(h: np.ndarray, cuts: np.ndarray) -> tuple:
        if level:
            return signatures(h, cuts, level, threshold)
        s, d = rare_elements(h, cuts, counts.value, threshold)
        return mixed(s + np.uint64(1234567)), d

    def blocks(found: list, names: list) -> pa.RecordBatch:
        s, d = (np.concatenate(x) for x in zip(*found))
        ids = np.concatenate(names).view(np.uint64).astype("<u4")
        b = (s >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(b, kind="stable")
        s, d, b = s[order].astype("<u4"), d[order], b[order]
        at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
        rows = {"bucket": [], "sigs": [], "ids": []}
        for x, y in zip(at, np.append(at[1:], len(b)) if len(b) else []):
            rows["bucket"].append(int(b[x]))
            rows["sigs"].append(s[x:y].tobytes())
            rows["ids"].append(ids[d[x:y]].tobytes())
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(rows["bucket"], pa.int32()), "sigs": pa.array(rows["sigs"], pa.binary()),
            "ids": pa.array(rows["ids"], pa.binary())})

    def run(batches):
        found, names, base, held = [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "t"):
                h, cuts = shingle_sets(part.column("t"), n)
                name = _set_sums(h, cuts)[0]
                # a class that the held slices have is signed once
                once = np.zeros(part.num_rows, dtype=bool)
                once[np.unique(name, return_index=True)[1]] = True
                for before in names:
                    once &= ~np.isin(name, before)
                names.append(name)
                sizes = np.diff(cuts)
                keep = np.repeat(once, sizes)
                s, d = signed(h[keep], np.concatenate([[0], np.cumsum(np.where(once, sizes, 0))]))
                found.append((s, d + base))
                base, held = base + part.num_rows, held + len(s)
                if held > _HELD_SIGNATURES or len(names) > 64:
                    yield blocks(found, names)
                    found, names, base, held = [], [], 0, 0
        if found:
            yield blocks(found, names)

    return texts.mapInArrow(run, "bucket int, sigs binary, ids binary")


def _candidates(blocks: DataFrame, max_group: int) -> DataFrame:
    """(a, b, star): pairs of codes a < b that share a signature; big groups give pairs with their first code.

    ``star``: ``a`` is the first code of a big group that has ``b``.
    """
    def run(table: pa.Table) -> pa.Table:
        s, d = (np.concatenate([np.frombuffer(x, "<u4") for x in table.column(c).to_pylist()])
                for c in ("sigs", "ids"))
        both = np.unique(s.astype(np.uint64) << np.uint64(32) | d)
        s, d = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        known, place = np.unique(d, return_inverse=True)
        held, waiting = [], 0
        for m in np.unique(size[(size > 1) & (size <= max_group)]).tolist():
            i, j = np.triu_indices(m, 1)
            at = start[size == m]
            step = max(1, _HELD_PAIRS // len(i))
            for k in range(0, len(at), step):
                some = at[k:k + step, None]
                # a pair is one number; members are in the order of their ids
                held.append((place[some + i] * np.int64(len(known)) + place[some + j]).ravel())
                waiting += held[-1].size
                if waiting > _HELD_PAIRS:
                    held, waiting = [np.unique(np.concatenate(held))], 0
        pair = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        # the members of big groups but the first; groups with one centre share their rows
        first = np.repeat(start, size)
        member = np.flatnonzero(np.repeat(size > max_group, size) & (np.arange(len(s)) != first))
        big = np.unique(place[first[member]] * np.int64(len(known)) + place[member])
        both = np.concatenate([pair, big])
        return pa.table({"a": pa.array(known[both // len(known)]), "b": pa.array(known[both % len(known)]),
                         "star": pa.array(np.arange(len(both)) >= len(pair))})

    return blocks.groupBy("bucket").applyInArrow(run, "a long, b long, star boolean")


def _sided(pairs: DataFrame, reps: DataFrame, key: str, column: str, threshold) -> DataFrame:
    """``pairs`` (a, b, star) of some key of ``reps`` as pairs of ids, with sizes and sketches of both.

    ``compare``: the sizes allow the similarity and the classes lie in different components.
    """
    num, den = threshold
    named = pairs.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "star")
    for x in "ab":
        named = named.join(reps.select(
            F.col(key).alias(f"k{x}"), F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"),
            F.col("component").alias(f"c{x}"), F.col(column).alias(f"s{x}")), f"k{x}")
    return (named.withColumn("compare", (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
                             & (F.col("ca") != F.col("cb")))
            .where("compare or star").select("a", "b", "star", "compare", "na", "nb", "sa", "sb"))


def _possible(sized: DataFrame, column: str, threshold) -> DataFrame:
    """(a, b, star, compare): pairs whose sketches allow the similarity, and stars, which need not be compared.

    What goes has a larger symmetric difference.
    """
    num, den = threshold

    def run(batches):
        for batch in batches:
            # sketches of the same widths side by side; the wider one is folded
            most, per = (PACKED, 4) if column == "packed" else (255, 1)
            widths = [pc.binary_length(batch.column(c)).to_numpy() for c in ("sa", "sb")]
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            meant, star = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("compare", "star"))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for wide in {(int(x), int(y)) for x, y in zip(*widths)}:
                rows = np.flatnonzero(meant & (widths[0] == wide[0]) & (widths[1] == wide[1]))
                for some in np.array_split(rows, len(rows) // _HELD_SKETCHES + 1):
                    cells = [np.frombuffer(b"".join(batch.column(c).take(pa.array(some)).to_pylist()), np.uint8)
                             .reshape(len(some), -1) for c in ("sa", "sb")]
                    cells = [c if per == 1 else unpacked_cells(c) for c in cells]
                    # a cell holds at most ``most``, so only sums below that are exact
                    cells = [np.minimum(c.reshape(len(some), -1, min(wide) * per).sum(axis=1, dtype=np.int32), most)
                             for c in cells]
                    least = np.abs(cells[0] - cells[1]).sum(axis=1)
                    keep[some] = least * (num + den) <= both[some] * (den - num)
            kept = pa.array(keep | star)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).filter(kept) for c in ("a", "b", "star")), pa.array(keep).filter(kept)],
                names=["a", "b", "star", "compare"])

    return sized.mapInArrow(run, "a long, b long, star boolean, compare boolean")


def _pick(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids: broadcast up to ``BROADCAST_IDS`` of them, a shuffle join beyond."""
    return texts.join(_few(ids), "id", "left_semi")


def _few(ids: DataFrame) -> DataFrame:
    """Ids for a join: broadcast up to ``BROADCAST_IDS`` of them."""
    with freed(ids.sparkSession):
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _ends(pairs: DataFrame) -> DataFrame:
    """(id): the ids of the pairs, made distinct where they are many."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    with freed(pairs.sparkSession):
        few = pairs.count() <= _FEW_PAIRS
    return ids if few else saved(ids.distinct(), "join-ids")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, threshold) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; fine sketches travel for classes of the pairs alone."""
    num, den = threshold
    fine = "packed" if "packed" in reps.columns else "fine"
    some = _pick(reps.select("id", "n_shingles", F.col("id").alias("component"), fine), _ends(pairs))
    pairs = saved(_possible(_sided(pairs.select("a", "b", F.lit(False).alias("star")), some, "id", fine, threshold),
                            fine, threshold).select("a", "b"), "join-likely", batch=TEXT_ROWS)
    few = saved(_pick(texts, _ends(pairs)).dropDuplicates(["id", "t"]), "join-texts", batch=TEXT_ROWS)
    left = few.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.xxhash64("t").alias("ha"))
    right = few.select(F.col("id").alias("b"), F.col("t").alias("tb"))

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            done, held = 0, (None, None)
            for part in slices(batch, "tb"):
                h, cuts = shingle_sets(part.column("tb"), n)
                # an id may have several texts
                names = list(zip(part.column("a").to_pylist(), part.column("ha").to_pylist()))
                texts_a = part.column("ta")
                for i in range(part.num_rows):
                    if held[0] != names[i]:
                        held = (names[i], shingle_sets(texts_a.slice(i, 1), n)[0])
                    x, y = held[1], h[cuts[i]:cuts[i + 1]]
                    if not len(x) or not len(y):
                        continue
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    same = int((x[at] == y).sum())
                    keep[done + i] = den * same >= num * (len(x) + len(y) - same)
                done += part.num_rows
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(kept) for c in "ab"], names=["a", "b"])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "ha", "tb")
    return joined.mapInArrow(run, "a long, b long")


def _one_code(reps: DataFrame) -> DataFrame:
    """(a, b): classes whose keys have one code, which no group of signatures tells apart."""
    coded = {x: reps.select(_code().alias("code"), F.col("id").alias(x)) for x in "ab"}
    return coded["a"].join(coded["b"], "code").where("a < b").select("a", "b")


def _code() -> Column:
    return F.col("k1").bitwiseAND(F.lit(0xFFFFFFFF))


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component): smallest id reachable, for every id that has a link (pairs a, b).

    Large-star and small-star rounds: every vertex hangs its larger neighbours
    on its smallest one, until nothing moves; a handful of rounds suffices.  The driver
    does this for up to ``DRIVER_LINKS`` links, which need no rounds of joins.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), f"{name}-edges")
    with freed(edges.sparkSession):
        if edges.count() <= DRIVER_LINKS:
            found = edges.toArrow()
            return saved(edges.sparkSession.createDataFrame(pa.table(dict(zip(("id", "component"), smallest_reachable(
                found.column("u").to_numpy(), found.column("v").to_numpy())))), "id long, component long"),
                f"{name}-labels")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(
            "u", F.least("low", "u").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).where("u <> v").distinct())
        edges = saved(small, f"{name}-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable) over the links (u, v), for the ids that reach a smaller one."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[:len(u)], place[len(u):]
    label = np.arange(len(ids))
    while (label[u] != label[v]).any():
        x, y = label[u], label[v]
        for root in (x, y):
            np.minimum.at(label, root, np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after more ``links``; only the components that they join are closed again."""
    ends = links.select("a", "b")
    for x in "ab":
        ends = ends.join(labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    across = saved(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b"),
                   "join-across")
    with freed(links.sparkSession):
        if not across.count():
            return labels
    moved = components(across)
    with freed(links.sparkSession):
        few = moved.count() <= BROADCAST_IDS
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("low"))
    # a component's smallest id has no label, and neither has an id without links
    return saved(labels.join(F.broadcast(to) if few else to, "component", "left")
                 .select("id", F.coalesce("low", "component").alias("component")).union(moved), "join-labels")


def _shared_ids(keys: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): the smallest and every other class of an id with several sets."""
    own = F.struct("k1", "k2", "n_shingles")
    several = (keys.where("n_shingles > 0 and id is not null").groupBy("id")
               .agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x <> y").select("id"))
    named = (keys.join(several, "id").select(F.col("id").alias("of"), "k1", "k2", "n_shingles")
             .join(reps.select("k1", "k2", "n_shingles", "id"), ["k1", "k2", "n_shingles"]))
    least = named.groupBy("of").agg(F.min("id").alias("a"))
    return named.join(least, "of").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM,
         threshold=THRESHOLD, max_group: int = MAX_GROUP, block: int = BLOCK) -> DataFrame:
    """(key, n_shingles, class_id, component_id), one row per row of ``docs``."""
    spark = docs.sparkSession
    keys = saved(set_keys(docs, key, text, n, packed=True), "join-keys", batch=TEXT_ROWS)
    classes = (keys.where("n_shingles > 0 and id is not null").groupBy("k1", "k2", "n_shingles")
               .agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("packed").alias("packed")))
    reps = saved(classes, "join-reps")
    texts = (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
             .where(F.col("t").isNotNull() & F.col("id").isNotNull()))
    links, labels, todo = saved(_shared_ids(keys, reps), "join-links"), None, None
    with freed(spark):
        total = reps.count()
    levels = [LEVELS[0], None, *LEVELS[1:]]              # None: by rare elements
    for depth, level in enumerate(levels):
        with freed(spark):
            count = todo.count() if depth else total
        if not count:
            break
        # signatures of a set, against those of level one
        weight = comb(*level) // (level[1] + 1) if level else 1
        # a pair comes once from every bucket, so they follow the size alone
        buckets = max(spark.sparkContext.defaultParallelism, count * weight // DOCS_PER_BUCKET)
        some, source = reps, texts
        many = 4 * count >= total
        # where most classes are left and their ids are no broadcast, all are signed, and no texts are shuffled or copied
        if depth and not (many and count > BROADCAST_IDS):
            some, source = _pick(reps, todo), _pick(texts, todo)
            source = source if many else saved(source, "join-texts", batch=TEXT_ROWS)
        # pairs inside one component tell nothing new
        some = (some.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")) if depth
                else some.withColumn("component", F.col("id")))
        found = saved(_candidates(_signature_blocks(source, level, buckets, n, threshold), max_group),
                      "join-candidates", batch=TEXT_ROWS)
        pairs = found.groupBy("a", "b").agg(F.max("star").alias("star"))
        near = saved(_possible(_sided(pairs, some.withColumn("code", _code()), "code", "sketch", threshold),
                               "sketch", threshold), "join-possible")
        pairs = near.where("compare").select("a", "b")
        if not depth:
            pairs = pairs.union(_one_code(reps))
            pairs = saved(pairs, "join-pairs")
        good = saved(_verified(pairs, reps, texts, n, threshold), "join-links", batch=TEXT_ROWS)
        labels = _relabelled(labels, good) if depth else components(links.union(good))
        # classes of the big groups that are not yet in one component
        rest = _unsettled(near.where("star").select("a", "b"), labels)
        if depth == len(levels) - 1:
            labels = _relabelled(labels, saved(_block_links(rest, texts, n, threshold, block), "join-links"))
        else:
            todo = saved(rest.select("id").distinct(), "join-todo")
    if labels is None:
        labels = spark.createDataFrame([], "id long, component long")
    in_class = reps.join(labels, "id", "left").select(
        "k1", "k2", "n_shingles", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    return keys.drop("sketch", "packed").join(in_class, ["k1", "k2", "n_shingles"], "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document, the smallest id, of every component; equal rows count once.

    Rows with a null id are not compared and stay.
    """
    joined = saved(join(docs.select(key, text), key, text, **options).select(key, "component_id"), "join-labels")
    gone = saved(joined.where(F.col(key) != F.col("component_id")).select(key).distinct(), "join-ids")
    left = docs.join(_few(gone), key, "left_anti")
    # whole texts are shuffled for the ids that several rows have, and for no other
    again = saved(joined.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                  .where("n > 1").select(key), "join-ids")
    once = left.join(_few(again), key, "left_anti")      # null ids match nothing and stay
    several = left.join(_few(again), key, "left_semi").dropDuplicates([key, text])
    return once.unionByName(several).select(*docs.columns)


def _unsettled(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(big, id, component): the sets of the groups that lie in several components; ``big`` is a group's centre.

    ``stars`` has (a, b): a centre and a member.
    """
    # a member's component is looked up once, not for each of its centres
    member = saved(stars.groupBy("b").agg(F.collect_set("a").alias("centres"))
                   .join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
                   .select(F.explode("centres").alias("a"), "b", F.coalesce("cb", "b").alias("cb")), "join-members")
    apart = (member.groupBy("a").agg(F.min("cb").alias("x"), F.max("cb").alias("y"))
             .join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
             .withColumn("ca", F.coalesce("ca", "a")).where("x <> ca or y <> ca").select("a", "ca"))
    return (member.join(apart, "a").select(F.col("a").alias("big"), F.col("b").alias("id"),
                                           F.col("cb").alias("component"))
            .union(apart.select("a", "a", "ca")))


def merged_groups(rest: DataFrame, name: str) -> DataFrame:
    """``rest`` (big, id, component) with overlapping groups made one where that makes fewer pairs."""
    rest = saved(rest.select("big", "id", "component").distinct(), f"{name}-rest")
    sized = rest.groupBy("big").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size"))
    of = components(rest.join(sized, "big").select("a", F.col("id").alias("b")), f"{name}-merge")
    # a group's smallest id names its cluster; it has no label of its own if it is the cluster's smallest
    named = sized.join(of.withColumnRenamed("id", "a"), "a", "left").select(
        "big", "size", F.coalesce("component", "a").alias("cluster"))
    pairs = named.groupBy("cluster").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"))
    placed = rest.join(named.select("big", "cluster"), "big")
    whole = placed.select("cluster", "id").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("all"))
    made = pairs.join(whole, "cluster").select(
        "cluster", (F.col("all").cast("double") * F.col("all") <= F.col("apart")).alias("one"))
    return saved(placed.join(made, "cluster").select(
        F.when(F.col("one"), F.col("cluster")).otherwise(F.col("big")).alias("big"), "one", "id", "component")
        .distinct(), f"{name}-merged")


def in_blocks(members: DataFrame, group: list, of: DataFrame, columns: list, compare) -> DataFrame:
    """(a, b): links that ``compare(table)`` finds between every two blocks of a group, and inside each.

    ``members`` has the columns of ``group``, id and ``columns``; ``of`` has the number of blocks
    ``of`` of every group.  A block travels as one row, so rows grow with pairs of blocks, not with
    pairs of a member and a block.  ``compare`` gets columns own, low, high and the members' own.
    """
    dealt = (members.join(of, group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
             .groupBy(*group, "of", "own").agg(F.collect_list(F.struct("id", *columns)).alias("held")))
    spread = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
              .select(*group, "own", F.least("own", "other").alias("low"),
                      F.greatest("own", "other").alias("high"), "held"))

    def run(table: pa.Table) -> pa.Table:
        held = table.column("held").combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        number = pc.list_value_length(held).to_numpy(zero_copy_only=False)
        rows = held.flatten()
        cols = {c: np.repeat(table.column(c).to_numpy(), number) for c in ("own", "low", "high")}
        cols |= {c: rows.field(c) for c in ("id", *columns)}
        links = compare(pa.table(cols))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy(*group, "low", "high").applyInArrow(run, "a long, b long")


def sets_of(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` slice by slice, so that only the sets of all texts are held at once."""
    sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in pa.table({"t": column}).combine_chunks().to_batches():
        for part in slices(batch, "t"):
            h, cuts = shingle_sets(part.column("t"), n)
            sets.append(h)
            sizes.append(np.diff(cuts))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def shared_counts(h: np.ndarray, cuts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``x`` with the sets ``y``, from products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    sides, kinds = [], []
    for some in (x, y):
        place = np.full(len(cuts) - 1, -1)
        place[some] = np.arange(len(some))
        held = place[owner] >= 0
        sides.append((h[held], place[owner[held]]))
        kinds.append(np.unique(h[held]))
    common = np.intersect1d(*kinds, assume_unique=True)
    for k, (value, row) in enumerate(sides):
        at = np.searchsorted(common, value)
        known = at < len(common)
        known[known] = common[at[known]] == value[known]
        order = np.argsort(at[known], kind="stable")
        sides[k] = (at[known][order], row[known][order])
    out = np.zeros((len(x), len(y)), np.float32)         # whole numbers below 2**24 are exact
    for c in range(0, len(common), _COLUMNS):
        wide = min(_COLUMNS, len(common) - c)
        parts = []
        for (at, row), some in zip(sides, (x, y)):
            i, j = np.searchsorted(at, (c, c + wide))
            part = np.zeros((len(some), wide), np.float32)
            part[row[i:j], at[i:j] - c] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def joining_links(table: pa.Table, h: np.ndarray, cuts: np.ndarray, threshold) -> list:
    """Links (id, id) between the two blocks of a table that join two of its components; each one merges two."""
    num, den = threshold
    own, low, high, ids, component = (table.column(c).to_numpy() for c in ("own", "low", "high", "id", "component"))
    size = np.diff(cuts)
    x, y = (np.flatnonzero((own == side) & (size > 0)) for side in (low, high))
    root = np.unique(component, return_inverse=True)[1]
    same = shared_counts(h, cuts, x, y)
    linked = den * same >= num * (size[x][:, None] + size[y][None, :] - same)
    links = []
    for r, i in enumerate(x.tolist()):
        near = y[linked[r]]
        while len(near := near[root[near] != root[i]]):
            links.append((int(ids[i]), int(ids[near[0]])))
            root[root == root[near[0]]] = root[i]
    return links


def _block_links(rest: DataFrame, texts: DataFrame, n: int, threshold, block: int) -> DataFrame:
    """(a, b): links that join the components inside the groups that the last level left.

    ``rest`` has big (the group), id and component.  A group's texts are dealt by a hash
    into blocks of about ``block`` texts and ``block`` times 4,096 characters; a task compares two
    blocks.  A link merges its two components, so a task emits fewer links than it has
    components.
    """
    rest = merged_groups(rest, "join")
    few = saved(_pick(texts, rest.select("id").distinct()).dropDuplicates(["id", "t"])
                .withColumn("size", F.length("t")), "join-texts")
    members = rest.join(few, "id")
    number = members.groupBy("big", "one").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / (block * 4_096))).cast("int").alias("of"))

    def compare(table: pa.Table) -> list:
        return joining_links(table, *sets_of(table.column("t"), n), threshold)

    return in_blocks(members, ["big", "one"], number, ["component", "t"], compare)
