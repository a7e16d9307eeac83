"""Operators 3, 5 and 6 against brute force."""

import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prevalens.llm import jaccard_join, mixing, packing

SEP = re.compile(r"[\x20\x09-\x0D]+")


def shingles(t):
    w = [x for x in SEP.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """id -> (sizes, smallest reachable id), from all pairs that share a shingle."""
    sets, holders, shared = defaultdict(set), defaultdict(set), Counter()
    for i, t in rows:
        if i is not None:
            sets[i].add(shingles(t))
    for i, group in sets.items():
        for s in group:
            for x in s:
                holders[x].add((i, s))
    for members in holders.values():
        shared.update(frozenset(p) for p in itertools.combinations(members, 2))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for pair, n in shared.items():
        (a, s), (b, t) = pair
        if 100 * n >= 75 * (len(s) + len(t) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def check_join(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_components(rows)
    out = jaccard_join.join(df, **options).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in out) == Counter((i, len(shingles(t))) for i, t in rows)
    for r in out:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)


def test_join_matches_brute_force(docs):
    check_join(docs)


def test_join_hot_groups(spark):
    """A third of the rows are copies or near copies, others share a passage; small groups force all levels."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = rng.choice(words, 60).tolist()
    passage = rng.choice(words, 25).tolist()
    texts = []
    for i in range(160):
        if i % 4 == 0:
            t = list(base)
            for k in rng.integers(0, 60, i % 7):
                t[k] = "edited%d" % i
        elif i % 4 == 1:
            t = rng.choice(words, 20).tolist() + passage + rng.choice(words, int(rng.integers(1, 30))).tolist()
        else:
            t = rng.choice(words, int(rng.integers(1, 40))).tolist()
        texts.append((i, " ".join(t)))
    df = spark.createDataFrame(texts + [(500, texts[0][1]), (501, texts[0][1].upper())], "doc_id long, text string")
    check_join(df)
    check_join(df, max_group=3)
    check_join(df, max_group=3, block=3)


def test_join_ids_with_several_texts(spark):
    rows = [(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "k l m n o p q r"), (3, "a b c d e f g h"),
            (4, "s t u v w x y z"), (0, "a b c d e f g h i j k l m n"), (5, "a b c d e f g h i j k l m n x")]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_signatures_meet():
    """Every pair at or above the threshold shares a signature on every level."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        pool = rng.integers(0, 1 << 63, 4 * n + 8).astype(np.uint64)
        a = pool[:n]
        lost = int(rng.integers(0, n // 4 + 1))
        more = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[lost:], pool[n:n + more]])
        if not len(b) or 100 * (n - lost) < 75 * (n + more):
            continue
        h = np.concatenate([np.sort(a), np.sort(b)])
        cuts = np.array([0, n, n + len(b)])
        for level in jaccard_join.LEVELS:
            s, d = jaccard_join.signatures(h, cuts, level)
            assert np.intersect1d(s[d == 0], s[d == 1]).size, (n, lost, more, level)


def test_sketches_never_reject_a_link(spark, docs):
    keys = jaccard_join.set_keys(docs, "doc_id", "text", 5).where("n_shingles > 0").collect()
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    for a, b in itertools.islice(itertools.combinations(keys, 2), 3000):
        x, y = (np.frombuffer(k["fine"], np.uint8).astype(int) for k in (a, b))
        m = min(len(x), len(y))
        low = np.abs(np.minimum(x.reshape(-1, m).sum(0), 255) - np.minimum(y.reshape(-1, m).sum(0), 255)).sum()
        assert low <= len(sets[a["id"]] ^ sets[b["id"]])


def test_join_edges(edge, nothing):
    check_join(edge)
    assert jaccard_join.join(nothing).count() == 0


def test_keep_one(edge):
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.collect())
    assert ids == [0, 1, 2, 3, 4, 5, 6, 8, 10, 11, 12]


def size(t):
    return len([x for x in SEP.split(t or "") if x])


def brute_targets(rows, weights=(5, 2, 1)):
    held = defaultdict(int)
    for s, t in rows:
        held[s] += size(t)
    names = sorted(held, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(held.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * held[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * held[s]}
        if not over:
            return {s: share.get(s, 3.0 * held[s]) for s in names}, held
        capped |= over


def check_mix(df):
    rows = df.collect()
    want, held = brute_targets([(r["source"], r["text"]) for r in rows])
    out = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r["doc_id"], size(r["text"])) for r in rows)
    taken = defaultdict(int)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == held[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
    return sorted(map(str, out))


def test_mix_matches_brute_force(docs):
    assert check_mix(docs) == check_mix(docs.repartition(7))


def test_mix_caps_and_hot_source(spark):
    rows = [(i, "w " * (i % 9), "a" if i % 3 else "b") for i in range(300)]
    rows += [(1000, "one two", "c"), (1001, None, "c"), (1002, "x", None), (1003, "", "d")]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_edges(edge, nothing):
    check_mix(edge.drop("size"))
    check_mix(edge)
    assert mixing.mix(nothing).count() == 0


def test_mixed_rows_hold_the_taken_words(edge):
    taken = Counter()
    for r in mixing.mix(edge).collect():
        taken[r["doc_id"]] += r["taken"]
    rows = mixing.mixed_rows(edge)
    assert rows.columns == edge.columns
    got = Counter()
    for r in rows.collect():
        got[r["doc_id"]] += size(r["text"])
    assert +got == +taken


def check_pack(df, out):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for r in df.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        cuts = [0] + list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins)


def test_pack_round_trip(docs):
    out = packing.pack_documents(docs).collect()
    total = sum(r["length"] for r in out)
    assert check_pack(docs, out) <= -(-total // 2048) * 1.02 + 1


def test_pack_edges(edge, nothing):
    check_pack(edge, packing.pack_documents(edge).collect())
    assert packing.pack_documents(nothing).count() == 0


def test_genetic_search_improves():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(300, 900, 200)]
    plain = packing.best_fit(sizes, range(200), [], 2048)
    best = packing.evolve(sizes, [], 1, 2048, generations=30)
    assert sorted(i for _, m in best for i in m) == list(range(200))
    assert all(sum(sizes[i] for i in m) + room == 2048 for room, m in best)
    assert len(best) < len(plain)
    rng = np.random.default_rng(2)
    child = packing.crossover(best, plain, sizes, 2048, rng)
    assert sorted(i for _, m in child for i in m) == list(range(200))


def test_word_memory_equals_plain_encoding():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.load_encoder()
    rng = np.random.default_rng(4)
    parts = ["ab", " ", " ", " ", "\n", "x's", "é", " 12", "\t", "<|endoftext|>", "...", "　", "Wort", "  "]
    for n in rng.integers(0, 80, 400):
        text = "".join(rng.choice(parts, int(n)))
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_shingle_sets_are_sorted_and_distinct():
    h, cuts = jaccard_join.shingle_sets(pa.array(["a b c d e a b c d e", None, "x"]))
    assert np.diff(cuts).tolist() == [5, 0, 1]
    assert all((np.diff(h[a:b].astype(object)) > 0).all() for a, b in zip(cuts, cuts[1:]))


def test_join_links_classes_that_share_an_id(spark):
    one, two, far = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, one), (5, one), (4, two), (5, two), (9, far)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(df).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 9}


def test_join_verifies_every_text_of_the_left_id(spark):
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "xy")
    for texts in ([one, two], [two, one]):
        docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, two + " end")], "id long, t string").coalesce(1)
        keys = jaccard_join.set_keys(docs.withColumnRenamed("t", "text"), "id", "text", jaccard_join.NGRAM)
        found = jaccard_join._verified(pairs, keys, docs, jaccard_join.NGRAM, jaccard_join.THRESHOLD)
        assert [tuple(r) for r in found.distinct().collect()] == [(1, 2)]


def test_mixed_rows_take_what_the_mix_says(spark):
    """Copies and first words row by row, with a source that is one repeated row and with equal rows at a cut."""
    from collections import Counter

    import random
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 30))), rng.choice("abc")) for i in range(400)]
    rows += [(9000, "one row many times over", "d")] * 37 + [(9001, "equal rows in a larger source", "a")] * 25
    rows += [(None, "a row without id", None), (9002, None, "a"), (9003, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for weights in ((5, 2, 1), (1, 3), (7, 1, 1, 2)):
        want = Counter()
        for r in mixing.mix(docs, weights=weights).collect():
            want[r.source, r.doc_id] += r.taken
        got = Counter()
        made = mixing.mixed_rows(docs, weights=weights).collect()
        for r in made:
            got[r.source, r.doc_id] += len((r.text or "").split())
        assert +got == +want
        # at most one cut document per source
        full = {(s, i, t) for i, t, s in rows}
        assert max(Counter(r.source for r in made if (r.source, r.doc_id, r.text) not in full).values(), default=0) <= 1


def test_ids_are_those_of_the_named_tokenizer(docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    named = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encode = packing.load_encoder()
    texts = [r.text for r in docs.collect()] + [
        "before <|endoftext|> after", "<|endoftext|>", " x  y \n z", "a  b" * 40, "été 12 345 " * 20, "\x00\t\r", "it's we'll DON'T"]
    for t in texts:
        assert encode(t) == np.array(named.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def _shared_passage(number=400, own=30, passage=60, seed=3):
    """Different texts that share a passage of about two thirds, and near copies of a few of them."""
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(passage)]
    texts = []
    for i in range(number):
        mine = [f"w{k}" for k in rng.integers(0, 1 << 40, own)]
        texts.append(" ".join(common + mine))
        if i % 40 == 0:
            texts.append(" ".join(common + mine[:-1]))
    return texts


def test_join_shared_passage_is_divided_by_rare_shingles(spark, monkeypatch):
    """Texts that share a passage leave the levels after the rare shingles and are never compared in blocks."""
    df = spark.createDataFrame(list(enumerate(_shared_passage())), "doc_id long, text string")
    left, old = [], jaccard_join._block_links
    monkeypatch.setattr(jaccard_join, "_block_links", lambda rest, *a: left.append(rest.count()) or old(rest, *a))
    check_join(df)
    assert sum(left) == 0


def test_rare_elements_meet():
    """Two linked sets share one of their first elements, whatever the counts are."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, counts = int(rng.integers(1, 120)), rng.integers(0, 5, 64)
        pool = rng.integers(0, 1 << 63, 4 * n + 8).astype(np.uint64)
        lost, more = (int(rng.integers(0, n // 4 + 1)) for _ in "ab")
        b = np.concatenate([pool[lost:n], pool[n:n + more]])
        if not len(b) or 100 * (n - lost) < 75 * (n + more):
            continue
        h = np.concatenate([np.sort(pool[:n]), np.sort(b)])
        s, d = jaccard_join.rare_elements(h, np.array([0, n, n + len(b)]), counts)
        assert np.intersect1d(s[d == 0], s[d == 1]).size


def test_shared_counts_are_exact(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(jaccard_join, "_COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    x, y = np.arange(0, 30, 2), np.arange(0, 30, 3)
    got = jaccard_join.shared_counts(np.concatenate(sets), cuts, x, y)
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in y] for i in x]


def test_overlapping_groups_are_merged(spark):
    """Groups of nearly the same members are compared once; groups that hardly overlap stay apart."""
    rows = [(g, i, i) for g in range(6) for i in range(20) if i != g]
    rows += [(g, i, i) for g, low in ((100, 50), (101, 69)) for i in range(low, low + 20)]
    rest = spark.createDataFrame(rows, "big long, id long, component long")
    got = jaccard_join.merged_groups(rest, "test").groupBy("big", "one").count().collect()
    assert sorted(r["count"] for r in got) == [20, 20, 20]


def test_signatures_are_handed_over_in_parts(spark, monkeypatch):
    """However few signatures a task may hold, no pair is lost and memory does not follow its rows."""
    df = spark.createDataFrame(list(enumerate(_shared_passage(60))), "doc_id long, text string").coalesce(1)
    blocks = [jaccard_join._signature_blocks(df.selectExpr("doc_id id", "text t"), (4, 1), 1, 5, (75, 100)).count()]
    monkeypatch.setattr(jaccard_join, "_HELD_SIGNATURES", 100)
    monkeypatch.setattr(jaccard_join, "slices", lambda b, c: (b.slice(i, 4) for i in range(0, b.num_rows, 4)))
    blocks.append(jaccard_join._signature_blocks(df.selectExpr("doc_id id", "text t"), (4, 1), 1, 5, (75, 100)).count())
    assert blocks[0] == 1 and blocks[1] > 4


def test_word_hash_tables_are_bounded():
    """A worker keeps one table of powers; longer texts have the same hashes without leaving theirs."""
    from prevalens.llm import textnum
    words_ = [f"word{i}" for i in range(120_000)]
    raw = np.frombuffer(" ".join(words_).encode(), np.uint8)
    starts, ends, _ = textnum.word_spans(raw, np.array([0, len(raw)]))
    whole = textnum.word_hashes(raw, starts, ends)
    tail = textnum.word_hashes(raw[starts[-9]:], starts[-9:] - starts[-9], ends[-9:] - starts[-9])
    assert len(raw) > textnum._KEPT_POWERS and whole[-9:].tolist() == tail.tolist()
    assert sum(x.nbytes for x in textnum._powers(1000)) <= 16 * textnum._KEPT_POWERS
    assert textnum._kept_powers.cache_info().currsize == 1


def test_packed_sketches_keep_lower_bounds():
    """Two bits a cell: folded and cut, the cells never differ by more than the sets."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64)
    sets = [np.sort(pool[a:b]) for a, b in ((0, 40), (5, 60), (0, 900), (100, 1100), (0, 9000))]
    fine = [jaccard_join._sketches(h, np.array([0, len(h)]))[1][0] for h in sets]
    cells = [jaccard_join.unpacked_cells(np.frombuffer(jaccard_join.pack_cells(x), np.uint8)[None])[0].astype(int) for x in fine]
    assert [len(jaccard_join.pack_cells(x)) * 4 for x in fine] == [len(x) for x in fine]
    for x, raw in zip(cells, fine):
        assert x.tolist() == np.minimum(np.frombuffer(raw, np.uint8), 3).tolist()
    for (x, a), (y, b) in itertools.combinations(zip(cells, sets), 2):
        m = min(len(x), len(y))
        low = np.abs(np.minimum(x.reshape(-1, m).sum(0), 3) - np.minimum(y.reshape(-1, m).sum(0), 3)).sum()
        assert low <= len(np.setxor1d(a, b))


def test_signature_blocks_do_not_grow_with_the_buckets(spark):
    df = spark.createDataFrame(list(enumerate(_shared_passage(60))), "id long, t string").coalesce(1)
    held = []
    for buckets in (1, 64):
        blocks = jaccard_join._signature_blocks(df, (1, 0), buckets, 5, (75, 100))
        held.append(sum(len(x) for r in blocks.collect() for x in r if isinstance(x, (bytes, bytearray))))
    assert held[0] == held[1]


def test_classes_of_one_code_are_paired(spark):
    reps = spark.createDataFrame([(1 << 33 | 5, 1), (1 << 40 | 5, 2), (5, 3), (6, 4)], "k1 long, id long")
    assert {(r.a, r.b) for r in jaccard_join._one_code(reps).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_texts_travel_in_small_batches(spark):
    from prevalens.llm.common import saved
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    got = saved(spark.range(100, numPartitions=1).mapInArrow(sizes, "n long"), "test-batches", batch=10)
    assert {r.n for r in got.collect()} == {10} and spark.conf.get(name) == before


def test_a_worker_reads_the_vocabulary_once():
    assert packing.load_encoder() is packing.load_encoder()


def test_written_tables_leave_no_shuffle_files(spark):
    from prevalens.llm.common import saved
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle_")}

    before = shuffled()
    got = [saved(spark.range(1000).repartition(n, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test-freed")
           for n in (3, 4)]
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"
    for _ in range(50):                                  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert [x.count() for x in got] == [7, 7]


def test_keep_one_shuffles_no_texts_of_single_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (2, "a b c d e f"), (3, "p q r"), (None, "p q r"),
            (None, "p q r"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one(df)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, "p q r"), (0, "p q r"), (1, "a b c d e f"), (1, "x y z"), (3, "p q r"), (4, "")]
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    # one branch alone groups by the text: the rows of ids that several rows have
    assert plan.count("LeftSemi") == 1 and plan.count("Aggregate") == 2 and "SortMergeJoin" not in plan


def test_big_groups_with_one_centre_share_their_rows(spark):
    """A passage that many texts share gives a row for each text, not for each signature."""
    df = spark.createDataFrame(list(enumerate(_shared_passage(60))), "id long, t string").coalesce(1)
    blocks = jaccard_join._signature_blocks(df, (1, 0), 1, 5, (75, 100))
    stars = [(r.a, r.b) for r in jaccard_join._candidates(blocks, 3).where("star").collect()]
    assert stars and len(stars) == len(set(stars)) and all(a < b for a, b in stars)


def test_components_by_the_driver_equal_those_of_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ends = np.concatenate([rng.integers(0, 300, (200, 2)), [(i, i + 1) for i in range(400, 480)], [(7, 7)]])
    links = spark.createDataFrame(ends.tolist(), "a long, b long")
    got = [{tuple(r) for r in jaccard_join.components(links).collect()}]
    monkeypatch.setattr(jaccard_join, "DRIVER_LINKS", 0)
    got.append({tuple(r) for r in jaccard_join.components(links).collect()})
    least = {int(x): int(x) for x in ends.ravel()}
    for _ in least:
        for a, b in ends.tolist():
            least[a] = least[b] = min(least[a], least[b])
    assert got[0] == got[1] == {(i, c) for i, c in least.items() if i != c}
    assert [len(x) for x in jaccard_join.smallest_reachable(*np.zeros((2, 0), np.int64))] == [0, 0]


def test_labels_follow_more_links(spark, monkeypatch):
    """New links close only the components that they join; links inside one component change nothing."""
    old, new = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 21), (40, 41), (1, 3)]
    seen, components = [], jaccard_join.components
    labels = components(spark.createDataFrame(old, "a long, b long"))
    monkeypatch.setattr(jaccard_join, "components", lambda links, *a: seen.append(links.count()) or components(links, *a))
    got = jaccard_join._relabelled(labels, spark.createDataFrame(new, "a long, b long"))
    want = components(spark.createDataFrame(old + new, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and seen == [3]
    assert jaccard_join._relabelled(got, spark.createDataFrame([(2, 10)], "a long, b long")) is got and len(seen) == 1


def test_rarity_counts_every_shingle(spark):
    texts = _shared_passage(40) + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    h = jaccard_join.shingle_sets(pa.array(texts))[0]
    for cells in (50, 5_000):
        want = np.bincount(jaccard_join._cells(h, cells), minlength=cells)
        assert (jaccard_join.rarity(df, 5, cells) == want).all()
    assert not jaccard_join.rarity(df.where("false"), 5, 50).any()


def test_join_without_broadcast_ids(spark, monkeypatch):
    """Most classes are signed again, none by a broadcast of ids: no texts are copied, the components are whole."""
    names, old = [], jaccard_join.saved
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard_join, "_FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "DRIVER_LINKS", 0)
    monkeypatch.setattr(jaccard_join, "saved", lambda df, name, *a, **k: names.append(name) or old(df, name, *a, **k))
    df = spark.createDataFrame(list(enumerate(_shared_passage())), "doc_id long, text string")
    check_join(df, max_group=3)
    second = names[names.index("join-todo"):]
    assert "join-texts" not in second[:second.index("join-candidates")]
