"""MinHash near duplicates, tokenizer alignment and phrase collocations against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prevalens.llm import alignment, minhash, phrases
from prevalens.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- MinHash ----------------------------------------------------------------------------
def shingles(text, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def classes(rows, least=80):
    """id -> smallest id reachable; rows with one id are one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
             if x and y and 100 * len(x & y) >= least * len(x | y)]
    while True:
        moved = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
        if not moved:
            return low


def same_as_brute(spark, table, **options):
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = minhash.near_duplicates(df, **options).collect()
    low = classes(table)
    assert len(got) == len(table)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingles(t))) for i, t in table)
    for r in got:
        assert r.component_id == low.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def near_copies(seed, groups=6, size=9, words=60):
    rng = random.Random(seed)
    rows, number = [], itertools.count(1)
    passage = [f"common{i}" for i in range(45)]
    for _ in range(groups):
        base = passage + [f"w{rng.randrange(10_000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, 14)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
            rows.append((next(number), " ".join(text)))
    return rows


def test_minhash_equals_brute_force(spark):
    same_as_brute(spark, near_copies(1))


def test_minhash_large_groups_are_divided_and_compared_in_blocks(spark):
    # one minimum a band and groups of at most two: every level has to work
    same_as_brute(spark, near_copies(2, 5, 8), rows=1, bands=12, max_group=2, block=4, least=0.3)


def test_minhash_blocks_travel_as_rows(spark, monkeypatch):
    """Large groups are compared once, and rows follow the pairs of blocks, not members times blocks."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(240):
        text = list(base)
        for k in rng.sample(range(80), 4 + i % 9):
            text[k] = f"x{i}e{k}"
        rows.append((i, " ".join(text)))
    made, old = [], minhash.in_blocks

    def seen(members, group, of, columns, compare):
        made.append((members.count(), members.select("id").distinct().count(), of.count()))
        return old(members, group, of, columns, compare)

    monkeypatch.setattr(minhash, "in_blocks", seen)
    same_as_brute(spark, rows, block=32)
    assert made and all(n <= distinct + 16 for n, distinct, _ in made)


def test_minhash_edges(spark, edge, nothing):
    same_as_brute(spark, [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()])
    # one id with different texts links their classes
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    same_as_brute(spark, [(9, a), (9, b), (5, a), (4, b), (4, b), (None, a), (7, None), (8, " ")])
    out = minhash.near_duplicates(nothing)
    assert out.count() == 0 and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_minima_estimate_similarity():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = np.concatenate([x[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    m = minhash.minima(np.concatenate([x, y]), np.array([0, 3000, 6000]), 2000)
    assert abs((m[0:, 0] == m[0:, 1]).mean() - 2400 / 3600) < 0.04


def test_minhash_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    low = classes(rows)
    got = QUERIES["op11_minhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == low and len(got) == len(rows)


# ---- alignment --------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokens():
    return alignment.Tokens()


ODD = ["", None, " lead", "trail ", "a  b", "x \n y", "\n\n a", "été déjà vu", "日本語 テスト", "<|endoftext|> hi <s> x",
       "tab\there", "nbsp x y", "ﬁ ligature", "a　b c", "é x", "\x00 z", "  ", "▁x y", "emoji 😀 ok",
       "it's don't  we'll", "a b " * 50, "x" * 5000, "  a b", "a   b", "naïve café . 12 345"]


def aligned(tokens, text):
    """(A ids, B ids, linked id pairs, groups) from plain encodings of the whole text, or None."""
    if not text:
        return None
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    xs, ys = [tokens.a_bytes[i] for i in a], [tokens.b_bytes[i] for i in b]
    whole = (" " + text).encode()
    if b"".join(xs) != whole or b"".join(ys) != whole:
        return None
    ends_a, ends_b = (list(itertools.accumulate(map(len, z))) for z in (xs, ys))
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
             if max(ends_a[i] - len(xs[i]), ends_b[j] - len(ys[j])) < min(ends_a[i], ends_b[j])]
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        i, j = x, y
    return a, b, links, ";".join(out)


def expected(tokens, rows):
    found = {t: aligned(tokens, t) for _, t in rows}
    count = Counter(p for _, t in rows if found[t] for p in found[t][2])
    best = {}
    for (_, b), c in count.items():
        best[b] = max(best.get(b, 0), c)
    out = []
    for i, t in rows:
        r = found[t]
        if r is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, len(r[0]), len(r[1]), r[3].count("|"), len(r[2]), sum(count[p] == best[p[1]] for p in r[2]),
                        sum(count[p] for p in r[2]), hashlib.sha256(r[3].encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, tokens, edge, limit):
    short = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1200").limit(60)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "twice the same"), (3, "twice the same")]
    rows += [(r.doc_id, r.text) for r in edge.where("length(coalesce(text, '')) < 1000").collect()]
    rows += [(1000 + r.doc_id, r.text) for r in short.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("extra"))
    got = alignment.alignments(docs, keep=["doc_id"], broadcast_pairs=limit)
    assert got.columns[0] == "doc_id" and Counter(tuple(r) for r in got.collect()) == expected(tokens, rows)


def test_alignment_of_long_text_and_nothing(spark, tokens, nothing):
    text = " ".join(f"word{i % 977} été" for i in range(20_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = alignment.alignments(docs, keep=["doc_id"]).first()
    assert r.n_a == len(tokens.a.encode(" " + text, add_special_tokens=False).ids)
    assert r.n_b == len(tokens.b.encode(text)) and r.n_links == r.n_a + r.n_b - r.n_groups
    assert alignment.alignments(nothing).count() == 0


def test_merge_path_is_the_same_for_any_piece_size():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, m = rng.integers(1, 40, 2)
        last = 200
        a = np.unique(np.append(rng.integers(1, last, n), last))
        b = np.unique(np.append(rng.integers(1, last, m), last))
        starts = lambda e: np.concatenate([[0], e[:-1]])
        want = [(i, j) for i in range(len(a)) for j in range(len(b))
                if max(starts(a)[i], starts(b)[j]) < min(a[i], b[j])]
        cuts = [(int(np.searchsorted(a, e)) + 1, int(np.searchsorted(b, e)) + 1) for e in sorted(set(a) & set(b))]
        for work in (1, 2, 3, 7, 256):
            i, j, x, y = alignment.merge_path(a, b, work)
            assert list(zip(i, j)) == want and list(zip(x, y)) == cuts


def test_diagonals_cut_the_path_in_equal_pieces():
    a, b = np.array([2, 4, 4 + 5, 20]), np.array([1, 4, 9, 10, 20])
    merged = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
    d = np.arange(len(merged) + 1)
    assert alignment.diagonal_starts(a, b, d).tolist() == [sum(s == 0 for _, s in merged[:k]) for k in d]


# ---- phrases ----------------------------------------------------------------------------
def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def collocations(rows, least=10, top=2000):
    f, n = counted(rows)
    out = {}
    cand = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    for (lang, p), a in cand.items():
        if any(len(q) > len(p) and o == lang and 100 * c >= 50 * a
               and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (o, q), c in cand.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows_ in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top]))


def language(seed, docs=120):
    rng = random.Random(seed)
    common = ["The", "of", "and", "to", "in"]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(5, 60)):
            words += rng.choice([["New", "York", "City"], ["machine", "learning"], [rng.choice(common)], [f"w{rng.randrange(30)}"],
                                 ["one", "one", "one"], ["été", "chaud"], ["."], ["\n"], ["\t"], [f"rare{rng.randrange(900)}"]])
        rows.append((" ".join(words), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_phrases_equal_brute_force(spark, shards):
    rows = language(4)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = phrases.collocations(df, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == collocations(rows)


def test_phrases_top_and_hand_over(spark, monkeypatch):
    rows = language(6, 80)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert sorted(tuple(r) for r in phrases.collocations(df, top=3).collect()) == collocations(rows, top=3)


def test_phrases_edges(spark, edge, nothing):
    rows = [(r.text, r.lang) for r in edge.collect()] * 12
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, a long")
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == collocations(rows)
    assert phrases.collocations(nothing).count() == 0


def test_phrases_count_anew_when_two_words_share_a_hash(spark, monkeypatch):
    rows = language(8, 60)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    plain, calls = phrases.count_step, []

    def clashing(shard, step, reach, seed, shards):
        calls.append(seed)
        out = plain(shard, step, reach, seed, shards)
        return out if seed else out.withColumn("word", F.when(F.col("h2") == 0, F.expr("uuid()")))

    monkeypatch.setattr(phrases, "count_step", clashing)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == collocations(rows)
    assert set(calls) == {0, 1}


def test_phrases_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 4_000_000_009, 5_000_000_029
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(phrases.cut_score("l", "r").alias("s")).first().s == 1_000_000 * a * a // (l * r)


def test_phrases_count_whole_when_their_pairs_share_the_buckets_of_words(spark):
    vocabulary = np.array([f"v{i}" for i in range(3000)])
    raw = np.frombuffer("".join(vocabulary).encode(), np.uint8)
    ends = np.cumsum([len(v) for v in vocabulary])
    w = phrases.mixed(phrases.word_hashes(raw, ends - np.char.str_len(vocabulary), ends)
                      ^ phrases.mixed(np.array([1], np.uint64)))
    mask = np.uint64(phrases.BUCKETS - 1)
    code = phrases._lang_hash(["en"], 0)["en"]
    taken = np.unique(phrases.named(code, w) & mask)
    follows = {i: np.flatnonzero(np.isin(phrases.named(code, np.repeat(w[i:i + 1], len(w)), w) & mask, taken))
               for i in range(400)}
    triples = [(i, j, k) for i in follows for j in follows[i] if j in follows for k in follows[j]][:5]
    assert triples
    # every word is frequent in both shards from the first scan on
    rows = [(" . ".join(vocabulary) + f" . n{d}", "en") for d in range(60)]
    rows += [(f"{d} . " + " ".join(vocabulary[list(t)]), "en") for t in triples for d in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert sorted(tuple(r) for r in phrases.collocations(df).collect()) == collocations(rows)


def test_phrases_tell_long_words_with_one_polynomial_apart():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    raw = np.frombuffer((a + b + a.upper()).encode(), np.uint8)
    starts = np.arange(3) * len(a)
    plain = phrases.word_hashes(raw, starts, starts + len(a), lower=True)
    assert plain[0] == plain[1]
    w = phrases.named_words(raw, starts, starts + len(a), 0)
    assert w[0] != w[1] and w[0] == w[2]


def test_phrases_with_one_number_are_summed_apart(monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.randrange(5)) for _ in range(400)]
    cols = [*(np.array(x, np.uint64) for x in zip(*rows)), np.ones(400, np.int64)]
    for factors in (phrases._FACTORS, [np.uint64(0)] * 3, [np.uint64(1)] * 3):
        monkeypatch.setattr(phrases, "_FACTORS", factors)
        a, b, c = phrases._summed(cols)
        assert {(x, y): n for x, y, n in zip(a.tolist(), b.tolist(), c.tolist())} == Counter(rows)
        assert len(a) == len(set(rows))


def test_phrases_travel_in_blocks(spark):
    """A task hands over a row per language and part, not one per phrase, and their sums are whole."""
    words_ = [f"w{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(words_), "en")] * 12, "t string, lang string").coalesce(1)
    reach = np.zeros(phrases.BUCKETS, np.uint8)
    sent = spark.sparkContext.broadcast((reach, 4))
    found = phrases.count_step(df, 1, sent, 0, 2)
    assert found.where("length = 2").count() == 4 and found.where("length = 3").count() <= 4
    pairs = phrases._frequent(found, 2, 10).collect()
    assert len(pairs) == 299 and {r.c for r in pairs} == {12}
    assert phrases._frequent(found, 2, 13).count() == 0


def test_phrases_that_are_complete_are_not_summed_again(spark, monkeypatch):
    """Cohorts leave the sums of pairs once complete, words are summed as text once; no count is lost."""
    rows = language(4) + [(f"late{i % 7} comer{i % 7} {i}", "en") for i in range(150)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    summed, worded = [], []
    frequent, words_ = phrases._frequent, phrases._words

    def noted(found, length, least):
        if length == 2:
            summed.append(sorted(r.since for r in found.where("length = 2").select("since").distinct().collect()))
        return frequent(found, length, least)

    monkeypatch.setattr(phrases, "_frequent", noted)
    monkeypatch.setattr(phrases, "_words", lambda found: worded.append(1) or words_(found))
    assert sorted(tuple(r) for r in phrases.collocations(df, shards=2).collect()) == collocations(rows)
    # step 3 sums what became active after step 1 alone; step 2 completes what did after step 0
    assert summed == [[0], [0, 1], [1]] and worded == [1]
