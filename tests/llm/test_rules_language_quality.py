"""Operators 1, 2 and 7: brute force for counts, held-out accuracy for models."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from prevalens.llm import language, quality_model, quality_rules
from prevalens.llm.textnum import shingle_hashes, utf8, word_hashes, word_spans

SEP = re.compile(r"[\x20\x09-\x0D]+")


def base_counts(t):
    t = t or ""
    w = [x for x in SEP.split(t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


def check_rules(rows, out):
    want = Counter((r["doc_id"],) + base_counts(r["text"]) for r in rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"],) + tuple(r[n] for n in names) for r in out) == want
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_rules_counts_match_brute_force(docs):
    out = quality_rules.score(docs.select("doc_id", "text")).drop("text").collect()
    check_rules(docs.collect(), out)


def test_rules_repeats(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), size=int(n))) for n in rng.integers(0, 60, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_rules(df.collect(), quality_rules.score(df).drop("text").collect())


def test_rules_verdict(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = quality_rules.score(many).join(labels, "doc_id").where("not base_failed")
    good = out.where("quality = 1")
    assert good.where("not kept").count() <= 0.01 * good.count()
    bad = out.where("quality = 0")
    assert bad.where("kept").count() <= 0.3 * bad.count()


def test_rules_verdict_holds_as_the_vocabulary_grows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    # twenty times the corpus in prose of new words
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", "i"), F.lit(400_000)).cast("string"))
    new = (spark.range(20_000).select((F.col("id") + 10**9).alias("doc_id"))
           .select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("i"))
           .groupBy("doc_id").agg(F.array_join(F.collect_list(word), " ").alias("text")))
    out = quality_rules.score(d.union(new)).drop("text").join(labels, "doc_id").where("not base_failed")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("not kept").count() <= 0.01 * good.count()
    assert bad.count() > 0 and bad.where("kept").count() == 0


def test_rules_edges(edge, nothing):
    out = quality_rules.score(edge).collect()
    check_rules(edge.collect(), out)
    assert quality_rules.score(nothing).count() == 0
    again = quality_rules.score(edge).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_rules_with_given_trust(edge):
    marked = edge.select("doc_id", "text", (F.col("doc_id") == 6).alias("good"))
    assert quality_rules.score(marked, trusted="good").where("llr <> 0").count() > 0


def test_grams_match_brute_force():
    texts = ["", "Ab c", "é1é", "x" * 5, "!!", "a-b  cd"]
    n, grams = language._grams(texts, language.BUCKETS)
    assert n.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    for order, (ids, counts) in zip(language.ORDERS, grams):
        want = [max(0, len(re.sub(r"[^a-zé]+", " ", t.lower() + " ").lstrip() or "") - order + 1) for t in texts]
        assert counts.tolist() == want and len(ids) == sum(want)


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(d.where(~out))
    found = language.predict(d.where(out), model)
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_edges(edge, nothing):
    model = language.fit(edge)
    assert model.labels == ["en", "fr"]
    rows = language.predict(edge, model, keep=["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge.count()
    for i in (1, 2, 3, 10):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0
    assert by_id[11]["lang_pred"] == "fr"
    assert language.predict(nothing, model).count() == 0
    empty = language.fit(nothing)
    assert {r["lang_pred"] for r in language.predict(edge, empty).collect()} == {"und"}


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = language.held_out(F.col("doc_id"), 1, 3)
    model = quality_model.fit(d, labels.where(~out))
    found = quality_model.predict(d, model).join(labels.where(out), "doc_id")
    right = {r["quality"]: r["right"] for r in found.groupBy("quality").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()}
    assert right[1] > 0.97 and right[0] > 0.6


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(4, 0), (5, 0), (6, 1), (7, 1), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality_model.fit(edge, labels)
    rows = quality_model.predict(edge, model, keep=["doc_id"]).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    untrained = quality_model.fit(edge, labels.where("false"))
    scores = {r["score"] for r in quality_model.predict(edge.where("text is null"), untrained).collect()}
    assert scores == {0.5}
    assert quality_model.predict(nothing, model).count() == 0


def test_word_helpers_match_split():
    import pyarrow as pa
    texts = ["a bb  ccc", "", None, "\x0bx\x0c", "é ü", "tail ", "one two three four five six"]
    raw, offsets = utf8(pa.array(texts))
    starts, ends, first = word_spans(raw, offsets)
    got = [[raw[starts[i]:ends[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(first, first[1:])]
    assert got == [[x for x in SEP.split(t or "") if x] for t in texts]
    h, made = shingle_hashes(word_hashes(raw, starts, ends), first)
    assert made.tolist() == [1, 0, 0, 1, 1, 1, 2] and len(h) == made.sum()


def test_buckets_are_taken_outside_of_the_lambdas(docs):
    """Hashes become buckets in compiled code after the explode, and are those of the plain words."""
    from pyspark.sql import functions as F

    from prevalens.llm import quality_rules
    few = docs.limit(1).select(F.lit("a b a").alias("text"))
    grams = quality_rules._grams(few, "text", None, 64, [])
    lambdas = [x for x in grams._jdf.queryExecution().optimizedPlan().toString().split("\n") if "lambdafunction" in x]
    assert lambdas and not any("pmod" in x for x in lambdas)
    one = few.select(*[F.pmod(F.xxhash64(*map(F.lit, w)), F.lit(64)).cast("int") for w in ("a", "b", "a", "ab", "ba")])
    assert sorted(r["b"] for r in grams.collect()) == sorted(one.first())
