"""The opN_* queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, fingerprints, html_extract, jaccard_join, language, licenses, minhash, mixing,
               packing, phrases, pii, quality_model, quality_rules)
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~out))
    return language.predict(docs.select("doc_id", out.alias("held_out"), "text"), model,
                            keep=["doc_id", "held_out"])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = language.held_out(F.col("doc_id"), fold=1, folds=3)
    model = quality_model.fit(docs, labels.where(~out))
    return quality_model.predict(docs.select("doc_id", out.alias("held_out"), "text"), model,
                                 keep=["doc_id", "held_out"])


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(field: str):
        return F.array_join(F.transform("licenses", lambda x: x[field].cast("string")), ",")

    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                        listed("license").alias("licenses"), listed("start_word").alias("start_words"),
                        listed("containment").alias("containments"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages, html_extract.fit(pages), keep=["page_id", "url"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs), keep=["doc_id"])
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    counts = [F.size(F.filter(F.col("base"), lambda s: s["kind"] == F.lit(i))).cast("long").alias(f"n_{k}")
              for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.alignments(docs, keep=["doc_id"])


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_license_scan": op4_license_scan,
    "op5_source_mixing": op5_source_mixing,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_syncmer_fingerprints": op8_syncmer_fingerprints,
    "op9_html_extraction": op9_html_extraction,
    "op10_pii": op10_pii,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_phrase_collocations": op13_phrase_collocations,
}
