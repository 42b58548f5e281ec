"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, jaccard, licenses, packing, pieces, quality, repeats, sharding, spotsigs, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files of this installation are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 2048)


def op10_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_next(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents"), 16)


def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(_read(spark, sf_dir, "documents"), toxicity.remainder(10) == 0)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_read(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_report(_read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.remove_repeats(docs, 400, with_text=False, words=repeats.PASSAGE, cut_words=False)  # 400 bytes decide what goes
    return found.select("doc_id", *(f"repeats.{n}" for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_rules(quality.labelled_stats(docs, _read(spark, sf_dir, "labels")))
    q = quality.judge(docs, rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *(f"quality.{n}" for n in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express on whole tables in good time; tests compare the others with brute force."""
    return {"op6_ngram_jaccard_join": jaccard.ORACLE_SQL, "op7_license_scans": licenses.oracle_sql()}
