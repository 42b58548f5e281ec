"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return documents' columns.

Defined results: of ``docs`` the columns of documents are used and returned, whatever else it has, names that the stages use
themselves included. A null or empty text scores as one without words and fails the quality stage's base rule; a row without
id is judged by its text and is never a later copy; repeated rows share their fate, and the join keeps them as one document;
a table without rows gives none. Without labelled rows of both classes, no text is toxic and no rule is learned. The language
of a row without one has the bound ``BOUND``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, packing, quality, repeats, toxicity
from .queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = repeats.PASSAGE


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the bound of their language (``BOUND`` where none is calibrated)."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(toxicity.labelled_sample(docs, _labels(spark, sf_dir)))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < toxicity.bound_of(model, F.col("lang"))).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the learned decision list keeps."""
    docs = docs.select(*COLUMNS)
    rules = quality.learn_rules(quality.labelled_stats(docs, _labels(spark, sf_dir)))
    judged = quality.judge(docs, rules, into="__quality").withColumn("__row", F.monotonically_increasing_id())
    return judged.where("__quality.kept and __row >= 0").select(*COLUMNS)  # a filter on a row's number stays above the statistics, which are then taken once


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component; repeated rows of it and rows without id stay."""
    docs = docs.select(*COLUMNS)
    parts = jaccard.link_components(docs)
    later = parts.where("doc_id <> component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(later, "doc_id", "left_anti")
    return named.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte of a 400-byte string that also starts elsewhere, and every run of over 50 words that does, however
    short its words; all documents stay."""
    cut = repeats.remove_repeats(docs.select(*COLUMNS), into="__repeats", words=PASSAGE)
    text = F.when(F.col("__repeats.n_removed") > 0, F.col("__repeats.kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]
