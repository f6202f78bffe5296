"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, hard_negatives, near_vectors, quality
from tidemark.plans.registry import Registry

REGISTRY = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@REGISTRY.add("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@REGISTRY.add("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@REGISTRY.add("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@REGISTRY.add("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


@REGISTRY.add("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


@REGISTRY.add("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "coverage", "n_tiles")


@REGISTRY.add("op4_quality", quality.SQL)
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@REGISTRY.add("op6_url_filter")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_filter import Rule, judge_urls

    rules = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@REGISTRY.add("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


@REGISTRY.add("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), vocabulary_path())


@REGISTRY.add("op13_fill_in_middle", fill_in_middle.SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.restore(fill_in_middle.rearrange(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@REGISTRY.add("op12_hard_negatives", hard_negatives.SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), key % 50 == 0, label)


@REGISTRY.add("op11_near_vectors", near_vectors.SQL)
def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))
