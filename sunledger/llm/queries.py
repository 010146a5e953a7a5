"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embedding_forest, fertility, language_profiles, length_histogram, lexical_search, line_crf, line_dedup, lm_scoring, minhash, mixing, packing,
    periodic_runs, tokens, url_filter,
)
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classify(table(spark, sf_dir, "documents"), width=2)


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), good, tokens.default_path())


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokens.default_path(), keep_ids=False, memory=600_000)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), tokens.default_path("piece_bpe_32k.model"))


def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_profiles.identify_documents(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.with_suffix_sums(length_histogram.histogram(table(spark, sf_dir, "documents"), tokens.default_path()))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.with_runs(docs, "found").select("doc_id", "found.*")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of ``op13``'s contract: with h = crc32(doc_id) divisible by 10, the words from a = g % n on repeat the first p of them."""
    number = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(number % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    planted = docs.withColumn("_g", F.expr("crc32(cast(doc_id as string)) div 10")).withColumn("_words", words)
    planted = planted.withColumn("_n", F.expr("nullif(size(_words), 0)")).withColumn("_a", F.expr("cast(_g % _n as int)"))
    planted = planted.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    again = "slice(flatten(array_repeat(slice(_words, _a + 1, _p), cast((_n - _a) div _p + 1 as int))), 1, _n - _a)"
    text = F.expr(f"if(_n is null, text, array_join(concat(slice(_words, 1, _a), {again}), ' '))")
    return planted.select("doc_id", text.alias("text"))


_ALL = (
    op1_minhash_near_dedup, op2_cross_entropy_difference, op3_best_fit_packing, op4_embedding_forest, op5_tokenizer_fertility, op6_language_profiles,
    op7_source_mixing, op8_line_crf, op9_length_histogram, op10_url_filter, op11_line_dedup, op12_lexical_search, op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}
