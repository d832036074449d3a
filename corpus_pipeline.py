"""Cleaning pipeline over `documents`: rules, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written and read again.
All but the last return the columns of `documents`; where a stage changes `text`, `n_chars` follows. Rows without a
doc_id are judged as all others in the first two stages; the third takes no passages from them. Of rows that repeat a
doc_id with its text one stays. Null texts have no words, so they fail the base rules. Very long texts are judged,
compared, cut and packed whole. An empty table gives an empty result; further columns, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpspark.llm import ngram_join, packing, quality_rules, secrets, substring_dedup
from warpspark.llm.common import fresh, written


def _resized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text (rows without a text keep theirs), if there is such a column."""
    if "n_chars" not in docs.columns:
        return changed.select(*docs.columns)
    size = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return changed.withColumn("n_chars", size).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond the adaptive cutoffs go. A verdict is of an id, a text, a
    language and a source, by a digest of them, so rows without an id and rows that repeat one have their own."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = fresh(docs, "__row")
    marked = docs.withColumn(row, F.md5(F.concat_ws("\0", F.md5("text"), *map(text_of, ("doc_id", "lang", "source")))))
    kept = quality_rules.judge(marked, (row,)).filter("kept").select(row).distinct()
    return marked.join(kept, row, "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays, and one
    row of those with its text. Rows without an id are named by their text's hash, above all usual ids."""
    unnamed = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    name, text, nth = (fresh(docs, c) for c in ("__id", "__text", "__nth"))
    named = docs.withColumn(name, F.coalesce("doc_id", unnamed))
    groups = ngram_join.similar_groups(named.select(F.col(name).alias("doc_id"), "text"), n=5, percent=80)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    alike = Window.partitionBy(name, text).orderBy(*([F.xxhash64(*others)] if others else [name]))
    rows = named.join(kept, name, "left_semi").withColumn(text, F.md5("text"))
    return rows.withColumn(nth, F.row_number().over(alike)).filter(F.col(nth) == 1).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that also stand earlier are taken out; a document left without words goes."""
    cut = _resized(substring_dedup.cut_repeats(docs), docs)
    return cut.filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return _resized(secrets.find_secrets(docs, redact=True), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scans", secret_redaction),
    ("packing", pack),
]
ORACLE_SQL = None  # similarity links and subtrees are beyond SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
