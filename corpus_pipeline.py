"""From raw documents to token ids: language, near copies, benchmark passages, personal data, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from habitus.llm import bpe, decontaminate, group_join, language_id, pii
from habitus.llm.text import remainder, stored
from habitus.session import prepare

KEY = "row_key"
SHINGLE, PERCENT = 5, 80  # words a shingle, and the least similarity of near copies


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart by id and text; a null id and a null text count as values."""
    key = fresh(docs, KEY)
    value = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("doc"), F.xxhash64("text").alias("mark"))
    return docs.withColumn(key, value), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or without a letter) go."""
    model = language_id.fit(docs.filter(remainder("doc_id", 4) != 2))
    names = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    kept = docs.withColumn(fresh(docs, "input"), F.col("text"))
    found = language_id.predict(kept, model, kept.columns[-1], tuple(docs.columns), names)
    return found.filter(F.col(names[0]) != "und").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similar texts hold together, the one with the least id stays."""
    return group_join.first_of_each(docs, SHINGLE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed, key = with_key(docs)
    found = decontaminate.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    keyed, key = with_key(docs)
    found = pii.find(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.concat("base", "added").alias(fresh(docs, "spans")))
    spans = found.columns[-1]
    some = found.filter(F.size(spans) > 0).dropDuplicates([key])
    joined = keyed.join(some, key, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(pii.redacted(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, the byte offset at which each token ends, and whether decoding gives the text back."""
    encoded = bpe.encode(docs, keep=("doc_id", "lang", "source"), verify="round_trip")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets", "round_trip")


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("personal data", redact),
    ("tokens", tokenize),
]

#: Language models and byte pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again by the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
