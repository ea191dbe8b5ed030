"""Corpus to training ids: toxic texts and near copies out, benchmark items out, private data replaced, texts encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.chunk_bpe import encode
from packetloom.llm.common import kept, text_of
from packetloom.llm.queries import tokenizer
from packetloom.llm.simhash import without_near_copies
from packetloom.llm.surrogates import replace_private
from packetloom.llm.templates import contaminated
from packetloom.llm.toxicity import score, train

SURROGATE_KEY = "a key of the deployment"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from labelled documents of ``sf_dir``."""
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = score(docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), model)
    return kept(judged.where("predicted = 0").select("row.*"), "judged", texts=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return without_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other numbers and names."""
    code = F.xxhash64(text_of("text"))
    found = contaminated(docs.select(code.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    codes = kept(found.select(F.col("doc_id").alias("__code")).distinct(), "contaminated")
    return docs.join(codes, code == F.col("__code"), "left_anti")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data in their texts replaced; ``n_chars`` follows the new text."""
    replaced = replace_private(docs, SURROGATE_KEY, entities="__entities")
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.length("text").cast("long"))
    return replaced.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the decoded text."""
    return encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name, texts=True)
    return STAGES[-1][1](spark, docs, sf_dir)
