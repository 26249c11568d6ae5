"""The corpus pipeline: documents through five stages of the language-model subpackage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.decontam import decontaminate
from panelwright.llm.minhash import near_duplicates
from panelwright.llm.packing import pack
from panelwright.llm.qualitylr import classify_quality, train_quality
from panelwright.llm.shared import written
from panelwright.llm.substring import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL cannot express a learned classifier; the run is tested stage by stage.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts have the score of no word; all rows are judged one by one."""
    weights = train_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify_quality(docs, weights, threshold=0.7).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id.

    Rows without a doc_id are compared with nothing, and all of them stay. Of rows that
    repeat a doc_id each is judged by its own text; of those with equal texts one stays,
    with the least of the other columns.
    """
    found = near_duplicates(docs, percent=80, keyed=True).where("doc_id IS NOT NULL")
    found = written(found.select("doc_id", "text_key", "kept"), "found")
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    kept = found.where("kept").join(repeated, "doc_id", "left_anti").select("doc_id")
    out = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))
    if repeated.isEmpty():
        return out
    texts = found.where("kept").join(repeated, "doc_id", "left_semi").select("doc_id", "text_key").distinct()
    rows = docs.withColumn("text_key", F.xxhash64(F.col("text").cast("string"))).join(texts, ["doc_id", "text_key"], "left_semi")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    rows = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least"))
    return out.unionByName(rows.select("doc_id", "text", *[f"least.{c}" for c in others]))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that an earlier document holds; documents of which nothing is left go.

    Null and empty texts and rows without a doc_id stay as they are, a null as an empty text.
    """
    out = substring_dedup(docs.select(*COLUMNS), window=50, layout=True).where("n_removed < n_words OR n_words = 0")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the spans of 13 words or more that benchmark items hold. Null and empty texts stay, empty."""
    out = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True).where("NOT contaminated")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is the end id alone; rows without a doc_id are packed too."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate documents", near_dedup),
    ("repeated passages", passages),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
