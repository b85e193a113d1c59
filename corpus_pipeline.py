"""From raw documents to packed training sequences, in five stages.

1. toxicity: rows that the subword classifier scores 0.5 or more go.
2. near_duplicates: of each component of the five-word shingle join at a similarity of 0.8, the row with the smallest id stays.
3. substrings: words covered by a 20-word window that also starts earlier are cut out of the text; n_chars follows.
4. decontamination: rows in which a benchmark window of ten words occurs go.
5. packing: what is left is tokenised and packed into sequences of 1024 tokens.

Each stage reads all that the one before it kept, from the Parquet files in which that was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm import decontam, jaccard, packing, substring, toxicity
from rankloom.llm.shared import table

#: Learnt models and tokenizers have no SQL form.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.clean(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage-{name}")
    return docs
