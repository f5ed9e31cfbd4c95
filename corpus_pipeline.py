"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes every stage's rows to
the shared folder and reads them back for the next. All stages but the last return the columns of their input, whatever
these are; a null text counts as an empty one, and each operator's docstring says what it does with ties and nulls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sliceweave.llm import bpe, decontaminate, simhash, toxicity
from sliceweave.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below the limit. The model is learnt from the labelled documents of ``sf_dir``."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id.

    Groups hold what the fingerprint rule links, and texts that share four fifths of their five-word shingles.
    """
    return simhash.keep_one(docs, similarity=SIMILARITY, similar_words=NEAR_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words stands in a benchmark window."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and digests of the ids and of the text they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: Words in a shingle of the near-duplicate stage, and the share of common shingles that makes near duplicates.
NEAR_WORDS, SIMILARITY = 5, 0.8
STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]
#: SQL can express neither the network nor XXH64 fingerprints; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
