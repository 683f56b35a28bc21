"""The corpus pipeline: documents in, encoded training documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from evenhand.llm import bpe, mixing, pii, quality, simhash
from evenhand.session import scratch_dir

#: SimHash needs XXH64, and the mix pseudorandom permutations: SQL has neither. The stages
#: are held against brute force in tests/llm.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs, shingle=3, most=3)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by tags."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document may be used twice."""
    return mixing.mixed(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids, and whether they decode to its text; columns of
    the documents that have the names of these give way."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = ["n_tokens", "ids", "exact"]
    kept = [c for c in docs.columns if c.lower() not in made]
    return bpe.encoded(docs, path, kept).select("_row.*", *made)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("pii", redact_pii),
    ("mixing sources to target weights", mix_sources),
    ("bpe encoding and decoding", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
