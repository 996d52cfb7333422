"""The corpus pipeline: quality, near copies, secrets, source weights, token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns a
frame that is written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``. Rows without ``doc_id`` pass through like others; an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlake.llm.common import read_table, save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more. It learns from the learning rows'
    labels of the documents it is given."""
    from envlake.llm.quality import keep_good, learn, with_statistics
    model = learn(save(with_statistics(docs), "quality-statistics"), read_table(spark, sf_dir, "labels"))
    return keep_good(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest ``doc_id`` of each component of five-word shingle sets with a
    similarity of 0.8 or more; one without ``doc_id`` only where no linked row has one. Rows are told
    apart by a digest of ``doc_id`` and text, so of repeated rows one stays, and of rows that share an id, or
    have none, each is judged by its own text."""
    from envlake.llm.ngram_join import jaccard_components
    i, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(i, text).alias("_key"), i.alias("_id"), text.alias("_text"))
    found = jaccard_components(keyed.select(F.col("_key").alias("doc_id"), F.col("_text").alias("text")), words=5, part=80)
    best = F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_key"))
    first = save(found.join(keyed.select("_key", "_id").distinct(), F.col("doc_id") == F.col("_key"))
                 .groupBy("component_id").agg(best.alias("x")).select(F.col("x._key").alias("_key")), "near-first")
    return keyed.select("_row", "_key").join(first, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    from envlake.llm.secrets import redact
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents at least once, those of small sources up to twice, by tempered weights."""
    from envlake.llm.mixing import mix_documents
    return mix_documents(docs, repeat=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids)``: byte-level BPE ids of every row that is left."""
    import public_tokenizers

    from envlake.llm.bpe import encode_documents
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can't express the classifier, the permutations and the tokenizer; tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
