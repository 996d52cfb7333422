"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from envlake.llm import centroids, hard_negatives, ngram_join, secrets
from envlake.llm.common import read_table, save


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    from envlake.llm.fingerprint import edited_fingerprints
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 or more words that occur elsewhere, and their spans."""
    from envlake.llm.suffixes import repeated_passages
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reading of each document in a mixture that reads no source more than twice as often as another."""
    from envlake.llm.mixing import mixed
    return mixed(read_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text by the public byte-level ranks, decoded again."""
    import public_tokenizers

    from envlake.llm.bpe import token_digests
    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, with text likelihoods learnt from all documents."""
    from envlake.llm.langid import identify, learn_text
    return identify(read_table(spark, sf_dir, "pages"), *learn_text(read_table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text by a discriminant learnt from the learning rows' labels."""
    from envlake.llm.quality import learn, score_documents, with_statistics
    stats = save(with_statistics(read_table(spark, sf_dir, "documents")), "op6-statistics")
    return score_documents(stats, learn(stats, read_table(spark, sf_dir, "labels")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op7_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same join, the number of documents that each document links with."""
    return ngram_join.jaccard_links(read_table(spark, sf_dir, "documents"))[1]


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, written to compressed files and read back from them."""
    import public_tokenizers

    from envlake.llm.token_codec import read_files, write_files
    return read_files(write_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, by pattern and by window entropy."""
    return secrets.secret_digests(read_table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules on every whole text, then robust outliers by language and source."""
    from envlake.llm.outliers import judged
    return judged(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by windows below its positives' scores."""
    return hard_negatives.mine_hard_negatives(hard_negatives.embeddings_with_anchors(read_table(spark, sf_dir, "embeddings")))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors after three rounds of exact k-means."""
    return centroids.clustered(read_table(spark, sf_dir, "embeddings"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages, with words learnt from all documents."""
    from envlake.llm.url_filter import judge
    return judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_passages": op2_passages,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op7_ngram_links": op7_ngram_links,
    "op8_token_files": op8_token_files,
    "op9_secrets": op9_secrets,
    "op10_rules": op10_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_centroids": op12_centroids,
    "op13_urls": op13_urls,
}

SQL: dict[str, str] = {
    "op7_ngram_join": ngram_join.ORACLE_SQL,
    "op7_ngram_links": ngram_join.LINKS_SQL,
    "op9_secrets": secrets.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_centroids": centroids.ORACLE_SQL,
}
