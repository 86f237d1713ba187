"""The corpus pipeline: quality rules, near and exact deduplication, mixing, tokenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from lakewright.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that their host repeats.

    Null and empty texts are rejected (no words). Null hosts are one host, null ids each their own. Repeated rows are one
    document for the counts and stay as many rows. A very long text is judged whole. Empty table: no rows.
    """
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Of a group the row of the smallest id stays, one of repeated rows. Texts without a word have the fingerprint zero and are
    near copies of each other. A very long text has one fingerprint, as any other. Empty table: no rows.
    """
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier document has go from the text.

    Null and empty texts stay as they are; so does a text shorter than the string's length. Of rows with one id, or with
    none, each is a document of its own, in the order of their texts. A very long text is cut into runs of strings, and no
    task holds more than its shard. Empty table: no rows.
    """
    return suffix_dedup.clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's target asks.

    Null sources are one source; texts without a word are taken as often as whole repetitions ask. Repeated rows and null
    ids each are documents. A part of a document is a prefix of whole words. Empty table: no rows.
    """
    return mixing.repeat_documents(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with the digests of encoding and decoding. Null and empty texts have no ids. Empty table: no rows."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: SQL has no byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
