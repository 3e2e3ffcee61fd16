"""A corpus pipeline of five stages: quality, line repeats, near-duplicates, benchmark passages, tokens.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

The last stage adds the token ids, how many there are, and the SHA-256 of the text decoded from them; ``run`` shows
the last on request only.

Line repeats change texts, so ``n_chars`` is set anew; a document of which no line is left was only repeats and
goes, while one that was blank from the start stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontaminate, lines, quality, simhash
from sparkloom.llm.common import forget, keep, small_batches, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone, n_lines = unused(docs, "gone"), unused(docs, "n_lines")
    left = lines.without_repeats(docs, gone, n_lines)
    lost = F.col(gone).isNotNull() & (F.size(gone) >= F.col(n_lines))
    left = left.where(~lost)
    length = F.when(F.col(gone).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    decoded = unused(docs, "decoded")
    read = bpe.encode(docs, decoded=decoded).withColumn("n_tokens", F.size("ids").cast("long"))
    return read.withColumn("decoded_sha256", F.sha2(decoded, 256)).drop(decoded)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", token_stage),
]

#: SQL can express neither the classifier nor the components; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, decoded: bool = False) -> DataFrame:
    """All stages over the documents of an input folder; ``decoded`` leaves the digest of the decoded text in."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if at:
            forget(before)
    return docs if decoded else docs.drop("decoded_sha256")
