"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as Parquet and reads it
back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import join_checked, materialize, numbered, settled, word_count
from helixmill.llm.mixing import mix_sources
from helixmill.llm.nearcopies import near_copies
from helixmill.llm.pieces import encode_texts
from helixmill.llm.pii import sanitize_documents
from helixmill.llm.toxicity import TOXIC_FROM, keep_ordinary, train_from_labels

#: Row numbers up to this many are broadcast, after a count, so that the documents needn't move; more are joined by shuffle.
KEYS = 500_000

#: What a worker remembers of encoded words; less than op10's, since it lives beside what other stages left.
TOKEN_CACHE = 16 << 20

#: SQL can't express a compression dictionary, hashed shingles or a tokenizer.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that op4 calls toxic; all labels are learned from, since no fold is held out here.

    Defined cases: null and empty texts score the share of toxic labels, and stay unless that reaches the threshold;
    without labels of both classes all documents score alike; repeated rows share their fate; columns of any name are
    kept as they are; very long texts are scored whole; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_ordinary(docs, train_from_labels(docs, labels), TOXIC_FROM)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Defined cases: texts without words (null too) are copies of each other; repeated rows are copies, whatever their
    ids; of equals the first row stays; columns of any name are kept as they are; an empty table stays empty.
    """
    whole = numbered(docs, "numbered")
    kept = near_copies(whole.select("row", "own.text")).filter("row = first").select("row")
    return join_checked(whole, kept, "row", "left_semi", rows=KEYS).select("own.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and the terms that disclose it; n_chars follows the text.

    Defined cases: a null text stays null, and so is its n_chars; texts without personal data stay as they are; repeated
    rows are sanitised alike; other columns of any name are kept as they are; an empty table stays empty.
    """
    clean = sanitize_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source has its share of the words.

    Defined cases: documents without words (null texts too) take no part; a null source is a source of its own; repeated
    rows are mixed one by one; columns of any name are kept as they are; an empty table stays empty.
    """
    whole = numbered(docs, "numbered")
    sized = whole.select("row", "own.doc_id", "own.source", word_count(F.col("own.text")).alias("size"))
    mixed = settled(spark, "mixed", lambda: mix_sources(materialize(sized, "sized")))
    copies = mixed.filter("copies > 0").select("row", F.sequence(F.lit(1), F.col("copies").cast("int")).alias("copies"))
    return join_checked(whole, copies, "row", rows=KEYS).select("own", F.explode("copies")).select("own.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text they decode to.

    Defined cases: a null text is empty and has the begin and end ids only; repeated rows are encoded alike; other
    columns are ignored; very long texts are encoded whole; an empty table stays empty.
    """
    return encode_texts(docs, cache_bytes=TOKEN_CACHE)


STAGES = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's result is written, and what it wrote on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
