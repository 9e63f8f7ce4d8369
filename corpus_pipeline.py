"""A corpus pipeline: toxicity, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each to the
shared folder and hands the next stage what was written.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegate.llm import entropy_secrets, fair_mix, hilbert_pack, nnpu_toxicity, shingle_dedup
from tidegate.llm.common import materialize, quoted, table, unused, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; it learns from the labelled rows of ``docs``.

    Null and empty texts score by the bias; repeated rows go or stay together; null doc_ids
    are scored like others; without a confirmed toxic row all stay; an empty table gives none.
    """
    model = nnpu_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxicity")
    scored = nnpu_toxicity.with_scores(docs, model, score)
    return scored.where(scored[score] < 0.5).select(*[scored[quoted(c)] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, link by link: the smallest doc_id's.

    Null and empty texts and those of gaps alone are one group; of repeated rows one stays;
    null doc_ids come after all others; an empty table gives none.
    """
    return shingle_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; null and empty texts and rows without secrets stay as they are."""
    return entropy_secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it (up to three times, or not at all).

    Null sources are a source; texts of no words (null, empty) are left out; repeated rows
    count each; an empty table gives none.
    """
    return fair_mix.fair_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences: positions and ids; null and empty texts are the end id alone, repeated rows are packed each."""
    return hilbert_pack.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer decide what comes out: no SQL says it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
