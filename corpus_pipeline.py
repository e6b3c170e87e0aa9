"""The corpus pipeline: rules, classifier, near-dedup, mixing and packing, one after the other.

Each stage takes all rows its predecessor kept and returns the columns of documents, the last the
pieces of packed sequences. Rules and classifier drop what they reject, near-dedup keeps the row
with the smallest id of each class, mixing repeats or drops whole documents so that sources meet their
targets, packing cuts the ids of all rows into windows of at most 2048.

Defined results, stage by stage: a null or empty text fails the rules (no words); other nulls, null ids among
them, pass through, each with the bucket, class or source of its own that the stage's operator defines; very
long texts are read whole; repeated rows are judged alike, of which near-dedup keeps one; ties of
rows alike in id and text go by a hash of all columns; an empty table gives an empty result of the same columns;
further columns, with whatever names, are passed on by all stages but the last.

Stages that run Python over texts bound the bytes of the session's Arrow batches, unless it has a bound of its own: 10,000
texts at once take several times their size in the JVM and in Python. No result depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from backleaf.llm import classifier, mixing, near_copies, packing, rules
from backleaf.llm.common import bound_batches, restored, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    out = rules.apply_rules(docs, rules.FILTER_RULES)
    return restored(out.where(out["kept"]), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents of the raw table, whatever the rules have dropped of them.

    A document goes only if it is good with a probability below a quarter: in a filter, clean documents count for more.
    """
    bound_batches(spark)
    labels, raw = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classifier.classify(docs, labels, training=raw, min_score=0.25)
    return restored(out.where(out["kept"]), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By five-word shingles with a Jaccard similarity of 0.8 or more; op7 has the fingerprints."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents; the rows of each partition, and so of each file written, are in the order of their shards."""
    rows = mixing.drawn_rows(mixing.mix(docs, whole=True))
    return restored(rows.sortWithinPartitions("shard", "place"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the fitted classifier nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
