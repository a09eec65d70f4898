"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.  A stage's intermediate tables go when the next stage
begins, as they are read until its result is stored; tables of operators that are called elsewhere are left alone.

Null texts and texts without words fail the quality rules; rows with a null identifier are kept by the stages after
them, each on its own; repeated rows are judged alike, so both stay or both go; an empty table stays empty; extra columns
pass all stages but the last.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import _common as c
from candlewright.llm import minhash, mixing, packing, quality, suffix_dedup
from candlewright.storage import delete

#: Target weights of the mixture by domain, as shares of the tokens that each domain has: clean text stays, toxic goes.
WEIGHTS = {"good": 1.0, "poor": 1.0, "toxic": 0.0}
OWNER = "pipeline"


def stage(f):
    """A stage: drops the tables of the stage before, whose result has been stored, and owns those that it writes."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        c.purge(spark, OWNER)
        with c.owned(OWNER):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy web-1."""
    return quality.passing(quality.ledger(docs), "web-1").select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least identifier) of each group of near duplicates; rows without words stay."""
    found = minhash.near_components(docs)
    gone = found.where("NOT kept").select("id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti")


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that occur earlier; broken characters at cuts go, n_chars follows."""
    columns = docs.columns
    found = suffix_dedup.dedup_substrings(docs, carry=columns)

    def whole(batches):
        for batch in batches:
            row = batch.column("row").field("carried")
            fields = {x: row.field(x) for x in columns}
            texts = [None if old is None else kept.decode(errors="ignore") for old, kept in zip(fields["text"].to_pylist(), batch.column("kept").to_pylist())]
            fields["text"] = pa.array(texts, pa.string())
            if "n_chars" in fields:
                fields["n_chars"] = pa.array([None if t is None else len(t) for t in texts], fields["n_chars"].type)
            yield pa.record_batch([fields[x] for x in columns], columns)

    return found.select("row", "kept").mapInArrow(whole, docs.schema)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that meet WEIGHTS, as the nearest whole number of copies."""
    found = mixing.mix(docs, c.table(spark, sf_dir, "labels"), keep_totals=WEIGHTS, carry=docs.columns)
    copies = F.floor(F.col("rate") + 0.5).cast("int")
    row = found.withColumn("_copies", copies).where("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return row.select(*(F.col(f"row.carried.`{x}`").alias(x) for x in docs.columns))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: Fitted rates cannot be expressed in SQL; tests hold each stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage kept is stored in the shared folder until the next one has been."""
    docs, before = c.table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        path = c.fresh(spark, f"pipeline-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    c.purge(spark, OWNER)
    return docs
