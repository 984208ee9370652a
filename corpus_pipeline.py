"""Training-data pipeline: toxicity, near-duplicates, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of the
documents table. Nulls, empty texts and repeated rows are kept as the operators define it.

A stage is a function of its arguments: its result reads tables of its own in the shared
folder, which nothing that is called later removes; ``run`` removes them once a result is
written. Rows are told apart by their file and their place in it, so that decisions keyed by
it hold however a later job splits the files, and no second copy of the texts is written.
While the table of row numbers to join is of a proven size, the texts are not shuffled.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.decontaminate import drop_contaminated
from docweave.llm.mixing import mix
from docweave.llm.queries import new_folder
from docweave.llm.simhash import simhash_components
from docweave.llm.storage import numbered, small_side, staged, staged_folders, unused
from docweave.llm.token_store import token_output
from docweave.llm.toxicity import held_out, reject_toxic, train
from docweave.session import ensure_checkpoint_dir, ship_package
from docweave.sources.versioned import delete_folder

ORACLE_SQL = None  # learned scores, fingerprints and alignments: the stages are tested against brute force instead


def _stage(work):
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return work(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 (operator 9); learned from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return reject_toxic(docs, train(docs, labels))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (operator 6, 3-word shingles, 3 bits): that of the smallest doc_id."""
    row, stays_at, goes_at = unused(docs, "_row", "_stays", "_goes")
    rows = numbered(docs, row, "dedup-input")
    found = staged(simhash_components(rows.select(row, "text"), id_col=row).select(F.col(row).alias("_row"), F.col("component_id").alias("_component")),
                   "dedup-components")
    ranked = rows.select(F.col(row).alias("_r"), "doc_id").join(found, F.col("_r") == F.col("_row"))
    stays = ranked.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))["_row"].alias(stays_at))
    goes = staged(found.join(staged(stays, "dedup-stays").select(stays_at), F.col("_row") == F.col(stays_at), "left_anti")
                  .select(F.col("_row").alias(goes_at)), "dedup-goes")
    return rows.join(small_side(goes), F.col(row) == F.col(goes_at), "left_anti").select(*docs.columns)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, whole or edited (operator 10)."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them (operator 5): weights 1, 2, 3 over the sources, at most 3 copies."""
    row, taken_at, copies, copy = unused(docs, "_row", "_taken", "_copies", "_copy")
    rows = numbered(docs, row, "mix-input")
    taken = staged(mix(rows.select(row, "doc_id", "text", "source"), keep=(row,)).where(F.col("copies") > 0).select(
        F.col(row).alias(taken_at), F.col("copies").alias(copies)), "mix-copies")
    return rows.join(small_side(taken), F.col(row) == F.col(taken_at)).withColumn(
        copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix (operator 2), read back: (doc_id, start, n_tokens, ids_crc32, part, shard)."""
    return token_output(docs, new_folder(spark, "pipeline-shards"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage leaves in the shared folder goes when its result is written, a
    stage's result when the next one's is; the last stage's tables stay, since the rows returned are read from them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        first = len(staged_folders())
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for path in before + staged_folders()[first:-1]:
            delete_folder(spark, path)
        before = staged_folders()[-1:]
        del staged_folders()[first:]
    return STAGES[-1][1](spark, docs, sf_dir)
