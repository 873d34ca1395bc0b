"""Five stages from raw documents to encoded training text; each stage's output is written and reread."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import langid, mixing, pieces, quality, simhash
from textloom.llm.common import ensure_checkpoint_dir, guarded
from textloom.llm.queries import tokenizer_file


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return langid.identify(docs).where("li_kept").select(*docs.columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go; references are those of the documents at hand."""
    own, names = guarded(docs)  # a caller's column may have the result's name
    judged = quality.with_quality(own, quality.references(docs), text=names["text"], lang=names["lang"])
    return judged.where("q_rules.kept").select(*names.values()).toDF(*docs.columns)


def stage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id."""
    return simhash.keep_representatives(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    needed = docs.select("doc_id", "lang", "source", "text")
    coded = pieces.encode(needed, tokenizer_file("piece_bpe_32k.model"), keep_text=False, group_chars=500_000, dictionary_limit=150_000)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language),
    ("quality_rules", stage_quality),
    ("simhash_dedup", stage_dedup),
    ("source_mix", stage_mix),
    ("sentencepiece", stage_encode),
]

#: Fingerprints, divergences and pieces are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread.

    A run that is given the ``run_id`` of an earlier one goes on after its last finished stage. What a stage has
    read is removed once its own output is whole, so one stage's output is left in the end.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{run_id or uuid.uuid4().hex}"
    if run_id:  # the session's checkpoint folder has a part of its own; a run that is to be found again does not
        folder = f"{spark.conf.get('spark.checkpoint.dir', folder.rsplit('/', 1)[0])}/pipeline-{run_id}"
    steps = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k for k, step in enumerate(steps) if _whole(spark, step)), default=-1)
    docs = spark.read.parquet(steps[done] if done >= 0 else f"{sf_dir}/documents.parquet")
    for k in range(done + 1, len(STAGES)):
        STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(steps[k])
        docs = spark.read.parquet(steps[k])
        if k:
            files, place = _place(spark, steps[k - 1])
            files.delete(place, True)
    return docs


def _place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output was written to its end."""
    files, place = _place(spark, f"{path}/_SUCCESS")
    return files.exists(place)
