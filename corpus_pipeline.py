"""A corpus pipeline from the operators of ``pulsegrid.llm``: documents in, packed pieces out.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame. All but the last
return the columns of documents, and whatever others docs has, under any names. No stage fails on nulls in any
column, empty or very long texts, ties, repeated rows or an empty table; what each makes of them is said below and
in the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, packing, pii, simhash, toxicity
from pulsegrid.llm.common import shared_folder
from pulsegrid.llm.queries import tokenizer_path, toxicity_machine


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine predicts toxic go; all others stay as they are.

    The machine sees labels through documents that are not held out only; what it decides on is each whole text.
    Null and empty texts have the score of a text without words. Repeated rows are each decided; without labels of
    both kinds all stay.
    """
    machine, rate = toxicity_machine(spark, sf_dir)
    return toxicity.keep_clean(docs, machine, rate)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id, null ids last.

    Null and empty texts are one group. Rows that repeat an id stay where their texts are no near-duplicates; of
    rows that agree in id and text one stays.
    """
    return simhash.deduplicate(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind; no document goes, and n_chars follows the text.

    Null texts stay null with their n_chars, empty ones empty; repeated rows change alike.
    """
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, from never to three times."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; null and empty texts have the closing id alone.

    A document that the mix took twice is packed twice. Cuts its lineage itself, so nothing reads docs afterwards.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Most stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; between stages, rows are written as Parquet and read again.

    A stage's table goes as soon as nothing reads it any more: once the next stage's is written, or the last stage,
    which checkpoints its pieces, has returned.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder, before = stage_folder(spark), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs.write.mode("overwrite").parquet(path := f"{folder}/{at}_{name}")
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    remove(spark, folder)
    return docs


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared ``spark.checkpoint.dir``."""
    return f"{shared_folder(spark)}/corpus_pipeline_{spark.range(1).select(F.expr('uuid()')).first()[0]}"
