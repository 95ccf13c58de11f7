"""A training corpus from raw documents: clean of toxic texts, copies, benchmark passages and personal data, and packed.

Each stage works on all that its predecessor kept. All but the last return the columns of documents, whatever others
there are. Rows count, not ids: rows that share an id and rows without one are treated by their own texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaflow.llm.common import crc_mod, read, shared_folder
from plazaflow.llm.decontam import without_contaminated
from plazaflow.llm.neardup import one_of_each_group
from plazaflow.llm.packing import pack_documents
from plazaflow.llm.pii import masked
from plazaflow.llm.queries import _vocabulary
from plazaflow.llm.toxicity import fit, without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    learn = F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))
    return without_toxic(docs, fit(docs, read(spark, sf_dir, "labels"), learn), limit=0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays; rows without words stay all."""
    return one_of_each_group(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return without_contaminated(docs, read(spark, sf_dir, "benchmark"), window=10)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind."""
    return masked(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and the place in it."""
    return pack_documents(docs, *_vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Learnt toxicity has no SQL form; the tests hold the stages against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back for the next.

    The last stage keeps its result in the checkpoint folder, so the files in between are deleted when it is done, or a stage fails.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
