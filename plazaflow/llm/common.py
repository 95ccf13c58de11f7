"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A-Z to a-z; word bytes 0-9, a-z and everything past ASCII stay; every other ASCII byte separates words.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def durable(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage through the reliable checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where none is set and all tasks run in the driver's
    process (tests, local mode) is a temporary one made; a cluster without it is an error, as its machines share no
    folder of ours. A lost executor costs a recomputation of unfinished tasks, never of the finished table.
    """
    shared_folder(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder, set from the session's configuration where it is not yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plazaflow-"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Asks the driver to collect what is out of use, so that shuffle files of finished steps leave the executors' disks now.

    Spark removes them when the driver's memory is next collected, which may be long after a step that is durable is done.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Lowers the session's Arrow batches to ``rows`` rows and ``size`` bytes, so that long texts don't pile up in one."""
    units = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.match(r"(-?\d+)\s*([a-z]?)", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * units.get(unit, 1 << 40) <= most:
            spark.conf.set(key, str(most))


def in_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a value's text, modulo ``n``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_chars: int = 48_000_000) -> DataFrame:
    """At most ``per_class`` learning rows of each label with their whole texts: doc_id, text, label.

    Rows are taken in the order of a hash of doc_id, so the sample is the same on every run. Rows without an id, a
    text or a label, and labels that contradict each other, are left out. Of rows that share an id one counts. The bounds,
    also of ``most_chars`` characters in all (:func:`bounded_sample`), keep the sample small enough for one task or the driver.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .where("lo = hi")
    )
    ids = [
        clean.where(F.col("lo") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", F.lit(value).alias("label"))
        for value in (0, 1)
    ]
    chosen = ids[0].unionByName(ids[1])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # of the rows that share an id one is taken, before anything comes to the driver
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    return bounded_sample(one, most_chars)


def bounded_texts(chosen: DataFrame, most_chars: int, part: int = 20) -> list[tuple]:
    """:func:`bounded_sample`'s rows, sorted."""
    return sorted((r.doc_id, r.text, r.label) for r in bounded_sample(chosen, most_chars, part).collect())


def bounded_sample(chosen: DataFrame, most_chars: int, part: int = 20) -> DataFrame:
    """Rows (doc_id, text, label) that have ``most_chars`` characters together at most, an equal share of them for each label.

    A label's rows are gone through in the order of a hash of their ids. Left out are texts of more than a ``part``-th of the
    label's share, and those that no longer fit into it; the others stay, however long a text among them is. If all texts of
    a label are that long, its shortest ones that fit into the share are taken. ``chosen`` is a bounded table: its ids and lengths come to the
    driver, no texts.
    """
    sizes = durable(chosen.withColumn("_size", F.length("text")).withColumn("_order", F.xxhash64("doc_id")))
    by_label: dict = {}
    for r in sizes.select("doc_id", "label", "_size", "_order").collect():
        by_label.setdefault(r.label, []).append((r["_order"], r.doc_id, r["_size"]))
    share = most_chars // max(1, len(by_label))
    taken = []
    for label, rows in by_label.items():
        short = sorted(r for r in rows if r[2] <= share // part) or sorted(rows, key=lambda r: (r[2], r))
        left = share
        for _, doc_id, size in short:
            if size <= left:
                taken.append((doc_id, label))
                left -= size
    ids = sizes.sparkSession.createDataFrame(taken, sizes.select("doc_id", "label").schema)
    return sizes.join(F.broadcast(ids), ["doc_id", "label"]).select("doc_id", "text", "label")
