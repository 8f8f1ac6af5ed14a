"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 4 << 20
WORD_SPACE = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """The same rows read back from the cluster's shared checkpoint folder, without their lineage.

    The folder is the one `spark.checkpoint.dir` names; a temporary one is taken only where none is
    set and the executors are threads of this process, as in a local test.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabuloom-checkpoint-"))
    return context.getCheckpointDir()


def parts(spark: SparkSession) -> int:
    """Tasks of a shuffle as the session sizes them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def values(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as UTF-8; a null is an empty text."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def word_blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in blocks, so that a very long text is never held as one list of words."""
    start, end = 0, len(text)
    while end - start > size:
        stop = start + size
        while stop < end and text[stop] not in WORD_SPACE:
            stop += 1
        yield text[start:stop].split()
        start = stop
    yield text[start:].split()
