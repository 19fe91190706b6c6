"""Helpers shared by the corpus operators: tables in the shared folder, tables of the test layout."""

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: what follows is computed from files that outlive any executor, and row order
    or generated keys of the written rows no longer depend on how often tasks run.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column of an Arrow batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def small(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts may become lists of words without filling the memory.

    When they are through, the worker gives back what it has freed, as the next task may be in another worker.
    """
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)
    del batches
    give_back()


def sized(batches: Iterable[pa.RecordBatch], name: str = "text", size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column ``name`` has at most ``size`` bytes after the first row."""
    for batch in batches:
        if batch.num_rows:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
            group = np.cumsum(lengths.to_numpy(), dtype=np.int64) // size
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]]).tolist()
            for low, high in zip(cuts, cuts[1:], strict=False):
                yield batch.slice(low, high - low)
    del batches
    give_back()


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise for as long as the worker lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8.

    ``bytes.split`` and ``bytes.lower`` know exactly the ASCII white space and letters meant here.
    Lone surrogates, which Parquet strings cannot hold, would be replaced.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def list_array(offsets, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


Batches = Iterator[pa.RecordBatch]
BatchesIn = Iterable[pa.RecordBatch]
