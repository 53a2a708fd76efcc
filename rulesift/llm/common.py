"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch are cut into pieces of at most this many bytes of text before Python objects are made.
PIECE_BYTES = 16 << 20
#: Bytes of an Arrow batch, as far as single rows allow: texts are long, and a batch is held by Spark and by Python.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores before it as it takes to be no column of ``df``, in any case of letters."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the session is local is it a folder of our own; on a cluster other machines couldn't
    read that.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(checkpoint_root, "own", None)
        if root is None:
            os.makedirs("/tmp/checkpoints", exist_ok=True)
            root = checkpoint_root.own = "file://" + tempfile.mkdtemp(prefix="rulesift-", dir="/tmp/checkpoints")
    return root.rstrip("/")


#: Paths of the tables that ``materialize`` has written.
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back.

    The written table survives lost executors and cuts the lineage; everything that is read more than once goes through
    it. It has a folder of its own, which goes with the session if ``discard`` doesn't take it before.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has returned and that nothing reads any more."""
    for t in tables:
        if path := _TABLES.pop(t, None):
            files, at = _files(t.sparkSession, path)
            files.delete(at, True)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch holding about ``most`` bytes of ``column`` each, so that long texts stay bounded."""
    if batch.num_rows == 0:
        return
    if batch.nbytes <= most:
        yield batch
        return
    own = batch.column(column)
    width = pc.list_value_length(own) if pa.types.is_list(own.type) else pc.binary_length(own)
    scale = own.type.value_type.bit_width // 8 if pa.types.is_list(own.type) else 1
    lengths = (scale * pc.fill_null(width, 0).to_numpy()).tolist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_BYTES``, if its own bound isn't lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def map_pieces(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``df`` has a binary column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(piece for batch in batches for piece in pieces(batch))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(column: str = "text") -> Column:
    """The text's bytes: Python workers get them without decoding."""
    return F.col(column).cast("binary").alias("text")
