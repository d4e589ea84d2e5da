"""What the operators of this subpackage share: scratch tables, Arrow helpers, tokenising."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch sent to Python: documents run to hundreds of kilobytes, so a batch stays in tens of megabytes.
ARROW_ROWS = 1000
#: Bytes in such a batch, about: a few long texts or sets fill it as well as many short ones.
ARROW_BYTES = 8_000_000
#: Paths of the tables that this program has written and not removed.
_WRITTEN: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, one of our own if all runs on this machine; a cluster has no folder that all its machines see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all machines share")
        base = f"file://{tempfile.gettempdir()}/tessel-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/tessel/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    _WRITTEN.add(path)
    return table


def removed(table: DataFrame) -> None:
    """Deletes a table that written() made and nothing will read again."""
    spark = table.sparkSession
    _WRITTEN.discard(table._scratch)
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of earlier steps, whose results are written: it does when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def cleared(spark: SparkSession) -> None:
    """Deletes the tables that written() has made in this program, no other's. To be called when results have been consumed."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded size."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(f, schema)


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with as many underscores after it as make it none of the columns'."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_slices(batch: pa.RecordBatch, column: int, most: int = 8_000_000) -> Iterable[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of the given binary column each, one row at least."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def remainder(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % of


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\x09-\\x0D, A-Z lowered; of null: none."""
    return text.lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
