"""Shared plumbing of the training-data operators: tables, folds, and tables written to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[str] = []

BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: fewer of them in an Arrow batch, unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codexa-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._codexa_path = path
    return out


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote, once nothing reads it any more."""
    path = getattr(df, "_codexa_path", None)
    if path is None:
        raise ValueError("not a table of materialise")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete every table written by :func:`materialise`; call it when no result that reads them is in use."""
    jvm = spark.sparkContext._jvm
    while _written:
        at = jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Ask the driver for a collection, so that what finished phases shuffled and broadcast leaves the executors and the driver."""
    for _ in range(2):  # the first round frees Python's handles, the second what they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): one row per id; of repeated labels the largest; rows without id or label go."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> list:
    """At most ``rows`` labelled training texts for each class, as (text, label) rows on the driver.

    Which rows: those of the smallest hash of their id, so reruns agree. Rows of the held-out fold are never read.
    The bound ``rows`` is the documented parameter of each classifier. The ids are chosen before any text moves.
    """
    keyed = one_label(labels, label).where(fold("doc_id", modulus) != held_out)
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        part = keyed.where(F.col("label") == value).orderBy(order, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # an id may stand for several texts: no more than two for each on average
    return texts.orderBy(order, "doc_id", F.xxhash64("text")).limit(4 * rows).select("text", "label").collect()


def private(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"{name}_"
    return name


def text_batches(batches: Iterator, column: str = "text", limit: int = 250_000) -> Iterator:
    """Cut Arrow batches into runs of at most ``limit`` bytes of text (one row at least), to bound memory."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
            yield batch.slice(a, b - a)


def map_texts(df: DataFrame, keep: list[str], make: Callable, shape: str, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` as they are, plus those of ``shape`` computed from every whole text (and the columns ``also``).

    ``make`` is called once in each task and gives the function from lists of values to a list of columns. The kept
    columns stay in Arrow, so that large ids beside nulls keep their value.
    """
    fields = StructType.fromDDL(shape)
    schema = StructType([df.schema[c] for c in keep] + list(fields))

    def run(batches):
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        each = make()
        for part in text_batches(batches, text):
            made = [pa.array(x, kinds[f.dataType.simpleString()]) for x, f in zip(each(*(part.column(c).to_pylist() for c in (text, *also))), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=schema.names)

    return df.select(*dict.fromkeys([*keep, text, *also])).mapInArrow(run, schema)


def chunks(frames: Iterator, column: str = "text", limit: int = 1_000_000) -> Iterator:
    """Cut batches of pandas rows into runs of at most ``limit`` characters (one row at least), to bound memory."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(frame)], strict=True):
            yield frame.iloc[a:b]


def sum_parts(parts: DataFrame, dtype: str = "int64") -> DataFrame:
    """Add up vectors that came in pieces: (piece int, data binary) -> one row per piece.

    Every task streams its pieces and keeps one running vector for each, so memory doesn't grow with the input.
    """

    def add(frames):
        import pandas as pd

        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for piece, data in zip(frame["piece"], frame["data"], strict=True):
                x = np.frombuffer(data, dtype=dtype)
                if piece in total:
                    total[piece] += x
                else:
                    total[piece] = x.copy()
        yield pd.DataFrame({"piece": list(total), "data": [x.tobytes() for x in total.values()]})

    return parts.repartition("piece").mapInPandas(add, "piece int, data binary")


def gather(parts: DataFrame, length: int, piece: int, dtype: str = "int64") -> np.ndarray:
    """The sum of the vectors in ``parts`` on the driver: ``length`` numbers, whatever the size of the input."""
    out = np.zeros(length, dtype)
    for row in sum_parts(parts, dtype).collect():
        x = np.frombuffer(row["data"], dtype=dtype)
        out[row["piece"] * piece : row["piece"] * piece + len(x)] += x
    return out


def pieces(vector: np.ndarray, piece: int):
    """Cut a vector for :func:`sum_parts`."""
    import pandas as pd

    n = -(-len(vector) // piece)
    return pd.DataFrame({"piece": np.arange(n, dtype=np.int32), "data": [vector[i * piece : (i + 1) * piece].tobytes() for i in range(n)]})
