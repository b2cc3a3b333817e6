"""What several operators share: intermediate tables, Arrow batches, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 27  # of the bitmap of passes()

#: An output batch is handed to Spark when its values pass this many bytes.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Own one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "own" not in _OWN:
        _OWN["own"] = tempfile.mkdtemp(prefix="seqframe-")
    return "file://" + _OWN["own"]


_OWN: dict[str, str] = {}
_OPEN: list[list[str]] = []  # paths of cut() by open scope


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that cut() writes within are deleted at the end, but for those taken off the list."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        for path in _OPEN.pop():
            drop(spark, path)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, free: bool = False) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there and a lost
    executor costs no recomputation. Returns the table and its path. free: Spark deletes
    the shuffle files of the writing at its end, not when the driver's memory is next collected."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqframe-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def row_map(df: DataFrame, fn: Callable[[], Callable], schema: str, *, size: Callable | None = None) -> DataFrame:
    """mapInArrow for functions of single rows. fn() is called once a task and returns
    a function from a row's values to a tuple of the new row's values (or to a list of
    such tuples with many=True on it). Output goes out in batches of bounded size."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fn()
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for values in zip(*(c.to_pylist() for c in batch.slice(k, 256).columns), strict=True):
                    row = f(*values)
                    out.append(row)
                    held += 64 + (size(row) if size else 0)
                    if held > BATCH_BYTES:
                        yield _batch(out, names, types)
                        out, held = [], 0
        if out:
            yield _batch(out, names, types)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)


def _arrow(schema: str) -> list[pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [known[c.split()[1]] for c in schema.split(", ")]


def text_of(text: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def kind_of(df: DataFrame, column: str) -> str:
    """The SQL name of a column's type."""
    return df.select(column).schema[0].dataType.simpleString()


def slices(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes in a column of strings or binaries; one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def hashed_bit(key) -> F.Column:
    return F.pmod(F.xxhash64(key, F.lit("filter")), F.lit(1 << FILTER_BITS))


def bitmap(keys: DataFrame):
    """A broadcast of 2**FILTER_BITS bits, however many keys there are, with those of all ids in keys."""
    bit = hashed_bit("id")
    bits = keys.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = (1 << 15) >> 3
    for row in bits.toLocalIterator():
        at = (row["bucket"] - 1) * width
        table[at : at + width] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def has(table: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def passes(sent):
    """A condition on the column id that holds for all ids of a bitmap() and for few others."""

    @F.pandas_udf("boolean")
    def passes(bit):
        import pandas as pd  # here, so that workers of other functions do without its memory

        return pd.Series(has(sent.value, bit.to_numpy(dtype=np.int64, na_value=0)))

    return passes(hashed_bit("id"))
