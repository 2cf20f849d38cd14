"""What the operators of this subpackage share: tables, folds, scratch tables and Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.scratch import new_path

#: What separates words everywhere in this subpackage; the regex of a word is its complement.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark drops the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession):
    """Queries that end in here leave no shuffle files."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared scratch folder and reads it again. Its shuffle files go when it is written."""
    path = new_path(df.sparkSession, name)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Joins ``table`` (a written one, with a row for each ``key`` and in ``weight`` its number of ``rows``) to ``rows`` without a task for a hot key.

    Keys of a thousandth of all rows are at most a thousand: all tasks get those. Only the others' rows are dealt by key.
    """
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    large = F.broadcast(table.where(F.col(weight) * 1000 >= total).drop(weight))
    small = table.where(F.col(weight) * 1000 < total).drop(weight)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(small, key, how), allowMissingColumns=True)


def held_out(key: str = "doc_id"):
    """Column: the row belongs to the fold that no model may learn from. A null key belongs to no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


#: A task that has seen fewer bytes, and holds nothing to let go of, leaves its worker as it is.
_TRIM = 1 << 18


def trimmed(run: Callable, after: Callable[[], None] | None = None) -> Callable:
    """Wraps a function of Arrow batches: after a partition its worker gives freed memory back, as workers live on for other stages."""

    def wrapped(batches):
        seen = 0

        def counted():
            nonlocal seen
            for batch in batches:
                seen += batch.nbytes
                yield batch

        try:
            yield from run(counted())
        finally:
            if after:
                after()
            if after or seen > _TRIM:
                gc.collect()
                pa.default_memory_pool().release_unused()
                if hasattr(_libc := ctypes.CDLL(None), "malloc_trim"):
                    _libc.malloc_trim(0)

    return wrapped


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list], int], dict[str, object]], schema: str, heavy: str | None = None, limit: int = 1 << 20, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with slices of at most about ``limit`` bytes of column ``heavy`` (a single longer row stays whole).

    ``fn`` gets the slice's columns as Python lists and its number of rows; it returns columns for ``schema``.
    ``after`` runs in the worker when a partition is done.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, heavy, limit):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}, part.num_rows)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(trimmed(run, after), schema)


def sliced(batch: pa.RecordBatch, heavy: str | None, limit: int) -> Iterator[pa.RecordBatch]:
    if heavy is None or batch.num_rows == 0:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(heavy))), 0).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
