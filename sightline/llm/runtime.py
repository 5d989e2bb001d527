"""What the operators share: tables, lineage cuts in the shared folder, and batches for Arrow functions."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[str, SparkSession] = {}
_open: list[list[str]] = []


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    """What is left goes when the driver ends; a driver that dies leaves it to the folder's own cleaning."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended before
            return


atexit.register(_remove)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Writes df to the shared folder, in folders by some columns, and reads it back: later stages don't recompute it, nor does a lost executor lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _written[path] = spark
    if _open:
        _open[-1].append(path)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sightline_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what cut() has written for df; no plan may read it any more."""
    _delete(getattr(df, "_sightline_path", ""))


class Cuts:
    def __init__(self, paths: list[str]):
        self.paths, self.kept = paths, []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, which cut() returned, outlives the block."""
        self.kept.append(df._sightline_path)
        return df


@contextmanager
def cuts() -> Iterator[Cuts]:
    """A block at whose end all that cut() has written in it is deleted, but for what is kept. Plans made in it may read only that afterwards."""
    found = Cuts([])
    _open.append(found.paths)
    try:
        yield found
    except BaseException:
        found.kept = []
        raise
    finally:
        _open.pop()
        for path in found.paths:
            if path not in found.kept:
                _delete(path)
        if _open:
            _open[-1].extend(found.kept)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def bites(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about so many bytes together, or one longer text; rows keep their order.

    Arrow batches rather than pandas frames: integers with nulls keep their type there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and total + n > size:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def from_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ddl(df: DataFrame) -> str:
    return df._jdf.schema().toDDL()
