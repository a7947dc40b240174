"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from riskfold.session import shared_folder, ship_package

#: ASCII white space that separates words: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, computes the plan once and survives the loss of executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join by exchange, never by broadcast.  Spark sizes
    the rows of an explode as one a row, and Parquet by its compressed bytes, so
    a table that grows with the input can look small enough to collect."""
    return df.hint("merge")


def held_out(id_col: str, folds: int, remainder: int) -> Column:
    """crc32(id as text) mod ``folds`` equals ``remainder``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == remainder, F.lit(False))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null or blank text: empty array."""
    core = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(core) > 0, F.split(core, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns that clash with ``names`` (an operator's own
    columns replace input columns of the same name, in any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(columns: Sequence[str]) -> str:
    """A prefix that no column begins with, for an operator's own columns."""
    prefix = "_own_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def slices(batches: Iterator[pa.RecordBatch], rows: int, chars: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``rows`` rows; a batch with
    very long values is cut further so that Python objects stay bounded."""
    for batch in batches:
        step = rows
        if batch.num_rows and batch.nbytes / batch.num_rows * rows > chars:
            step = max(1, int(chars * batch.num_rows / batch.nbytes))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def add_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[StructField],
                make: Callable[[], Callable[..., list]], rows: int = 512) -> DataFrame:
    """``df`` plus ``fields``, computed in Arrow batches.  ``make()`` runs once
    per task and returns a function from the input columns (Python lists) to
    one list per new field.  Input columns that clash are replaced, unless
    they are inputs themselves: then they are read first."""
    ship_package(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = StructType([*kept, *fields])
    out = to_arrow_schema(schema)
    names, places = [f.name for f in kept], list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in slices(batches, rows):
            made = work(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in places])
            arrays = [b.column(b.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(v, type=out.field(len(names) + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


class Recent:
    """Two-generation cache of at most about 2 x ``size`` entries: entries that
    were used since the last turn survive it, memory stays bounded."""

    __slots__ = ("size", "new", "old")

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}

    def get_or(self, key, make):
        v = self.new.get(key)
        if v is None:
            v = self.old.get(key)
            if v is None:
                v = make(key)
            self.new[key] = v
        return v
