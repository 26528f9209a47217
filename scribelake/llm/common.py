"""Helpers shared by the corpus operators: durable intermediate tables, keyed draws, column checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.sources.shared import durable, shared_folder  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Draws use this many hexadecimal digits of an MD5, which a long and a double both hold exactly.
DRAW_DIGITS = 13


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def spilled(rows: DataFrame, name: str) -> Iterator[DataFrame]:
    """``rows`` as Parquet in the shared folder, read again; the folder goes when the block ends."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    try:
        rows.write.parquet(folder)
        yield spark.read.schema(rows.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def key_text(*parts: Column | str) -> Column:
    """The parts as text, joined by ``|``; a null is the word ``null``."""
    return F.concat_ws("|", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts))


def draw(*parts: Column | str) -> Column:
    """A repeatable uniform draw, strictly between 0 and 1, that depends on nothing but the parts."""
    digits = F.conv(F.substring(F.md5(key_text(*parts)), 1, DRAW_DIGITS), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))


def draw_sql(text: str) -> str:
    """``draw`` in DuckDB, of a SQL expression that has the same text as ``key_text``."""
    return f"((('0x' || substr(md5({text}), 1, {DRAW_DIGITS}))::BIGINT + 0.5) / {float(16**DRAW_DIGITS)!r}::DOUBLE)"


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that are not in ``taken``, whatever extra columns the input has."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in used:
            new += "_"
        used.add(new.lower())
        out.append(new)
    return out


def add_columns(df: DataFrame, fields: T.StructType, make: Callable[[dict[str, pa.Array]], list[pa.Array]], inputs: list[str], rows: int = 256) -> DataFrame:
    """``df`` and the columns that ``make`` computes from ``inputs``, by Arrow batches of at most ``rows`` rows.

    A column of ``df`` with the name of a new one is replaced; the others pass through.
    """
    kept = [c for c in df.columns if c.lower() not in {f.name.lower() for f in fields}]
    names, at = kept + [f.name for f in fields], {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                new = make({c: part.column(at[c]) for c in inputs})
                yield pa.RecordBatch.from_arrays([part.column(at[c]) for c in kept] + new, names=names)

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in kept] + list(fields)))


def utf8(texts: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is empty."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, heavy: int = 1000) -> DataFrame:
    """Inner join with a table that has one row for each key, and in ``count`` the rows that the key has.

    Keys with over a ``heavy``-th of all rows are at most ``heavy``, so they are broadcast; the rest shuffle. Of so few rows
    all keys are.
    """
    if total <= heavy:
        return rows.join(F.broadcast(table.where(F.col(count) > 0).drop(count)), key)
    hot = table.where(F.col(count) * heavy > total).drop(count)
    cold = table.where(F.col(count) * heavy <= total).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
