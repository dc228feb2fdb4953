"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's and SQL's white space in the contracts: a space and the controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, cut from its lineage, in the shared folder that the cluster names.

    Ids and partition numbers in the rows stay what they are when an executor is lost. Only
    where ``spark.checkpoint.dir`` is unset, as in tests, a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share; a temporary one only where both are this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


def released() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on, beside a full heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_of(column: str | Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with a row number that is stable, as the rows are written first; wide columns should be gone by now."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def once(value: Column, body) -> Column:
    """body(value) where value is computed once: a lambda's variable isn't expanded as a column is."""
    return F.transform(F.array(value), body)[0]


#: Elements after which what was gathered is appended to the rest: appending one by one would copy all of it each time.
RUN = 512


def gathered(items: Column, kind: str, step) -> Column:
    """Elements made of an array's items one after another, with a running number: struct<at: int, found: array<kind>>.

    step(at, item) gives the next number, the item's element, and whether it has one (None: it has).
    """
    none = F.array().cast(f"array<{kind}>")

    def one(done: Column, x: Column) -> Column:
        at, element, there = step(done["at"], x)
        grown = F.concat(done["found"], F.array(element))
        return F.struct(at.alias("at"), (grown if there is None else F.when(there, grown).otherwise(done["found"])).alias("found"))

    def run(done: Column, part: Column) -> Column:
        return once(F.aggregate(part, F.struct(done["at"].alias("at"), none.alias("found")), one), lambda r: F.struct(r["at"].alias("at"), F.concat(done["found"], r["found"]).alias("found")))

    def all_(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, F.lit(RUN)))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("found")), run)

    return once(items, all_)
